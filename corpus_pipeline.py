"""A training corpus from ``documents``: classify, drop near copies, decontaminate, redact secrets, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspan.llm.common import materialize, read_table
from volspan.llm.decontaminate import remove_contaminated
from volspan.llm.jaccard_join import keep_one
from volspan.llm.packing import pack_documents
from volspan.llm.queries import tokenizer
from volspan.llm.rule_ensemble import quality_scores, train
from volspan.llm.secrets import redact

#: SQL can't express the classifier, the tokens or the redaction; tests hold every stage against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, trained on their labelled ones, takes for good; all columns as they are."""
    model = train(docs, read_table(spark, sf_dir, "labels"))
    scored = quality_scores(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "doc_id", "text"), model)
    return scored.filter("predicted = 1").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row, with the least id."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those in which a twentieth of the words or more stands in benchmark windows."""
    return remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 1024 tokens."""
    return pack_documents(docs, tokenizer())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

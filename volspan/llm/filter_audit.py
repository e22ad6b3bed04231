"""Operator 11: how text filters interact: what each removes, alone and after the others, in every order.

Words are exploded and counted by (document, word), then by document for totals and distinct words; the flags of the other filters are joined to them. A document is its id and its text:
texts are dealt once by id, text and a salt, so that both counts stay where the words are and a row that is repeated any number of times is spread; only a number or two a document is
shuffled after that. Equal texts have equal flags, so a text's rows are summed before its least id is looked for: a text that makes up a third of the table is a few rows by then, and
no join meets it. Each part then gets one row of conditional counts for the 32 combinations of failed filters (documents, good and toxic ones), from which all orders follow.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import partitions_for

# Fixed values of the contract: the filters' failure conditions.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_SHARE, UPPER_SHARE, SIGNS = 200, 50, 3, "#$%&*|"
SPACES = "\t\n\x0b\x0c\r "
#: Rows with the same id and text are spread over so many tasks.
SALTS = 64


def _words(text: Column) -> Column:
    """The words of a text and empty strings, which stand between spaces in a row."""
    for c in SPACES[:-1]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.split(text, " ")


def word_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, h, words, distinct`` of each different id and text (``h`` tells the texts of an id apart): its number of words and of different words."""
    key = ["doc_id", "h", "salt"]
    dealt = docs.select("doc_id", F.xxhash64("text").alias("h"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"), "text").repartition(partitions_for(docs, 4), *key)
    # The null word that ends every text counts its copies.
    words = dealt.select(*key, F.concat(_words(F.col("text")), F.array(F.lit(None).cast("string"))).alias("words"))
    words = words.select(*key, F.explode_outer("words").alias("word")).filter("word is null or word <> ''")
    each = words.groupBy(*key, "word").agg(F.count("*").alias("n"))
    salted = each.groupBy(*key).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("copies"), F.count("word").alias("distinct"))
    whole = salted.groupBy("doc_id", "h").agg(F.sum("all").alias("all"), F.sum("copies").alias("copies"), F.max("distinct").alias("distinct"))
    return whole.select("doc_id", "h", F.expr("all div copies - 1").alias("words"), "distinct")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part by the filters that they fail (bit k for the k-th letter), and how many of them are labelled good or toxic.

    Null texts are empty, null languages the empty part. A row with a null id has no smaller id and is smaller than none, so it never fails E, nor do other rows because of it; it has no
    label. Repeated rows count each; of repeated labels any good or toxic one counts. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    signs = F.lit(False)
    for c in SIGNS:
        signs = signs | F.contains("text", F.lit(c))
    flags = docs.select("doc_id", "part", F.xxhash64("text").alias("h"), F.unhex(F.sha2("text", 256)).alias("same"), (100 * upper > UPPER_SHARE * F.length("text")).alias("C"), signs.alias("D"))
    flags = flags.groupBy("doc_id", "part", "h", "same", "C", "D").agg(F.count("*").alias("n"))
    counts = word_counts(docs).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "words", "distinct")
    flags = flags.join(counts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    marks = labels.groupBy(F.col("doc_id").alias("_label")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("_toxic"))
    flags = flags.join(marks, F.col("doc_id") == F.col("_label"), "left")
    words, good, toxic = F.coalesce("words", F.lit(0)), F.coalesce("_good", F.lit(0)) * F.col("n"), F.coalesce("_toxic", F.lit(0)) * F.col("n")
    failed = [words < LEAST_WORDS, 100 * F.col("distinct") < DISTINCT_SHARE * words, F.col("C"), F.col("D")]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))
    rows = flags.select("doc_id", "part", "same", mask.alias("mask"), "n", good.alias("good"), toxic.alias("toxic"))
    # By text and part: the sums of all rows, of those without an id, and the least id's own.
    sums = F.struct(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", "good", "toxic")))
    texts = rows.groupBy("same", "part").agg(F.max("mask").alias("mask"), sums.alias("all"), first.alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("no_id"))
    least = F.min("first.doc_id").over(W.partitionBy("same"))  # a row a part
    texts = texts.withColumn("is_first", F.coalesce(F.col("first.doc_id") == least, F.lit(False)))
    kept = {c: F.when(F.col("is_first"), F.col(f"first.{c}")).otherwise(0) for c in ("n", "good", "toxic")}
    kept["n"] = kept["n"] + F.coalesce("no_id", F.lit(0))
    both = F.array(F.struct(F.col("mask"), *[kept[c].alias(c) for c in kept]), F.struct((F.col("mask") + 16).alias("mask"), *[(F.col(f"all.{c}") - kept[c]).alias(c) for c in kept]))
    return texts.select("part", F.inline(both)).filter("n > 0").groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def orders() -> list[tuple[str, int, int, int, int, int, int, int]]:
    """(order, step, combination of failures, and whether such a document is kept, removed, removed before, the filter's only failure, with the number of orders that let it remove it)."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        for step, f in enumerate(order):
            before = sum(1 << k for k in order[:step])
            for mask in range(1 << len(FILTERS)):
                fails, gone = mask >> f & 1, int(mask & before > 0)
                out.append((name, step + 1, mask, int(not fails and not gone), int(fails and not gone), int(fails and gone), int(mask == 1 << f), 120 // mask.bit_count() if fails else 0))
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``: 600 rows for each part of ``failures``."""
    found = failures(docs, labels)
    count = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == k, F.col(c))), F.lit(0)) for k in range(32)]).alias(c)
    wide = found.groupBy("part").agg(*[count(c) for c in ("n", "good", "toxic")])
    long = wide.select("part", F.posexplode(F.arrays_zip("n", "good", "toxic")).alias("mask", "v")).select("part", "mask", "v.*").filter("n > 0")
    table = docs.sparkSession.createDataFrame(orders(), "filter_order string, step int, mask int, is_kept int, is_removed int, is_redundant int, is_only int, weight int")  # 19,200 rows, whatever the input
    total = lambda x, name, of="n": F.sum(F.col(x) * F.col(of)).alias(name)
    return long.join(F.broadcast(table), "mask").groupBy("part", "filter_order", "step").agg(
        total("is_kept", "kept"), total("is_removed", "removed"), total("is_redundant", "redundant"), total("is_only", "unique_fails"),
        total("is_removed", "good_lost", "good"), total("is_removed", "toxic_lost", "toxic"), total("weight", "shapley"),
    )

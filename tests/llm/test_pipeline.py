"""Each stage keeps what it should; the whole gives one piece of each kept document's tokens."""

import collections
import re

import corpus_pipeline

from volspan.llm import decontaminate, jaccard_join, secrets
from volspan.llm.common import read_table

SF = "/root/testdata/sf0.001"


def one_of_each(docs):
    """The least id of every class of texts linked by a Jaccard similarity of 0.8 of word 5-grams, by all pairs."""
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(i, least.get(find(k), i))
    return list(least.values())


def test_stages(spark, tmp_path):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF)
        path = f"file://{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "pack":
            assert docs.columns == columns
            kept = {r["doc_id"] for r in docs.collect()}
            assert kept <= {r["doc_id"] for r in before.collect()}
        if name == "near_duplicates":
            assert collections.Counter(r["doc_id"] for r in docs.collect()) == collections.Counter(one_of_each([(r["doc_id"], r["text"]) for r in before.collect()]))
        if name == "secrets":
            old, new = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (before, docs))
            assert {i: secrets.redact_text(t) for i, t in old.items() if t is not None} == {i: t for i, t in new.items() if t is not None}
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"] is not None)
        if name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
            expected = decontaminate.brute_force([(r["doc_id"], r["text"]) for r in before.collect()], items)
            assert kept == {k for k, v in expected.items() if not v[-1]}
        if name == "quality":
            bad = {r["doc_id"] for r in read_table(spark, SF, "labels").filter("quality = 0").collect()}
            good = {r["doc_id"] for r in read_table(spark, SF, "labels").filter("quality = 1").collect()}
            assert len(bad & kept) <= max(1, len(bad) // 10) and len(good - kept) <= max(1, len(good) // 50)
    assert {r["doc_id"] for r in docs.filter("piece = 0").collect()} == kept


def test_stages_take_empty_and_odd_tables(spark):
    docs = read_table(spark, SF, "documents").selectExpr("*", "1 AS score", "'x' AS _gone", "2 AS _bad", "3 AS s_digits", "4 AS _doc")
    for table in (docs.limit(0), docs.limit(12).union(docs.limit(3)).union(docs.limit(1).selectExpr("null", "null", "null", "null", "null", "score", "_gone", "_bad", "s_digits", "_doc"))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            assert name == "pack" or out.columns == table.columns
            out.count()


def test_filters_go_by_row_not_by_id(spark):
    prose = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    a, b, c, d = (prose(x, 60) for x in "abcd")
    rows = [(6, a), (6, a), (6, a), (None, b), (None, b), (None, b + " more"), (9, c), (None, c), (7, c), (8, d), (8, prose("e", 60)), (None, ""), (None, None), (5, " "), (None, prose("f", 60))]
    table = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    once = jaccard_join.keep_one(table)
    assert once.columns == table.columns
    got = collections.Counter((r["doc_id"], {b + " more": b}.get(r["text"], r["text"])) for r in once.collect())
    assert got == collections.Counter([(6, a), (None, b), (7, c), *rows[9:]])
    bench = spark.createDataFrame([(1, b), (2, d)], "item_id long, text string")
    clean = decontaminate.remove_contaminated(table, bench)
    assert clean.columns == table.columns
    assert sorted(r["row"] for r in clean.collect()) == [0, 1, 2, 6, 7, 8, 10, 11, 12, 13, 14]

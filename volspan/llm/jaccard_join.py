"""Operator 3: join of documents whose sets of word 5-grams have a Jaccard similarity of at least 0.8.

1. Documents with equal word sequences are one class (two independent fingerprints, 122 bits); only its representative goes on, under a number of its own.
2. MinHash bands, their number and rows chosen for a target recall at the threshold, are shuffled on their hashes; documents that share a band are candidates. A
   bucket gives one edge per member (to its least member), and connected documents form groups. While a group fits one task its sets are shipped once, not once per band.
3. Pairs are verified on the full n-gram sets. A larger group is dealt either as a whole or by its buckets, whichever takes fewer comparisons: near copies of one text share most bands and
   are best taken whole, while a chain of loosely related texts falls into small buckets. A pair that shares several buckets counts in the first. Either way groups are dealt into blocks of
   about ``block_ngrams`` n-grams and ``block_rows`` sets at most, and one task takes each pair of blocks, so memory is bounded and no link is lost. Tasks return counts of links per
   document and a spanning forest of the links, never the pairs.

Words are runs of characters other than the space and \\x09-\\x0D, ASCII letters lower-cased; a text of one to four words has one n-gram, all its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, partitions_for, steps
from .components import components
from .textscan import PrefixHash, mix, spread
from .words import NOT_SPACE, word_prints

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.999


def choose_bands(threshold: float, recall: float, hashes: int = 96) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``hashes`` values that finds a pair at the threshold with at least this probability."""
    fits = [(math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows) for rows in range(1, 33)]
    return max((x for x in fits if x[0] * x[1] <= hashes), key=lambda x: x[1], default=fits[0])


def _ngrams(prints: np.ndarray, upto: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram fingerprints, n-grams of each text), in order, with repeats."""
    words = np.diff(upto)
    width = np.minimum(words, n)
    count = np.where(words > 0, words - width + 1, 0)
    text, place = spread(count)
    start = upto[:-1][text] + place
    return PrefixHash(prints).of(start, start + width[text]), count


def _signatures(bands: int, rows: int, n: int):
    rng = np.random.default_rng(7)
    multiply = (rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    flip = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    weight = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in steps(batches, "text"):
            prints, upto = word_prints(data, off, NOT_SPACE)
            grams, count = _ngrams(prints, upto, n)
            some = np.flatnonzero(count)
            first = (np.cumsum(count) - count)[some]
            short = (grams >> np.uint64(32)).astype(np.uint32)
            least = np.empty((bands * rows, len(some)), np.uint32)
            for k in range(bands * rows if len(some) else 0):
                least[k] = np.minimum.reduceat((short ^ flip[k]) * multiply[k], first)
            sums = (least.reshape(bands, rows, -1).astype(np.uint64) * weight[None, :, None]).sum(axis=1, dtype=np.uint64)
            sums = mix(sums + (np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None])
            words = np.diff(upto)
            a = PrefixHash(prints).of(upto[:-1], upto[1:])
            b = PrefixHash(word_prints(data, off, NOT_SPACE, 1)[0], 1).of(upto[:-1], upto[1:])
            size = np.zeros(len(count), np.int32)
            size[some] = bands
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.ascontiguousarray(sums.T).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["key"], pa.array(words.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), listed], ["doc_id", "key", "words", "pa", "pb", "bands"])

    return run


_DEALT = ["group", "band", "i", "j", "side", "node", "copies", "bands"]


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in steps(batches, "text"):
            prints, upto = word_prints(data, off, NOT_SPACE)
            second = word_prints(data, off, NOT_SPACE, 1)[0]
            grams, count = _ngrams(prints, upto, n)
            # A key may stand for another text too; the representative is the one with its class's fingerprints.
            mine = np.flatnonzero((PrefixHash(prints).of(upto[:-1], upto[1:]).view(np.int64) == part["pa"].to_numpy()) & (PrefixHash(second, 1).of(upto[:-1], upto[1:]).view(np.int64) == part["pb"].to_numpy()))
            ends = np.cumsum(count)
            sets = [np.unique(grams[e - c : e]).tobytes() for c, e in zip(count[mine].tolist(), ends[mine].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part[c].take(pa.array(mine)) for c in _DEALT), pa.array(sets, pa.binary())], [*_DEALT, "grams"])

    return run


def _links(size: np.ndarray, grams: np.ndarray, side: np.ndarray, across: bool, threshold: float) -> np.ndarray:
    """Matrix of the pairs of sets with at least the threshold, both ways; ``across``: only pairs of side 0 with side 1, of which either may be empty."""
    owner = np.repeat(np.arange(len(size)), size)
    _, gram, found = np.unique(grams, return_inverse=True, return_counts=True)
    shared = found[gram] > 1
    owner, gram = owner[shared], gram[shared]
    _, gram = np.unique(gram, return_inverse=True)
    n, wide = len(size), int(gram.max()) + 1 if len(gram) else 0
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if across else (np.arange(n), np.arange(n))
    both = np.zeros((len(left), len(right)), np.float32)
    step = max(1, (8 << 20) // max(1, n))
    for lo in range(0, wide, step):
        a, b = np.searchsorted(gram, [lo, lo + step])
        block = np.zeros((n, min(step, wide - lo)), np.float32)
        block[owner[a:b], gram[a:b] - lo] = 1
        both += block[left] @ block[right].T
    union = size[left][:, None] + size[right][None, :] - both
    hit = both >= threshold * union - 1e-4  # whole numbers below 2**24: the margin only guards the product's rounding
    if across:
        linked = np.zeros((n, n), bool)
        linked[np.ix_(left, right)] = hit
        return linked | linked.T
    np.fill_diagonal(hit, False)
    return hit


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row the first row that it is connected with."""
    root, seen = np.arange(len(linked)), ~linked.any(axis=1)
    for k in np.flatnonzero(~seen).tolist():
        front = np.array([k]) if not seen[k] else np.zeros(0, np.int64)
        while len(front):
            root[front], seen[front] = k, True
            front = np.flatnonzero(linked[front].any(axis=0) & ~seen)
    return root


def _shared_before(bands: np.ndarray, band: int) -> np.ndarray:
    """Pairs of rows that share one of the bands before ``band``."""
    out = np.zeros((len(bands), len(bands)), bool)
    for k in range(band):
        out |= bands[:, k][:, None] == bands[:, k][None, :]
    return out


def _verify(threshold: float):
    names = ["node", "root", "links"]

    def solve(rows: pa.Table) -> pa.RecordBatch:
        nodes = rows["node"].to_numpy()
        keep = np.concatenate([[True], nodes[1:] != nodes[:-1]])  # a repeated row brings its text again
        rows, nodes = rows.filter(pa.array(keep)), nodes[keep]
        across, band = rows["i"][0].as_py() != rows["j"][0].as_py(), rows["band"][0].as_py()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows["grams"].combine_chunks()]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        copies, side = (rows[c].to_numpy() for c in ("copies", "side"))
        linked = _links(size, np.concatenate(sets), side, across, threshold)
        if band > 0:
            linked &= ~_shared_before(np.stack(rows["bands"].to_pylist()), band)
        keep = np.flatnonzero(linked.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[_roots(linked)[keep]]), pa.array((linked @ copies)[keep])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            key = np.stack([held[c].to_numpy() for c in ("group", "band", "i", "j")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cut.tolist()][:-1], cut.tolist(), strict=True):
                if hi - lo > 1:
                    yield solve(held.slice(lo, hi - lo))
            held = held.slice(int(cut[-1])) if len(cut) else held
        if held is not None and held.num_rows > 1:
            yield solve(held)

    return run


def _in_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of each (``group``, ``band``) dealt to its pairs of ``blocks``."""
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = rows.join(blocks, ["group", "band"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other"), "side": (F.col("mine") > F.col("other")).cast("int")}).drop("mine", "other", "blocks")


def jaccard_classes(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block_ngrams: int = 400_000, block_rows: int = 512) -> DataFrame:
    """One row per document: ``doc_id, class_id, set_id, n_links``.

    ``class_id`` is the least id among the documents connected by links, ``set_id`` the least id of those with the same words, ``n_links`` the number of other documents
    with a similarity of at least ``threshold`` (copies included). Every row is a document of its own, whatever its id: null and repeated ids are allowed, with equal texts or different
    ones; a null id is never the least of several, so a class of null ids alone has none. Texts without words (null, empty, blank) have no n-grams, hence no links, and are classes of
    their own.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    bands, rows = choose_bands(threshold, recall)
    n = partitions_for(docs, 2)
    marks = materialize(docs.mapInArrow(_signatures(bands, rows, ngram), f"doc_id {id_type}, key long, words long, pa long, pb long, bands array<long>"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "bands", "words")).alias("r")
    classes = marks.filter("words > 0").groupBy("pa", "pb").agg(least, F.count("*").alias("copies"))
    classes = materialize(classes.select("pa", "pb", "copies", F.col("r.doc_id").alias("id"), "r.key", "r.bands", "r.words", F.monotonically_increasing_id().alias("node")))

    banded = classes.select("node", "words", F.posexplode("bands").alias("k", "band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    candidates = components(banded.join(buckets, "band").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    candidates = materialize(candidates.withColumnRenamed("id", "node").join(classes.select("node", "words"), "node"))
    blocks = F.ceil(F.greatest(F.sum("words") / block_ngrams, F.count("*") / block_rows)).cast("int").alias("blocks")
    whole = candidates.groupBy("component").agg(blocks, F.count("*").cast("double").alias("_n"))
    # Groups above one block: comparisons by their buckets, beside those of the whole.
    inside = banded.join(buckets.select("band"), "band").join(candidates.join(whole.filter("blocks > 1"), "component").select("node", "component", (F.col("_n") * F.col("_n")).alias("_whole")), "node")
    shared = inside.groupBy("component", "_whole", F.col("band").alias("group"), F.col("k").alias("band")).agg(blocks, F.count("*").cast("double").alias("_n")).filter("_n > 1")
    apart = materialize(shared.groupBy("component", "_whole").agg(F.sum(F.col("_n") * F.col("_n")).alias("_apart")).filter("_apart < _whole").select("component"))
    whole = whole.join(apart, "component", "left_anti").select(F.col("component").alias("group"), F.lit(-1).alias("band"), "blocks")
    together = _in_blocks(candidates.select("node", F.col("component").alias("group"), F.lit(-1).alias("band")), whole)
    single = _in_blocks(inside.select("node", "component", F.col("band").alias("group"), F.col("k").alias("band")), shared.join(apart, "component", "left_semi").select("group", "band", "blocks")).drop("component")
    dealt = together.unionByName(single).join(classes.select("node", "copies", "key", "pa", "pb", F.col("bands").alias("_bands")), "node").withColumn("bands", F.when(F.col("band") > 0, F.col("_bands"))).drop("_bands")
    texts = docs.select("key", "text").join(dealt, "key").select(*_DEALT, "pa", "pb", "text")
    sets = texts.mapInArrow(_sets(ngram), "group long, band int, i int, j int, side int, node long, copies long, bands array<long>, grams binary")
    found = materialize(sets.repartition(n, "group", "band", "i", "j").sortWithinPartitions("group", "band", "i", "j", "node").mapInArrow(_verify(threshold), "node long, root long, links long"))

    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    near = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = linked.join(classes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("class_id"))  # least of those that aren't null
    linked = linked.join(named, "component").select("node", F.lit(True).alias("linked"), "class_id")
    sized = classes.join(linked, "node", "left").join(near, "node", "left").select(
        F.col("pa").alias("_a"), F.col("pb").alias("_b"), F.col("id").alias("set_id"), F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    member = F.col("words") > 0
    out = marks.select("doc_id", "words", "pa", "pb").join(sized, (F.col("pa") == F.col("_a")) & (F.col("pb") == F.col("_b")), "left")
    return out.select("doc_id", F.when(member, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(member, F.col("set_id")).otherwise(F.col("doc_id")).alias("set_id"), F.when(member, F.col("n_links")).otherwise(0).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without near copies: of each class exactly one row stays, one with the least id (null after all others), all columns as they are.

    Rows are compared by their texts, each as a document of its own, so copies under a repeated or null id go too. Rows without words are copies of none and stay.
    """
    rows = numbered(docs)
    classes = materialize(jaccard_classes(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), **options).filter("n_links > 0").select(F.col("doc_id").alias("row"), "class_id"))
    ids = rows.select("row", F.col("doc.doc_id").alias("doc_id"))
    first = classes.join(ids, "row").groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")).select(F.col("least.row").alias("row"))
    gone = classes.select("row").join(first, "row", "left_anti")
    return rows.join(gone, "row", "left_anti").select("doc.*")

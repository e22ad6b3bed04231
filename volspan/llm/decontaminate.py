"""Operator 7: benchmark decontamination by suffix arrays over the training text.

A shard is the text that one step of a task holds. Its words become ranks in the benchmark's vocabulary, and its suffix array orders all word positions by as many of the words that follow
as a window has: by whole words packed into 64 bits, then, among equal ones, by the next. Every benchmark suffix is binary-searched in it. The range that shares a window's words
(13, or a whole shorter item) holds all its places in the shard; the neighbours of a suffix's place give its longest verbatim match. Words are ranked by fingerprint, and the
words of every match are then compared byte by byte.

The benchmark's size is measured first: while it is at most ``block_bytes`` it is sent to every task, beyond that it is taken in as many blocks of items, one scan of the documents each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, numbered, steps, utf8_view
from .textscan import same_slices, spread
from .words import ALPHANUMERIC, word_slices

WINDOW, BLOCK_BYTES = 13, 32 << 20


def _packed(ranks: np.ndarray, bits: int, words: int) -> np.ndarray:
    """The ranks of the ``words`` words from each position in one number, zeros past the end."""
    key = np.zeros(len(ranks), np.uint64)
    for k in range(words):
        key <<= np.uint64(bits)
        key[: max(0, len(ranks) - k)] |= ranks[k:].astype(np.uint64)
    return key


def _first_at_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each target the first place from ``lo`` up to ``hi`` whose value isn't less; values are sorted within each range."""
    lo, hi = lo.copy(), hi.copy()
    while len(open_ := np.flatnonzero(lo < hi)):
        middle = (lo[open_] + hi[open_]) // 2
        less = values[middle] < target[open_]
        lo[open_[less]] = middle[less] + 1
        hi[open_[~less]] = middle[~less]
    return lo


class Benchmark:
    """A block of items: its vocabulary, the ranks of its words and its distinct windows with the items that hold them."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.ids = [i for i, _ in items]
        data, off = utf8_view(pa.array([t for _, t in items], pa.string()))
        for self.which in (0, 1):  # the point under which no two of these words share a fingerprint
            text, prints, starts, ends, self.upto = word_slices(data, off, ALPHANUMERIC, self.which)
            self.prints, first, rank = np.unique(prints, return_index=True, return_inverse=True)
            size = ends - starts
            if (size == size[first][rank]).all() and same_slices(text, starts, text, starts[first][rank], size):
                break
        run, at = spread(size[first])
        self.size, self.at, self.text = size[first], np.cumsum(size[first]) - size[first], text[starts[first][run] + at]
        self.ranks = (rank + 1).astype(np.int64)
        self.bits = max(1, (len(first) + 1).bit_length())
        self.words = max(1, min(window, 64 // self.bits))
        self.levels = -(-window // self.words)
        n = np.diff(self.upto)
        width = np.minimum(n, window)
        item, place = spread(np.where(n > 0, n - width + 1, 0))
        start, width = self.upto[:-1][item] + place, width[item]
        keys = np.stack([self.level(k)[start] & self._mask(width - k * self.words) for k in range(self.levels)]) if len(start) else np.zeros((self.levels, 0), np.uint64)
        order = np.lexsort((item, *keys[::-1], width))
        keys, width, item = keys[:, order], width[order], item[order]
        new = np.ones(len(order), bool)
        new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0) | (width[1:] != width[:-1])
        again = ~new
        again[1:] &= item[1:] == item[:-1]
        of = np.cumsum(new) - 1
        self.keys, self.width = keys[:, new], width[new]
        self.items, self.n_items = item[~again], np.bincount(of[~again], minlength=int(new.sum()))

    def _mask(self, width: np.ndarray) -> np.ndarray:
        """Bits of the first ``width`` words of a key."""
        kept = np.clip(width, 0, self.words)
        whole = (1 << self.bits * self.words) - 1
        return np.array([whole & ~((1 << self.bits * (self.words - k)) - 1) for k in range(self.words + 1)], np.uint64)[kept]

    def level(self, k: int, ranks: np.ndarray | None = None) -> np.ndarray:
        """Keys of the words from ``k`` whole keys on."""
        key = _packed(self.ranks if ranks is None else ranks, self.bits, self.words)
        out = np.zeros(len(key), np.uint64)
        out[: max(0, len(key) - k * self.words)] = key[k * self.words :]
        return out


class Shard:
    """The texts of one step: their words' ranks (0: not of the benchmark) and the suffix array of the positions whose word has one."""

    def __init__(self, data: np.ndarray, off: np.ndarray, bench: Benchmark):
        self.bench = bench
        self.text, prints, self.starts, self.ends, self.upto = word_slices(data, off, ALPHANUMERIC, bench.which)
        self.n = len(prints)
        place = np.minimum(np.searchsorted(bench.prints, prints), max(0, len(bench.prints) - 1))
        self.rank = np.where(bench.prints[place] == prints, place + 1, 0) if len(bench.prints) else np.zeros(self.n, np.int64)
        self.end = np.repeat(self.upto[1:], np.diff(self.upto))  # of each word's text
        self.keys = [bench.level(k, self.rank) for k in range(bench.levels)]
        at = np.flatnonzero(self.rank)
        self.array = at[np.argsort(self.keys[0][at], kind="stable")]
        group = np.zeros(len(self.array), np.int64)
        tied = np.arange(len(self.array))
        for key in range(bench.levels - 1):
            value = self.keys[key][self.array[tied]]
            new = np.ones(len(tied), bool)
            new[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
            group = np.cumsum(new)
            keep = np.bincount(group)[group] > 1
            tied, group = tied[keep], group[keep]
            order = np.lexsort((self.keys[key + 1][self.array[tied]], group))
            self.array[tied] = self.array[tied[order]]

    def search(self, keys: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of the array whose suffixes begin with the first ``width`` words of each of these keys, or the place where they would stand."""
        lo, hi = np.zeros(len(width), np.int64), np.full(len(width), len(self.array))
        for k in range(self.bench.levels):
            ask = np.flatnonzero((width > k * self.bench.words) & (lo < hi))
            if not len(ask):
                break
            values, mask = self.keys[k][self.array], self.bench._mask(width[ask] - k * self.bench.words)
            low, high = keys[k, ask] & mask, keys[k, ask] | (~mask & np.uint64((1 << self.bench.bits * self.bench.words) - 1))
            if k == 0:
                lo[ask], hi[ask] = np.searchsorted(values, low), np.searchsorted(values, high, side="right")
            else:
                first = _first_at_least(values, lo[ask], hi[ask], low)
                lo[ask], hi[ask] = first, _first_at_least(values, first, hi[ask], high + np.uint64(1)) if self.bench.bits * self.bench.words < 64 else self._past(values, first, hi[ask], high)
        return lo, hi

    @staticmethod
    def _past(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, high: np.ndarray) -> np.ndarray:
        """As ``_first_at_least`` for the number after ``high``, which may not fit 64 bits."""
        last = high == ~np.uint64(0)
        return np.where(last, hi, _first_at_least(values, lo, np.where(last, lo, hi), high + np.uint64(1)))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct window, word) of every verbatim occurrence."""
        lo, hi = self.search(self.bench.keys, self.bench.width)
        window, k = spread(np.maximum(hi - lo, 0))
        at = self.array[lo[window] + k]
        inside = at + self.bench.width[window] <= self.end[at]
        return self._verbatim(window[inside], at[inside], self.bench.width[window[inside]])

    def _verbatim(self, what: np.ndarray, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those whose words are the vocabulary's, byte by byte."""
        cover = np.zeros(self.n + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + width, -1)
        word = np.flatnonzero(np.cumsum(cover[:-1]))
        rank, size = self.rank[word] - 1, (self.ends - self.starts)[word]
        if (size == self.bench.size[rank]).all() and same_slices(self.text, self.starts[word], self.bench.text, self.bench.at[rank], size):
            return what, at
        wrong = np.zeros(self.n + 1, np.int64)
        for w, r, n in zip(word.tolist(), rank.tolist(), size.tolist(), strict=True):
            wrong[w + 1] = n != self.bench.size[r] or bool((self.text[self.starts[w] : self.starts[w] + n] != self.bench.text[self.bench.at[r] : self.bench.at[r] + n]).any())
        wrong = np.cumsum(wrong)
        good = wrong[at + width] == wrong[at]
        return what[good], at[good]

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each item: words of its longest verbatim match in the shard, the word of the item and the word of the shard where it begins."""
        bench, n = self.bench, len(self.bench.ranks)
        ranks, end = np.append(bench.ranks, -1), np.repeat(bench.upto[1:], np.diff(bench.upto))
        mine = np.append(self.rank, 0)
        keys = np.stack([bench.level(k) for k in range(bench.levels)])
        lo, hi = self.search(keys, np.minimum(end - np.arange(n), bench.words * bench.levels))
        best, where = np.zeros(n, np.int64), np.full(n, self.n)
        # A range shares all words that the array orders by; further words may differ, so all its suffixes are tried. Otherwise the neighbours of the place are.
        run, k = spread(np.where(hi > lo, hi - lo, 2))
        index = np.where(hi[run] > lo[run], lo[run], lo[run] - 1) + k
        ok = (index >= 0) & (index < len(self.array))
        run, at = run[ok], self.array[index[ok]]
        length = np.zeros(len(run), np.int64)
        going = np.arange(len(run))
        while len(going):
            x, y = run[going] + length[going], at[going] + length[going]
            same = (x < end[run[going]]) & (y < self.end[at[going]])
            same &= ranks[np.minimum(x, n)] == mine[np.minimum(y, self.n)]
            going = going[same]
            length[going] += 1
        kept = np.flatnonzero(length)
        kept = self._verbatim(kept, at[kept], length[kept])[0]
        order = kept[np.lexsort((at[kept], -length[kept], run[kept]))]
        first = np.ones(len(order), bool)
        first[1:] = run[order][1:] != run[order][:-1]
        order = order[first]
        best[run[order]], where[run[order]] = length[order], at[order]
        item = np.repeat(np.arange(len(bench.ids)), np.diff(bench.upto))
        order = np.lexsort((where, -best, item))
        first = np.ones(n, bool)
        first[1:] = item[order][1:] != item[order][:-1]
        rows = order[first]
        rows = rows[best[rows] > 0]
        return best[rows], rows, where[rows]


def _shards(batches: Iterator[pa.RecordBatch], bench: Benchmark) -> Iterator[tuple[pa.RecordBatch, Shard]]:
    for part, data, off in steps(batches, "text", min(32 << 20, max(STEP_BYTES, 8 * len(bench.ranks)))):
        yield part, Shard(data, off, bench)


def _cut(first: np.ndarray, last: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last) of ranges of words cut at the texts' ends."""
    a, b = np.searchsorted(upto, first, side="right") - 1, np.searchsorted(upto, last - 1, side="right") - 1
    run, k = spread(b - a + 1)
    text = a[run] + k
    lo, hi = np.maximum(first[run], upto[text]), np.minimum(last[run], upto[text + 1])
    keep = lo < hi
    return text[keep], lo[keep], hi[keep]


def _listed(owner: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """A list for each of ``n`` owners, from values sorted by owner."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)), values)


def _scan(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = broadcast.value
        ids = np.array(bench.ids, np.int64)
        item_at = np.cumsum(bench.n_items) - bench.n_items
        for part, shard in _shards(batches, bench):
            upto, n = shard.upto, part.num_rows
            window, at = shard.places()
            width = bench.width[window]
            cover = np.zeros(shard.n + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + width, -1)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]]).astype(np.int8)))
            text, lo, hi = _cut(edge[::2], edge[1::2], upto)
            runs = _listed(text, n, pa.StructArray.from_arrays([pa.array(lo - upto[text]), pa.array(hi - upto[text])], ["lo", "hi"]))
            run, k = spread(bench.n_items[window])
            item, at, width = bench.items[item_at[window][run] + k], at[run], width[run]
            text = np.searchsorted(upto, at, side="right") - 1
            order = np.lexsort((at, item, text))
            item, at, width, text = item[order], at[order], width[order], text[order]
            new = np.ones(len(at), bool)
            new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (at[1:] > at[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1 if len(at) else first
            words = at[last] + width[last] - at[first]
            order = np.lexsort((at[first], -words, item[first], text[first]))
            first, words = first[order], words[order]
            one = np.ones(len(first), bool)
            one[1:] = (text[first][1:] != text[first][:-1]) | (item[first][1:] != item[first][:-1])
            first, words = first[one], words[one]
            matches = _listed(text[first], n, pa.StructArray.from_arrays([pa.array(ids[item[first]]), pa.array(at[first] - upto[text[first]]), pa.array(words)], ["item_id", "start", "words"]))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["_print"], pa.array(np.diff(upto)), runs, matches], ["doc_id", "_print", "n_words", "runs", "matches"])

    return run


def _scan_longest(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = broadcast.value
        for part, shard in _shards(batches, bench):
            words, row, at = shard.longest()
            item = np.searchsorted(bench.upto, row, side="right") - 1
            text = np.searchsorted(shard.upto, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.array(bench.ids, np.int64)[item]), pa.array(words), pa.array(row - bench.upto[item]), part["doc_id"].take(pa.array(text)), pa.array(at - shard.upto[text])], ["item_id", "words", "place", "doc_id", "start"])

    return run


def _over_blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, scan: Callable, schema: str) -> list[DataFrame]:
    """The scan of the documents for each block of the benchmark, whose size is measured; a single item may be larger than a block."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    sc = docs.sparkSession.sparkContext
    out = []
    for k in range(n):
        block = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = block.orderBy("item_id", "text").collect()  # a block by its measured size
        out.append(docs.mapInArrow(scan(sc.broadcast(Benchmark([(r[0], r[1]) for r in rows], window))), schema))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Verbatim occurrences of benchmark windows in whole texts.

    ``docs``: ``doc_id, text``; ``benchmark``: ``item_id, text`` (rows with a null are ignored; an item may have several rows). Returns one row per document: ``doc_id,
    n_words, n_hit`` (words inside an occurrence), ``n_items, items`` (ids of items that occur, sorted as strings), ``matches`` (of each item the longest stretch of words whose
    windows follow one another: item_id, start in words, words) and ``contaminated`` (``n_hit`` > 0 and at least one in ``share`` words). Null and empty texts have no words
    and are clean; no benchmark hits nothing. Rows are independent: null and repeated ids are kept.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_print", F.xxhash64("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, _print long, n_words long, runs array<struct<lo:bigint,hi:bigint>>, matches array<struct<item_id:bigint,start:bigint,words:bigint>>"
    found = _over_blocks(docs, benchmark, window, block_bytes, _scan, schema)
    out = found[0]
    if len(found) > 1:
        for more in found[1:]:
            out = out.unionByName(more)
        # Each row of the documents came once per block; rows that repeat another come back as often as they were.
        out = out.groupBy("doc_id", "_print", "n_words").agg((F.count("*") / len(found)).cast("int").alias("_rows"), F.flatten(F.collect_set("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"))
        out = out.withColumn("_row", F.explode(F.sequence(F.lit(1), "_rows")))
    covered = F.aggregate(
        F.array_sort("runs"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["hi"] - F.greatest(r["lo"], s["upto"]))).alias("n"), F.greatest(s["upto"], r["hi"]).alias("upto")), lambda s: s["n"],
    )
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    out = out.select("doc_id", "n_words", covered.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), "matches")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each item of which a word occurs anywhere: its longest verbatim match (``words``), where in the item it begins (``place``, in words) and one document and word where it stands.

    Of several longest ones it is one that neighbours the item's suffix in a shard's order. A row of an item that has several is judged by itself, and the longest counts.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = f"item_id long, words long, place long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long"
    found = _over_blocks(docs, benchmark, window, block_bytes, _scan_longest, schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = out.groupBy("item_id").agg(F.min(F.struct((-F.col("words")).alias("less"), "doc_id", "start", "place")).alias("b"))
    return best.select("item_id", (-F.col("b.less")).alias("words"), "b.place", "b.doc_id", "b.start")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without those that ``find_contamination`` flags; each row is judged by its own text, whatever its id."""
    rows = numbered(docs)
    bad = find_contamination(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), benchmark, **options).filter("contaminated").select(F.col("doc_id").alias("row"))
    return rows.join(bad, "row", "left_anti").select("doc.*")


def items_digest(items) -> object:
    return F.sha2(F.array_join(items, ","), 256)


def brute_force(docs: list[tuple[int, str]], items: list[tuple[int, str]], window: int = WINDOW) -> dict[int, tuple]:
    """The contract's columns by direct comparison, for tests on small tables."""
    import re

    def words(text: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    out = {}
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            x = words(item)
            k = min(len(x), window)
            for s in range(len(x) - k + 1 if x else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == x[s : s + k]:
                        hit.update(range(p, p + k))
                        ids.add(item_id)
        out[doc_id] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out

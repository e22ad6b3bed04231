"""Operator 13: periodic runs of words in whole texts, and texts without their repetitions.

A run is a stretch of consecutive words with a smallest period q (words q apart are identical) and at least ``max(LEAST, TIMES * q)`` words that no neighbouring word extends. The words of a
step's texts become one sequence of fingerprints with prefix hashes. A run of period q holds a stretch of ``max(LEAST, TIMES * q) - q`` places equal to the place q further on, so a grid
of that step meets every run of the period; over all periods the grids are a harmonic sum, n log n points a text. At all (period, grid point) pairs whose words agree, how far they agree
to both sides is found by one binary search over prefix hashes, for all pairs at once. Runs that several points or multiples of a period found are one run, of the least period; the words
of what is left are compared byte by byte, and a text in which a fingerprint misled is read again word by word.

A step is 1 MB of texts or one longer text, and pairs are made by blocks, so memory follows the longest text. Rows are independent: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps
from .textscan import PrefixHash, same_slices, spread, word_bounds
from .words import NOT_SPACE

# Fixed values of the contract: a run has TIMES periods, and LEAST words.
TIMES, LEAST = 4, 6
#: Pairs of period and grid point, and bytes of joined words, that one vector operation handles.
BLOCK = 1 << 19
_SPACES = r"[\x20\x09-\x0D]+"


def _step_of(p: np.ndarray) -> np.ndarray:
    return np.maximum(LEAST, TIMES * p) - p


def _candidates(x: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place in ``x``) of the grid points whose word equals the one a period further on, block by block."""
    most = np.where(count >= LEAST, count // TIMES, 0)
    upto = np.cumsum(most)
    lo = 0
    while lo < len(most):
        # Texts with about BLOCK periods together; a longer text alone.
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BLOCK, side="right")))
        text, p = spread(most[lo:hi])
        text, p = text + lo, p + 1
        step = _step_of(p)
        points = -(-(count[text] - p) // step)
        total = np.cumsum(points)
        a = 0
        while a < len(p):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BLOCK, side="right")))
            pair, place = spread(points[a:b])
            pair += a
            at = first[text[pair]] + place * step[pair]
            same = np.flatnonzero(x[at] == x[at + p[pair]])
            yield text[pair[same]], p[pair[same]], at[same]
            a = b
        lo = hi


def _agreement(prints: PrefixHash, at: np.ndarray, p: np.ndarray, most: np.ndarray, sign: int) -> np.ndarray:
    """How many words from ``at`` on (before it, for a negative sign) equal those ``p`` further on: binary searches over prefix hashes, all at once."""
    low, high = np.zeros(len(at), np.int64), most.astype(np.int64)
    while True:
        todo = np.flatnonzero(low < high)
        if not len(todo):
            return low
        middle = (low[todo] + high[todo] + 1) // 2
        start = at[todo] if sign > 0 else at[todo] - middle
        same = prints.of(start, start + middle) == prints.of(start + p[todo], start + p[todo] + middle)
        low[todo[same]], high[todo[~same]] = middle[same], middle[~same] - 1


def _same_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    return bool((sizes[a] == sizes[b]).all()) and same_slices(data, starts[a], data, starts[b], sizes[a])


def runs_by_words(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by comparing words at every period: for the text in which a fingerprint misled."""
    best: dict[tuple[int, int], int] = {}
    for p in range(1, len(words) // TIMES + 1):
        j, n = 0, len(words) - p
        while j < n:
            s = j
            while j < n and words[j] == words[j + p]:
                j += 1
            if j - s + p >= max(LEAST, TIMES * p):
                best.setdefault((s, j + p), p)
            j += 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


def find_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends of all words, offsets of the texts into them, runs as rows of text, start, length, period; words to drop) for texts given as bytes and offsets."""
    starts, ends = word_bounds(NOT_SPACE[data], off)
    upto = np.searchsorted(starts, off)
    first, count = upto[:-1], np.diff(upto)
    drop = np.zeros(len(starts), bool)
    if not len(starts):
        return starts, ends, upto, np.zeros((0, 4), np.int64), drop
    x = PrefixHash(data).of(starts, ends)
    prints = PrefixHash(x)
    found: list[np.ndarray] = []
    within, end, period = np.full(len(x), -1), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for text, p, at in _candidates(x, first, count):
        if len(end):
            # Both words lie in a run whose period divides this one: the stretch is that run.
            run = within[at]
            new = np.flatnonzero((run < 0) | (at + p >= end[run]) | (p % period[run] > 0))
            text, p, at = text[new], p[new], at[new]
        ahead = _agreement(prints, at, p, first[text] + count[text] - p - at, 1)
        back = _agreement(prints, at, p, at - first[text], -1)
        long = np.flatnonzero(ahead + back >= _step_of(p))
        s = at[long] - back[long]
        mine = np.unique(np.stack([text[long], s - first[text[long]], ahead[long] + back[long] + p[long], p[long]], axis=1), axis=0)
        found.append(mine)
        begin = first[mine[:, 0]] + mine[:, 1]
        for k, (a, b) in enumerate(zip(begin.tolist(), (begin + mine[:, 2]).tolist(), strict=True), len(end)):
            within[a:b] = k
        end, period = np.append(end, begin + mine[:, 2]), np.append(period, mine[:, 3])
    runs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
    # Of equal stretches the least period stays: rows are in the order of text, start, length, period.
    runs = runs[np.append(True, (runs[1:, :3] != runs[:-1, :3]).any(axis=1))] if len(runs) else runs
    sizes, misled = ends - starts, set()
    for k in range(len(runs)):
        text, s, length, p = runs[k].tolist()
        for lo in range(first[text] + s, first[text] + s + length - p, BLOCK):
            a = np.arange(lo, min(lo + BLOCK, first[text] + s + length - p))
            if not _same_words(data, starts, sizes, a, a + p):
                misled.add(text)
                break
    if misled:
        again = [(t, *r) for t in misled for r in runs_by_words([data[starts[i] : ends[i]].tobytes() for i in range(first[t], first[t] + count[t])])]
        runs = np.concatenate([runs[~np.isin(runs[:, 0], list(misled))], np.array(again, np.int64).reshape(-1, 4)])
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    edges = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edges, first[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
    np.add.at(edges, first[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
    return starts, ends, upto, runs, np.cumsum(edges[:-1]) > 0


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, upto: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each text's kept words, joined by one space."""
    kept = np.flatnonzero(keep)
    sizes = (ends - starts)[kept]
    place = np.searchsorted(kept, upto)
    last = np.zeros(len(kept), bool)
    last[place[1:][place[1:] > place[:-1]] - 1] = True
    wide = sizes + ~last  # a word and the space after it
    at = np.append(0, np.cumsum(wide))
    out = np.full(int(at[-1]), 0x20, np.uint8)
    lo = 0
    while lo < len(kept):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK, side="right")) - 1)
        run, inside = spread(sizes[lo:hi])
        out[at[lo:hi][run] + inside] = data[starts[kept[lo:hi]][run] + inside]
        lo = hi
    return out, at[place]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, off in steps(batches, "text"):
        starts, ends, upto, runs, drop = find_runs(data, off)
        out, cuts = joined_words(data, starts, ends, upto, ~drop)
        listed = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(_RUN))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(runs[:, 0], np.arange(batch.num_rows + 1)).astype(np.int32)), listed)
        texts = pa.Array.from_buffers(pa.string(), batch.num_rows, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(upto)), lists, texts], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Of each row: ``doc_id, n_words``, ``runs`` (structs of ``start, length, period`` by start, then period) and ``collapsed``, the text of the words that no run repeats.

    A null or empty text has no words, no runs and an empty ``collapsed``. Rows are independent: null or repeated ids are kept as they are; other columns are ignored; an empty table gives
    none. A stretch that has several periods counts once, with the least; runs that overlap all count.
    """
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_scan, f"doc_id {id_type}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in which a tenth of the documents repeat some of their own words to the end, as the query's contract lays down; a null id has no checksum and changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", _SPACES), lambda w: w != "")
    chosen = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words").cast("long")
    chosen = chosen.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", F.floor((n - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    word = lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")
    return chosen.select("doc_id", F.when(F.size("words") > 0, text).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The contract's columns: the number of runs, the longest one (ties: least start, then period) with ``exponent_milli``, and checksums of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("_best", best)
    period = -F.col("_best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("_best.length") / period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

"""Operator 6: removal of every byte covered by a 200-byte string that starts anywhere else.

Only the suffixes at anchors are sorted: an anchor is the least 64-byte fingerprint of a 200-byte window, so equal windows have equal anchors wherever
they stand, and about one position in seventy is one. A segment is the run of windows that share an anchor.

1. Segments with equal text (two independent fingerprints of the whole segment, 122 bits) are repeats in all their windows. Repeats inside one step of a task are combined before the
   shuffle; the rest are sorted by anchor in the shuffle and read as a stream, so a group of any size takes constant memory.
2. Segments that share an anchor but not their text (an edit or the edge of a passage is near) are suffixes to compare: sampled splitters range-partition them by
   the leading bytes at the anchor, each bucket sorts its windows by multikey quicksort and keeps those that occur twice. All segments of an anchor lie in one bucket,
   and batches inside a bucket are joined up to a change of anchor, so no comparison ends at a boundary. Groups above ``hot_rows`` go to grouped counts of single windows,
   which no task needs to see whole; equal windows are found there by the same pair of fingerprints, so the result doesn't depend on ``hot_rows``.

Each input row has a number of its own, written beside its compressed text before anything else, and segments, contexts and spans are joined on it; ids are only passed on.

An anchor's mark has 52 bits and may collide, which only adds comparisons. Buckets compare the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, materialize, partitions_for, steps, utf8_view
from .textscan import PrefixHash, rolling_marks, sliding_min, spread

LENGTH, ANCHOR = 200, 64
_LOW = np.uint64(0xFFF)
_FULL, _COMPARE = 0, 1


def _segments(data: np.ndarray, off: np.ndarray, length: int, anchor: int) -> dict[str, np.ndarray] | None:
    """Segments of the texts in ``data``: text number, start, number of windows, anchor's place after the start, anchor, two fingerprints."""
    width = length - anchor + 1
    long = np.diff(off) >= length
    if not long.any():
        return None
    at = rolling_marks(data, anchor)
    at &= ~_LOW
    at |= np.arange(len(at), dtype=np.uint64) & _LOW
    least = sliding_min(at, width)
    n = len(least)
    cut = np.empty(n, bool)
    cut[0] = True
    np.not_equal(least[1:], least[:-1], out=cut[1:])
    begin, end = off[:-1][long], off[1:][long] - length + 1
    inside = np.zeros(n + 1, np.int8)
    inside[begin] += 1
    np.add.at(inside, end, -1)
    cut[begin] = True
    edges = np.flatnonzero(cut)
    keep = np.cumsum(inside[:n], dtype=np.int8)[edges] > 0
    upto = np.append(edges[1:], n)[keep]
    start = edges[keep]
    text = np.searchsorted(off, start, side="right") - 1
    upto = np.minimum(upto, off[text + 1] - length + 1)
    place = ((least[start] & _LOW).astype(np.int64) - start) % 4096
    prints = [PrefixHash(data, k).of(start, upto + length - 1).view(np.int64) for k in (0, 1)]
    return {"text": text, "start": start - off[text], "n": upto - start, "place": place, "anchor": (least[start] >> np.uint64(12)).view(np.int64), "print": prints[0], "print2": prints[1]}


def _pack(s: dict[str, np.ndarray]) -> np.ndarray:
    return s["start"] << 20 | s["n"] << 10 | s["place"]


def _emit_segments(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in _unpacked_steps(batches):
            s = _segments(data, off, length, anchor)
            if s is None:
                continue
            where = _pack(s)
            order = np.lexsort((s["print2"], s["print"], s["anchor"]))
            a, p, q = s["anchor"][order], s["print"][order], s["print2"][order]
            new = np.empty(len(a), bool)
            new[0] = True
            new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            run_of = np.cumsum(new) - 1
            many = np.bincount(run_of)[run_of] > 1
            kind = np.where(new, many.astype(np.int8), np.int8(2))  # 0: alone here, 1: stands for repeats, 2: another of them, only passed on
            key = np.where(kind == 2, (where[order] * np.int64(0x9E3779B97F4A7C1)) >> np.int64(12), a)
            p, q = np.where(kind == 2, 0, p), np.where(kind == 2, 0, q)
            owner = part.column("row").take(pa.array(s["text"][order]))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(p), pa.array(q), owner, pa.array(where[order]), pa.array(kind)], ["anchor", "print", "print2", "row", "at", "kind"])

    return run


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by anchor and fingerprints: whole repeats (without their anchors), and segments to compare. Holds one row between batches."""
    names = ["row", "at", "anchor", "todo", "full"]

    def out(b: pa.RecordBatch, rows: np.ndarray, todo: int, full: np.ndarray) -> pa.RecordBatch:
        t = b.take(pa.array(rows))
        anchors = t["anchor"] if todo == _COMPARE else pa.array(np.zeros(len(rows), np.int64))
        return pa.RecordBatch.from_arrays([t["row"], t["at"], anchors, pa.array(np.full(len(rows), todo, np.int8)), pa.array(full)], names)

    held, held_done, earlier = None, False, False  # the last run's first row; whether it is known to be a repeat; whether its anchor had a run before
    for batch in batches:
        kind = batch["kind"].to_numpy()
        passed = np.flatnonzero(kind == 2)
        if len(passed):
            yield out(batch, passed, _FULL, np.ones(len(passed), bool))
            batch = batch.take(pa.array(np.flatnonzero(kind != 2)))
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        a, p, q = (batch[c].to_numpy() for c in ("anchor", "print", "print2"))
        new = np.empty(len(a), bool)
        new[0] = True
        new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        first = np.flatnonzero(new)
        run_of = np.cumsum(new) - 1
        full = (np.bincount(run_of) > 1) | (np.maximum.reduceat(batch["kind"].to_numpy(), first) == 1)
        if held is not None:
            full[0] |= held_done
        rows = full[run_of]
        if held is not None and held_done:
            rows[0] = False
        rows = np.flatnonzero(rows)
        if len(rows):
            yield out(batch, rows, _FULL, np.ones(len(rows), bool))
        same = a[first[1:]] == a[first[:-1]]
        before = np.append(earlier, same)
        mixed = before.copy()
        mixed[:-1] |= same
        done = np.flatnonzero(mixed[:-1])
        if len(done):
            yield out(batch, first[done], _COMPARE, full[done])
        held, held_done, earlier = batch.slice(int(first[-1]), 1), bool(full[-1]), bool(before[-1])
    if held is not None and earlier:
        yield out(held, np.zeros(1, np.int64), _COMPARE, np.array([held_done]))


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for part, data, off in steps(batches, "text"):
        view = memoryview(np.ascontiguousarray(data))
        yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array([pack(view[s:e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())], ["row", "doc_id", "packed"])


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def _unpacked_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of packed batches holding about a step of text each, with their bytes and offsets from 0."""
    for batch in batches:
        texts, lo, size = [], 0, 0
        for k, packed in enumerate(batch["packed"]):
            texts.append(_unpack(packed.as_py()))
            size += len(texts[-1])
            if size >= STEP_BYTES or k + 1 == batch.num_rows:
                off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                yield batch.slice(lo, len(texts)), np.frombuffer(b"".join(texts), np.uint8), off
                texts, lo, size = [], k + 1, 0


def _contexts(length: int):
    """Bytes that the windows of each segment to compare span, with the eight bytes at its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, lead, anchor, at, full, text = [], [], [], [], [], []
            for row, packed in enumerate(batch["packed"]):
                raw = _unpack(packed.as_py())
                for s in batch["todo"][row].as_py():
                    start, n, place = s["at"] >> 20, s["at"] >> 10 & 1023, s["at"] & 1023
                    owner.append(row)
                    lead.append(int.from_bytes(raw[start + place : start + place + 8], "big") - (1 << 63))
                    anchor.append(s["anchor"])
                    at.append(s["at"])
                    full.append(s["full"])
                    text.append(raw[start : start + n + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(lead, pa.int64()), pa.array(anchor, pa.int64()), batch["row"].take(pa.array(owner, pa.int64())), pa.array(at, pa.int64()), pa.array(full, pa.bool_()), pa.array(text, pa.binary())], ["lead", "anchor", "row", "at", "full", "context"])

    return run


def _leading_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number that orders like them (zeros after the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def repeated_windows(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` (8 at least) bytes from each start equal those from another start of its group.

    Multikey quicksort, one step of all parts at a time: by the eight bytes at its depth a part falls into those below, equal to and above the bytes of one of its rows; the
    equal ones go on eight bytes deeper, and a row that is alone leaves. Rows still together after the last byte are equal.
    """
    depths = np.array([*range(0, length - 7, 8), *([length - 8] if length % 8 else [])])
    keys, rng = _leading_bytes(data), np.random.default_rng(0)
    hit = np.zeros(len(start), bool)
    rows = np.argsort(group, kind="stable")
    code = group[rows]
    depth = None
    while len(rows):
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        size = np.diff(np.append(first, len(rows)))
        depth = np.zeros(len(first), np.int64) if depth is None else depth[code[first] // 3] + (code[first] % 3 == 1)
        done = depth == len(depths)
        hit[rows[np.repeat(done & (size > 1), size)]] = True
        more = ~done & (size > 1)
        rows, size, depth = rows[np.repeat(more, size)], size[more], depth[more]
        part = np.repeat(np.arange(len(size)), size)
        key = keys[start[rows] + depths[depth][part]]
        pivot = key[np.cumsum(size) - size + rng.integers(0, size)][part] if len(size) else key
        code = 3 * part + 1 + (key > pivot) - (key < pivot)
        order = np.argsort(code, kind="stable")
        rows, code = rows[order], code[order]
    return hit


def _windows(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of a batch of contexts: row, place in the row, start in the bytes; and the bytes."""
    data, off = utf8_view(batch["context"])
    data, off = data[off[0] : off[-1]], off - off[0]
    row, place = spread(np.diff(off) - length + 1)
    return row, place, off[:-1][row] + place, data


def _window_prints(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For all windows of a batch of contexts: row, place in the row, two fingerprints."""
    row, place, start, data = _windows(batch, length)
    return row, place, [PrefixHash(data, k).of(start, start + length).view(np.int64) for k in (0, 1)]


def _runs(batch: pa.RecordBatch, row: np.ndarray, place: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    """Removed runs of the rows that aren't repeats as a whole."""
    hit = hit & ~batch["full"].to_numpy(zero_copy_only=False)[row]
    row, place = row[hit], place[hit]
    if not len(row):
        return pa.RecordBatch.from_arrays([batch["row"].slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.int64())], ["row", "lo", "hi"])
    new = np.empty(len(row), bool)
    new[0] = True
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    start = batch["at"].to_numpy()[row[first]] >> 20
    return pa.RecordBatch.from_arrays([batch["row"].take(pa.array(row[first])), pa.array(start + place[first]), pa.array(start + place[last])], ["row", "lo", "hi"])


def _compare(length: int, rows_at_once: int):
    """Windows found twice among the segments of an anchor; batches are joined up to a change of anchor."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        row, place, start, data = _windows(batch, length)
        anchor = np.unique(batch["anchor"].to_numpy(), return_inverse=True)[1]
        hit = repeated_windows(data, start, anchor[row], length)
        return _runs(batch, row, place, hit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for big in batches:
            for lo in range(0, big.num_rows, rows_at_once):
                batch = big.slice(lo, rows_at_once)
                a = batch["anchor"].to_numpy()
                if parts and sum(p.num_rows for p in parts) >= rows_at_once:
                    change = np.flatnonzero(a != parts[-1]["anchor"][-1].as_py())
                    if len(change):
                        k = int(change[0])
                        yield solve([*parts, batch.slice(0, k)] if k else parts)
                        parts, batch = [], batch.slice(k)
                parts.append(batch)
        if parts:
            yield solve(parts)

    return run


def _single_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 4096):
                batch = big.slice(lo, 4096)
                row, place, prints = _window_prints(batch, length)
                at = (batch["at"].to_numpy() >> 20)[row] + place
                yield pa.RecordBatch.from_arrays([*map(pa.array, prints), batch["row"].take(pa.array(row)), pa.array(at), batch["full"].take(pa.array(row))], ["print", "print2", "row", "lo", "full"])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digests, kept = [], [], [], [], []
            for row, packed in enumerate(batch["packed"]):
                raw = _unpack(packed.as_py())
                cover = np.zeros(len(raw) + 1, np.int32)
                for name, shift in (("whole", None), ("parts", 0)):
                    cell = batch[name][row]
                    if cell.is_valid and len(cell.values):
                        v = cell.values
                        lo, hi = (v.field("lo").to_numpy(), v.field("hi").to_numpy()) if shift == 0 else ((x := v.to_numpy()) >> 20, (x >> 20) + (x >> 10 & 1023) - 1)
                        np.add.at(cover, lo, 1)
                        np.add.at(cover, hi + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                sizes.append(len(raw))
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot_rows: int = 20_000) -> DataFrame:
    """Cut every byte covered by a ``length``-byte string that also starts elsewhere (the same document included).

    ``docs``: ``doc_id`` and ``text``; other columns are ignored. Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes), one row per
    input row. Every row is a text of its own, whatever its id: null and repeated ids are allowed, with equal texts or different ones, and a row that repeats another is
    a repeat of its text. Null and empty texts, and those shorter than ``length``, keep all. A window may hold at most 1,023 places for its anchor.

    Anchors in more than ``hot_rows`` segments to compare are broadcast, at most one for so many segments; contexts are dealt out once, by their leading bytes.
    """
    if not 8 <= anchor <= length or length - anchor + 1 > 1023:
        raise ValueError("the anchor must be shorter than the string, by 1,022 bytes at most")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = partitions_for(docs, 2)
    packed = materialize(docs.mapInArrow(_squeeze, f"row long, doc_id {id_type}, packed binary"))
    rows = packed.select("row", "packed").mapInArrow(_emit_segments(length, anchor), "anchor long, print long, print2 long, row long, at long, kind byte")
    found = materialize(rows.repartition(n, "anchor").sortWithinPartitions("anchor", "print", "print2").mapInArrow(_classify, "row long, at long, anchor long, todo byte, full boolean"))
    todo = found.filter(F.col("todo") == _COMPARE).groupBy("row").agg(F.collect_list(F.struct("at", "anchor", "full")).alias("todo"))
    contexts = materialize(
        packed.select("row", "packed").join(todo, "row").mapInArrow(_contexts(length), "lead long, anchor long, row long, at long, full boolean, context binary")
    )
    hot = F.broadcast(found.filter(F.col("todo") == _COMPARE).groupBy("anchor").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > hot_rows).select("anchor"))
    usual = contexts.join(hot, "anchor", "left_anti").repartitionByRange(n, "lead", "anchor").sortWithinPartitions("lead", "anchor")
    parts = usual.select("anchor", "row", "at", "full", "context").mapInArrow(_compare(length, 4096), "row long, lo long, hi long")
    windows = contexts.join(hot, "anchor", "left_semi").select("row", "at", "full", "context").mapInArrow(_single_windows(length), "print long, print2 long, row long, lo long, full boolean")
    twice = windows.groupBy("print", "print2").agg(F.count("*").alias("_n")).filter("_n > 1").select("print", "print2")
    single = windows.filter("not full").join(twice, ["print", "print2"], "left_semi").select("row", "lo", F.col("lo").alias("hi"))
    parts = parts.unionByName(single)
    gone = (
        found.filter(F.col("todo") == _FULL).select("row", "at", F.lit(None).cast("struct<lo:bigint,hi:bigint>").alias("part"))
        .unionByName(parts.select("row", F.lit(None).cast("long").alias("at"), F.struct("lo", "hi").alias("part")))
        .groupBy("row").agg(F.collect_list("at").alias("whole"), F.collect_list("part").alias("parts"))
    )
    cut = packed.join(gone, "row", "left").select("doc_id", "packed", "whole", "parts")
    return cut.mapInArrow(_cut(length), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

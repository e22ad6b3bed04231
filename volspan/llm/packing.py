"""Operator 2: packing of token pieces into sequences by exact complements, then best fit.

The plan is made from the histogram of piece lengths alone (at most ``capacity`` numbers, whatever the input): for each length from the longest down, the gap beside
it is looked up in the sums of one, two and three available lengths, and a combination that fills it exactly is used as often as the counts allow. Where no
combination is exact, the longest length that fits goes in and the remaining gap is looked up again. The plan maps (length, rank among pieces of this length) to
(sequence, offset); ranks come from two-level counting, so no task or driver sees more than its share of pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, steps, two_level_rank
from .textscan import spread
from .tokens import encoder

END_ID = 2


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part, data, off in steps(batches, "text"):
            ids, upto = enc.encode(data, off)
            n = np.diff(upto) + 1
            full = np.empty(int(n.sum()), np.uint32)
            ends = np.cumsum(n)
            keep = np.ones(len(full), bool)
            keep[ends - 1] = False
            full[~keep] = end_id
            full[keep] = ids
            count = -(-n // capacity)
            doc, piece = spread(count)
            head = n - (count - 1) * capacity
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[doc], capacity)
            at = (ends - n)[doc] + start
            raw = memoryview(full.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each whole text and its end id; only longer documents are cut, and only the first piece may then be shorter.

    Returns ``doc_id, piece, start, length, ids_crc32``. Null and empty texts are one piece, the end id. Rows are independent: null and repeated ids are kept.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_pieces(tokenizer, capacity, end_id), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def _fill(left: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths whose sum is ``gap``, longest first."""
    if left[gap]:
        return [gap]
    have = left > 0

    def pair(gap: int, left: np.ndarray) -> list[int] | None:
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        ok = (left[a] > 0) & (left[gap - a] > 0) & ((2 * a != gap) | (left[a] > 1))
        return [int(a[k := int(np.argmax(ok))]), int(gap - a[k])] if ok.any() else None

    if found := pair(gap, left):
        return found
    sums = np.convolve(have[: gap + 1], have[: gap + 1])
    a = np.arange(gap - 2, 0, -1)
    for x in a[have[a] & (sums[gap - a] > 0)].tolist():
        if 3 * x < gap:
            break
        rest = left.copy()
        rest[x] -= 1
        if found := pair(gap - x, rest):
            return [x, *found]
    return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(number of sequences, lengths in each) for these counts of lengths. Every step uses up a length, so the plan is short whatever the counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            rest, chosen, gap = left.copy(), [longest], capacity - longest
            rest[longest] -= 1
            while gap:
                if found := _fill(rest, gap):
                    chosen += found
                    break
                fits = np.flatnonzero(rest[1 : gap + 1])
                if not len(fits):
                    break
                best = int(fits[-1]) + 1
                chosen.append(best)
                rest[best] -= 1
                gap -= best
            need = Counter(chosen)
            times = min(int(left[x]) // k for x, k in need.items())
            for x, k in need.items():
                left[x] -= times * k
            out.append((times, sorted(chosen, reverse=True)))
    return out


def _table(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length << 40 | first rank, first sequence, places of the length in a sequence, offset of the first), sorted."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for times, lengths in patterns:
        offset = 0
        for length, k in sorted(Counter(lengths).items(), reverse=True):
            rows.append((length << 40 | used[length], sequence, k, offset))
            used[length] += times * k
            offset += k * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (gapless from 0 in each sequence) to pieces with ``doc_id, piece, length`` (1 to ``capacity``).

    ``pieces`` should be a written table: it is read twice. Equal lengths are interchangeable; ties go by doc_id and piece, then by ``_row`` where there is one (a number of each row, which
    spreads repeated ids over tasks and isn't returned). An empty table gives an empty one.
    """
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = _table(plan(counts, capacity))
    columns = [c for c in pieces.columns if c != "_row"]
    ranked = two_level_rank(pieces, ["length"], ["doc_id", "piece", *(c for c in pieces.columns if c == "_row")], "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            row = table[np.searchsorted(table[:, 0], length << 40 | rank, side="right") - 1] if len(length) else table[:0]
            past = rank - (row[:, 0] & (1 << 40) - 1)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(row[:, 1] + past // row[:, 2]), pa.array(row[:, 3] + past % row[:, 2] * length)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "_row")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = END_ID) -> DataFrame:
    return pack(materialize(token_pieces(docs, tokenizer, capacity, end_id).withColumn("_row", F.monotonically_increasing_id())), capacity)

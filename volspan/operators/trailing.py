"""Ranks within trailing windows of any width, in the logarithm of a range's rows for each row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from volspan.operators import ranges as ra


def count_at_most(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place i: how many of ``values[first[i] .. i]`` are at most ``values[i]``.

    All places go down a wavelet matrix together: at each bit of the ranks the values are split stably by that bit, counts of zeros before a place carry the ends of its window along, and
    a place whose own bit is one adds the zeros between them.
    """
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    need, lo, hi = rank + 1, first.astype(np.int64), np.arange(1, len(values) + 1)
    total, left = np.zeros(len(values), np.int64), rank
    for bit in reversed(range(int(need.max(initial=0)).bit_length())):
        one = (left >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        a, b = zeros[lo], zeros[hi]
        up = (need >> bit & 1).astype(bool)
        total += np.where(up, b - a, 0)
        lo, hi = np.where(up, zeros[-1] + lo - a, a), np.where(up, zeros[-1] + hi - b, b)
        left = np.concatenate([left[~one], left[one]])
    return total


def trailing_rank(rows: DataFrame, value: str, name: str, width: int, ranges: int = 1, time: str = "dt") -> DataFrame:
    """Adds ``name``: the share of the last ``width`` values, this one included, that are at most this one; null until the window is full, and where it holds a null.

    ``rows``: ``series_id``, a time unique in its series, ``value``; all columns are returned. The result is ``features.percentile_rank``, whose cost is the width for each row; here the width
    only lengthens the halo. A task holds one range of a series, ``width - 1`` rows before it and no more.
    """
    parts = ra.with_halo(rows, ranges, width - 1, time=time)
    schema = StructType([*[f for f in rows.schema.fields if f.name != name], StructField(name, DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table[time]))
        column = table[value].combine_chunks().cast(pa.float64())
        missing = column.is_null().to_numpy(zero_copy_only=False)
        first = np.maximum(np.arange(len(missing)) - width + 1, 0)
        known = np.concatenate([[0], np.cumsum(~missing)])
        full = known[1:] - known[first] == width
        share = count_at_most(column.to_numpy(zero_copy_only=False), first) / width
        own = table["_own"].combine_chunks()
        columns = [table[f.name] for f in schema.fields[:-1]]
        return pa.table([*columns, pa.array(share, mask=~full)], names=schema.names).filter(own)

    return parts.groupBy("series_id", "_part").applyInArrow(run, schema)

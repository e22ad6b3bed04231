"""Hourly bars over a stream: the batch aggregation under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_event_bars(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """``series_id, hour, open, high, low, close`` from a stream of ``event_id, ts, event_type, value``; an hour is final ``lateness`` after its end, and later events are left out."""
    place = F.struct("ts", "event_id", F.col("value").alias("px"))
    grouped = events.withWatermark("ts", lateness).groupBy(F.col("event_type").alias("series_id"), F.window("ts", "1 hour").alias("w"))
    out = grouped.agg(F.min_by("value", place).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", place).alias("close"))
    return out.select("series_id", F.col("w.start").alias("hour"), "open", "high", "low", "close")

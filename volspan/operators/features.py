"""Volatility series and ex-ante features: one ordered window pass per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volspan.functions.volatility import garman_klass, log_floor, log_return, realized_vol

HAR = ["rv1", "rv2", "rv5", "rv22"]
LOG_HAR = ["log_rv1", "log_rv2", "log_rv5", "log_rv22"]
RETURNS = ["ret_lag", "abs_ret_lag"]
FEATURES = ["rv", "return", *HAR, "log_rv", *LOG_HAR, "rv_neg", *RETURNS, "rv1_pctile"]


def by_time(key: str = "series_id", time: str = "dt"):
    return W.partitionBy(key).orderBy(time)


def full_mean(x: Column, first: int, last: int) -> Column:
    """Mean over the frame, null unless all its rows have values."""
    frame = by_time().rowsBetween(first, last)
    return F.when(F.count(x).over(frame) == last - first + 1, F.avg(x).over(frame))


def percentile_rank(x: Column, width: int) -> Column:
    """Share of the last ``width`` values, this one included, that are at most this one; null until the window is full of values."""
    values = F.collect_list(x).over(by_time().rowsBetween(1 - width, 0))
    return F.when((F.size(values) == width) & x.isNotNull(), F.size(F.filter(values, lambda v: v <= x)) / width)


def volatility_series(bars: DataFrame) -> DataFrame:
    """Bars with ``gk, rv, return``. A null price gives nulls in its row (and the next return), never the floor."""
    gk = garman_klass(F.col("open"), F.col("high"), F.col("low"), F.col("close"))
    return bars.withColumn("gk", gk).withColumn("rv", realized_vol(F.col("gk"))).withColumn("return", log_return(F.col("close"), F.lag("close").over(by_time())))


def lag_features(series: DataFrame) -> DataFrame:
    """Adds lags, shifted rolling means, their logs, signed and return features, and the trailing percentile of the last value; everything but ``rv, return, log_rv`` is known the day before."""
    w, rv = by_time(), F.col("rv")
    out = series.withColumns({"rv1": F.lag("rv").over(w), "rv2": F.lag("rv", 2).over(w), "rv5": full_mean(rv, -5, -1), "rv22": full_mean(rv, -22, -1), "log_rv": log_floor(rv), "ret_lag": F.lag("return").over(w)})
    log_rv = F.col("log_rv")
    out = out.withColumns({"log_rv1": F.lag("log_rv").over(w), "log_rv2": F.lag("log_rv", 2).over(w), "log_rv5": full_mean(log_rv, -5, -1), "log_rv22": full_mean(log_rv, -22, -1)})
    out = out.withColumn("rv_neg", F.when(F.col("ret_lag") < 0, F.col("rv1")).otherwise(0.0)).withColumn("abs_ret_lag", F.abs("ret_lag"))
    return out.withColumn("rv1_pctile", percentile_rank(F.col("rv1"), 252))


def forward_mean(series: DataFrame, horizon: int = 5) -> DataFrame:
    """Adds ``target``, the mean of the next ``horizon`` values; null at the end."""
    return series.withColumn("target", full_mean(F.col("rv"), 1, horizon))


def feature_table(bars: DataFrame) -> DataFrame:
    """``series_id, dt`` and the 15 features; rows with a null are dropped."""
    return lag_features(volatility_series(bars)).select("series_id", "dt", *[F.col(f"`{c}`") for c in FEATURES]).dropna()


def mark_events(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Adds ``event_day`` (1.0 or 0.0) for dates in the calendar."""
    days = calendar.select(F.col("event_date").alias("dt"), F.lit(1.0).alias("event_day")).distinct()
    return df.join(days, "dt", "left").fillna(0.0, ["event_day"])


def last_known(df: DataFrame, changes: DataFrame, columns: list[str], time: str = "dt") -> DataFrame:
    """As-of join: the latest row of ``changes`` (``series_id``, time, columns) at or before each row; one ordered pass over the union."""
    none = [F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in columns]
    both = df.select("*", *none, F.lit(1).alias("_side")).unionByName(changes.select("series_id", time, *columns, F.lit(0).alias("_side")), allowMissingColumns=True)
    w = W.partitionBy("series_id").orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns}).filter("_side = 1").drop("_side")

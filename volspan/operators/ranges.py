"""A long series over many tasks: ranges of time with about equally many rows, each with the rows that its windows need from the ranges beside it.

Windows of bounded width are computed within (series, range) over a halo of their width; running sums and last values are computed within a range and carried over by one row a range. No task
holds a series: the tables that meet a series as a whole have one row a series, or one a range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volspan.operators import features as fe
from volspan.operators.walk_forward import MIN_TRAIN, REFIT_EVERY, TEST_MONTHS

#: Rows before a row that its features reach: 252 lagged values.
FEATURE_HALO = 253


def cut(rows: DataFrame, ranges: int, time: str = "dt") -> DataFrame:
    """Adds ``_range``, 0 to ``ranges - 1`` in order of time, by approximate quantiles of each series' times; equal times stay together."""
    at = F.col(time).cast("timestamp").cast("double")
    bounds = rows.groupBy("series_id").agg(F.percentile_approx(at, [k / ranges for k in range(1, ranges)], 10_000).alias("_bounds")) if ranges > 1 else rows.select("series_id", F.array().cast("array<double>").alias("_bounds")).distinct()
    return rows.join(bounds, "series_id").withColumn("_range", F.size(F.filter("_bounds", lambda b: b < at))).drop("_bounds")


def placed(rows: DataFrame, ranges: int, time: str = "dt") -> DataFrame:
    """Adds ``_range``, ``_pos`` (the row's number in its series, from 1) and ``_ends`` (rows of the series up to the end of each range); times are unique in a series."""
    rows = cut(rows, ranges, time)
    counts = rows.groupBy("series_id", "_range").agg(F.count("*").alias("_n"))
    upto = lambda k: F.aggregate(F.filter("_c", lambda c: c["_range"] <= k), F.lit(0).cast("long"), lambda s, c: s + c["_n"])
    ends = counts.groupBy("series_id").agg(F.collect_list(F.struct("_range", "_n")).alias("_c")).select("series_id", F.transform(F.sequence(F.lit(0), F.lit(ranges - 1)), upto).alias("_ends"))
    before = F.when(F.col("_range") > 0, F.get("_ends", F.col("_range") - 1)).otherwise(0)
    return rows.join(ends, "series_id").withColumn("_pos", F.row_number().over(W.partitionBy("series_id", "_range").orderBy(time)) + before)


def with_halo(rows: DataFrame, ranges: int, before: int, after: int = 0, time: str = "dt") -> DataFrame:
    """Rows in every range that needs them (``_part``), as one of its own (``_own``) or of the ``before`` rows before its first or the ``after`` rows after its last."""
    rows = placed(rows, ranges, time)
    start = lambda j: F.when(j > 0, F.get("_ends", j - 1)).otherwise(0)
    needed = lambda j: (F.col("_pos") > start(j) - before) & (F.col("_pos") <= F.get("_ends", j) + after) & (F.get("_ends", j) > start(j))
    out = rows.withColumn("_part", F.explode(F.filter(F.sequence(F.lit(0), F.lit(ranges - 1)), needed)))
    return out.withColumn("_own", F.col("_part") == F.col("_range")).drop("_ends", "_range")


def in_ranges(rows: DataFrame, f: Callable[[DataFrame], DataFrame], ranges: int, before: int, after: int = 0) -> DataFrame:
    """``f(rows)`` by ranges, for an ``f`` that adds columns by windows within ``series_id`` reaching at most so many rows."""
    parts = with_halo(rows, ranges, before, after)
    out = f(parts.withColumn("series_id", F.struct("series_id", "_part"))).filter("_own")
    return out.withColumn("series_id", F.col("series_id.series_id")).drop("_part", "_own", "_pos")


def feature_table(bars: DataFrame, ranges: int) -> DataFrame:
    """``features.feature_table`` by ranges."""
    out = in_ranges(bars, lambda b: fe.lag_features(fe.volatility_series(b)), ranges, FEATURE_HALO)
    return out.select("series_id", "dt", *[F.col(f"`{c}`") for c in fe.FEATURES]).dropna()


def schedule(features: DataFrame, ranges: int, months: int = TEST_MONTHS, every: int = REFIT_EVERY, least: int = MIN_TRAIN) -> DataFrame:
    """``walk_forward.schedule`` by ranges: row numbers are placed, and the rest follows from the number of rows before the split date."""
    rows = placed(features, ranges).withColumn("rn", (F.col("_pos") - 1).cast("int")).drop("_pos", "_ends", "_range")
    last = features.groupBy("series_id").agg(F.add_months(F.max("dt"), -months).alias("split_date"))
    known = features.join(last, "series_id").groupBy("series_id", "split_date").agg(F.count_if(F.col("dt") <= F.col("split_date")).alias("_before"))
    out = rows.join(known, "series_id").withColumn("is_test", F.col("dt") > F.col("split_date"))
    out = out.withColumn("i", F.when(F.col("is_test"), F.col("rn") - F.col("_before"))).withColumn("refit_id", F.floor(F.col("i") / every).cast("int"))
    out = out.withColumn("usable", F.col("is_test") & (F.col("rn") >= least))
    return out.withColumn("is_refit", F.coalesce(F.col("usable") & (F.col("rn") == F.greatest(F.col("_before") + F.col("refit_id") * every, F.lit(least))), F.lit(False))).drop("_before")


def refit_moments(scheduled: DataFrame, columns: list[str], rollings: list[int], ranges: int, embargo: int = 0) -> DataFrame:
    """``walk_forward.refit_moments`` by ranges: running sums within a range, plus the sums of the ranges before it."""
    first = scheduled.groupBy("series_id").agg(F.min_by(F.array(*columns), "dt").alias("shift"))
    refits = scheduled.filter("is_refit").select("series_id", "refit_id", F.col("dt").alias("refit_date"), F.col("rn").cast("int").alias("_at"))
    rows = cut(scheduled.select("series_id", "dt", "rn", *columns), ranges).join(first, "series_id")
    z = [F.col(c) - F.col("shift")[k] for k, c in enumerate(columns)]
    values = z + [z[a] * z[b] for a in range(len(z)) for b in range(a + 1)]
    names = [f"_v{k}" for k in range(len(values))]
    rows = rows.select("series_id", "_range", "dt", "rn", *[v.alias(n) for v, n in zip(values, names, strict=True)])
    each = rows.groupBy("series_id", "_range").agg(*[F.sum(n).alias(n) for n in names])
    earlier = W.partitionBy("series_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    carried = each.select("series_id", "_range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0.0)).alias(f"_c{n}") for n in names])
    within = W.partitionBy("series_id", "_range").orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    running = rows.select("series_id", "_range", "rn", *[F.sum(n).over(within).alias(n) for n in names]).join(carried, ["series_id", "_range"])
    running = running.select("series_id", F.col("rn").alias("_row"), F.array(*[F.col(n) + F.col(f"_c{n}") for n in names]).alias("_sums"))
    zero = F.array(*[F.lit(0.0)] * len(names))
    out = refits
    for r in [0, *rollings]:
        mine = running.select("series_id", F.col("_row").alias(f"_row{r}"), F.col("_sums").alias(f"_sums{r}"))
        out = out.withColumn(f"_row{r}", F.col("_at") - 1 - embargo - r).join(mine, ["series_id", f"_row{r}"], "left").withColumn(f"_sums{r}", F.coalesce(f"_sums{r}", zero))
    out = out.join(first, "series_id").withColumn("n", F.greatest(F.col("_at") - embargo, F.lit(0))).withColumn("sums", F.col("_sums0"))
    for r in rollings:
        out = out.withColumn(f"n_{r}", F.least("n", F.lit(r))).withColumn(f"sums_{r}", F.zip_with("_sums0", f"_sums{r}", lambda a, b: a - b))
    return out.select("series_id", "refit_id", "refit_date", "shift", "n", "sums", *[c for r in rollings for c in (f"n_{r}", f"sums_{r}")])


def last_known(df: DataFrame, changes: DataFrame, columns: list[str], ranges: int, time: str = "dt") -> DataFrame:
    """``features.last_known`` by ranges: the last values of the ranges before are carried into each."""
    none = [F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in columns]
    both = df.select("*", *none, F.lit(1).alias("_side")).unionByName(changes.select("series_id", time, *columns, F.lit(0).alias("_side")), allowMissingColumns=True)
    both = cut(both, ranges, time)
    known = both.groupBy("series_id", "_range").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(time, "_side"))).alias(f"_l{c}") for c in columns])
    earlier = W.partitionBy("series_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    carried = known.select("series_id", "_range", *[F.last(f"_l{c}", ignorenulls=True).over(earlier).alias(f"_c{c}") for c in columns])
    within = W.partitionBy("series_id", "_range").orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumns({c: F.last(c, ignorenulls=True).over(within) for c in columns}).filter("_side = 1").join(carried, ["series_id", "_range"])
    return out.withColumns({c: F.coalesce(c, f"_c{c}") for c in columns}).drop("_side", "_range", *[f"_c{c}" for c in columns])


def acf(rows: DataFrame, value: str, lags: int, ranges: int) -> DataFrame:
    """``diagnostics.acf`` of each series by ranges: ``series_id, n, acf``."""
    mean = rows.groupBy("series_id").agg(F.avg(value).alias("_mean"))
    rows = rows.join(mean, "series_id").select("series_id", "dt", (F.col(value) - F.col("_mean")).alias("_x"))
    w = fe.by_time()
    lagged = in_ranges(rows, lambda r: r.select("*", *[F.lag("_x", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)]), ranges, lags)
    out = lagged.groupBy("series_id").agg(F.count("_x").alias("n"), *[F.sum(F.col("_x") * F.col("_x" if k == 0 else f"_l{k}")).alias(f"_s{k}") for k in range(lags + 1)])
    whole = F.when(F.col("_s0") > 0, F.col("_s0"))
    return out.select("series_id", "n", F.array(*[F.when(F.col("_s0") > 0, F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) / whole) for k in range(lags + 1)]).alias("acf"))

"""Data of the reports: thresholds, summaries, chart tables, audits, tallies and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspan.functions.volatility import FORECAST_FLOOR, floored
from volspan.operators import corrections as cor
from volspan.operators import features as fe

#: What a stored history keeps of a refit, beside ``series_id`` and its date ``dt``.
HISTORY = ["c", "k", "alpha_pooled", "beta_pooled", "har_intercept", "har_coef"]


def crisis_threshold(features: DataFrame, scheduled: DataFrame | None = None, kind: str = "training") -> DataFrame:
    """``series_id, threshold``: the 0.9 quantile of rv over ``training`` rows (before the first test row), ``before_split`` rows (before the split date), ``test`` rows or ``all`` rows."""
    rows = features if scheduled is None else scheduled
    keep = {"training": "not is_test", "before_split": "dt < split_date", "test": "is_test", "all": "true"}[kind]
    return rows.filter(keep).groupBy("series_id").agg(F.percentile("rv", 0.9).alias("threshold"))


def summary(series: DataFrame, features: DataFrame) -> DataFrame:
    """Row counts, dates and moments of the volatility series."""
    raw = series.groupBy("series_id").agg(F.count("*").alias("raw_rows"), F.min("dt").alias("date_start"), F.max("dt").alias("date_end"), F.avg("rv").alias("rv_mean"), F.stddev_samp("rv").alias("rv_std"), F.min("rv").alias("rv_min"), F.max("rv").alias("rv_max"), F.percentile("rv", 0.9).alias("rv_p90"))
    return raw.join(features.groupBy("series_id").agg(F.count("*").alias("feature_rows")), "series_id", "left").fillna(0, ["feature_rows"])


def top_forecasts(forecasts: DataFrame, ranked: DataFrame, k: int = 3) -> DataFrame:
    """Rows of the ``k`` best models by RMSE of each series, with their rank."""
    best = ranked.filter(F.col("rank_by_rmse") <= k).select("series_id", "model", "rank_by_rmse")
    return forecasts.join(best, ["series_id", "model"])


def verdicts(scored: DataFrame, base: str) -> DataFrame:
    """Per series: the best model by each metric, and whether any beats the base model by QLIKE."""
    overall = scored.filter("subsample = 'overall'")
    reference = F.max(F.when(F.col("model") == base, F.col("qlike")))
    return overall.groupBy("series_id").agg(F.min_by("model", F.struct("rmse", "model")).alias("best_rmse"), F.min_by("model", F.struct("qlike", "model")).alias("best_qlike"), (F.min(F.when(F.col("model") != base, F.col("qlike"))) < reference).alias("any_beats_base"))


def refit_audit(coefs: DataFrame) -> DataFrame:
    """Per series and model: number of refits, least and most training rows, whether every fit has a finite intercept."""
    return coefs.groupBy("series_id", "model").agg(F.count("*").alias("refits"), F.min("n_train").alias("n_first"), F.max("n_train").alias("n_last"), F.bool_and(~F.isnan("intercept")).alias("all_finite"))


def dm_tally(tests: DataFrame) -> DataFrame:
    """Number of tests and of rejections at 5 % by subsample and loss, with the number that chance alone would reject."""
    return tests.groupBy("subsample", "loss").agg(F.count("*").alias("n_tests"), F.count_if(F.col("p_value") < 0.05).alias("n_rejected"), (F.count("*") * 0.05).alias("n_by_chance"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metric rows of one model before and after a change, side by side with the largest absolute difference of the forecasts."""
    both = before.select("series_id", "dt", "actual", F.col("forecast").alias("before")).join(after.select("series_id", "dt", F.col("forecast").alias("after")), ["series_id", "dt"])
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col("actual") - F.col(c), 2)))
    return both.groupBy("series_id").agg(F.count("*").alias("n"), rmse("before").alias("rmse_before"), rmse("after").alias("rmse_after"), F.max(F.abs(F.col("before") - F.col("after"))).alias("max_abs_diff"))


def rebuilt_blend(rows: DataFrame, history: DataFrame) -> DataFrame:
    """``series_id, dt, c, k, rebuilt``: the blend of the pooled line and the first model, from a stored table of refits (``HISTORY``) whose settings are carried forward by date. ``rows``
    have volatility, features and percentile; a row before the first refit has nulls."""
    known = fe.last_known(rows.select("series_id", "dt", "sigma", "rv1_pctile", *fe.HAR), history.select("series_id", "dt", *HISTORY), HISTORY)
    har = F.col("har_intercept")
    for j, f in enumerate(fe.HAR):
        har = har + F.col("har_coef")[j] * F.col(f)
    first = F.col("alpha_pooled") + F.col("beta_pooled") * F.col("sigma")
    return known.select("series_id", "dt", "c", "k", cor.blend(F.col("rv1_pctile"), F.col("c"), F.col("k"), first, floored(har, FORECAST_FLOOR))[1].alias("rebuilt"))


def reconstruction(rebuilt: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Per series: rows, the rebuilt mean, and the largest difference between rebuilt and given forecasts; a row that only one side has makes it infinite."""
    both = forecasts.select("series_id", "dt", "forecast").join(rebuilt.select("series_id", "dt", "rebuilt"), ["series_id", "dt"], "full")
    off = F.coalesce(F.abs(F.col("forecast") - F.col("rebuilt")), F.lit(float("inf")))
    return both.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("rebuilt").alias("mean_rebuilt"), F.max(off).alias("max_abs_diff"))

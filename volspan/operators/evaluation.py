"""Forecast evaluation by subsample: accuracy, Diebold-Mariano, Mincer-Zarnowitz and encompassing tests, as grouped moments.

``forecasts`` is long: ``series_id, dt, model, actual, forecast`` and, for subsamples, a boolean ``crisis``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volspan.functions.distributions import f_two_p, student_t_p
from volspan.functions.volatility import dm_verdict, loss, stars

LOSSES = ("mse", "mae", "qlike")


def label_regimes(forecasts: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds ``crisis``: the actual is above the series' ``threshold``; null for a series without one."""
    return forecasts.join(thresholds, "series_id", "left").withColumn("crisis", F.col("actual") > F.col("threshold")).drop("threshold")


def _subsample() -> Column:
    return F.when(F.col("_all") == 1, "overall").when(F.col("crisis").isNull(), "unknown").when(F.col("crisis"), "crisis").otherwise("calm").alias("subsample")


def losses_long(forecasts: DataFrame) -> DataFrame:
    """Adds ``sq_err`` and ``abs_err`` per row."""
    return forecasts.withColumn("sq_err", F.pow(F.col("actual") - F.col("forecast"), 2)).withColumn("abs_err", F.abs(F.col("actual") - F.col("forecast")))


def metrics(forecasts: DataFrame) -> DataFrame:
    """``rmse, mae, qlike`` per series, model and subsample (overall, crisis, calm) in one grouping."""
    a, f = F.col("actual"), F.col("forecast")
    grouped = forecasts.groupingSets([["series_id", "model", "crisis"], ["series_id", "model"]], "series_id", "model", "crisis")
    out = grouped.agg(F.grouping("crisis").alias("_all"), F.count("*").alias("n"), F.sqrt(F.avg(loss("mse", a, f))).alias("rmse"), F.avg(loss("mae", a, f)).alias("mae"), F.avg(loss("qlike", a, f)).alias("qlike"))
    return out.select("series_id", "model", _subsample(), "n", "rmse", "mae", "qlike")


def ranking(scored: DataFrame) -> DataFrame:
    """Overall metrics with ``rank_by_rmse`` and ``rank_by_qlike`` (ties by name)."""
    w = W.partitionBy("series_id")
    return scored.filter("subsample = 'overall'").drop("subsample").withColumn("rank_by_rmse", F.row_number().over(w.orderBy("rmse", "model"))).withColumn("rank_by_qlike", F.row_number().over(w.orderBy("qlike", "model")))


def _pairs(forecasts: DataFrame, pairs: DataFrame | list[tuple[str, str]]) -> DataFrame:
    """Rows with ``f1, f2`` for each pair (``first, second``) of models: each series' row gathers its forecasts once, and the pairs are taken from them."""
    listed = pairs if isinstance(pairs, list) else [(r[0], r[1]) for r in pairs.select("first", "second").collect()]  # a declared list
    models = sorted({m for p in listed for m in p})
    crisis = ["crisis"] if "crisis" in forecasts.columns else []
    wide = forecasts.filter(F.col("model").isin(models)).groupBy("series_id", "dt", "actual", *crisis).pivot("model", models).agg(F.first("forecast"))
    each = F.inline(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"`{a}`").alias("f1"), F.col(f"`{b}`").alias("f2")) for a, b in listed]))
    return wide.select("series_id", "dt", "actual", *crisis, each).filter("f1 is not null and f2 is not null")


def distinct_pairs(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Pairs in order, each once."""
    return list(dict.fromkeys(pairs))


def dm_tests(forecasts: DataFrame, pairs: DataFrame | list[tuple[str, str]], losses: tuple[str, ...] = LOSSES) -> DataFrame:
    """Diebold-Mariano tests per series, pair, loss and subsample: positive statistics favour the second; with ``p_value, stars, verdict``.

    Differences without variance give (0, 1). The small-sample factor is sqrt((n - 1 + 1/n) / n).
    """
    rows = _pairs(forecasts, pairs)
    d = F.explode(F.array(*[F.struct(F.lit(k).alias("loss"), (loss(k, F.col("actual"), F.col("f1")) - loss(k, F.col("actual"), F.col("f2"))).alias("d")) for k in losses])).alias("_d")
    rows = rows.select("series_id", "first", "second", "crisis", d).select("series_id", "first", "second", "crisis", "_d.loss", "_d.d")
    key = ["series_id", "first", "second", "loss"]
    out = rows.groupingSets([[*key, "crisis"], key], *key, "crisis").agg(F.grouping("crisis").alias("_all"), F.count("*").alias("n"), F.avg("d").alias("_m"), F.var_samp("d").alias("_v"))
    none = F.coalesce(F.col("_v") < 1e-15, F.lit(True))
    n = F.col("n").cast("double")
    stat = F.when(none, 0.0).otherwise(F.col("_m") / F.sqrt(F.when(none, 1.0).otherwise(F.col("_v")) / n) * F.sqrt((n - 1 + 1 / n) / n))
    out = out.withColumn("dm_stat", stat).withColumn("p_value", F.when(none, 1.0).otherwise(student_t_p(stat, F.col("n") - 1)))
    return out.select(*key, _subsample(), "n", "dm_stat", "p_value", stars(F.col("p_value")).alias("stars"), dm_verdict(F.col("dm_stat"), F.col("p_value")).alias("verdict"))


def mincer_zarnowitz(rows: DataFrame, key: list[str], y: str = "actual", x: str = "forecast") -> DataFrame:
    """Regression of y on x per key: ``alpha, alpha_se, beta, beta_se, r2`` and the joint F test of (0, 1)."""
    yy, xx = F.col(y), F.col(x)
    out = rows.groupBy(*key).agg(F.count("*").alias("n"), F.regr_intercept(yy, xx).alias("alpha"), F.regr_slope(yy, xx).alias("beta"), F.regr_r2(yy, xx).alias("r2"), F.regr_syy(yy, xx).alias("_syy"), F.regr_sxx(yy, xx).alias("_sxx"), F.avg(xx).alias("_mx"), F.sum(xx).alias("_x"), F.sum(xx * xx).alias("_xx"))
    n = F.col("n").cast("double")
    s2 = F.col("_syy") * (1 - F.col("r2")) / (n - 2)
    a, b = F.col("alpha"), F.col("beta")
    f = (n * a * a + 2 * a * (b - 1) * F.col("_x") + F.pow(b - 1, 2) * F.col("_xx")) / (2 * s2)
    enough = (F.col("n") > 2) & (F.col("_sxx") > 0) & (s2 > 0)
    out = out.withColumn("alpha_se", F.when(enough, F.sqrt(s2 * (1 / n + F.pow("_mx", 2) / F.col("_sxx"))))).withColumn("beta_se", F.when(enough, F.sqrt(s2 / F.col("_sxx")))).withColumn("f_stat", F.when(enough, f))
    return out.withColumn("f_pval", F.when(enough, f_two_p(F.col("f_stat"), n - 2))).select(*key, "n", "alpha", "alpha_se", "beta", "beta_se", "r2", "f_stat", "f_pval")


def encompassing(forecasts: DataFrame, pairs: DataFrame | list[tuple[str, str]]) -> DataFrame:
    """Regression of the actual on two forecasts without an intercept: ``b1, t1, p1, b2, t2, p2`` with n - 2 degrees of freedom."""
    a, f1, f2 = F.col("actual"), F.col("f1"), F.col("f2")
    out = _pairs(forecasts, pairs).groupBy("series_id", "first", "second").agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in (("_11", f1 * f1), ("_22", f2 * f2), ("_12", f1 * f2), ("_a1", a * f1), ("_a2", a * f2), ("_aa", a * a))])
    c = {k: F.col(k) for k in ("_11", "_22", "_12", "_a1", "_a2", "_aa")}
    det = c["_11"] * c["_22"] - c["_12"] * c["_12"]
    b1, b2 = (c["_22"] * c["_a1"] - c["_12"] * c["_a2"]) / det, (c["_11"] * c["_a2"] - c["_12"] * c["_a1"]) / det
    s2 = (c["_aa"] - b1 * c["_a1"] - b2 * c["_a2"]) / (F.col("n") - 2)
    out = out.filter((det > 0) & (F.col("n") > 2)).withColumns({"b1": b1, "b2": b2, "t1": b1 / F.sqrt(s2 * c["_22"] / det), "t2": b2 / F.sqrt(s2 * c["_11"] / det)})
    return out.select("series_id", "first", "second", "n", "b1", "t1", student_t_p(F.col("t1"), F.col("n") - 2).alias("p1"), "b2", "t2", student_t_p(F.col("t2"), F.col("n") - 2).alias("p2"))


def encompassing_with_best(forecasts: DataFrame, listed: list[tuple[str, str]], against: str, models: list[str]) -> DataFrame:
    """The listed pairs and each series' best model by RMSE with ``against``, each pair once; adds ``best`` and ``encompasses`` (the second adds nothing at 5 %)."""
    best = ranking(metrics(forecasts)).filter("rank_by_rmse = 1").select("series_id", F.col("model").alias("best"))
    found = encompassing(forecasts, distinct_pairs([*listed, *[(m, against) for m in models if m != against]]))
    wanted = F.concat_ws("|", "first", "second").isin(["|".join(p) for p in listed])
    return found.join(best, "series_id").filter(wanted | (F.col("first") == F.col("best"))).withColumn("encompasses", F.col("p2") > 0.05)


def wins(tests: DataFrame, base: str) -> DataFrame:
    """Per series: how many models are tested against the base by squared errors over all rows, how many beat it at 5 %, and which."""
    tests = tests.filter((F.col("first") == base) & (F.col("loss") == "mse") & (F.col("subsample") == "overall"))
    won = (F.col("dm_stat") > 0) & (F.col("p_value") < 0.05)
    return tests.groupBy("series_id").agg(F.count("*").alias("n_tests"), F.count_if(won).alias("n_wins"), F.array_join(F.array_sort(F.collect_list(F.when(won, F.col("second")))), ", ").alias("winners"))


def slope_difference(by_regime: DataFrame) -> DataFrame:
    """t of the difference between crisis and calm slopes, from ``mincer_zarnowitz`` rows with ``regime``."""
    pick = lambda c, r: F.max(F.when(F.col("regime") == r, F.col(c)))
    out = by_regime.groupBy("series_id").agg(*[pick(c, r).alias(f"{c}_{r}") for c in ("beta", "beta_se") for r in ("crisis", "calm")])
    return out.withColumn("difference", F.col("beta_crisis") - F.col("beta_calm")).withColumn("t", F.col("difference") / F.sqrt(F.pow("beta_se_crisis", 2) + F.pow("beta_se_calm", 2)))


def cumulative_difference(forecasts: DataFrame, base: str) -> DataFrame:
    """``csed``: running sum of the base model's squared errors less each other model's."""
    rows = losses_long(forecasts).select("series_id", "dt", "model", "sq_err")
    rows = rows.withColumn("_base", F.max(F.when(F.col("model") == base, F.col("sq_err"))).over(W.partitionBy("series_id", "dt")))
    other = rows.filter((F.col("model") != base) & F.col("_base").isNotNull())
    return other.select("series_id", "dt", "model", F.sum(F.col("_base") - F.col("sq_err")).over(W.partitionBy("series_id", "model").orderBy("dt").rowsBetween(W.unboundedPreceding, 0)).alias("csed"))


def long_to_wide(forecasts: DataFrame, models: list[str]) -> DataFrame:
    return forecasts.groupBy("series_id", "dt", "actual").pivot("model", models).agg(F.first("forecast"))


def wide_to_long(wide: DataFrame, models: list[str]) -> DataFrame:
    return wide.unpivot(["series_id", "dt", "actual"], models, "model", "forecast").filter("forecast is not null")


def weight_distribution(weights: DataFrame) -> DataFrame:
    """Blend weights ``w`` by ``regime``: count, mean, median, extremes, deciles and shares above 0.95 and 0.99."""
    w = F.col("w")
    return weights.groupBy("series_id", "regime").agg(F.count("*").alias("n"), F.avg(w).alias("mean"), F.percentile(w, 0.5).alias("median"), F.min(w).alias("min"), F.max(w).alias("max"), F.percentile(w, 0.1).alias("p10"), F.percentile(w, 0.9).alias("p90"), F.avg((w > 0.95).cast("double")).alias("frac_above_95"), F.avg((w > 0.99).cast("double")).alias("frac_above_99"))

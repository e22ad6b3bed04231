"""Named queries over the tables of a folder: one for each operator or family. Doubles are rounded, so that any engine's sums compare."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspan.operators import corrections as cor
from volspan.operators import diagnostics as dia
from volspan.operators import egarch
from volspan.operators import evaluation as ev
from volspan.operators import features as fe
from volspan.operators import quantiles as qu
from volspan.operators import ranges as ra
from volspan.operators import reports as rep
from volspan.operators import trailing
from volspan.operators import variance_pass as vp
from volspan.operators import walk_forward as wf
from volspan.operators import zoo
from volspan.sources import bars as src
from volspan.sources.stored import new_folder, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
M1 = wf.SPECS[0]
COMBINED = wf.Spec("M3 Combined", (*fe.HAR, "sigma"))
LOG_BEFORE = wf.Spec("M4 Log-HAR", tuple(fe.LOG_HAR), target="log_rv", log=True, smear=False)
MACRO = wf.Spec("M1-macro", (*fe.HAR, "event_day"))
INFERENCE = wf.Spec("two features", ("rv1", "rv22"))
H5 = wf.Spec("M1_h5", tuple(fe.HAR), target="target")


#: Decimal places of columns on the scale of prices or of their squares; others have six. Bars are exact and aren't rounded.
PLACES = {"actual": 4, "forecast": 4, "m1": 4, "m5": 4, "sq_err": 2, "abs_err": 4, "rmse": 4, "mae": 4, "csed": 2, "open": None, "high": None, "low": None, "close": None}


def rounded(df: DataFrame) -> DataFrame:
    place = lambda c: PLACES.get(c, 6)
    return df.select([(F.round(f"`{c}`", place(c)) + 0.0).alias(c) if t == "double" and place(c) is not None else F.col(f"`{c}`") for c, t in df.dtypes])


class Tables(str):
    """A folder's path, beside the bars that a query derived from its tables and wrote once."""

    bars: DataFrame | None = None


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, Tables(sf_dir)))
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars. Within a query they are derived once and written; each use has columns of its own."""
    found = sf_dir.bars if isinstance(sf_dir, Tables) else None
    if found is None:
        found = stored(src.lineitem_bars(table(spark, sf_dir, "lineitem")))
        if isinstance(sf_dir, Tables):
            sf_dir.bars = found
    return found.toDF(*found.columns)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.volatility_series(bars(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.feature_table(bars(spark, sf_dir))


def scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wf.schedule(features(spark, sf_dir))


def with_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled features beside the volatility filtered under the fixed parameters."""
    return scheduled(spark, sf_dir).join(egarch.filter_fixed(series(spark, sf_dir)), ["series_id", "dt"])


def fixed_lines(spark: SparkSession, sf_dir: str, qlike: bool = False, blends: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scheduled features with the fixed parameters' volatility, refits with their lines and, if asked for, QLIKE lines and blends of lines)."""
    rows = with_sigma(spark, sf_dir)
    found = vp.with_lines(vp.summed(rows, egarch.refits_of(rows)))
    if blends:
        har = wf.fit_models(rows, [M1]).select(*cor.KEY, F.col("intercept").alias("har_intercept"), F.col("coef").alias("har_coef"))
        found = found.join(har, cor.KEY)
    return rows, vp.chosen(rows, found, blends or [], qlike) if qlike or blends else found


def evaluated(spark: SparkSession, sf_dir: str, specs: list[wf.Spec] | None = None) -> DataFrame:
    """Forecasts of the model zoo, labelled by the training threshold."""
    rows = scheduled(spark, sf_dir)
    found = wf.predict(rows, wf.fit_models(rows, specs or wf.SPECS), specs or wf.SPECS)
    return ev.label_regimes(found, rep.crisis_threshold(rows, rows))


VS_BASE = [(M1.name, s.name) for s in wf.SPECS[1:]]


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of the linear models and, under the fixed variance parameters, of M2, M2b, M2c and M3, labelled by the training threshold."""
    rows, refits = fixed_lines(spark, sf_dir)
    lines = vp.served_rows(rows, refits, ["rv"])
    values = {zoo.RAW: F.col("sigma"), **{name: cor.corrected(F.col("sigma"), F.col("p"), kind) for name, kind in ((zoo.POOLED, "pooled"), (zoo.REGIME, "regime"))}}
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("model"), cor.floored(v, cor.FORECAST_FLOOR).alias("forecast")) for name, v in values.items()]))
    mine = lines.select("series_id", "dt", F.col("rv").alias("actual"), each).select("series_id", "dt", "model", "actual", "forecast")
    specs = [*wf.SPECS, COMBINED]
    found = wf.predict(rows, wf.fit_models(rows, specs), specs).unionByName(mine)
    return ev.label_regimes(found, rep.crisis_threshold(rows, rows))


REPORTED = [*[s.name for s in wf.SPECS], COMBINED.name, zoo.RAW, zoo.POOLED, zoo.REGIME]
REPORT_PAIRS = ev.distinct_pairs([*[(M1.name, m) for m in REPORTED[1:]], (zoo.RAW, zoo.POOLED), (zoo.RAW, zoo.REGIME), (zoo.POOLED, zoo.REGIME), (M1.name, zoo.RAW)])


# Sources, projections, windows


@query
def daily_bars(spark, d):
    return bars(spark, d)


@query
def hourly_bars(spark, d):
    return src.event_bars(table(spark, d, "events"))


@query
def gk_realized_vol(spark, d):
    return series(spark, d).select("series_id", "dt", "gk", "rv", fe.log_floor(F.col("rv")).alias("log_rv"))


@query
def log_returns(spark, d):
    return series(spark, d).select("series_id", "dt", "return", F.abs("return").alias("abs_return"))


@query
def har_lags(spark, d):
    return fe.lag_features(series(spark, d)).select("series_id", "dt", *fe.HAR)


@query
def log_har_lags(spark, d):
    return fe.lag_features(series(spark, d)).select("series_id", "dt", *fe.LOG_HAR)


@query
def asym_return_features(spark, d):
    return fe.lag_features(series(spark, d)).filter("rv1 is not null and ret_lag is not null").select("series_id", "dt", "rv_neg", *fe.RETURNS)


@query
def rolling_pct_rank_252(spark, d):
    return fe.lag_features(series(spark, d)).select("series_id", "dt", "rv1_pctile")


@query
def forward_mean_target_5(spark, d):
    return fe.forward_mean(series(spark, d)).select("series_id", "dt", "target")


@query
def feature_table(spark, d):
    return features(spark, d)


@query
def data_summary(spark, d):
    return rep.summary(series(spark, d), features(spark, d))


@query
def bars_csv_round_trip(spark, d):
    path = new_folder(spark)
    src.write_table(bars(spark, d), path)
    return src.read_csv(spark, path, src.BAR_SCHEMA, "fail")


@query
def bars_parquet_round_trip(spark, d):
    path = new_folder(spark)
    src.write_table(bars(spark, d), path, "parquet")
    return src.read_bars(spark, path)


@query
def csv_malformed_lines(spark, d):
    """Lines of text, some with a field missing, one too many or no number where one belongs: what the reader reports, by the first field."""
    field = lambda *x: F.concat_ws(",", "l_returnflag", *x)
    day, quantity, n = F.to_date("l_shipdate").cast("string"), F.col("l_quantity").cast("double").cast("string"), F.col("l_linenumber")
    line = F.when(n == 5, field(day)).when(n == 6, field(day, F.lit("n/a"))).when(n == 7, field(day, quantity, F.lit("more"))).otherwise(field(day, quantity))
    path = new_folder(spark)
    table(spark, d, "lineitem").select(line.alias("value")).write.text(path)
    found = src.read_csv(spark, path, "flag string, day date, quantity double", "report", header=False)
    good = F.col("bad_line").isNull()
    return found.groupBy("flag").agg(F.count_if(good).alias("n_good"), F.count_if(~good).alias("n_bad"), F.sum(F.when(good, F.col("quantity"))).alias("quantity"), F.max(F.when(good, F.col("day"))).alias("last_day"))


# Splits, schedules, regimes, lookups


@query
def train_test_split(spark, d):
    return scheduled(spark, d).groupBy("series_id", "split_date").agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"))


@query
def refit_schedule(spark, d):
    return scheduled(spark, d).filter("is_refit").select("series_id", "refit_id", F.col("dt").alias("refit_date"), F.col("rn").alias("n_train"))


@query
def crisis_thresholds(spark, d):
    rows = scheduled(spark, d)
    kinds = ["training", "before_split", "test", "all"]
    out = [rep.crisis_threshold(rows, rows, k).withColumn("kind", F.lit(k)) for k in kinds]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query
def regime_labels_exante(spark, d):
    return features(spark, d).withColumn("regime", F.when(cor.in_crisis(F.col("rv1_pctile")), "crisis").otherwise("calm")).groupBy("series_id", "regime").agg(F.count("*").alias("n"), F.avg("rv").alias("mean_rv"))


@query
def regime_labels_eval(spark, d):
    rows = scheduled(spark, d)
    return rows.filter("is_test").join(rep.crisis_threshold(rows, rows), "series_id").select("series_id", "dt", "rv", (F.col("rv") > F.col("threshold")).alias("crisis"))


@query
def event_dummy(spark, d):
    return fe.mark_events(bars(spark, d).select("series_id", "dt"), src.order_calendar(table(spark, d, "orders")))


@query
def event_calendar(spark, d):
    return src.order_calendar(table(spark, d, "orders"))


@query
def asof_params(spark, d):
    rows = scheduled(spark, d)
    changes = rows.filter("is_refit").select("series_id", "dt", F.col("rn").alias("n_train"))
    return fe.last_known(rows.filter("is_test").select("series_id", "dt"), changes, ["n_train"])


# Walk-forward models


@query
def expanding_ols_1f(spark, d):
    w = fe.by_time().rowsBetween(fe.W.unboundedPreceding, -1)
    rows = scheduled(spark, d).withColumn("slope", F.regr_slope("rv", "rv1").over(w)).withColumn("intercept", F.regr_intercept("rv", "rv1").over(w))
    return rows.filter("is_refit").select("series_id", "refit_id", "slope", "intercept")


def _model(k: int):
    return lambda spark, d: wf.walk_forward(features(spark, d), [wf.SPECS[k]])


for _k, _name in enumerate(["har_ols_walk_forward", "log_har_smearing", "asym_har", "har_returns", "rolling_ols_1000", "ridge_kitchen_sink"]):
    QUERIES[_name] = (lambda f: lambda spark, d: rounded(f(spark, Tables(d))))(_model(_k))


@query
def macro_walk_forward(spark, d):
    rows = fe.mark_events(features(spark, d), src.order_calendar(table(spark, d, "orders")))
    return wf.walk_forward(rows, [MACRO])


@query
def h5_walk_forward(spark, d):
    rows = features(spark, d).join(fe.forward_mean(series(spark, d)).select("series_id", "dt", "target"), ["series_id", "dt"]).dropna(subset=["target"])
    return wf.walk_forward(rows, [H5], embargo=5)


def _five_ahead(spark, d):
    """(scheduled features with the five-row target, refits by an embargoed history under their own fitted parameters, which serve simulated volatilities)."""
    ahead = fe.forward_mean(series(spark, d)).select("series_id", "dt", "target")
    rows = wf.schedule(features(spark, d).join(ahead, ["series_id", "dt"]).dropna(subset=["target"]), least=wf.MIN_TRAIN + 5)
    return rows, vp.summed(rows, egarch.fit_refits(rows, embargo=5), "target", horizon=5, embargo=5)


@query
def h5_sim_raw(spark, d):
    rows, refits = _five_ahead(spark, d)
    return vp.served_rows(rows, refits, ["target"]).select("series_id", "dt", F.col("target").alias("actual"), cor.floored(F.col("sigma"), cor.FORECAST_FLOOR).alias("forecast"))


@query
def h5_combined(spark, d):
    rows, refits = _five_ahead(spark, d)
    served = vp.served_rows(rows, vp.with_combined(refits, "M3_h5", "target"), ["target", *fe.HAR])
    total = F.col("both_intercept") + F.col("both_coef")[4] * F.col("sigma")
    for k, f in enumerate(fe.HAR):
        total = total + F.col("both_coef")[k] * F.col(f)
    return served.select("series_id", "dt", F.lit("M3_h5").alias("model"), F.col("target").alias("actual"), cor.floored(total, cor.FORECAST_FLOOR).alias("forecast"))


@query
def ols_inference(spark, d):
    coefs = wf.fit_models(scheduled(spark, d), [INFERENCE])
    names = F.array(*[F.lit(x) for x in ("const", *INFERENCE.features)])
    rows = coefs.select("series_id", "refit_id", "n_train", "df", F.explode(F.arrays_zip(names.alias("feature"), F.concat(F.array("intercept"), "coef").alias("coef"), "se")).alias("v"))
    rows = rows.select("series_id", "refit_id", "n_train", "df", "v.feature", "v.coef", "v.se").withColumn("t", F.col("coef") / F.col("se"))
    return rows.withColumn("p", ev.student_t_p(F.col("t"), F.col("df"))).drop("df")


# Conditional variance, corrections, blends


@query
def egarch_filter_fixed(spark, d):
    return egarch.filter_fixed(series(spark, d))


@query
def egarch_h1_fixed(spark, d):
    found = egarch.one_step(egarch.filter_fixed(series(spark, d)))
    return scheduled(spark, d).filter("usable").select("series_id", "dt", F.col("rv").alias("actual")).join(found, ["series_id", "dt"])


def _params(found: DataFrame) -> DataFrame:
    return found.select("series_id", "refit_id", "n_train", *egarch.PARAMS, "loglik", "grad_norm", "converged", "nu_at_bound")


@query
def egarch_fit(spark, d):
    return _params(egarch.fit_refits(scheduled(spark, d)))


@query
def egarch_fit_chained(spark, d):
    return _params(egarch.fit_refits(scheduled(spark, d), chained=True))


def fitted(spark, d):
    """(scheduled features, variance parameters fitted at every refit)."""
    rows = scheduled(spark, d)
    return rows, egarch.fit_refits(rows)


@query
def egarch_refit_filter(spark, d):
    """Of each refit's own filter: rows of history, mean volatility over them, and the volatility of the first row that it serves."""
    found = vp.summed(*fitted(spark, d))
    return found.select("series_id", "refit_id", F.col("sums")[0].cast("long").alias("n"), (F.col("sums")[1] / F.col("sums")[0]).alias("mean_sigma"), F.col("served")[0]["sigma"].alias("first_sigma"))


@query
def egarch_h5_sim(spark, d):
    return egarch.simulate(series(spark, d))


@query
def mz_correction_audit(spark, d):
    return fixed_lines(spark, d)[1].select("series_id", "refit_id", "n_train", *[f"{x}_{r}" for r in vp.REGIMES for x in ("beta", "alpha", "n") if (x, r) != ("n", "pooled")], "crisis_stable", "calm_stable")


def _corrected(spark, d, kind: str, qlike: bool = False):
    rows, refits = fixed_lines(spark, d, qlike)
    value = cor.corrected(F.col("sigma"), F.col("p"), kind, "d_" if qlike else "")
    return vp.served_rows(rows, refits, ["rv"]).select("series_id", "dt", F.col("rv").alias("actual"), cor.floored(value, cor.FORECAST_FLOOR).alias("forecast"))


@query
def mz_pooled_correction(spark, d):
    return _corrected(spark, d, "pooled")


@query
def mz_regime_correction(spark, d):
    return _corrected(spark, d, "regime")


@query
def regime_switch_correction(spark, d):
    return _corrected(spark, d, "switch")


@query
def qlike_affine_fit(spark, d):
    found = fixed_lines(spark, d, qlike=True)[1]
    return found.select("series_id", "refit_id", *[f"{x}_d_{r}" for r in vp.REGIMES for x in ("alpha", "beta", "converged")])


@query
def qlike_corrections(spark, d):
    rows, refits = fixed_lines(spark, d, qlike=True)
    served = vp.served_rows(rows, refits, ["rv"])
    kinds = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), cor.floored(cor.corrected(F.col("sigma"), F.col("p"), k, "d_"), cor.FORECAST_FLOOR).alias("forecast")) for k in ("pooled", "regime", "switch")]))
    return served.select("series_id", "dt", F.col("rv").alias("actual"), kinds)


@query
def combined_har_sigma(spark, d):
    rows = with_sigma(spark, d)
    return wf.predict(rows, wf.fit_models(rows, [COMBINED]), [COMBINED])


@query
def logistic_grid_search(spark, d):
    found = fixed_lines(spark, d, blends=["pooled"])[1]
    return found.select("series_id", "refit_id", *[F.col(f"{x}_pooled").alias(x) for x in ("c", "k", "train_qlike")])


def _blended(spark, d, line: str):
    rows, refits = fixed_lines(spark, d, line in ("q_regime", "switch"), [line])
    har = F.col("har_intercept")
    for k, f in enumerate(M1.features):
        har = har + F.col("har_coef")[k] * F.col(f)
    first = cor.corrected(F.col("sigma"), F.col("p"), *cor.LINES[line])
    w, blend = cor.blend(F.col("p"), F.col(f"c_{line}"), F.col(f"k_{line}"), first, cor.floored(har, cor.FORECAST_FLOOR))
    regime = F.when(cor.in_crisis(F.col("p")), "crisis").otherwise("calm")
    return vp.served_rows(rows, refits, ["rv", *fe.HAR]).select("series_id", "dt", F.col("rv").alias("actual"), blend.alias("forecast"), w.alias("w"), regime.alias("regime"))


@query
def regime_blend(spark, d):
    return _blended(spark, d, "pooled")


@query
def regime_blend_split(spark, d):
    return _blended(spark, d, "regime")


@query
def regime_blend_qlike(spark, d):
    return _blended(spark, d, "q_regime")


@query
def regime_blend_switch(spark, d):
    return _blended(spark, d, "switch")


@query
def weight_distribution(spark, d):
    return ev.weight_distribution(_blended(spark, d, "pooled"))


@query
def regime_blend_rebuilt(spark, d):
    """The blend's forecasts against those rebuilt from a written table of its refits."""
    rows, refits = fixed_lines(spark, d, blends=["pooled"])
    dates = rows.filter("is_refit").select("series_id", "refit_id", "dt")
    history = stored(refits.withColumnsRenamed({"c_pooled": "c", "k_pooled": "k"}).join(dates, cor.KEY).select("series_id", "dt", *rep.HISTORY))
    found = rep.reconstruction(rep.rebuilt_blend(rows.filter("usable"), history), _blended(spark, d, "pooled"))
    return found.select("series_id", "n", "mean_rebuilt", (F.col("max_abs_diff") < 1e-12).alias("equal"))


# One series over many tasks: the same results by ranges of time
RANGES = 8


@query
def feature_table_in_ranges(spark, d):
    return ra.feature_table(bars(spark, d), RANGES)


@query
def refit_schedule_in_ranges(spark, d):
    return ra.schedule(ra.feature_table(bars(spark, d), RANGES), RANGES).filter("is_refit").select("series_id", "refit_id", F.col("dt").alias("refit_date"), F.col("rn").alias("n_train"))


@query
def rolling_ols_in_ranges(spark, d):
    spec, rows = wf.SPECS[4], scheduled(spark, d)
    columns = [spec.target, *spec.features]
    return wf.predict(rows, wf.solved(ra.refit_moments(rows, columns, [spec.rolling], RANGES), [spec], columns), [spec])


@query
def asof_params_in_ranges(spark, d):
    rows = scheduled(spark, d)
    changes = rows.filter("is_refit").select("series_id", "dt", F.col("rn").alias("n_train"))
    return ra.last_known(rows.filter("is_test").select("series_id", "dt"), changes, ["n_train"], RANGES)


@query
def correlogram_in_ranges(spark, d):
    return dia.correlogram(dia.with_pacf(ra.acf(series(spark, d).filter("rv is not null"), "rv", 30, RANGES), 30), ["series_id"])


@query
def trailing_rank_in_ranges(spark, d):
    rows = fe.lag_features(series(spark, d)).select("series_id", "dt", "rv1")
    return trailing.trailing_rank(rows, "rv1", "rv1_pctile", 252, RANGES).select("series_id", "dt", "rv1_pctile")


@query
def price_percentiles(spark, d):
    """Percentiles of single prices by return flag; groups above 5,000 rows are narrowed down before any value is gathered."""
    lines = table(spark, d, "lineitem").filter("l_quantity > 0").select("l_returnflag", (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))
    found = [qu.exact_percentile(lines, ["l_returnflag"], "px", p, most=5000).withColumn("p", F.lit(p)) for p in (0.0, 0.5, 0.9, 0.99, 1.0)]
    return reduce(DataFrame.unionByName, found)


@query
def crisis_thresholds_refined(spark, d):
    rows = stored(scheduled(spark, d).filter("not is_test").select("series_id", "rv"))  # read in every round
    return qu.exact_percentile(rows, ["series_id"], "rv", 0.9, "threshold", 200)


# Evaluation


@query
def metrics_by_regime(spark, d):
    return ev.metrics(evaluated(spark, d))


@query
def model_ranking(spark, d):
    return ev.ranking(ev.metrics(evaluated(spark, d)))


@query
def row_losses(spark, d):
    return ev.losses_long(evaluated(spark, d, [M1])).select("series_id", "dt", "model", "sq_err", "abs_err", "crisis")


@query
def dm_tests(spark, d):
    return ev.dm_tests(evaluated(spark, d), VS_BASE)


@query
def mz_tests(spark, d):
    return ev.mincer_zarnowitz(evaluated(spark, d), ["series_id", "model"])


@query
def encompassing(spark, d):
    return ev.encompassing(evaluated(spark, d), VS_BASE)


@query
def slope_difference(spark, d):
    rows = with_sigma(spark, d).filter("not is_test").withColumn("regime", F.when(cor.in_crisis(F.col("rv1_pctile")), "crisis").otherwise("calm"))
    return ev.slope_difference(ev.mincer_zarnowitz(rows, ["series_id", "regime"], "rv", "sigma"))


@query
def correlogram_rv(spark, d):
    found = dia.with_pacf(dia.acf(series(spark, d).filter("rv is not null"), ["series_id"], "rv", "dt", 30), 30)
    return dia.correlogram(found, ["series_id"])


def _residuals(spark, d):
    return evaluated(spark, d, [M1]).withColumn("resid", F.col("actual") - F.col("forecast")).withColumn("resid2", F.pow("resid", 2))


@query
def ljung_box(spark, d):
    rows = _residuals(spark, d)
    both = [dia.ljung_box(dia.acf(rows, ["series_id"], c, "dt", 20), ["series_id"]).withColumn("of", F.lit(c)) for c in ("resid", "resid2")]
    return both[0].unionByName(both[1])


@query
def arch_lm(spark, d):
    return dia.arch_lm(_residuals(spark, d), ["series_id"], "resid", "dt")


@query
def csed(spark, d):
    return ev.cumulative_difference(evaluated(spark, d), M1.name)


@query
def topk_forecasts(spark, d):
    rows = evaluated(spark, d)
    return rep.top_forecasts(rows, ev.ranking(ev.metrics(rows))).select("series_id", "dt", "model", "actual", "forecast", "rank_by_rmse")


@query
def crisis_qlike_bars(spark, d):
    return ev.metrics(evaluated(spark, d)).filter("subsample = 'crisis'").select("series_id", "model", "n", "qlike")


@query
def wide_forecasts(spark, d):
    found = evaluated(spark, d, [wf.SPECS[0], wf.SPECS[2]])
    wide = ev.long_to_wide(found, [wf.SPECS[0].name, wf.SPECS[2].name])
    return wide.select("series_id", "dt", "actual", F.col(f"`{wf.SPECS[0].name}`").alias("m1"), F.col(f"`{wf.SPECS[2].name}`").alias("m5"))


@query
def verdicts(spark, d):
    return rep.verdicts(ev.metrics(evaluated(spark, d)), M1.name)


@query
def refit_audit(spark, d):
    return rep.refit_audit(wf.fit_models(scheduled(spark, d), wf.SPECS))


@query
def dm_tally(spark, d):
    return rep.dm_tally(ev.dm_tests(evaluated(spark, d), VS_BASE))


@query
def before_after(spark, d):
    rows = features(spark, d)
    return rep.before_after(wf.walk_forward(rows, [LOG_BEFORE]), wf.walk_forward(rows, [wf.SPECS[1]]))


# All models on refitted variances, and the reports of the fixed ones


@query
def all_models(spark, d):
    return zoo.all_models(*fitted(spark, d))


@query
def all_models_metrics(spark, d):
    rows, params = fitted(spark, d)
    return ev.metrics(ev.label_regimes(zoo.all_models(rows, params), rep.crisis_threshold(rows, rows)))


@query
def all_models_dm_tests(spark, d):
    rows, params = fitted(spark, d)
    return ev.dm_tests(ev.label_regimes(zoo.all_models(rows, params), rep.crisis_threshold(rows, rows)), ev.distinct_pairs([*VS_BASE, *zoo.CRISIS_PAIRS]))


@query
def all_models_refit_audit(spark, d):
    return zoo.audit(zoo.fit(*fitted(spark, d)))


@query
def all_models_slopes(spark, d):
    refits = zoo.fit(*fitted(spark, d), blends=[])
    return zoo.slopes_fall(refits).join(zoo.audit_ranges(refits).drop("refits"), "series_id")


@query
def fixed_refit_ranges(spark, d):
    return zoo.audit_ranges(fixed_lines(spark, d)[1])


@query
def report_metrics(spark, d):
    return ev.metrics(reported(spark, d))


@query
def report_dm_tests(spark, d):
    return ev.dm_tests(reported(spark, d), REPORT_PAIRS)


@query
def report_dm_of_corrections(spark, d):
    """Tests whose comparison names a corrected variance (a null label never does)."""
    named = F.concat_ws(" vs ", "second", "first")
    tests = ev.dm_tests(reported(spark, d), REPORT_PAIRS).withColumn("comparison", named)
    return tests.filter(F.coalesce(F.col("comparison").rlike("M2[bc]"), F.lit(False))).select("series_id", "comparison", "loss", "subsample", "n", "dm_stat", "p_value")


@query
def report_wins(spark, d):
    return ev.wins(ev.dm_tests(reported(spark, d), REPORT_PAIRS), M1.name)


@query
def report_mz_tests(spark, d):
    return ev.mincer_zarnowitz(reported(spark, d), ["series_id", "model"])


@query
def report_encompassing(spark, d):
    return ev.encompassing_with_best(reported(spark, d), zoo.ENCOMPASSING_PAIRS, zoo.RAW, REPORTED)


@query
def report_test_crisis(spark, d):
    """Accuracy by the 0.9 quantile of the test rows' own actuals."""
    rows = scheduled(spark, d)
    found = reported(spark, d).drop("crisis")
    return ev.metrics(ev.label_regimes(found, rep.crisis_threshold(rows, rows.filter("usable"), "test"))).filter("subsample <> 'overall'").select("series_id", "model", "subsample", "n", "rmse", "mae")


@query
def report_row_losses(spark, d):
    return ev.losses_long(reported(spark, d)).select("series_id", "dt", "model", "sq_err", "abs_err", "crisis")


@query
def report_csed(spark, d):
    return ev.cumulative_difference(reported(spark, d), M1.name)


@query
def report_rankings(spark, d):
    return ev.ranking(ev.metrics(reported(spark, d)))


@query
def report_top_forecasts(spark, d):
    rows = reported(spark, d)
    return rep.top_forecasts(rows, ev.ranking(ev.metrics(rows))).select("series_id", "dt", "model", "actual", "forecast", "rank_by_rmse")


@query
def report_crisis_bars(spark, d):
    return ev.metrics(reported(spark, d)).filter("subsample = 'crisis'").filter(F.col("model").isin(M1.name, zoo.RAW, zoo.POOLED, zoo.REGIME, COMBINED.name)).select("series_id", "model", "n", "qlike")


@query
def headline_crisis_bars(spark, d):
    """Loss in crises of the first model, the raw variance and its four corrections, those of least QLIKE included."""
    rows, refits = fixed_lines(spark, d, qlike=True)
    kinds = {zoo.RAW: F.col("sigma"), **{name: cor.corrected(F.col("sigma"), F.col("p"), *cor.LINES[line]) for name, line in ((zoo.POOLED, "pooled"), (zoo.REGIME, "regime"), (zoo.Q_REGIME, "q_regime"), (zoo.SWITCH, "switch"))}}
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("model"), cor.floored(v, cor.FORECAST_FLOOR).alias("forecast")) for name, v in kinds.items()]))
    mine = vp.served_rows(rows, refits, ["rv"]).select("series_id", "dt", F.col("rv").alias("actual"), each).select("series_id", "dt", "model", "actual", "forecast")
    found = wf.predict(rows, wf.fit_models(rows, [M1]), [M1]).unionByName(mine)
    return ev.metrics(ev.label_regimes(found, rep.crisis_threshold(rows, rows))).filter("subsample = 'crisis'").select("series_id", "model", "n", "qlike")


@query
def report_residuals(spark, d):
    return dia.residual_tests(reported(spark, d))

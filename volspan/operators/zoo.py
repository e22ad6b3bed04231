"""All models in one walk-forward: the linear ones, the conditional variance and its corrections, the combination and the blends, from one table of refits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspan.functions.volatility import FORECAST_FLOOR, floored
from volspan.operators import corrections as cor
from volspan.operators import diagnostics as dia
from volspan.operators import egarch
from volspan.operators import evaluation as ev
from volspan.operators import reports as rep
from volspan.operators import variance_pass as vp
from volspan.operators import walk_forward as wf
from volspan.operators.features import HAR

# The models' names, and the comparisons that the reports make of them (a positive statistic favours the second).
RAW, POOLED, REGIME, Q_POOLED, Q_REGIME, SWITCH, COMBINED = "M2 EGARCH", "M2b Corrected EGARCH", "M2c Regime-OLS", "M2d Pooled-QLIKE", "M2d Regime-QLIKE", "M2e Switched", "M3 Combined"
BLENDS = {"M9 Regime": "pooled", "M9c Regime-OLS": "regime", "M9d Regime-QLIKE": "q_regime", "M9e Switched": "switch"}
BASE = wf.SPECS[0].name
CRISIS_PAIRS = [
    (BASE, RAW), (RAW, POOLED), (RAW, REGIME), (POOLED, REGIME), (RAW, Q_REGIME), (REGIME, Q_REGIME), (POOLED, Q_POOLED), (RAW, SWITCH), (REGIME, SWITCH), (Q_REGIME, SWITCH),
    *[(other, name) for name in BLENDS for other in (COMBINED, BASE)], *[(a, b) for k, b in enumerate(BLENDS) for a in list(BLENDS)[:k]],
]
ENCOMPASSING_PAIRS = [(BASE, RAW), (BASE, "M4 Log-HAR"), (BASE, "M5 Asym-HAR"), (BASE, "M6 HAR+Ret"), ("M4 Log-HAR", "M5 Asym-HAR"), ("M4 Log-HAR", RAW)]


def fit(scheduled: DataFrame, params: DataFrame, blends: list[str] | None = None) -> DataFrame:
    """Everything that a refit finds under its own variance parameters (``egarch.fit_refits`` or ``fixed_refits``), one row a refit: ``refit_date``, the parameters (``eg_*``), lines, the
    first model and the combination (``*_intercept, *_coef``), lines of least QLIKE, settings of ``blends`` (all of ``BLENDS`` if None), and ``served``, its rows' volatility."""
    blends = list(BLENDS) if blends is None else blends
    found = vp.with_lines(vp.summed(scheduled, params))
    har = wf.fit_models(scheduled, wf.SPECS[:1]).select(*cor.KEY, "refit_date", F.col("intercept").alias("har_intercept"), F.col("coef").alias("har_coef"))
    found = vp.chosen(scheduled, found.join(har, cor.KEY), [BLENDS[b] for b in blends])
    return found.withColumnsRenamed({c: f"eg_{c}" for c in egarch.PARAMS})


def audit(refits: DataFrame) -> DataFrame:
    """The refits without the rows that they serve."""
    return refits.drop("served", "sums", "moments", "har_intercept", "har_coef", "first", "last")


def forecasts(scheduled: DataFrame, refits: DataFrame, blends: list[str] | None = None) -> DataFrame:
    """``series_id, dt, model, actual, forecast`` of every model for the usable test rows, from one reading of ``refits``."""
    blends = list(BLENDS) if blends is None else blends
    sigma, p = F.col("sigma"), F.col("p")
    lines = {name: cor.corrected(sigma, p, *how) for name, how in cor.LINES.items()}
    rows = vp.served_rows(scheduled, vp.with_combined(refits, COMBINED), ["rv", *HAR])
    total, har = F.col("both_coef")[4] * sigma + F.col("both_intercept"), F.col("har_intercept")
    for k, f in enumerate(HAR):
        total, har = total + F.col("both_coef")[k] * F.col(f), har + F.col("har_coef")[k] * F.col(f)
    values = {RAW: sigma, POOLED: lines["pooled"], REGIME: lines["regime"], Q_POOLED: lines["q_pooled"], Q_REGIME: lines["q_regime"], SWITCH: lines["switch"], COMBINED: total}
    for b in blends:
        line = BLENDS[b]
        values[b] = cor.blend(p, F.col(f"c_{line}"), F.col(f"k_{line}"), lines[line], floored(har, FORECAST_FLOOR))[1]
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("model"), floored(v, FORECAST_FLOOR).alias("forecast")) for name, v in values.items()]))
    mine = rows.select("series_id", "dt", F.col("rv").alias("actual"), each).select("series_id", "dt", "model", "actual", "forecast")
    return wf.predict(scheduled, wf.fit_models(scheduled, wf.SPECS), wf.SPECS).unionByName(mine)


def all_models(scheduled: DataFrame, params: DataFrame) -> DataFrame:
    return forecasts(scheduled, fit(scheduled, params))


def slopes_fall(refits: DataFrame) -> DataFrame:
    """Of each series: refits, whether every QLIKE fit converged, and whether its slope is above the least-squares one at every refit, or below it at every one."""
    names = ("pooled", "crisis", "calm")
    every = lambda f: F.bool_and(f(names[0]) & f(names[1]) & f(names[2]))
    return refits.groupBy("series_id").agg(
        F.count("*").alias("refits"), every(lambda n: F.col(f"converged_d_{n}")).alias("all_converged"),
        every(lambda n: F.col(f"beta_d_{n}") > F.col(f"beta_{n}")).alias("all_above"), every(lambda n: F.col(f"beta_d_{n}") < F.col(f"beta_{n}")).alias("all_below"),
        *[f(f"beta{kind}_{n}").alias(f"{name}_beta_{fit}_{n}") for n in names for fit, kind in (("ols", ""), ("qlike", "_d")) for name, f in (("least", F.min), ("most", F.max))],
    )


def audit_ranges(refits: DataFrame) -> DataFrame:
    """Per series: refits, least and most training rows and crisis rows, whether both regimes are stable at every refit, ranges of the regime lines."""
    ends = [f(c).alias(f"{name}_{c}") for c in ("n_train", "n_crisis", "n_calm", "alpha_crisis", "beta_crisis", "alpha_calm", "beta_calm") for name, f in (("least", F.min), ("most", F.max))]
    return refits.groupBy("series_id").agg(F.count("*").alias("refits"), F.bool_and("crisis_stable").alias("crisis_stable"), F.bool_and("calm_stable").alias("calm_stable"), *ends)


def full_report(scheduled: DataFrame, found: DataFrame) -> dict[str, DataFrame]:
    """The tables of a run's report over all its models: accuracy and ranks, tests against the base, efficiency, encompassing, accuracy by the quantile of the test rows' own actuals, tests
    in crises, residuals, the data of the charts, and the verdict."""
    labelled = ev.label_regimes(found, rep.crisis_threshold(scheduled, scheduled)).persist()
    own = ev.label_regimes(found, rep.crisis_threshold(scheduled, scheduled.filter("usable"), "test"))
    models = [s.name for s in wf.SPECS] + [RAW, POOLED, REGIME, Q_POOLED, Q_REGIME, SWITCH, COMBINED, *BLENDS]
    scored = ev.metrics(labelled)
    ranked = ev.ranking(scored)
    against = ev.dm_tests(labelled, [(BASE, m) for m in models if m != BASE])
    return {
        "accuracy": ranked, "by_regime": scored, "against_base": against, "efficiency": ev.mincer_zarnowitz(labelled, ["series_id", "model"]),
        "encompassing": ev.encompassing_with_best(labelled, ENCOMPASSING_PAIRS, RAW, models), "conditional": ev.metrics(own).filter("subsample <> 'overall'"),
        "in_crises": ev.dm_tests(labelled, ev.distinct_pairs(CRISIS_PAIRS)).filter("subsample = 'crisis'"), "residuals": dia.residual_tests(labelled),
        "cumulative": ev.cumulative_difference(labelled, BASE), "best_forecasts": rep.top_forecasts(labelled, ranked), "crisis_bars": scored.filter("subsample = 'crisis'"),
        "verdict": rep.verdicts(scored, BASE).join(ev.wins(against, BASE), "series_id"),
    }

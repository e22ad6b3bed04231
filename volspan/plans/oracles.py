"""The same results as SQL, by other algorithms: regressions by successive orthogonalisation, the filter by a recursive query."""

from __future__ import annotations

import math

from volspan.functions.volatility import GK_WEIGHT
from volspan.operators.egarch import FIXED
from volspan.operators.features import FEATURES, HAR, LOG_HAR
from volspan.operators.walk_forward import SPECS, Spec
from volspan.operators.zoo import ENCOMPASSING_PAIRS
from volspan.plans.queries import PLACES, REPORT_PAIRS, REPORTED

ORACLES: dict[str, str] = {}
W = "(PARTITION BY series_id ORDER BY dt)"


def _mean(x: str, first: int, last: int) -> str:
    side = lambda n: f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
    frame = f"(PARTITION BY series_id ORDER BY dt ROWS BETWEEN {side(first)} AND {side(last)})"
    return f"CASE WHEN count({x}) OVER {frame} = {last - first + 1} THEN avg({x}) OVER {frame} END"


BARS = """trades AS (SELECT unnest(['ALL', l_returnflag]) AS series_id, CAST(l_shipdate AS DATE) AS dt, l_extendedprice / l_quantity AS px, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4 FROM lineitem WHERE l_quantity > 0),
bars AS (SELECT series_id, dt, arg_min(px, (k1, k2, k3, k4, px)) AS open, max(px) AS high, min(px) AS low, arg_max(px, (k1, k2, k3, k4, px)) AS close FROM trades GROUP BY series_id, dt)"""
VOL = f"""{BARS},
gks AS (SELECT *, 0.5::DOUBLE * pow(ln(high / low), 2) - {GK_WEIGHT!r}::DOUBLE * pow(ln(close / open), 2) AS gk, ln(close / lag(close) OVER {W}) * 100 AS ret FROM bars),
vol AS (SELECT series_id, dt, gk, ret, CASE WHEN gk IS NOT NULL THEN sqrt(greatest(gk, 1e-10::DOUBLE)) * 100 END AS rv FROM gks)"""
LAGS = f"""{VOL},
lag0 AS (SELECT *, lag(rv) OVER {W} AS rv1, lag(rv, 2) OVER {W} AS rv2, {_mean("rv", -5, -1)} AS rv5, {_mean("rv", -22, -1)} AS rv22, ln(greatest(rv, 1e-6::DOUBLE)) AS log_rv, lag(ret) OVER {W} AS ret_lag FROM vol),
lags AS (SELECT *, ret AS "return", lag(log_rv) OVER {W} AS log_rv1, lag(log_rv, 2) OVER {W} AS log_rv2, {_mean("log_rv", -5, -1)} AS log_rv5, {_mean("log_rv", -22, -1)} AS log_rv22, CASE WHEN ret_lag < 0 THEN rv1 ELSE 0.0::DOUBLE END AS rv_neg, abs(ret_lag) AS abs_ret_lag,
 CASE WHEN count(rv1) OVER (PARTITION BY series_id ORDER BY dt ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) = 252 THEN len(list_filter(list(rv1) OVER (PARTITION BY series_id ORDER BY dt ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), lambda v: v <= rv1)) / 252.0::DOUBLE END AS rv1_pctile FROM lag0)"""
FEATS = f"""{LAGS},
feats AS (SELECT series_id, dt, {", ".join(f'"{c}"' for c in FEATURES)} FROM lags WHERE {" AND ".join(f'"{c}" IS NOT NULL' for c in FEATURES)})"""


def sched(rows: str = "feats") -> str:
    return f"""sch0 AS (SELECT *, row_number() OVER {W} - 1 AS rn, CAST(max(dt) OVER (PARTITION BY series_id) - INTERVAL 18 MONTH AS DATE) AS split_date FROM {rows}),
sch1 AS (SELECT *, dt > split_date AS is_test, CASE WHEN dt > split_date THEN count(*) FILTER (WHERE dt > split_date) OVER {W} - 1 END AS i FROM sch0),
sch2 AS (SELECT *, CAST(floor(i / 21) AS INTEGER) AS refit_id, is_test AND rn >= 500 AS usable FROM sch1),
sched AS (SELECT *, coalesce(usable AND rn = min(CASE WHEN usable THEN rn END) OVER (PARTITION BY series_id, refit_id), false) AS is_refit FROM sch2)"""


SCHED = f"{FEATS},\n{sched()}"
P = FIXED
SIGMA = f"""seq AS (SELECT series_id, dt, ret, row_number() OVER {W} AS k FROM vol WHERE ret IS NOT NULL),
filt AS (SELECT series_id, k, dt, ret, {P["omega"] / (1 - P["beta"])!r}::DOUBLE AS v FROM seq WHERE k = 1
 UNION ALL SELECT s.series_id, s.k, s.dt, s.ret, least(greatest({P["omega"]!r}::DOUBLE + {P["alpha"]!r}::DOUBLE * (abs(f.z) - {math.sqrt(2 / math.pi)!r}::DOUBLE) + ({P["gamma"]!r}::DOUBLE) * f.z + {P["beta"]!r}::DOUBLE * f.v, -50.0::DOUBLE), 50.0::DOUBLE) FROM (SELECT *, (ret - {P["mu"]!r}::DOUBLE) * exp(-v / 2) AS z FROM filt) AS f JOIN seq s ON s.series_id = f.series_id AND s.k = f.k + 1),
sigma AS (SELECT series_id, dt, exp(v / 2) AS sigma FROM filt),
ssched AS (SELECT s.*, g.sigma FROM sched s JOIN sigma g ON s.series_id = g.series_id AND s.dt = g.dt)"""


def ols(name: str, spec: Spec, rows: str = "sched", embargo: int = 0) -> str:
    """CTEs ending in ``name`` (series_id, refit_id, dt, tr, te, actual, fit, resid): the model fitted at each refit by successive orthogonalisation of centred columns."""
    k = len(spec.features)
    xs = [f"x{j}" for j in range(1, k + 1)]
    key, part = "series_id, refit_id, dt, tr, te, aug, actual", "OVER (PARTITION BY series_id, refit_id)"
    late = f" AND s.rn >= r.rn - {spec.rolling}" if spec.rolling else ""
    out = [
        f"""{name}_r AS (SELECT r.series_id, r.refit_id, s.dt, s.rn < r.rn - {embargo}{late} AS tr, s.usable AND s.refit_id = r.refit_id AS te, false AS aug, s.{spec.target if not spec.log else "rv"} AS actual, s.{spec.target} AS y, {", ".join(f"s.{f} AS x{j}" for j, f in enumerate(spec.features, 1))}
 FROM {rows} r JOIN {rows} s ON r.series_id = s.series_id AND r.is_refit AND ((s.rn < r.rn - {embargo}{late}) OR (s.usable AND s.refit_id = r.refit_id)))""",
        f"{name}_c AS (SELECT {key}, avg(y) FILTER (WHERE tr) {part} AS my, y - avg(y) FILTER (WHERE tr) {part} AS y, {', '.join(f'{x} - avg({x}) FILTER (WHERE tr) {part} AS {x}' for x in xs)} FROM {name}_r)",
    ]
    last = f"{name}_c"
    if spec.ridge:
        extra = " UNION ALL ".join(f"SELECT series_id, refit_id, NULL AS dt, true AS tr, false AS te, true AS aug, NULL AS actual, 0.0::DOUBLE AS my, 0.0::DOUBLE AS y, {', '.join(f'{math.sqrt(spec.ridge) if i == j else 0.0!r}::DOUBLE AS x{i}' for i in range(1, k + 1))} FROM (SELECT DISTINCT series_id, refit_id FROM {name}_c) AS q{j}" for j in range(1, k + 1))
        out.append(f"{name}_a AS (SELECT * FROM {name}_c UNION ALL {extra})")
        last = f"{name}_a"
    for j, x in enumerate(xs, 1):
        slope = lambda v, x=x: f"sum({v} * {x}) FILTER (WHERE tr) {part} / sum({x} * {x}) FILTER (WHERE tr) {part}"
        fit = "my" if j == 1 else "fit"
        out.append(f"{name}_{j} AS (SELECT {key}, {fit} + ({slope('y')}) * {x} AS fit, y - ({slope('y')}) * {x} AS y{''.join(f', {v} - ({slope(v)}) * {x} AS {v}' for v in xs[j:])} FROM {last})")
        last = f"{name}_{j}"
    out.append(f"{name} AS (SELECT series_id, refit_id, dt, tr, te, actual, fit, y AS resid, sum(y * y) FILTER (WHERE tr AND NOT aug) {part} / (count(*) FILTER (WHERE tr AND NOT aug) {part} - 1) AS rvar FROM {last})")
    return ",\n".join(out)


def forecast(name: str, spec: Spec) -> str:
    value = f"exp(fit + {'rvar / 2' if spec.smear else '0'})" if spec.log else "fit"
    return f"SELECT series_id, dt, '{spec.name}' AS model, actual, greatest({value}, 1e-4::DOUBLE) AS forecast FROM {name} WHERE te"


def rnd(columns: str, body: str) -> str:
    """``columns``: names, those to be rounded marked by a leading ``~``."""
    value = lambda c: f'"{c}"' if PLACES.get(c, 6) is None else f'round("{c}", {PLACES.get(c, 6)}) + 0.0::DOUBLE AS "{c}"'
    cols = ", ".join(value(c[1:]) if c[0] == "~" else f'"{c}"' for c in columns.split())
    return f"SELECT {cols} FROM ({body}) AS final"


def add(name: str, ctes: str, columns: str, body: str) -> None:
    ORACLES[name] = f"WITH RECURSIVE {ctes}\n{rnd(columns, body)}"


add("daily_bars", BARS, "series_id dt ~open ~high ~low ~close", "SELECT * FROM bars")
add("hourly_bars", "x AS (SELECT 1)", "series_id hour ~open ~high ~low ~close", "SELECT event_type AS series_id, date_trunc('hour', ts) AS hour, arg_min(value, (ts, event_id, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id, value)) AS close FROM events GROUP BY 1, 2")
add("gk_realized_vol", VOL, "series_id dt ~gk ~rv ~log_rv", "SELECT series_id, dt, gk, rv, CASE WHEN rv IS NOT NULL THEN ln(greatest(rv, 1e-6::DOUBLE)) END AS log_rv FROM vol")
add("log_returns", VOL, "series_id dt ~return ~abs_return", 'SELECT series_id, dt, ret AS "return", abs(ret) AS abs_return FROM vol')
add("har_lags", LAGS, "series_id dt ~rv1 ~rv2 ~rv5 ~rv22", "SELECT * FROM lags")
add("log_har_lags", LAGS, "series_id dt ~log_rv1 ~log_rv2 ~log_rv5 ~log_rv22", "SELECT * FROM lags")
add("asym_return_features", LAGS, "series_id dt ~rv_neg ~ret_lag ~abs_ret_lag", "SELECT * FROM lags WHERE rv1 IS NOT NULL AND ret_lag IS NOT NULL")
add("rolling_pct_rank_252", LAGS, "series_id dt ~rv1_pctile", "SELECT * FROM lags")
add("forward_mean_target_5", VOL, "series_id dt ~target", f"SELECT series_id, dt, {_mean('rv', 1, 5)} AS target FROM vol")
add("feature_table", FEATS, "series_id dt " + " ".join(f"~{c}" for c in FEATURES), "SELECT * FROM feats")
add("data_summary", FEATS, "series_id raw_rows date_start date_end ~rv_mean ~rv_std ~rv_min ~rv_max ~rv_p90 feature_rows", "SELECT v.*, coalesce(n, 0) AS feature_rows FROM (SELECT series_id, count(*) AS raw_rows, min(dt) AS date_start, max(dt) AS date_end, avg(rv) AS rv_mean, stddev_samp(rv) AS rv_std, min(rv) AS rv_min, max(rv) AS rv_max, quantile_cont(rv, 0.9) AS rv_p90 FROM vol GROUP BY series_id) AS v LEFT JOIN (SELECT series_id, count(*) AS n FROM feats GROUP BY series_id) AS f ON v.series_id = f.series_id")
add("train_test_split", SCHED, "series_id split_date n_train n_test", "SELECT series_id, split_date, count(*) FILTER (WHERE NOT is_test) AS n_train, count(*) FILTER (WHERE is_test) AS n_test FROM sched GROUP BY 1, 2")
add("refit_schedule", SCHED, "series_id refit_id refit_date n_train", "SELECT series_id, refit_id, dt AS refit_date, rn AS n_train FROM sched WHERE is_refit")
add("crisis_thresholds", SCHED, "series_id ~threshold kind", " UNION ALL ".join(f"SELECT series_id, quantile_cont(rv, 0.9) AS threshold, '{k}' AS kind FROM sched WHERE {c} GROUP BY series_id" for k, c in (("training", "NOT is_test"), ("before_split", "dt < split_date"), ("test", "is_test"), ("all", "true"))))
add("regime_labels_exante", FEATS, "series_id regime n ~mean_rv", "SELECT series_id, CASE WHEN rv1_pctile >= 0.9 THEN 'crisis' ELSE 'calm' END AS regime, count(*) AS n, avg(rv) AS mean_rv FROM feats GROUP BY 1, 2")
THRESHOLD = "thr AS (SELECT series_id, quantile_cont(rv, 0.9) AS threshold FROM sched WHERE NOT is_test GROUP BY series_id)"
add("regime_labels_eval", f"{SCHED},\n{THRESHOLD}", "series_id dt ~rv crisis", "SELECT s.series_id, dt, rv, rv > threshold AS crisis FROM sched s JOIN thr t ON s.series_id = t.series_id WHERE is_test")
CALENDAR = "cal AS (SELECT min(CAST(o_orderdate AS DATE)) AS event_date FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY date_trunc('month', o_orderdate))"
add("event_calendar", CALENDAR, "event_date source", "SELECT event_date, CASE WHEN year(event_date) < 1995 THEN 'early' ELSE 'late' END AS source FROM cal")
add("event_dummy", f"{BARS},\n{CALENDAR}", "series_id dt ~event_day", "SELECT series_id, dt, CASE WHEN dt IN (SELECT event_date FROM cal) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS event_day FROM bars")
add("asof_params", SCHED, "series_id dt n_train", "SELECT s.series_id, s.dt, max(r.rn) AS n_train FROM sched s LEFT JOIN sched r ON r.series_id = s.series_id AND r.is_refit AND r.dt <= s.dt WHERE s.is_test GROUP BY 1, 2")
add("expanding_ols_1f", SCHED, "series_id refit_id ~slope ~intercept", "SELECT r.series_id, r.refit_id, regr_slope(s.rv, s.rv1) AS slope, regr_intercept(s.rv, s.rv1) AS intercept FROM sched r JOIN sched s ON r.series_id = s.series_id AND r.is_refit AND s.rn < r.rn GROUP BY 1, 2")
for _name, _spec in zip(["har_ols_walk_forward", "log_har_smearing", "asym_har", "har_returns", "rolling_ols_1000", "ridge_kitchen_sink"], SPECS, strict=True):
    add(_name, f"{SCHED},\n{ols('m', _spec)}", "series_id dt model ~actual ~forecast", forecast("m", _spec))
_macro = Spec("M1-macro", (*HAR, "event_day"))
add("macro_walk_forward", f"{FEATS},\n{CALENDAR},\nmarked AS (SELECT *, CASE WHEN dt IN (SELECT event_date FROM cal) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS event_day FROM feats),\n{sched('marked')},\n{ols('m', _macro)}", "series_id dt model ~actual ~forecast", forecast("m", _macro))
_h5 = Spec("M1_h5", tuple(HAR), target="target")
add("h5_walk_forward", f"{FEATS},\nahead AS (SELECT series_id, dt, {_mean('rv', 1, 5)} AS target FROM vol),\nwith5 AS (SELECT f.*, a.target FROM feats f JOIN ahead a ON f.series_id = a.series_id AND f.dt = a.dt WHERE a.target IS NOT NULL),\n{sched('with5')},\n{ols('m', _h5, embargo=5)}", "series_id dt model ~actual ~forecast", forecast("m", _h5))
# Two centred regressors have closed forms; p values of odd and even degrees of freedom by the finite series.
T_P = """CASE WHEN df % 2 = 1 THEN 1 - 2 / pi() * (th + sin(th) * cos(th) * coalesce((SELECT sum(q) FROM (SELECT exp(sum(ln(1.0::DOUBLE * CASE WHEN g = 0 THEN 1 ELSE 2.0::DOUBLE * g / (2 * g + 1) * pow(cos(th), 2) END)) OVER (ORDER BY g)) AS q FROM range(0, CAST(greatest((df - 1) // 2, 0) AS BIGINT)) AS r(g))), 0))
 ELSE 1 - sin(th) * (SELECT sum(q) FROM (SELECT exp(sum(ln(1.0::DOUBLE * CASE WHEN g = 0 THEN 1 ELSE (2.0::DOUBLE * g - 1) / (2 * g) * pow(cos(th), 2) END)) OVER (ORDER BY g)) AS q FROM range(0, CAST(greatest(df // 2, 1) AS BIGINT)) AS r(g))) END"""


def training(rows: str = "ssched") -> str:
    return f"train AS (SELECT r.series_id, r.refit_id, s.dt, s.rv, s.sigma, s.rv1_pctile AS p FROM {rows} r JOIN {rows} s ON r.series_id = s.series_id AND r.is_refit AND s.rn < r.rn)"


MZ = """mz0 AS (SELECT series_id, refit_id, CAST(count(*) AS INTEGER) AS n_train, regr_slope(rv, sigma) AS beta_pooled, regr_intercept(rv, sigma) AS alpha_pooled,
 regr_slope(rv, sigma) FILTER (WHERE p >= 0.9) AS bc, regr_intercept(rv, sigma) FILTER (WHERE p >= 0.9) AS ac, count(*) FILTER (WHERE p >= 0.9) AS n_crisis, regr_slope(rv, sigma) FILTER (WHERE p < 0.9) AS bk, regr_intercept(rv, sigma) FILTER (WHERE p < 0.9) AS ak, count(*) FILTER (WHERE p < 0.9) AS n_calm FROM train GROUP BY 1, 2),
mz AS (SELECT *, n_crisis >= 30 AS crisis_stable, n_calm >= 30 AS calm_stable, CASE WHEN n_crisis >= 30 THEN ac ELSE alpha_pooled END AS alpha_crisis, CASE WHEN n_crisis >= 30 THEN bc ELSE beta_pooled END AS beta_crisis, CASE WHEN n_calm >= 30 THEN ak ELSE alpha_pooled END AS alpha_calm, CASE WHEN n_calm >= 30 THEN bk ELSE beta_pooled END AS beta_calm FROM mz0)"""
GARCH = f"{SCHED},\n{SIGMA}"
CORRECTED = f"{GARCH},\n{training()},\n{MZ}"
add("egarch_filter_fixed", GARCH, "series_id dt ~sigma", "SELECT * FROM sigma")
add("egarch_h1_fixed", GARCH, "series_id dt ~actual ~forecast", "SELECT series_id, dt, rv AS actual, greatest(sigma, 1e-4::DOUBLE) AS forecast FROM ssched WHERE usable")
add("mz_correction_audit", CORRECTED, "series_id refit_id n_train ~beta_pooled ~alpha_pooled ~beta_crisis ~alpha_crisis n_crisis ~beta_calm ~alpha_calm n_calm crisis_stable calm_stable", "SELECT * FROM mz")
for _name, _expr in (
    ("mz_pooled_correction", "alpha_pooled + beta_pooled * sigma"),
    ("mz_regime_correction", "CASE WHEN rv1_pctile >= 0.9 THEN alpha_crisis + beta_crisis * sigma ELSE alpha_calm + beta_calm * sigma END"),
    ("regime_switch_correction", "CASE WHEN rv1_pctile >= 0.9 THEN sigma ELSE alpha_calm + beta_calm * sigma END"),
):
    add(_name, CORRECTED, "series_id dt ~actual ~forecast", f"SELECT s.series_id, dt, rv AS actual, greatest({_expr}, 1e-4::DOUBLE) AS forecast FROM ssched s JOIN mz ON s.series_id = mz.series_id AND s.refit_id = mz.refit_id WHERE usable")
_combined = Spec("M3 Combined", (*HAR, "sigma"))
add("combined_har_sigma", f"{GARCH},\n{ols('m', _combined, 'ssched')}", "series_id dt model ~actual ~forecast", forecast("m", _combined))


def grid(line: str) -> str:
    """The grid search whose first forecast is ``line``."""
    return f"""{CORRECTED},
{ols("m", SPECS[0], "ssched")},
inputs AS MATERIALIZED (SELECT m.series_id, m.refit_id, m.dt, m.tr, m.te, s.rv, s.rv1_pctile AS p, greatest({line}, 1e-4::DOUBLE) AS a, greatest(fit, 1e-4::DOUBLE) AS b FROM m JOIN ssched s ON m.series_id = s.series_id AND m.dt = s.dt JOIN mz ON mz.series_id = m.series_id AND mz.refit_id = m.refit_id),
tries AS (SELECT series_id, refit_id, rv, i, k, 1 / (1 + exp(-k * (p - (0.1::DOUBLE + i * 0.05::DOUBLE)))) AS w, a, b FROM inputs, range(0, 17) AS ci(i), range(1, 21) AS ck(k) WHERE tr),
losses AS (SELECT series_id, refit_id, i, k, round(avg(r * r - 2 * ln(r) - 1), 12) AS loss FROM (SELECT series_id, refit_id, i, k, rv / greatest(b + w * (a - b), 1e-4::DOUBLE) AS r FROM tries) AS t GROUP BY 1, 2, 3, 4),
best AS MATERIALIZED (SELECT series_id, refit_id, 0.1::DOUBLE + i * 0.05::DOUBLE AS c, CAST(k AS DOUBLE) AS k, loss AS train_qlike FROM (SELECT *, row_number() OVER (PARTITION BY series_id, refit_id ORDER BY loss, i, k) AS pos FROM losses) AS o WHERE pos = 1)"""


def blend(line: str) -> str:
    return f"""{grid(line)},
blended AS (SELECT i.series_id, i.dt, i.rv AS actual, w, greatest(w * a + (1 - w) * b, 1e-4::DOUBLE) AS forecast, CASE WHEN p >= 0.9 THEN 'crisis' ELSE 'calm' END AS regime FROM (SELECT x.*, 1 / (1 + exp(-k * (p - c))) AS w FROM inputs x JOIN best ON x.series_id = best.series_id AND x.refit_id = best.refit_id WHERE te) AS i)"""


POOLED, SPLIT = "alpha_pooled + beta_pooled * sigma", "CASE WHEN s.rv1_pctile >= 0.9 THEN alpha_crisis + beta_crisis * sigma ELSE alpha_calm + beta_calm * sigma END"
GRID, BLEND = grid(POOLED), blend(POOLED)
add("logistic_grid_search", GRID, "series_id refit_id ~c ~k ~train_qlike", "SELECT * FROM best")
for _name, _line in (("regime_blend", POOLED), ("regime_blend_split", SPLIT)):
    add(_name, blend(_line), "series_id dt ~actual ~forecast ~w regime", "SELECT * FROM blended")
add("weight_distribution", BLEND, "series_id regime n ~mean ~median ~min ~max ~p10 ~p90 ~frac_above_95 ~frac_above_99", "SELECT series_id, regime, count(*) AS n, avg(w) AS mean, median(w) AS median, min(w) AS min, max(w) AS max, quantile_cont(w, 0.1) AS p10, quantile_cont(w, 0.9) AS p90, avg(CASE WHEN w > 0.95 THEN 1.0::DOUBLE ELSE 0 END) AS frac_above_95, avg(CASE WHEN w > 0.99 THEN 1.0::DOUBLE ELSE 0 END) AS frac_above_99 FROM blended GROUP BY 1, 2")


def zoo(specs: list[Spec]) -> str:
    parts = ",\n".join(ols(f"z{k}", s) for k, s in enumerate(specs))
    union = " UNION ALL ".join(forecast(f"z{k}", s) for k, s in enumerate(specs))
    return f"{SCHED},\n{THRESHOLD},\n{parts},\nfc AS (SELECT f.*, actual > threshold AS crisis FROM ({union}) AS f JOIN thr ON f.series_id = thr.series_id)"


QL = "(pow(actual / forecast, 2) - ln(pow(actual / forecast, 2)) - 1)"
LABEL = "CASE WHEN grouping(crisis) = 1 THEN 'overall' WHEN crisis THEN 'crisis' ELSE 'calm' END AS subsample"
ZOO = f"{zoo(SPECS)},\nmet AS (SELECT series_id, model, {LABEL}, count(*) AS n, sqrt(avg(pow(actual - forecast, 2))) AS rmse, avg(abs(actual - forecast)) AS mae, avg({QL}) AS qlike FROM fc GROUP BY GROUPING SETS ((series_id, model, crisis), (series_id, model)))"
RANKED = f"{ZOO},\nranked AS (SELECT series_id, model, n, rmse, mae, qlike, CAST(row_number() OVER (PARTITION BY series_id ORDER BY rmse, model) AS INTEGER) AS rank_by_rmse, CAST(row_number() OVER (PARTITION BY series_id ORDER BY qlike, model) AS INTEGER) AS rank_by_qlike FROM met WHERE subsample = 'overall')"
BASE = SPECS[0].name
add("metrics_by_regime", ZOO, "series_id model subsample n ~rmse ~mae ~qlike", "SELECT * FROM met")
add("model_ranking", RANKED, "series_id model n ~rmse ~mae ~qlike rank_by_rmse rank_by_qlike", "SELECT * FROM ranked")
add("row_losses", zoo(SPECS[:1]), "series_id dt model ~sq_err ~abs_err crisis", "SELECT *, pow(actual - forecast, 2) AS sq_err, abs(actual - forecast) AS abs_err FROM fc")
DM = f"""{ZOO},
pair AS (SELECT b.series_id, '{BASE}' AS first, o.model AS second, b.dt, b.crisis, b.actual, b.forecast AS f1, o.forecast AS f2 FROM fc b JOIN fc o ON b.series_id = o.series_id AND b.dt = o.dt AND b.model = '{BASE}' AND o.model <> '{BASE}'),
diff AS (SELECT *, 'mse' AS loss, pow(actual - f1, 2) - pow(actual - f2, 2) AS d FROM pair UNION ALL SELECT *, 'mae' AS loss, abs(actual - f1) - abs(actual - f2) AS d FROM pair UNION ALL SELECT *, 'qlike' AS loss, {QL.replace("forecast", "f1")} - {QL.replace("forecast", "f2")} AS d FROM pair),
dm0 AS (SELECT series_id, first, second, loss, {LABEL}, count(*) AS n, avg(d) AS m, var_samp(d) AS v FROM diff GROUP BY GROUPING SETS ((series_id, first, second, loss, crisis), (series_id, first, second, loss))),
dm1 AS (SELECT *, CASE WHEN coalesce(v < 1e-15, true) THEN 0.0::DOUBLE ELSE m / sqrt(v / n) * sqrt((n - 1 + 1.0::DOUBLE / n) / n) END AS dm_stat FROM dm0),
dm2 AS (SELECT *, n - 1 AS df, atan(abs(dm_stat) / sqrt(greatest(n - 1, 1)::DOUBLE)) AS th FROM dm1),
dm AS (SELECT series_id, first, second, loss, subsample, n, dm_stat, CASE WHEN coalesce(v < 1e-15, true) THEN 1.0::DOUBLE ELSE greatest({T_P}, 0) END AS p_value FROM dm2),
dms AS (SELECT *, CASE WHEN p_value < 0.01 THEN '***' WHEN p_value < 0.05 THEN '**' WHEN p_value < 0.1 THEN '*' ELSE '' END AS stars, CASE WHEN p_value >= 0.05 THEN 'no difference' WHEN dm_stat > 0 THEN 'second better' ELSE 'first better' END AS verdict FROM dm)"""
add("dm_tests", DM, "series_id first second loss subsample n ~dm_stat ~p_value stars verdict", "SELECT * FROM dms")
add("dm_tally", DM, "subsample loss n_tests n_rejected ~n_by_chance", "SELECT subsample, loss, count(*) AS n_tests, count(*) FILTER (WHERE p_value < 0.05) AS n_rejected, count(*) * 0.05::DOUBLE AS n_by_chance FROM dms GROUP BY 1, 2")
MZ_TEST = """mt0 AS (SELECT {key}, count(*) AS n, regr_intercept(y, x) AS alpha, regr_slope(y, x) AS beta, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, avg(x) AS mx, sum(x) AS sx, sum(x * x) AS sxx0 FROM {rows} GROUP BY {key}),
mt1 AS (SELECT *, syy * (1 - r2) / (n - 2) AS s2 FROM mt0),
mt AS (SELECT *, sqrt(s2 * (1.0::DOUBLE / n + mx * mx / sxx)) AS alpha_se, sqrt(s2 / sxx) AS beta_se, (n * alpha * alpha + 2 * alpha * (beta - 1) * sx + pow(beta - 1, 2) * sxx0) / (2 * s2) AS f_stat FROM mt1)"""
add("mz_tests", f"{ZOO},\nxy AS (SELECT series_id, model, actual AS y, forecast AS x FROM fc),\n{MZ_TEST.format(key='series_id, model', rows='xy')}", "series_id model n ~alpha ~alpha_se ~beta ~beta_se ~r2 ~f_stat ~f_pval", "SELECT *, pow(1 + 2 * f_stat / (n - 2), -(n - 2) / 2.0::DOUBLE) AS f_pval FROM mt")
add("slope_difference", f"{GARCH},\nxy AS (SELECT series_id, CASE WHEN rv1_pctile >= 0.9 THEN 'crisis' ELSE 'calm' END AS regime, rv AS y, sigma AS x FROM ssched WHERE NOT is_test),\n{MZ_TEST.format(key='series_id, regime', rows='xy')}", "series_id ~beta_crisis ~beta_calm ~beta_se_crisis ~beta_se_calm ~difference ~t", "SELECT a.series_id, a.beta AS beta_crisis, b.beta AS beta_calm, a.beta_se AS beta_se_crisis, b.beta_se AS beta_se_calm, a.beta - b.beta AS difference, (a.beta - b.beta) / sqrt(a.beta_se * a.beta_se + b.beta_se * b.beta_se) AS t FROM mt a JOIN mt b ON a.series_id = b.series_id AND a.regime = 'crisis' AND b.regime = 'calm'")
ENC = f"""{DM},
e0 AS (SELECT series_id, first, second, count(*) AS n, sum(f1 * f1) AS a11, sum(f2 * f2) AS a22, sum(f1 * f2) AS a12, sum(actual * f1) AS y1, sum(actual * f2) AS y2, sum(actual * actual) AS yy FROM pair GROUP BY 1, 2, 3),
e1 AS (SELECT *, a11 * a22 - a12 * a12 AS det FROM e0), e2 AS (SELECT *, (a22 * y1 - a12 * y2) / det AS b1, (a11 * y2 - a12 * y1) / det AS b2 FROM e1), e3 AS (SELECT *, (yy - b1 * y1 - b2 * y2) / (n - 2) AS s2 FROM e2),
e4 AS (SELECT *, b1 / sqrt(s2 * a22 / det) AS t1, b2 / sqrt(s2 * a11 / det) AS t2, n - 2 AS df FROM e3),
e5 AS (SELECT *, {T_P} AS p1 FROM (SELECT *, atan(abs(t1) / sqrt(df::DOUBLE)) AS th FROM e4) AS q1), e6 AS (SELECT *, {T_P} AS p2 FROM (SELECT * EXCLUDE (th), atan(abs(t2) / sqrt(df::DOUBLE)) AS th FROM e5) AS q2)"""
add("encompassing", ENC, "series_id first second n ~b1 ~t1 ~p1 ~b2 ~t2 ~p2", "SELECT series_id, first, second, n, b1, t1, greatest(p1, 0) AS p1, b2, t2, greatest(p2, 0) AS p2 FROM e6")
add("csed", DM, "series_id dt model ~csed", "SELECT series_id, dt, second AS model, sum(pow(actual - f1, 2) - pow(actual - f2, 2)) OVER (PARTITION BY series_id, second ORDER BY dt ROWS UNBOUNDED PRECEDING) AS csed FROM pair")
add("topk_forecasts", RANKED, "series_id dt model ~actual ~forecast rank_by_rmse", "SELECT f.*, rank_by_rmse FROM fc f JOIN ranked r ON f.series_id = r.series_id AND f.model = r.model WHERE rank_by_rmse <= 3")
add("crisis_qlike_bars", ZOO, "series_id model n ~qlike", "SELECT * FROM met WHERE subsample = 'crisis'")
add("wide_forecasts", zoo([SPECS[0], SPECS[2]]), "series_id dt ~actual ~m1 ~m5", f"SELECT series_id, dt, actual, max(CASE WHEN model = '{SPECS[0].name}' THEN forecast END) AS m1, max(CASE WHEN model = '{SPECS[2].name}' THEN forecast END) AS m5 FROM fc GROUP BY 1, 2, 3")
add("verdicts", ZOO, "series_id best_rmse best_qlike any_beats_base", f"SELECT series_id, arg_min(model, (rmse, model)) AS best_rmse, arg_min(model, (qlike, model)) AS best_qlike, min(CASE WHEN model <> '{BASE}' THEN qlike END) < max(CASE WHEN model = '{BASE}' THEN qlike END) AS any_beats_base FROM met WHERE subsample = 'overall' GROUP BY series_id")
add("refit_audit", SCHED, "series_id model refits n_first n_last all_finite", " UNION ALL ".join(f"SELECT series_id, '{s.name}' AS model, count(*) AS refits, CAST(min({f'least(rn, {s.rolling})' if s.rolling else 'rn'}) AS INTEGER) AS n_first, CAST(max({f'least(rn, {s.rolling})' if s.rolling else 'rn'}) AS INTEGER) AS n_last, true AS all_finite FROM sched WHERE is_refit GROUP BY series_id" for s in SPECS))
_before = Spec("before", tuple(LOG_HAR), target="log_rv", log=True, smear=False)
add("before_after", f"{SCHED},\n{ols('m', SPECS[1])},\nba AS (SELECT series_id, actual, greatest(exp(fit), 1e-4::DOUBLE) AS f0, greatest(exp(fit + rvar / 2), 1e-4::DOUBLE) AS f1 FROM m WHERE te)", "series_id n ~rmse_before ~rmse_after ~max_abs_diff", "SELECT series_id, count(*) AS n, sqrt(avg(pow(actual - f0, 2))) AS rmse_before, sqrt(avg(pow(actual - f1, 2))) AS rmse_after, max(abs(f0 - f1)) AS max_abs_diff FROM ba GROUP BY series_id")


def autocorrelations(rows: str, value: str, lags: int, name: str) -> str:
    return f"""{name}0 AS (SELECT series_id, row_number() OVER {W} AS k, {value} - avg({value}) OVER (PARTITION BY series_id) AS x FROM {rows}),
{name} AS (SELECT a.series_id, l AS lag, count(*) + l AS n, sum(a.x * b.x) AS c FROM {name}0 a CROSS JOIN range(0, {lags + 1}) AS r(l) JOIN {name}0 b ON a.series_id = b.series_id AND b.k = a.k - l GROUP BY 1, 2)"""


RES = f"{zoo(SPECS[:1])},\nres AS (SELECT series_id, dt, actual - forecast AS resid, pow(actual - forecast, 2) AS resid2 FROM fc),\n{autocorrelations('res', 'resid', 20, 'ac1')},\n{autocorrelations('res', 'resid2', 20, 'ac2')}"
CHI = lambda x, df: f"exp(-{x} / 2) * ({' + '.join(f'pow({x} / 2, {j}) / {math.factorial(j)}.0::DOUBLE' for j in range(df // 2))})"
_lb = lambda t, of: f"SELECT z.series_id, z.n, z.n * (z.n + 2)::DOUBLE * sum(pow(a.c / z.c, 2) / (z.n - a.lag)) AS q, '{of}' AS \"of\" FROM {t} a JOIN {t} z ON a.series_id = z.series_id AND z.lag = 0 AND a.lag > 0 GROUP BY z.series_id, z.n, z.c"
add("ljung_box", RES, "series_id n ~q of ~p_value", f"SELECT *, {CHI('q', 20)} AS p_value FROM ({_lb('ac1', 'resid')} UNION ALL {_lb('ac2', 'resid2')}) AS lb")

add("correlogram_rv", f"""{VOL},
{autocorrelations("vol", "rv", 30, "ac")},
rho AS (SELECT a.series_id, max(z.n) AS n, list(a.c / z.c ORDER BY a.lag) AS r FROM ac a JOIN ac z ON a.series_id = z.series_id AND z.lag = 0 GROUP BY a.series_id),
lev AS (SELECT series_id, 0 AS k, CAST([] AS DOUBLE[]) AS phi, 1.0::DOUBLE AS p FROM rho
 UNION ALL SELECT series_id, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - ph * phi[k + 1 - j]), ph), ph FROM
 (SELECT l.series_id, l.k, l.phi, (r.r[l.k + 2] - coalesce(list_sum(list_transform(range(1, l.k + 1), lambda j: l.phi[j] * r.r[l.k + 2 - j])), 0)) / (1 - coalesce(list_sum(list_transform(range(1, l.k + 1), lambda j: l.phi[j] * r.r[j + 1])), 0)) AS ph FROM lev l JOIN rho r ON l.series_id = r.series_id WHERE l.k < 30) AS nxt)""", "series_id lag ~acf ~pacf significant", "SELECT l.series_id, CAST(k AS INTEGER) AS lag, r[k + 1] AS acf, p AS pacf, k > 0 AND abs(p) > 1.96::DOUBLE / sqrt(n) AS significant FROM lev l JOIN rho ON l.series_id = rho.series_id")


def _lm() -> str:
    part = "OVER (PARTITION BY series_id)"
    lags = [f"x{j}" for j in range(1, 11)]
    out = [f"l0 AS (SELECT series_id, resid2 AS y, {', '.join(f'lag(resid2, {j}) OVER {W} AS x{j}' for j in range(1, 11))} FROM res)", f"l1 AS (SELECT series_id, y - avg(y) {part} AS y, y - avg(y) {part} AS y0, {', '.join(f'{x} - avg({x}) {part} AS {x}' for x in lags)} FROM l0 WHERE x10 IS NOT NULL)"]
    for j, x in enumerate(lags, 1):
        slope = lambda v, x=x: f"sum({v} * {x}) {part} / sum({x} * {x}) {part}"
        out.append(f"l{j + 1} AS (SELECT series_id, y0, y - ({slope('y')}) * {x} AS y{''.join(f', {v} - ({slope(v)}) * {x} AS {v}' for v in lags[j:])} FROM l{j})")
    return ",\n".join(out)


add("arch_lm", f"{RES},\n{_lm()}", "series_id n ~lm ~p_value", f"SELECT *, {CHI('lm', 10)} AS p_value FROM (SELECT series_id, count(*) AS n, count(*) * (1 - sum(y * y) / sum(y0 * y0)) AS lm FROM l11 GROUP BY series_id) AS q")
add("ols_inference", f"""{SCHED},
tr AS (SELECT r.series_id, r.refit_id, s.rv AS y, s.rv1 AS a, s.rv22 AS b FROM sched r JOIN sched s ON r.series_id = s.series_id AND r.is_refit AND s.rn < r.rn),
m0 AS (SELECT series_id, refit_id, CAST(count(*) AS INTEGER) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, regr_sxx(y, a) AS saa, regr_sxx(y, b) AS sbb, regr_sxy(b, a) AS sab, regr_sxy(y, a) AS say, regr_sxy(y, b) AS sby, regr_syy(y, a) AS syy FROM tr GROUP BY 1, 2),
m1 AS (SELECT *, saa * sbb - sab * sab AS det FROM m0), m2 AS (SELECT *, (sbb * say - sab * sby) / det AS ba, (saa * sby - sab * say) / det AS bb FROM m1), m3 AS (SELECT *, (syy - ba * say - bb * sby) / (n - 3) AS s2, my - ba * ma - bb * mb AS b0 FROM m2),
m4 AS (SELECT series_id, refit_id, n, 'const' AS feature, b0 AS coef, sqrt(s2 * (1.0::DOUBLE / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det)) AS se FROM m3 UNION ALL SELECT series_id, refit_id, n, 'rv1', ba, sqrt(s2 * sbb / det) FROM m3 UNION ALL SELECT series_id, refit_id, n, 'rv22', bb, sqrt(s2 * saa / det) FROM m3),
m5 AS (SELECT *, coef / se AS t, n - 3 AS df, atan(abs(coef / se) / sqrt((n - 3)::DOUBLE)) AS th FROM m4)""", "series_id refit_id n_train feature ~coef ~se ~t ~p", f"SELECT *, n AS n_train, greatest({T_P}, 0) AS p FROM m5")


# The reports over ten models under the fixed variance parameters.
_lines = {"M2 EGARCH": "sigma", "M2b Corrected EGARCH": "alpha_pooled + beta_pooled * sigma", "M2c Regime-OLS": "CASE WHEN rv1_pctile >= 0.9 THEN alpha_crisis + beta_crisis * sigma ELSE alpha_calm + beta_calm * sigma END"}
_parts = ",\n".join([*[ols(f"z{k}", s).replace(f"z{k} AS (", f"z{k} AS MATERIALIZED (") for k, s in enumerate(SPECS)], ols("zc", _combined, "ssched").replace("zc AS (", "zc AS MATERIALIZED (")])
_all = " UNION ALL ".join([*[forecast(f"z{k}", s) for k, s in enumerate(SPECS)], forecast("zc", _combined), *[f"SELECT s.series_id, dt, '{n}' AS model, rv AS actual, greatest({x}, 1e-4::DOUBLE) AS forecast FROM ssched s JOIN mz ON s.series_id = mz.series_id AND s.refit_id = mz.refit_id WHERE usable" for n, x in _lines.items()]])
TEN = f"{CORRECTED.replace('sched AS (', 'sched AS MATERIALIZED (', 1).replace('mz AS (', 'mz AS MATERIALIZED (')},\n{THRESHOLD},\n{_parts},\nfc AS MATERIALIZED (SELECT f.*, actual > threshold AS crisis FROM ({_all}) AS f JOIN thr ON f.series_id = thr.series_id)"
_after = lambda text: text.split("fc AS (", 1)[1].split("\nmet AS", 1)[1]
TEN_MET = f"{TEN},\nmet AS{_after(ZOO)}"
TEN_RANKED = f"{TEN},\nmet AS{_after(RANKED)}"
_pairs = lambda pairs: f"pairs AS (SELECT * FROM (VALUES {', '.join(f'({a!r}, {b!r})' for a, b in pairs)}) AS v(first, second)),\npair AS MATERIALIZED (SELECT b.series_id, p.first, p.second, b.dt, b.crisis, b.actual, b.forecast AS f1, o.forecast AS f2 FROM pairs p JOIN fc b ON b.model = p.first JOIN fc o ON o.model = p.second AND b.series_id = o.series_id AND b.dt = o.dt)"
_dm = DM.split("diff AS", 1)[1]
TEN_DM = f"{TEN_MET},\n{_pairs(REPORT_PAIRS)},\ndiff AS{_dm}"
add("report_metrics", TEN_MET, "series_id model subsample n ~rmse ~mae ~qlike", "SELECT * FROM met")
add("report_rankings", TEN_RANKED, "series_id model n ~rmse ~mae ~qlike rank_by_rmse rank_by_qlike", "SELECT * FROM ranked")
add("report_top_forecasts", TEN_RANKED, "series_id dt model ~actual ~forecast rank_by_rmse", "SELECT f.*, rank_by_rmse FROM fc f JOIN ranked r ON f.series_id = r.series_id AND f.model = r.model WHERE rank_by_rmse <= 3")
add("report_row_losses", TEN, "series_id dt model ~sq_err ~abs_err crisis", "SELECT *, pow(actual - forecast, 2) AS sq_err, abs(actual - forecast) AS abs_err FROM fc")
add("report_csed", TEN_DM, "series_id dt model ~csed", f"SELECT series_id, dt, second AS model, sum(pow(actual - f1, 2) - pow(actual - f2, 2)) OVER (PARTITION BY series_id, second ORDER BY dt ROWS UNBOUNDED PRECEDING) AS csed FROM pair WHERE first = '{BASE}'")
add("report_dm_tests", TEN_DM, "series_id first second loss subsample n ~dm_stat ~p_value stars verdict", "SELECT * FROM dms")
add("report_dm_of_corrections", TEN_DM, "series_id comparison loss subsample n ~dm_stat ~p_value", "SELECT *, second || ' vs ' || first AS comparison FROM dms WHERE regexp_matches(second || ' vs ' || first, 'M2[bc]')")
add("report_wins", TEN_DM, "series_id n_tests n_wins winners", f"SELECT series_id, count(*) AS n_tests, count(*) FILTER (WHERE dm_stat > 0 AND p_value < 0.05) AS n_wins, coalesce(string_agg(second, ', ' ORDER BY second) FILTER (WHERE dm_stat > 0 AND p_value < 0.05), '') AS winners FROM dms WHERE first = '{BASE}' AND loss = 'mse' AND subsample = 'overall' GROUP BY series_id")
add("report_mz_tests", f"{TEN},\nxy AS (SELECT series_id, model, actual AS y, forecast AS x FROM fc),\n{MZ_TEST.format(key='series_id, model', rows='xy')}", "series_id model n ~alpha ~alpha_se ~beta ~beta_se ~r2 ~f_stat ~f_pval", "SELECT *, pow(1 + 2 * f_stat / (n - 2), -(n - 2) / 2.0::DOUBLE) AS f_pval FROM mt")
_listed = " OR ".join(f"(first = {a!r} AND second = {b!r})" for a, b in ENCOMPASSING_PAIRS)
add("report_encompassing", f"{TEN_RANKED},\n{_pairs(list(dict.fromkeys([*ENCOMPASSING_PAIRS, *[(m, 'M2 EGARCH') for m in REPORTED if m != 'M2 EGARCH']])))},\ne0 AS{ENC.split('e0 AS', 1)[1]}", "series_id first second n ~b1 ~t1 ~p1 ~b2 ~t2 ~p2 best encompasses", f"SELECT e.series_id, first, second, e.n, b1, t1, greatest(p1, 0) AS p1, b2, t2, greatest(p2, 0) AS p2, r.model AS best, p2 > 0.05 AS encompasses FROM e6 e JOIN ranked r ON e.series_id = r.series_id AND rank_by_rmse = 1 WHERE first = r.model OR {_listed}")
add("report_test_crisis", f"{TEN},\nthr2 AS (SELECT series_id, quantile_cont(rv, 0.9) AS threshold FROM sched WHERE usable GROUP BY series_id),\nfc2 AS (SELECT f.* REPLACE (actual > t.threshold AS crisis) FROM fc f JOIN thr2 t ON f.series_id = t.series_id)", "series_id model subsample n ~rmse ~mae", "SELECT series_id, model, CASE WHEN crisis THEN 'crisis' ELSE 'calm' END AS subsample, count(*) AS n, sqrt(avg(pow(actual - forecast, 2))) AS rmse, avg(abs(actual - forecast)) AS mae FROM fc2 GROUP BY 1, 2, 3")
add("report_crisis_bars", TEN_MET, "series_id model n ~qlike", f"SELECT * FROM met WHERE subsample = 'crisis' AND model IN ('{BASE}', 'M2 EGARCH', 'M2b Corrected EGARCH', 'M2c Regime-OLS', 'M3 Combined')")
_keyed = lambda text: text.replace("PARTITION BY series_id", "PARTITION BY series_id, model").replace("SELECT series_id", "SELECT series_id, model").replace("SELECT a.series_id", "SELECT a.series_id, a.model").replace("a.series_id = b.series_id", "a.series_id = b.series_id AND a.model = b.model").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3").replace("SELECT z.series_id", "SELECT z.series_id, z.model").replace("a.series_id = z.series_id", "a.series_id = z.series_id AND a.model = z.model").replace("GROUP BY z.series_id", "GROUP BY z.series_id, z.model").replace("GROUP BY series_id", "GROUP BY series_id, model")
add("report_residuals", f"{TEN},\nres AS MATERIALIZED (SELECT series_id, model, dt, actual - forecast AS resid, pow(actual - forecast, 2) AS resid2 FROM fc),\n{_keyed(autocorrelations('res', 'resid', 20, 'ac1'))},\n{_keyed(autocorrelations('res', 'resid2', 20, 'ac2'))},\n{_keyed(_lm())}", "series_id model n ~q ~p_q ~q_squared ~p_q_squared ~lm ~p_lm", f"SELECT a.series_id, a.model, a.n, a.q, {CHI('a.q', 20)} AS p_q, b.q AS q_squared, {CHI('b.q', 20)} AS p_q_squared, lm, {CHI('lm', 10)} AS p_lm FROM ({_keyed(_lb('ac1', 'resid'))}) AS a JOIN ({_keyed(_lb('ac2', 'resid2'))}) AS b ON a.series_id = b.series_id AND a.model = b.model JOIN (SELECT series_id, model, count(*) * (1 - sum(y * y) / sum(y0 * y0)) AS lm FROM l11 GROUP BY series_id, model) AS c ON a.series_id = c.series_id AND a.model = c.model")
_ends = [f"{f}({c}) AS {n}_{c}" for c in ("n_train", "n_crisis", "n_calm", "alpha_crisis", "beta_crisis", "alpha_calm", "beta_calm") for n, f in (("least", "min"), ("most", "max"))]
add("fixed_refit_ranges", CORRECTED, "series_id refits crisis_stable calm_stable " + " ".join(("~" if "a_c" in x else "") + x.split(" AS ")[1] for x in _ends), f"SELECT series_id, count(*) AS refits, bool_and(crisis_stable) AS crisis_stable, bool_and(calm_stable) AS calm_stable, {', '.join(_ends)} FROM mz GROUP BY series_id")
for _name, _of in (("feature_table_in_ranges", "feature_table"), ("refit_schedule_in_ranges", "refit_schedule"), ("rolling_ols_in_ranges", "rolling_ols_1000"), ("asof_params_in_ranges", "asof_params"), ("correlogram_in_ranges", "correlogram_rv")):
    ORACLES[_name] = ORACLES[_of]
for _name, _of in (("trailing_rank_in_ranges", "rolling_pct_rank_252"), ("bars_csv_round_trip", "daily_bars"), ("bars_parquet_round_trip", "daily_bars")):
    ORACLES[_name] = ORACLES[_of]
add("price_percentiles", "px AS (SELECT l_returnflag, l_extendedprice / l_quantity AS px FROM lineitem WHERE l_quantity > 0)", "l_returnflag ~percentile p", " UNION ALL ".join(f"SELECT l_returnflag, quantile_cont(px, {p}) AS percentile, {p}::DOUBLE AS p FROM px GROUP BY l_returnflag" for p in (0.0, 0.5, 0.9, 0.99, 1.0)))
add("crisis_thresholds_refined", f"{SCHED},\n{THRESHOLD}", "series_id ~threshold", "SELECT * FROM thr")
add("csv_malformed_lines", "x AS (SELECT l_returnflag AS flag, l_linenumber < 5 AS good, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_shipdate AS DATE) AS day FROM lineitem)", "flag n_good n_bad ~quantity last_day", "SELECT flag, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE NOT good) AS n_bad, sum(quantity) FILTER (WHERE good) AS quantity, max(day) FILTER (WHERE good) AS last_day FROM x GROUP BY flag")
add("regime_blend_rebuilt", BLEND, "series_id n ~mean_rebuilt equal", "SELECT series_id, count(*) AS n, avg(forecast) AS mean_rebuilt, true AS equal FROM blended GROUP BY 1")

"""Every model of the walk-forward against direct computation on one series, under given variance parameters, and the audits."""

import datetime as dt
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.simplex import minimize
from volspan.operators import corrections as cor
from volspan.operators import egarch, zoo
from volspan.operators import evaluation as ev
from volspan.operators import variance_pass as vp
from volspan.operators import walk_forward as wf

DAY = dt.date(2015, 1, 1)
NAMES = ["rv", "rv1", "rv2", "rv5", "rv22", "rv_neg", "ret_lag", "abs_ret_lag", "log_rv", "log_rv1", "log_rv2", "log_rv5", "log_rv22", "return", "rv1_pctile"]
PARAMS = {"mu": 0.02, "omega": 0.03, "alpha": 0.2, "gamma": -0.08, "beta": 0.9, "nu": 7.0}
N = 620


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(8)
    returns = rng.standard_t(6, N)
    sigma = np.exp(np.array(egarch.log_variances(returns.tolist(), **PARAMS)[:-1]) / 2)
    x = np.exp(rng.normal(size=(N, len(NAMES)))) + 0.1
    x[:, 0] = 0.3 + 0.6 * sigma * np.exp(0.3 * rng.normal(size=N)) + 0.1 * x[:, 1]
    x[:, 8:13] = np.log(x[:, :5])
    x[:, 13], x[:, 14] = returns, rng.uniform(size=N)
    return x, sigma


@pytest.fixture(scope="module")
def scheduled(spark, table):
    rows = [("s", DAY + dt.timedelta(k), *r) for k, r in enumerate(table[0].tolist())]
    features = spark.createDataFrame(rows, "series_id string, dt date, " + ", ".join(f"`{n}` double" for n in NAMES))
    short = spark.createDataFrame([("short", *r[1:]) for r in rows[:30]], features.schema)
    return wf.schedule(features.union(short), months=3, every=21, least=400).persist()


def qlike(y, f):
    r = (y / np.maximum(f, 1e-4)) ** 2
    return float(np.mean(r - np.log(r) - 1))


def direct(x, sigma, at, t):
    """Forecasts of the conditional-variance models for row ``t``, refitted at row ``at``."""
    y, s, p = x[:at, 0], sigma[:at], x[:at, 14]
    lines = {}
    for name, rows in (("pooled", p >= 0), ("crisis", p >= 0.9), ("calm", p < 0.9)):
        b, a = np.polyfit(s[rows], y[rows], 1)
        lines[name], lines["q_" + name] = (a, b), minimize(lambda q, y=y[rows], s=s[rows]: qlike(y, q[0] + q[1] * s), [a, b])[0]
    on = lambda line, v: lines[line][0] + lines[line][1] * v
    kinds = {
        "pooled": lambda v, q: on("pooled", v), "regime": lambda v, q: np.where(q >= 0.9, on("crisis", v), on("calm", v)), "q_pooled": lambda v, q: on("q_pooled", v),
        "q_regime": lambda v, q: np.where(q >= 0.9, on("q_crisis", v), on("q_calm", v)), "switch": lambda v, q: np.where(q >= 0.9, v, on("q_calm", v)),
    }
    ols = lambda z: np.linalg.lstsq(np.column_stack([np.ones(at), z[:at]]), y, rcond=None)[0]
    har, both = ols(x[:, 1:5]), ols(np.column_stack([x[:, 1:5], on("pooled", sigma)]))
    fitted = har[0] + x[:, 1:5] @ har[1:]
    out = {zoo.RAW: sigma[t], zoo.COMBINED: both[0] + np.append(x[t, 1:5], on("pooled", sigma[t])) @ both[1:]}
    for name, kind in ((zoo.POOLED, "pooled"), (zoo.REGIME, "regime"), (zoo.Q_POOLED, "q_pooled"), (zoo.Q_REGIME, "q_regime"), (zoo.SWITCH, "switch")):
        out[name] = float(kinds[kind](sigma[t], x[t, 14]))
    for name, kind in zoo.BLENDS.items():
        first, best = np.maximum(kinds[kind](s, p), 1e-4), (np.inf,)
        for c in range(17):
            for k in range(1, 21):
                w = 1 / (1 + np.exp(-k * (p - (0.1 + 0.05 * c))))
                best = min(best, (round(qlike(y, w * first + (1 - w) * np.maximum(fitted[:at], 1e-4)), 12), c, k))
        w = 1 / (1 + np.exp(-best[2] * (x[t, 14] - (0.1 + 0.05 * best[1]))))
        out[name] = w * max(float(kinds[kind](sigma[t], x[t, 14])), 1e-4) + (1 - w) * max(fitted[t], 1e-4)
    return {m: max(v, 1e-4) for m, v in out.items()}


def test_every_model_equals_direct_computation(spark, table, scheduled):
    x, sigma = table
    found = zoo.fit(scheduled, egarch.fixed_refits(scheduled, PARAMS))
    got = {(r["model"], r["dt"]): r["forecast"] for r in zoo.forecasts(scheduled, found).collect()}
    rows = scheduled.filter("usable").orderBy("dt").collect()
    assert len(got) == len(rows) * (len(wf.SPECS) + 7 + len(zoo.BLENDS))
    first = {}
    for r in rows:
        first.setdefault(r["refit_id"], r["rn"])
    for r in rows[::9]:
        for model, value in direct(x, sigma, first[r["refit_id"]], r["rn"]).items():
            assert got[model, r["dt"]] == pytest.approx(value, rel=1e-6), (model, r["dt"])
    audit = zoo.audit(found).orderBy("refit_id").collect()
    assert [r["n_train"] for r in audit] == [first[k] for k in sorted(first)] and all(r["eg_beta"] == 0.9 for r in audit)
    slopes = zoo.slopes_fall(found).first()
    above = [r[f"beta_d_{n}"] > r[f"beta_{n}"] for r in audit for n in ("pooled", "crisis", "calm")]
    assert (slopes["refits"], slopes["all_above"], slopes["all_below"]) == (len(audit), all(above), not any(above))
    ranges = zoo.audit_ranges(found).first()
    assert (ranges["least_n_train"], ranges["most_n_train"]) == (audit[0]["n_train"], audit[-1]["n_train"])
    assert ranges["crisis_stable"] == all(r["crisis_stable"] for r in audit)


def test_report_holds_every_model(scheduled):
    found = zoo.all_models(scheduled, egarch.fixed_refits(scheduled, PARAMS)).persist()
    n_models, n_rows = len(wf.SPECS) + 7 + len(zoo.BLENDS), scheduled.filter("usable").count()
    report = zoo.full_report(scheduled, found)
    count = {name: table.count() for name, table in report.items()}
    assert count["accuracy"] == count["efficiency"] == count["residuals"] == count["crisis_bars"] == n_models and count["by_regime"] == 3 * n_models
    assert count["against_base"] == (n_models - 1) * 9 and count["conditional"] == 2 * n_models and count["in_crises"] == 3 * len(set(zoo.CRISIS_PAIRS))
    assert count["cumulative"] == (n_models - 1) * n_rows and count["best_forecasts"] == 3 * n_rows and count["verdict"] == 1
    assert len(zoo.ENCOMPASSING_PAIRS) <= count["encompassing"] <= len(zoo.ENCOMPASSING_PAIRS) + 1


def test_refits_are_fitted_together_and_one_after_the_other(spark, table, scheduled, monkeypatch):
    x = table[0]
    fits = egarch.fit_refits(scheduled).orderBy("refit_id").collect()
    chained = egarch.fit_refits(scheduled, chained=True).orderBy("refit_id").collect()
    served = {r["refit_id"]: (r["first"], r["last"]) for r in scheduled.filter("usable").groupBy("refit_id").agg(F.min("rn").alias("first"), F.max("rn").alias("last")).collect()}
    assert [r["refit_id"] for r in fits] == sorted(served) and all((r["first"], r["last"]) == served[r["refit_id"]] and r["n_train"] == r["first"] for r in fits)
    rng = np.random.default_rng(2)
    for r, c in zip(fits, chained, strict=True):
        returns = x[: r["n_train"], 13]
        p = np.array([r[k] for k in egarch.PARAMS])
        assert r["converged"] and r["grad_norm"] <= egarch.TOLERANCE and r["loglik"] == pytest.approx(-egarch.negative_log_likelihood(returns, p))
        assert c["loglik"] == pytest.approx(r["loglik"], abs=1e-3)
        for _ in range(3):
            start = [rng.normal(), rng.normal(), rng.normal(0, 0.3), rng.normal(0, 0.2), rng.uniform(-0.9, 0.95), rng.uniform(3, 40)]
            assert egarch.fit(returns, start)[1] <= r["loglik"] + 1e-3
    monkeypatch.setattr(egarch, "LANES", 2)
    again = egarch.fit_refits(scheduled).orderBy("refit_id").collect()
    assert [r["loglik"] for r in again] == pytest.approx([r["loglik"] for r in fits], abs=1e-3)


def test_sums_are_those_of_each_refits_own_filter(table, scheduled, monkeypatch):
    x, _ = table
    params = egarch.fit_refits(scheduled, embargo=5)
    found = vp.summed(scheduled, params).orderBy("refit_id").collect()
    for r in found:
        n, own = r["n_train"], {p: r[p] for p in egarch.PARAMS}
        assert n == r["first"] - 5
        s, y, p = np.exp(np.array(egarch.log_variances(x[:, 13].tolist(), **own)) / 2), x[:n, 0], x[:n, 14]
        for k, rows in enumerate((p >= 0, p >= 0.9, p < 0.9)):
            assert r["sums"][6 * k : 6 * k + 6] == pytest.approx([rows.sum(), s[:n][rows].sum(), (s[:n][rows] ** 2).sum(), y[rows].sum(), (y[rows] ** 2).sum(), (s[:n][rows] * y[rows]).sum()])
        z = np.column_stack([y, x[:n, 1:5], s[:n]])
        assert r["moments"] == pytest.approx([*z.sum(axis=0), *[(z[:, a] * z[:, b]).sum() for a in range(6) for b in range(a + 1)]])
        assert [v["rn"] for v in r["served"]] == list(range(r["first"], r["last"] + 1)) and [v["sigma"] for v in r["served"]] == pytest.approx(s[r["first"] : r["last"] + 1].tolist())
    monkeypatch.setattr(egarch, "LANES", 1)
    again = vp.summed(scheduled, params).orderBy("refit_id").collect()
    assert all(a["sums"] == pytest.approx(b["sums"]) and a["moments"] == pytest.approx(b["moments"]) for a, b in zip(found, again, strict=True))
    # Five rows ahead: from the filter that ends five rows before the row, by the refit's own paths.
    for r in vp.summed(scheduled, params, horizon=5, embargo=5).collect():
        own = {p: r[p] for p in egarch.PARAMS}
        v = np.array(egarch.log_variances(x[:, 13].tolist(), **own))
        added = egarch.shocks(own, 5, 500, np.random.default_rng([42, zlib.crc32(b"s"), r["refit_id"]]))
        want = egarch.path_mean(v[r["first"] - 5 : r["last"] - 4], own, added)
        assert [q["rn"] for q in r["served"]] == list(range(r["first"], r["last"] + 1)) and [q["sigma"] for q in r["served"]] == pytest.approx(want.tolist())


def test_volatilities_that_are_not_kept_are_computed_again(table, monkeypatch):
    x, _ = table
    rows, refits = pd.DataFrame({"return": x[:, 13]}), pd.DataFrame([PARAMS, {**PARAMS, "beta": 0.5}])
    kept = np.concatenate([s for _, s in vp._sigmas(rows, refits, 100)()])
    monkeypatch.setattr(vp, "KEPT", 10)
    passes = vp._sigmas(rows, refits, 70)
    for _ in range(2):
        assert np.concatenate([s for _, s in passes()]) == pytest.approx(kept)
    assert kept[:, 0] == pytest.approx(np.exp(np.array(egarch.log_variances(x[:, 13].tolist(), **PARAMS)[:-1]) / 2))


def test_pairs_in_order_and_unknown_regimes(spark):
    assert ev.distinct_pairs([("a", "b"), ("b", "a"), ("a", "b"), ("a", "c")]) == [("a", "b"), ("b", "a"), ("a", "c")]
    forecasts = spark.createDataFrame([(s, DAY, "m", 1.0 + k, 1.0) for k, s in enumerate("xy")], "series_id string, dt date, model string, actual double, forecast double")
    labelled = ev.label_regimes(forecasts, spark.createDataFrame([("x", 0.5)], "series_id string, threshold double"))
    assert {(r["series_id"], r["subsample"]) for r in ev.metrics(labelled).collect()} == {("x", "crisis"), ("x", "overall"), ("y", "unknown"), ("y", "overall")}
    assert labelled.filter(F.col("crisis").isNull()).count() == 1

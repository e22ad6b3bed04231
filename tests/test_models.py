"""Walk-forward models, conditional variance, corrections and tests against direct computation and published numbers."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspan.functions import distributions as dist
from tests.simplex import minimize
from volspan.operators import diagnostics as dia
from volspan.functions.quasi_newton import minimize_lanes
from volspan.operators import egarch, reports
from volspan.operators import variance_pass as vp
from volspan.operators import evaluation as ev
from volspan.operators import walk_forward as wf

DAY = dt.date(2015, 1, 1)
NAMES = ["rv", "rv1", "rv2", "rv5", "rv22", "rv_neg", "ret_lag", "abs_ret_lag", "log_rv", "log_rv1", "log_rv2", "log_rv5", "log_rv22"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    x = np.exp(rng.normal(size=(1300, len(NAMES)))) + 0.1
    x[:, 0] = 0.5 + x[:, 1:5] @ [0.3, 0.2, 0.1, 0.1] + np.exp(rng.normal(size=1300))
    x[:, 8:] = np.log(x[:, :5])
    return x


def frame(spark, x):
    return spark.createDataFrame([("s", DAY + dt.timedelta(k), *row) for k, row in enumerate(x.tolist())], "series_id string, dt date, " + ", ".join(f"{n} double" for n in NAMES))


def direct(x, spec, at, t):
    f = [NAMES.index(n) for n in spec.features]
    lo = max(0, at - spec.rolling) if spec.rolling else 0
    a, y = x[lo:at][:, f], x[lo:at, NAMES.index(spec.target)]
    c = a - a.mean(axis=0)
    b = np.linalg.solve(c.T @ c + spec.ridge * np.eye(len(f)), c.T @ (y - y.mean()))
    fit = lambda z: y.mean() + (z - a.mean(axis=0)) @ b
    out = fit(x[t, f])
    return max(math.exp(out + np.var(y - fit(a), ddof=1) / 2) if spec.log else out, 1e-4)


def test_walk_forward_equals_direct_fits(spark, table):
    got = {(r["model"], r["dt"]): r["forecast"] for r in wf.walk_forward(frame(spark, table)).collect()}
    test = [k for k in range(1300) if DAY + dt.timedelta(k) > dt.date(2017, 1, 23)]
    assert len(got) == len(test) * len(wf.SPECS)
    for spec in wf.SPECS:
        for i in range(0, len(test), 17):
            at = test[i - i % 21]
            assert got[spec.name, DAY + dt.timedelta(test[i])] == pytest.approx(direct(table, spec, at, test[i]), rel=1e-9)


def test_no_look_ahead(spark, table):
    before = {(r["model"], r["dt"]): r["forecast"] for r in wf.walk_forward(frame(spark, table)).collect()}
    changed = table.copy()
    changed[1200:] *= 3
    after = {(r["model"], r["dt"]): r["forecast"] for r in wf.walk_forward(frame(spark, changed)).collect()}
    cut = DAY + dt.timedelta(1200)
    assert all(after[k] == pytest.approx(v, rel=1e-12) for k, v in before.items() if k[1] < cut)


def test_ridge_tends_to_least_squares(spark, table):
    free, tied = wf.Spec("free", ("rv1", "rv5")), wf.Spec("tied", ("rv1", "rv5"), ridge=1e-9)
    rows = wf.fit_models(wf.schedule(frame(spark, table)), [free, tied]).collect()
    by = {(r["model"], r["refit_id"]): r["coef"] for r in rows}
    assert all(by["free", k] == pytest.approx(by["tied", k], rel=1e-9) for m, k in by if m == "free")


@pytest.mark.parametrize("t, df, p", [(2.7970, 37, 0.00814), (3.8329, 37, 0.00048), (1.0915, 37, 0.2821), (3.5995, 375, 0.00036), (1.4281, 375, 0.1541), (2.4622, 28, 0.0202), (1.4526, 11, 0.1743), (0.0, 5, 1.0), (1.0, 1, 0.5), (1.0, 2, 0.42265)])
def test_student_t(spark, t, df, p):
    got = spark.range(1).select(dist.student_t_p(F.lit(t), F.lit(df)), dist.student_t_p(F.lit(-t), F.lit(df))).first()
    assert got[0] == got[1] == pytest.approx(p, rel=2e-2 if p < 0.001 else 2e-3)


def test_other_tails(spark):
    got = spark.range(1).select(dist.chi_squared_p(F.lit(31.410433), 20), dist.f_two_p(F.lit(3.295), F.lit(36.0).cast("double"))).first()
    assert got[0] == pytest.approx(0.05, rel=1e-5) and got[1] == pytest.approx((1 + 2 * 3.295 / 36) ** -18)
    with pytest.raises(ValueError):
        dist.chi_squared_p(F.lit(1.0), 3)


@pytest.fixture(scope="module")
def forecasts(spark):
    rng = np.random.default_rng(4)
    actual = np.exp(rng.normal(size=80))
    models = {"a": actual * np.exp(0.2 * rng.normal(size=80)), "b": np.full(80, 1.0), "same": np.full(80, 1.0), "true": actual}
    rows = [("s", DAY + dt.timedelta(k), m, float(actual[k]), float(f[k]), bool(actual[k] > 1.5)) for m, f in models.items() for k in range(80)]
    return spark.createDataFrame(rows, "series_id string, dt date, model string, actual double, forecast double, crisis boolean")


def test_accuracy_by_subsample(forecasts):
    got = {(r["model"], r["subsample"]): r for r in ev.metrics(forecasts).collect()}
    assert got["true", "overall"]["rmse"] == 0 and got["true", "crisis"]["qlike"] == pytest.approx(0)
    assert all(r["qlike"] >= -1e-12 for r in got.values())
    assert got["a", "crisis"]["n"] + got["a", "calm"]["n"] == got["a", "overall"]["n"] == 80
    assert ev.ranking(ev.metrics(forecasts)).filter("rank_by_rmse = 1").first()["model"] == "true"


def test_equal_accuracy_tests(spark, forecasts):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "same")], "first string, second string")
    got = {(r["first"], r["second"], r["loss"], r["subsample"]): (r["dm_stat"], r["p_value"]) for r in ev.dm_tests(forecasts, pairs).collect()}
    assert len(got) == 27
    for k, (stat, p) in got.items():
        if k[1] == "same":
            assert (stat, p) == (0, 1)
        else:
            other = got[k[1], k[0], *k[2:]]
            assert stat == pytest.approx(-other[0]) and p == pytest.approx(other[1])
    assert got["a", "b", "mse", "overall"][0] < 0
    assert sum(r["n_tests"] for r in reports.dm_tally(ev.dm_tests(forecasts, pairs)).collect()) == 27


def test_calibration_and_encompassing(spark, forecasts):
    mz = {r["model"]: r for r in ev.mincer_zarnowitz(forecasts, ["model"]).collect()}
    assert (mz["true"]["alpha"], mz["true"]["beta"]) == pytest.approx((0, 1), abs=1e-12)
    assert mz["b"]["beta"] is None and mz["b"]["f_pval"] is None
    enc = ev.encompassing(forecasts, spark.createDataFrame([("a", "b")], "first string, second string")).first()
    x = np.array([(r["f1"], r["f2"], r["actual"]) for r in ev._pairs(forecasts, spark.createDataFrame([("a", "b")], "first string, second string")).collect()])
    assert (enc["b1"], enc["b2"]) == pytest.approx(tuple(np.linalg.lstsq(x[:, :2], x[:, 2], rcond=None)[0]))
    wide = ev.long_to_wide(forecasts.filter("model in ('a', 'b')"), ["a", "b"])
    assert ev.wide_to_long(wide, ["a", "b"]).count() == 160


def test_serial_dependence(spark):
    rng = np.random.default_rng(5)
    x = [0.0]
    for e in rng.normal(size=399):
        x.append(0.6 * x[-1] + float(e))
    df = spark.createDataFrame([("s", k, v) for k, v in enumerate(x)], "series_id string, k int, v double")
    found = dia.with_pacf(dia.acf(df, ["series_id"], "v", "k", 20), 20)
    r = found.first()
    c = np.array(x) - np.mean(x)
    rho = [float(c[k:] @ c[: len(c) - k] / (c @ c)) for k in range(21)]
    assert r["acf"] == pytest.approx(rho)
    m = np.array([[rho[abs(i - j)] for j in range(5)] for i in range(5)])
    assert r["pacf"][5] == pytest.approx(np.linalg.solve(m, rho[1:6])[-1])
    assert dia.ljung_box(found, ["series_id"]).first()["p_value"] < 1e-6
    lm = dia.arch_lm(df, ["series_id"], "v", "k", 4).first()
    s = np.array(x) ** 2
    a = np.column_stack([np.ones(396), *[s[4 - j : 400 - j] for j in range(1, 5)]])
    resid = s[4:] - a @ np.linalg.lstsq(a, s[4:], rcond=None)[0]
    assert lm["lm"] == pytest.approx(396 * (1 - resid @ resid / ((s[4:] - s[4:].mean()) ** 2).sum()))


def test_simplex():
    best, value, done = minimize(lambda p: (p[0] - 1) ** 2 + 10 * (p[1] - p[0] ** 2) ** 2, [-1.0, 1.0])
    assert done and best == pytest.approx([1, 1], abs=1e-5) and value < 1e-9


def test_conditional_variance_recovers_parameters(spark):
    rng = np.random.default_rng(6)
    p = {"mu": 0.0, "omega": 0.02, "alpha": 0.2, "gamma": -0.1, "beta": 0.9, "nu": 8.0}
    v, returns = p["omega"] / (1 - p["beta"]), []
    for _ in range(3000):
        z = rng.standard_t(8) * math.sqrt(6 / 8)
        returns.append(math.exp(v / 2) * z)
        v = p["omega"] + p["alpha"] * (abs(z) - math.sqrt(2 / math.pi)) + p["gamma"] * z + p["beta"] * v
    found, loglik, _ = egarch.fit(np.array(returns))
    assert found["beta"] == pytest.approx(0.9, abs=0.06) and found["gamma"] == pytest.approx(-0.1, abs=0.05)
    assert loglik > -egarch.negative_log_likelihood(np.array(returns), np.array([p[k] for k in egarch.PARAMS])) - 1
    series = spark.createDataFrame([("s", DAY + dt.timedelta(k), r) for k, r in enumerate(returns[:300])], "series_id string, dt date, return double")
    sigma = [r["sigma"] for r in egarch.filter_fixed(series, p).orderBy("dt").collect()]
    assert sigma == pytest.approx(np.exp(np.array(egarch.log_variances(returns[:300], **p)[:-1]) / 2).tolist())
    one = egarch.simulate(series, p, horizon=1).orderBy("dt").collect()
    assert [r["forecast"] for r in one[:-1]] == pytest.approx(sigma[1:])
    assert egarch.simulate(series, p).collect() == egarch.simulate(series, p).collect()
    late = egarch.simulate(series, p, horizon=1, origin="embargoed").orderBy("dt").collect()
    assert [r["forecast"] for r in late[5:]] == pytest.approx(sigma[:-5])


def test_corrections(spark):
    rng = np.random.default_rng(7)
    x = np.exp(rng.normal(size=400))
    y, p = (0.2 + 0.7 * x) * np.exp(0.3 * rng.normal(size=400)), rng.uniform(size=400)
    p[p > 0.94] = 0.5  # under 30 rows in the crisis regime
    rows = [("s", k, float(a), float(b), float(c), 1.0, 1.0, 1.0, 1.0) for k, (a, b, c) in enumerate(zip(y, x, p, strict=True))]
    rows = spark.createDataFrame(rows, "series_id string, rn int, rv double, sigma double, rv1_pctile double, rv1 double, rv2 double, rv5 double, rv22 double")
    refits = spark.createDataFrame([("s", 0, 400, 400, 420)], "series_id string, refit_id int, n_train int, first int, last int")
    lines = vp.with_lines(vp.summed(rows, refits))
    r = vp.chosen(rows, lines, []).first()
    assert r["beta_pooled"] == pytest.approx(np.polyfit(x, y, 1)[0]) and not r["crisis_stable"] and r["beta_crisis"] == r["beta_pooled"] and r["n_crisis"] == (p >= 0.9).sum()
    ql = lambda a, b: np.mean((y / np.maximum(a + b * x, 1e-4)) ** 2 - np.log((y / np.maximum(a + b * x, 1e-4)) ** 2) - 1)
    assert r["converged_d_pooled"] and r["converged_d_calm"] and r["beta_d_crisis"] == r["beta_d_pooled"]
    for name, mask in (("pooled", p >= 0), ("calm", p < 0.9)):
        best, _, _ = minimize(lambda q, m=mask: float(np.mean((z := (y[m] / np.maximum(q[0] + q[1] * x[m], 1e-4)) ** 2) - np.log(z) - 1)), [r[f"alpha_{name}"], r[f"beta_{name}"]])
        assert [r[f"alpha_d_{name}"], r[f"beta_d_{name}"]] == pytest.approx(best.tolist(), abs=1e-6)
    assert all(ql(r["alpha_d_pooled"], r["beta_d_pooled"]) <= ql(r["alpha_d_pooled"] + e, r["beta_d_pooled"] - e) for e in (-0.01, 0.01))
    given = lambda a, b, har: lines.withColumns({"alpha_pooled": F.lit(a), "beta_pooled": F.lit(b), "har_intercept": F.lit(har), "har_coef": F.array(*[F.lit(0.0)] * 4)})
    best = vp.chosen(rows, given(0.2, 0.7, 5.0), ["pooled"], qlike=False).first()
    assert (round(best["c_pooled"], 9), best["k_pooled"]) == (0.1, 20.0)
    flat = vp.chosen(rows, given(1.0, 0.0, 1.0), ["pooled"], qlike=False).first()
    assert (round(flat["c_pooled"], 9), flat["k_pooled"]) == (0.1, 1.0)


def test_qlike_lines_from_bad_starts():
    """Newton's steps reach the simplex's line from far away, also from where the loss bends the other way."""
    rng = np.random.default_rng(3)
    x = np.exp(rng.normal(size=300))
    y = (0.5 + 0.4 * x) * np.exp(0.4 * rng.normal(size=300))
    starts = np.array([[0.5, 0.01, 2.0], [0.4, 0.001, 9.0]])
    mask = np.ones((300, 1), bool)
    at, done = vp.qlike_lines(starts, lambda q: vp._qlike_sums(y, np.repeat(x[:, None], q.shape[1], axis=1), mask, q[0], q[1]))
    best, _, _ = minimize(lambda q: float(np.mean((z := (y / np.maximum(q[0] + q[1] * x, 1e-4)) ** 2) - np.log(z) - 1)), [0.5, 0.4])
    assert done.all() and at == pytest.approx(np.repeat(best[:, None], 3, axis=1), abs=1e-6)


def test_gradient_of_the_likelihood(monkeypatch):
    returns = np.random.default_rng(0).standard_t(6, 300)
    counts, p = np.array([300, 120, 300, 7]), np.array([[0.02, 0.03, 0.2, -0.08, 0.9, 7.0], [0.1, -0.1, 0.1, 0.1, -0.5, 20.0], [0.0, 0.2, -0.1, 0.05, 0.3, 3.0], [0.3, 0.2, 1.5, 1.2, 0.3, 100.0]])
    for few in (0, 12):
        monkeypatch.setattr(egarch, "_FEW", few)
        value, gradient, _ = egarch.likelihoods(returns, counts, p)
        for k, n in enumerate(counts.tolist()):
            v, nu = np.array(egarch.log_variances(returns[:n].tolist(), *p[k])[:-1]), p[k, 5]
            constant = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
            assert value[k] == pytest.approx(-(constant - 0.5 * v - (nu + 1) / 2 * np.log1p((returns[:n] - p[k, 0]) ** 2 * np.exp(-v) / (nu - 2))).sum())
        for j in range(6):
            step = np.eye(6)[j] * 1e-6
            numeric = (egarch.likelihoods(returns, counts, p + step)[0] - egarch.likelihoods(returns, counts, p - step)[0]) / 2e-6
            assert gradient[:, j] == pytest.approx(numeric, rel=1e-4, abs=1e-4)


def test_quasi_newton_on_many_lanes():
    def f(x, lanes):
        """Rosenbrock's valley, another scale for each lane."""
        a = (lanes + 1.0) * 10
        return (1 - x[:, 0]) ** 2 + a * (x[:, 1] - x[:, 0] ** 2) ** 2, np.stack([-2 * (1 - x[:, 0]) - 4 * a * x[:, 0] * (x[:, 1] - x[:, 0] ** 2), 2 * a * (x[:, 1] - x[:, 0] ** 2)], axis=1)

    x, value, left = minimize_lanes(f, np.array([[-1.2, 1.0]] * 12 + [[1.0, 1.0]]), 1e-8, gain=1e-20)
    assert x == pytest.approx(np.ones((13, 2)), abs=1e-6) and (value < 1e-12).all() and (left <= 1e-8).all()


def test_paths_have_the_moments_of_a_closed_form():
    p = {"mu": 0.0, "omega": 0.1, "alpha": 0.2, "gamma": -0.1, "beta": 0.8, "nu": 7.0}
    added = egarch.shocks(p, 2, 400_000, np.random.default_rng(5))
    mean_abs = 2 * math.sqrt(p["nu"] - 2) * math.gamma((p["nu"] + 1) / 2) / ((p["nu"] - 1) * math.sqrt(math.pi) * math.gamma(p["nu"] / 2))
    assert not added[0].any() and added[1].mean() == pytest.approx(p["omega"] + p["alpha"] * (mean_abs - math.sqrt(2 / math.pi)), abs=1e-3)
    assert added[1].var() == pytest.approx(p["alpha"] ** 2 * (1 - mean_abs**2) + p["gamma"] ** 2, rel=0.02)
    v = np.array([0.5, -1.0])
    want = (np.exp(v / 2) + np.exp(0.5 * p["beta"] * v) * math.sqrt(np.exp(added[1]).mean())) / 2
    assert egarch.path_mean(v, p, added) == pytest.approx(want)
    assert egarch.path_mean(v, p, np.full((2, 3), np.inf)) == pytest.approx(np.exp(v / 2))

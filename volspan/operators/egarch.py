"""Asymmetric conditional variance (Nelson 1991) with Student-t errors.

ln s2[t] = omega + alpha (|z[t-1]| - sqrt(2 / pi)) + gamma z[t-1] + beta ln s2[t-1], z = (return - mu) / s; the first row has the unconditional log variance omega / (1 - beta).

The recursion runs along one series; all refits of a block (``LANES``) run along it side by side as lanes of one vector recursion, each as far as its history goes. So a task holds a series'
rows up to its last refit and a few numbers a lane, never a refit's rows; series, and blocks of a series' refits, run in parallel.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspan.functions.quasi_newton import minimize_lanes
from volspan.functions.volatility import FORECAST_FLOOR, floored

#: mu, omega, alpha, gamma, beta, nu
PARAMS = ("mu", "omega", "alpha", "gamma", "beta", "nu")
#: Near the fits of the whole ``ALL`` series.
FIXED = {"mu": 1.0, "omega": 9.3, "alpha": 0.6, "gamma": 0.02, "beta": 0.1, "nu": 15.0}
_MEAN_ABS = math.sqrt(2 / math.pi)
#: Refits that run side by side in one task.
LANES = 256
#: Bounds of the fit, kept by transformation: |beta| and nu's least and greatest value.
BETA_BOUND, NU_LEAST, NU_MOST = 0.9995, 2.05, 200.0
#: Greatest absolute gradient (of the mean log likelihood of scaled returns, in transformed parameters) of a converged fit. |z| bends where a return equals mu: at an optimum there the
#: likelihood falls to both sides of mu, and the gradient is that of the other parameters.
TOLERANCE = 1e-4


def log_variances(returns: list[float], mu: float, omega: float, alpha: float, gamma: float, beta: float, nu: float = 8.0) -> list[float]:
    """Log variance of each row and, last, of the row to come."""
    v, exp = omega / (1 - beta), math.exp
    out, base, up, down = [v], omega - alpha * _MEAN_ABS, gamma + alpha, gamma - alpha
    for r in returns:
        z = (r - mu) * exp(-v / 2)
        v = base + (up if z >= 0 else down) * z + beta * v
        if v > 50.0 or v < -50.0:
            v = min(max(v, -50.0), 50.0)
        out.append(v)
    return out


def lane_variances(returns: np.ndarray, params: np.ndarray, chunk: int = 512) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, log variances as rows x lanes) of successive chunks of a series under each lane's parameters (lanes x 6)."""
    mu, omega, alpha, gamma, beta, _ = params.T
    v, base, up, down = omega / (1 - beta), omega - alpha * _MEAN_ABS, gamma + alpha, gamma - alpha
    for lo in range(0, len(returns), chunk):
        part = returns[lo : lo + chunk]
        out = np.empty((len(part), len(params)))
        for k, r in enumerate(part):
            out[k] = v
            z = (r - mu) * np.exp(-0.5 * v)
            v = np.minimum(np.maximum(base + np.where(z >= 0, up, down) * z + beta * v, -50.0), 50.0)
        yield lo, out


def _digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 6 and the asymptotic series (Abramowitz and Stegun 6.3.5, 6.3.18)."""
    shift = np.zeros_like(x)
    for _ in range(6):
        shift = np.where(x < 6, shift - 1 / x, shift)
        x = np.where(x < 6, x + 1, x)
    y = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _sums(returns: list[float], p: list[float]) -> list[float]:
    """What a lane of ``likelihoods`` sums over rows, number by number: faster than vectors for a few lanes."""
    mu, omega, alpha, gamma, beta, nu = p
    exp, log, half, nu2, base, up, down = math.exp, math.log, (nu + 1) / 2, nu - 2, omega - alpha * _MEAN_ABS, gamma + alpha, gamma - alpha
    v, d0, d1, d2, d3, d4 = omega / (1 - beta), 0.0, 1 / (1 - beta), 0.0, 0.0, omega / (1 - beta) ** 2
    total = rests = growth = g0 = g1 = g2 = g3 = g4 = 0.0
    for r in returns:
        e = exp(-0.5 * v)
        z = (r - mu) * e
        q = nu2 + z * z
        pull = half * z / q
        log_q = log(q)
        total += 0.5 * v + half * log_q
        rests += 0.5 * log_q + half / q
        lift = 0.5 - pull * z
        g0 += lift * d0 - 2 * pull * e
        g1 += lift * d1
        g2 += lift * d2
        g3 += lift * d3
        g4 += lift * d4
        slope = up if z >= 0 else down
        bent = slope * z
        keep = beta - 0.5 * bent
        growth += log(abs(keep) + 1e-300)
        d0 = keep * d0 - slope * e
        d1 = keep * d1 + 1.0
        d2 = keep * d2 + abs(z) - _MEAN_ABS
        d3 = keep * d3 + z
        d4 = keep * d4 + v
        v = base + bent + beta * v
        if v > 50.0 or v < -50.0:
            v = min(max(v, -50.0), 50.0)
            d0 = d1 = d2 = d3 = d4 = 0.0
    return [total, rests, growth, g0, g1, g2, g3, g4]


#: Lanes up to which numbers are faster than vectors.
_FEW = 12


def likelihoods(returns: np.ndarray, counts: np.ndarray, params: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(negative log likelihood, its gradient, log growth of a change of the first variance) of each lane's first ``counts`` rows under its parameters (lanes x 6); the derivatives of the log
    variance have a recursion of their own."""
    order = np.argsort(-counts, kind="stable")
    many = -np.searchsorted(np.sort(counts), np.arange(counts.max(initial=0)), side="right") + len(counts)  # lanes whose history reaches each row
    mu, omega, alpha, gamma, beta, nu = params[order].T
    if len(counts) <= _FEW:
        sums = np.array([_sums(returns[:n].tolist(), p) for n, p in zip(counts[order].tolist(), params[order].tolist(), strict=True)]).T
        total, rests, growth, g, many = sums[0], sums[1], sums[2], sums[3:], many[:0]
    else:
        total, rests, growth, g = *np.zeros((3, len(counts))), np.zeros((5, len(counts)))
    v = omega / (1 - beta)
    d = np.zeros((5, len(counts)))
    d[1], d[4] = 1 / (1 - beta), omega / (1 - beta) ** 2
    base, up, down, half, nu2 = omega - alpha * _MEAN_ABS, gamma + alpha, gamma - alpha, (nu + 1) / 2, nu - 2
    a = len(counts)
    for t, n in enumerate(many.tolist()):
        if n < a:
            a = n
            mu, v, d, base, up, down, beta, half, nu2 = mu[:a], v[:a], d[:, :a], base[:a], up[:a], down[:a], beta[:a], half[:a], nu2[:a]
        e = np.exp(-0.5 * v)
        z = (returns[t] - mu) * e
        q = nu2 + z * z
        pull = half * z / q  # half of what a unit of z takes from the likelihood
        log_q = np.log(q)
        total[:a] += 0.5 * v + half * log_q
        rests[:a] += 0.5 * log_q + half / q
        g[0, :a] -= 2 * pull * e
        g[:, :a] += (0.5 - pull * z) * d
        slope = np.where(z >= 0, up, down)
        bent = slope * z
        keep = beta - 0.5 * bent
        growth[:a] += np.log(np.abs(keep) + 1e-300)
        d = keep * d
        d[0] -= slope * e
        d[1] += 1.0
        d[2] += np.abs(z) - _MEAN_ABS
        d[3] += z
        d[4] += v
        v = base + bent + beta * v
        if v.max() > 50.0 or v.min() < -50.0:
            d[:, np.abs(v) > 50.0] = 0.0
            v = np.minimum(np.maximum(v, -50.0), 50.0)
    nu, n = params[order, 5], counts[order]
    total -= n * (_lgamma((nu + 1) / 2) - _lgamma(nu / 2) - 0.5 * np.log(math.pi * (nu - 2)) + (nu + 1) / 2 * np.log(nu - 2))
    by_nu = rests - n * (0.5 * np.log(nu - 2) + 0.5 * nu / (nu - 2) + 0.5 * (_digamma((nu + 1) / 2) - _digamma(nu / 2)))
    value, gradient, grown = np.empty(len(counts)), np.empty((len(counts), 6)), np.empty(len(counts))
    value[order], gradient[order], grown[order] = total, np.vstack([g, by_nu]).T, growth
    return value, gradient, grown


def negative_log_likelihood(returns: np.ndarray, p: np.ndarray) -> float:
    return float(likelihoods(returns, np.array([len(returns)]), np.asarray(p, float)[None])[0][0])


def _inside(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parameters of free coordinates, derivatives of each by its own): beta and nu are kept within their bounds."""
    p, d = u.copy(), np.ones_like(u)
    p[:, 4] = BETA_BOUND * np.tanh(u[:, 4])
    d[:, 4] = BETA_BOUND * (1 - np.tanh(u[:, 4]) ** 2)
    part = 0.5 * (1 + np.tanh(0.5 * u[:, 5]))
    p[:, 5] = NU_LEAST + (NU_MOST - NU_LEAST) * part
    d[:, 5] = (NU_MOST - NU_LEAST) * part * (1 - part)
    return p, d


def _outside(p: np.ndarray) -> np.ndarray:
    u = p.copy()
    u[:, 4] = np.arctanh(np.clip(p[:, 4] / BETA_BOUND, -0.999999, 0.999999))
    part = np.clip((p[:, 5] - NU_LEAST) / (NU_MOST - NU_LEAST), 1e-6, 1 - 1e-6)
    u[:, 5] = np.log(part / (1 - part))
    return u


#: omega, alpha, gamma, beta and nu from which the longest and the shortest history are fitted, for returns of unit deviation.
STARTS = [(0.0, 0.15, -0.05, 0.95, 8.0), (0.0, 0.1, 0.0, 0.5, 8.0), (0.0, 0.1, 0.0, -0.5, 8.0), (0.0, 0.3, 0.1, 0.8, 5.0), (0.0, -0.1, 0.1, 0.3, 30.0), (0.0, 0.05, -0.1, 0.99, 15.0), (0.0, 0.1, 0.05, -0.9, 30.0), (0.0, -0.1, -0.05, 0.9, 8.0)]


def fit_lanes(returns: np.ndarray, counts: np.ndarray, given: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum likelihood of every history (the first ``counts`` rows): (parameters, log likelihoods, greatest absolute gradients).

    The longest and the shortest history are fitted from several starts, and every history from the best optima that they found; where another history's parameters suit a history better than its own it is
    fitted again from those. Only filters that forget their first variance are looked at; others' likelihoods are rough everywhere. With ``given`` (lanes x 6) each is fitted from its own start only.
    """
    scale = max(float(returns.std()), 1e-6)
    x = returns / scale
    # Parameters of scaled returns: a scale moves the level of the log variance.
    level = 2 * math.log(scale)
    up = lambda p: np.column_stack([p[:, 0] * scale, p[:, 1] + (1 - p[:, 4]) * level, p[:, 2:]])
    down = lambda p: np.column_stack([p[:, 0] / scale, p[:, 1] - (1 - p[:, 4]) * level, p[:, 2:]])

    def fitted(lengths: np.ndarray, start: np.ndarray, most: int = 200, still: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def objective(u: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p, d = _inside(u)
            try:
                with np.errstate(all="ignore"):  # a step too far has no finite value, and is taken back
                    value, gradient, growth = likelihoods(x, lengths[lanes], p)
                    value[growth >= 0] = np.inf  # a filter that doesn't forget its first variance has no likelihood to speak of
            except OverflowError:
                return np.full(len(lanes), np.inf), np.zeros_like(u)
            d[:, 0] = 0.0 if still else 1.0
            return value / lengths[lanes], gradient * d / lengths[lanes, None]

        u, value, left = minimize_lanes(objective, _outside(start), TOLERANCE / 4, most)
        return _inside(u)[0], value * lengths, left

    def bent(lengths: np.ndarray, p: np.ndarray, value: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lanes that found no flat place are held at the return next to their mu, if that is an optimum."""
        for k in np.flatnonzero(left > TOLERANCE):
            at = p[[k]].copy()
            at[0, 0] = x[: lengths[k]][np.abs(x[: lengths[k]] - at[0, 0]).argmin()]
            q, v, rest = fitted(lengths[[k]], at, still=True)
            below, above = (likelihoods(x, lengths[[k]], q + np.eye(6)[:1] * e)[1][0, 0] for e in (-1e-9, 1e-9))
            if below <= 0 <= above and v[0] <= value[k] + 1e-6:
                p[k], value[k], left[k] = q[0], v[0], rest[0]
        return p, value, left

    if given is not None:
        p, value, left = bent(counts, *fitted(counts, down(given)))
        return up(p), -value - counts * math.log(scale), left
    starts = np.array([(float(x.mean()), *s) for s in STARTS])
    ends = np.unique([counts.min(), counts.max()])
    found, value, _ = fitted(np.repeat(ends, len(starts)), np.tile(starts, (len(ends), 1)), 100)
    best = []
    for points, values in zip(np.split(found, len(ends)), np.split(value, len(ends)), strict=True):
        order = np.argsort(values)
        best += [points[k] for i, k in enumerate(order) if not any(abs(values[k] - values[j]) < 1e-2 for j in order[:i])][:3]
    k, n = len(best), len(counts)
    p, value, left = (v.reshape(k, n, *v.shape[1:]) for v in fitted(np.tile(counts, k), np.repeat(np.array(best), n, axis=0)))
    pick = value.argmin(axis=0)
    p, value, left = p[pick, np.arange(n)], value[pick, np.arange(n)], left[pick, np.arange(n)]
    for _ in range(3):
        # Every history under every 4th other's parameters and its neighbours'.
        to, of = np.divmod(np.arange(n * n), n)
        near = (np.abs(to - of) <= 2) | (of % 4 == 0)
        to, of = to[near], of[near]
        other, _, growth = likelihoods(x, counts[to], p[of])
        other[growth >= 0] = np.inf
        least = np.full(n, np.inf)
        np.minimum.at(least, to, other)
        worse = np.flatnonzero(least < value - 1e-4)
        if not len(worse):
            break
        source = np.array([of[to == k][other[to == k].argmin()] for k in worse])
        q, v, g = fitted(counts[worse], p[source])
        better = v < value[worse]
        p[worse[better]], value[worse[better]], left[worse[better]] = q[better], v[better], g[better]
    p, value, left = bent(counts, p, value, left)
    return up(p), -value - counts * math.log(scale), left


def fit(returns: np.ndarray, start: list[float] | None = None) -> tuple[dict[str, float], float, bool]:
    """Maximum likelihood of one history: (parameters, log likelihood, converged), from given parameters or from several starts."""
    p, value, left = fit_lanes(returns, np.array([len(returns)]), None if start is None else np.array([start]))
    return dict(zip(PARAMS, p[0].tolist(), strict=True)), float(value[0]), bool(left[0] <= TOLERANCE)


def filter_fixed(series: DataFrame, params: dict[str, float] = FIXED) -> DataFrame:
    """``series_id, dt, sigma`` (known from the rows before) for rows with a return, in time order, under fixed parameters."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("dt")
        v = log_variances(frame["return"].tolist(), **params)[:-1]
        return pd.DataFrame({"series_id": frame["series_id"], "dt": frame["dt"], "sigma": np.exp(np.array(v) / 2)})

    rows = series.select("series_id", "dt", "return").filter(F.col("return").isNotNull())
    return rows.groupBy("series_id").applyInPandas(run, "series_id string, dt date, sigma double")


def one_step(filtered: DataFrame) -> DataFrame:
    """Raw one-step forecasts: the variance of the next row is known the day before, so no simulation is needed."""
    return filtered.select("series_id", "dt", floored(F.col("sigma"), FORECAST_FLOOR).alias("forecast"))


def refits_of(scheduled: DataFrame, embargo: int = 0) -> DataFrame:
    """``series_id, refit_id``, ``n_train`` (rows of history), ``first`` and ``last`` (the usable rows that it serves, as row numbers)."""
    served = scheduled.filter("usable").groupBy("series_id", "refit_id").agg(F.min("rn").cast("int").alias("first"), F.max("rn").cast("int").alias("last"))
    return served.select("series_id", "refit_id", F.greatest(F.col("first") - embargo, F.lit(0)).alias("n_train"), "first", "last")


def over_lanes(scheduled: DataFrame, columns: list[str], refits: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` on every block of ``LANES`` refits: (the series' rows up to the block's last one, in order; the block's refits, in order).

    A series' rows go to each of its blocks, so a task holds at most a series' columns, and a long series' refits are spread over tasks.
    """
    block = F.floor(F.col("refit_id") / LANES).alias("block")
    given = refits.withColumn("block", block)
    ends = given.groupBy("series_id", "block").agg(F.max("last").alias("_end"))
    rows = scheduled.select("series_id", "rn", *columns).join(ends, "series_id").filter("rn <= _end").drop("_end")

    def ordered(rows: pd.DataFrame, refits: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(refits):
            return pd.DataFrame({k.split()[0]: pd.Series(dtype=object) for k in re.sub("<.*?>", "", schema).split(", ")})
        return run(rows.sort_values("rn"), refits.sort_values("refit_id"))

    # Columns of their own: both sides may come from the same table. A fixed number of partitions, since few bytes are much work here and must not be put together.
    tasks = 4 * int(scheduled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, given = (x.toDF(*x.columns).repartition(tasks, "series_id", "block") for x in (rows, given))
    return rows.groupBy("series_id", "block").cogroup(given.groupBy("series_id", "block")).applyInPandas(ordered, schema)


_REFIT = "series_id string, refit_id int, n_train int, first int, last int"
_FITTED = ", ".join(f"{p} double" for p in PARAMS)


def fit_refits(scheduled: DataFrame, embargo: int = 0, chained: bool = False) -> DataFrame:
    """Parameters at every refit: the columns of ``refits_of``, the six parameters, ``loglik``, ``grad_norm``, ``converged`` and ``nu_at_bound``.

    All refits of a series are fitted together (``fit_lanes``). ``chained``: one after the other instead, each started from what the one before found; the first from several starts.
    """

    def run(rows: pd.DataFrame, refits: pd.DataFrame) -> pd.DataFrame:
        returns, counts = rows["return"].to_numpy(), refits["n_train"].to_numpy()
        enough = counts > len(PARAMS)
        p, value, left = np.full((len(counts), 6), np.nan), np.full(len(counts), np.nan), np.full(len(counts), np.nan)
        for lanes in [[k] for k in np.flatnonzero(enough)] if chained else [np.flatnonzero(enough)]:
            if len(lanes):
                before = p[[lanes[0] - 1]] if chained and lanes[0] and enough[lanes[0] - 1] else None
                p[lanes], value[lanes], left[lanes] = fit_lanes(returns[: counts[lanes].max()], counts[lanes], before)
        out = refits[[c.split()[0] for c in _REFIT.split(", ")]].reset_index(drop=True)
        for k, name in enumerate(PARAMS):
            out[name] = p[:, k]
        return out.assign(loglik=value, grad_norm=left, converged=left <= TOLERANCE, nu_at_bound=p[:, 5] > NU_MOST - 1)

    return over_lanes(scheduled, ["return"], refits_of(scheduled, embargo), run, f"{_REFIT}, {_FITTED}, loglik double, grad_norm double, converged boolean, nu_at_bound boolean")


def fixed_refits(scheduled: DataFrame, params: dict[str, float] = FIXED, embargo: int = 0) -> DataFrame:
    """The same parameters at every refit, in the form of ``fit_refits``."""
    return refits_of(scheduled, embargo).select("*", *[F.lit(float(v)).alias(p) for p, v in params.items()])


def shocks(params: dict[str, float], horizon: int, paths: int, rng: np.random.Generator) -> np.ndarray:
    """What random paths add to the log variance that has decayed by beta, for each row ahead (the first, known one has nothing added): horizon x paths."""
    z = rng.standard_t(params["nu"], (horizon, paths)) * math.sqrt((params["nu"] - 2) / params["nu"])
    out = np.zeros((horizon, paths))
    for h in range(1, horizon):
        out[h] = params["omega"] + params["alpha"] * (np.abs(z[h - 1]) - _MEAN_ABS) + params["gamma"] * z[h - 1] + params["beta"] * out[h - 1]
    return out


def path_mean(v: np.ndarray, params: dict[str, float], added: np.ndarray) -> np.ndarray:
    """Mean over the rows ahead of the root of the mean simulated variance, for paths that start at the log variances ``v``; the last known volatility where that isn't finite."""
    decay = params["beta"] ** np.arange(len(added))
    with np.errstate(over="ignore", invalid="ignore"):
        mean = np.exp(0.5 * (decay[:, None] * v + np.log(np.exp(added).mean(axis=1))[:, None])).mean(axis=0)
    return np.maximum(np.where(np.isfinite(mean), mean, np.exp(v / 2)), FORECAST_FLOOR)


def simulate(series: DataFrame, params: dict[str, float] = FIXED, horizon: int = 5, paths: int = 500, origin: str = "next", embargo: int = 5, seed: int = 42) -> DataFrame:
    """``series_id, dt, forecast``: simulated mean volatility of ``horizon`` rows, from one set of random paths per series.

    ``origin="next"`` starts at the row after ``dt`` (the target's first row); ``"embargoed"`` starts ``embargo`` rows before ``dt``, as when the filter is cut with the training rows. A failed
    simulation falls back to the filter's last value.
    """
    back = {"next": -1, "embargoed": embargo}[origin]
    run = _simulator(params, horizon, paths, back, seed)
    rows = series.select("series_id", "dt", "return").filter(F.col("return").isNotNull())
    return rows.groupBy("series_id").applyInPandas(run, "series_id string, dt date, forecast double")


def _simulator(params: dict[str, float], horizon: int, paths: int, back: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("dt")
        v = np.array(log_variances(frame["return"].tolist(), **params))
        at = np.maximum(0, np.arange(len(frame)) - back)
        # The paths of a row are those of its log variance: v[t + h] = beta**h * v[t] + the shocks' sum, which is the same for all rows.
        added = shocks(params, horizon, paths, np.random.default_rng([seed, zlib.crc32(frame["series_id"].iloc[0].encode())]))
        return pd.DataFrame({"series_id": frame["series_id"], "dt": frame["dt"], "forecast": path_mean(v[at], params, added)})

    return run

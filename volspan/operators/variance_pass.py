"""What refits need of the conditional variance, summed along the recursion: no table of refits x history is made.

Refits are lanes of one pass over their series (``egarch.over_lanes``). A chunk of the series gives a matrix of volatilities (rows x lanes) for as long as its sums are taken; a lane's rows
after its history are left out by a mask. Where the volatility doesn't depend on the refit, as under fixed parameters, it is a column ``sigma`` of the rows, and every lane has the same.

``summed`` gives the regressions' sums and the volatility of the rows that a refit serves, ``chosen`` the lines of least QLIKE and the blends, which need several passes; each is one row a
refit, so that a whole walk-forward is a chain of tables of that size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from volspan.functions.volatility import FORECAST_FLOOR
from volspan.operators import corrections as cor
from volspan.operators import egarch
from volspan.operators.features import HAR
from volspan.operators.walk_forward import Spec, solver

#: Volatilities that a task keeps between passes; beyond it they are computed again.
KEPT = 1 << 23
REGIMES = ("pooled", "crisis", "calm")


def _sigmas(rows: pd.DataFrame, refits: pd.DataFrame, chunk: int = 512) -> Callable[[], Iterator[tuple[slice, np.ndarray]]]:
    """A function that starts a pass: (rows, volatilities by lane) of each chunk."""
    if "sigma" in rows:
        given = rows["sigma"].to_numpy()[:, None]
        return lambda: ((slice(lo, lo + chunk), given[lo : lo + chunk]) for lo in range(0, len(given), chunk))
    returns, params = rows["return"].to_numpy(), refits[list(egarch.PARAMS)].to_numpy()
    fresh = lambda: ((slice(lo, lo + len(v)), np.exp(v / 2)) for lo, v in egarch.lane_variances(returns, params, chunk))
    if len(returns) * len(params) > KEPT:
        return fresh
    kept = list(fresh())
    return lambda: iter(kept)


def _columns(rows: pd.DataFrame) -> list[str]:
    return ["sigma"] if "sigma" in rows.columns else ["return"]


def summed(scheduled: DataFrame, refits: DataFrame, target: str = "rv", horizon: int = 1, embargo: int = 0, paths: int = 500, seed: int = 42) -> DataFrame:
    """``refits`` (``egarch.fit_refits`` or ``refits_of``) with ``sums`` (by regime: rows, and sums of the volatility, its square, the target, its square, their product), ``moments`` (of target,
    the four lags and the volatility, as a solver takes them) and ``served`` (structs of ``rn, sigma`` of the rows that the refit serves).

    For a horizon above one, ``sigma`` of the served rows is the simulated mean volatility of that many rows, from a filter that ends ``embargo`` rows before them.
    """
    own = [c for c in refits.columns if c not in ("series_id", "refit_id")]

    def run(rows: pd.DataFrame, refits: pd.DataFrame) -> pd.DataFrame:
        y, rn = rows[target].to_numpy(), rows["rn"].to_numpy()
        crisis = rows["rv1_pctile"].to_numpy() >= cor.CRISIS
        regimes = np.stack([np.ones(len(y)), crisis, ~crisis], axis=1)
        common = np.column_stack([y, rows[HAR].to_numpy()])
        low = [(a, b) for a in range(common.shape[1]) for b in range(a + 1)]
        flat = np.column_stack([np.ones(len(y)), common, *[common[:, a] * common[:, b] for a, b in low]])
        n, lanes = refits["n_train"].to_numpy(), len(refits)
        sums, plain, cross, square = np.zeros((lanes, 6, 3)), np.zeros((lanes, flat.shape[1])), np.zeros((lanes, common.shape[1] + 1)), np.zeros(lanes)
        served: list[list[tuple[int, float]]] = [[] for _ in range(lanes)]
        first, last = refits["first"].to_numpy() - (embargo if horizon > 1 else 0), refits["last"].to_numpy() - (embargo if horizon > 1 else 0)
        for at, sigma in _sigmas(rows, refits)():
            mask = (rn[at, None] < n).astype(float)
            s = sigma * mask
            g, gy = regimes[at], regimes[at] * y[at, None]
            for k, part in enumerate((mask.T @ g, s.T @ g, (s * sigma).T @ g, mask.T @ gy, mask.T @ (gy * y[at, None]), s.T @ gy)):
                sums[:, k] += part
            plain += mask.T @ flat[at]
            cross += s.T @ np.column_stack([np.ones(len(mask)), common[at]])
            square += (s * sigma).sum(axis=0)
            for k in np.flatnonzero((first <= rn[at][-1]) & (last >= rn[at][0])):
                mine = np.flatnonzero((rn[at] >= first[k]) & (rn[at] <= last[k]))
                served[k] += zip(rn[at][mine].tolist(), np.broadcast_to(sigma, mask.shape)[mine, k].tolist(), strict=True)
        if horizon > 1:
            for k, p in enumerate(refits.to_dict("records")):
                rng = np.random.default_rng([seed, zlib.crc32(p["series_id"].encode()), p["refit_id"]])
                v = 2 * np.log([x for _, x in served[k]])
                ahead = egarch.path_mean(v, p, egarch.shocks(p, horizon, paths, rng))
                served[k] = [(i + embargo, f) for (i, _), f in zip(served[k], ahead.tolist(), strict=True)]
        out = refits.drop(columns="block").reset_index(drop=True)
        c = common.shape[1]
        out["sums"] = sums.transpose(0, 2, 1).reshape(lanes, -1).tolist()
        out["moments"] = np.column_stack([plain[:, 1 : c + 1], cross[:, :1], plain[:, c + 1 :], cross[:, 1:], square]).tolist()
        out["served"] = [[{"rn": i, "sigma": x} for i, x in rows_of] for rows_of in served]
        return out

    columns = [*_columns(scheduled), target, "rv1_pctile", *HAR]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in refits.select("series_id", "refit_id", *own).schema)
    found = egarch.over_lanes(scheduled, columns, refits.select("series_id", "refit_id", *own), run, f"{schema}, sums array<double>, moments array<double>, served array<struct<rn:int,sigma:double>>")
    return found


def with_lines(found: DataFrame) -> DataFrame:
    """Adds ``alpha_*, beta_*`` of the target on the volatility, pooled and by regime (pooled where a regime has under 30 rows), ``n_*`` and ``*_stable``, from ``sums``."""
    for k, name in enumerate(REGIMES):
        n, s, ss, y, _, sy = (F.col("sums")[6 * k + j] for j in range(6))
        spread = n * ss - s * s
        beta = F.when(spread != 0, (n * sy - s * y) / F.when(spread != 0, spread))
        found = found.withColumns({f"beta_{name}": beta, f"n_{name}": n.cast("long")}).withColumn(f"alpha_{name}", (y - F.col(f"beta_{name}") * s) / n)
    return cor.stable_lines(found).drop("n_pooled")


def with_combined(refits: DataFrame, name: str, target: str = "rv") -> DataFrame:
    """Adds ``both_intercept, both_coef``: the target on the four lags and the volatility, from ``moments``; null where there is too little history."""
    columns, key = [target, *HAR, "sigma"], ["series_id", "refit_id"]
    solve = solver([Spec(name, (*HAR, "sigma"), target=target)], columns)
    schema = StructType([*refits.schema.fields, StructField("both_intercept", DoubleType()), StructField("both_coef", ArrayType(DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums = pd.DataFrame({**{k: frame[k] for k in key}, "refit_date": None, "shift": [[0.0] * len(columns)] * len(frame), "n": frame["n_train"], "sums": frame["moments"]})
            found = next(solve(iter([sums])))[[*key, "intercept", "coef"]].rename(columns={"intercept": "both_intercept", "coef": "both_coef"})
            yield frame.merge(found, on=key, how="left")

    return refits.mapInPandas(run, schema)


def _qlike_sums(y: np.ndarray, x: np.ndarray, mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of a chunk, by lane: summed loss, its gradient by (a, b), its second derivatives, and their expected values, which are never negative."""
    f = a + b * x
    floor = f <= FORECAST_FLOOR
    f = np.maximum(f, FORECAST_FLOOR)
    r2 = (y[:, None] / f) ** 2
    slope = np.where(floor, 0.0, 2 * (1 - r2) / f) * mask
    bend, mean_bend = np.where(floor, 0.0, (6 * r2 - 2) / f**2) * mask, np.where(floor, 0.0, 4 / f**2) * mask
    return np.stack([((r2 - np.log(r2) - 1) * mask).sum(axis=0), slope.sum(axis=0), (slope * x).sum(axis=0), *[(h * z).sum(axis=0) for h in (bend, mean_bend) for z in (1.0, x, x * x)]])


def qlike_lines(start: np.ndarray, sums: Callable[[np.ndarray], np.ndarray], most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """((alpha, beta), converged) of many lines of least QLIKE by damped Newton steps from ``start`` (2 x lines); ``sums`` gives the rows of ``_qlike_sums`` at (2 x lines)."""
    at, now = start.copy(), sums(start)
    damp = np.full(start.shape[1], 1e-10)
    done = np.zeros(start.shape[1], bool)
    for _ in range(most):
        h = now[3:6].copy()
        flat = h[0] * h[2] - h[1] ** 2 <= 1e-12 * np.abs(h[0] * h[2])
        flat |= h[0] <= 0
        h[:, flat] = now[6:9, flat]
        p, q, r = h[0] * (1 + damp), h[1], h[2] * (1 + damp)
        det = p * r - q * q
        with np.errstate(all="ignore"):
            step = np.stack([-(r * now[1] - q * now[2]), p * -now[2] + q * now[1]]) / np.where(det > 0, det, np.inf)
        step[:, done] = 0.0
        # A step that moves nothing in the tenth digit ends a line.
        small = (np.abs(step) <= 1e-10 * (1e-8 + np.abs(at))).all(axis=0) & (damp < 1e-3)
        done |= small
        if done.all():
            break
        new = sums(at + step)
        better = ~done & (new[0] <= now[0] + 1e-13 * np.abs(now[0]))
        at[:, better] += step[:, better]
        now[:, better] = new[:, better]
        damp = np.where(better, np.maximum(damp / 10, 1e-10), np.minimum(damp * 30, 1e12))
        done |= damp >= 1e12  # no step in any direction lowers the loss
    return at, done


def chosen(scheduled: DataFrame, refits: DataFrame, blends: list[str], qlike: bool = True) -> DataFrame:
    """Adds to refits that have lines (and ``har_intercept, har_coef`` of the first model, for blends): with ``qlike`` the lines of least QLIKE, ``alpha_d_*, beta_d_*, converged_d_*``,
    and for each blend of a line (``corrections.LINES``) ``c_*, k_*, train_qlike_*``, the setting of the 17 x 20 with the least mean QLIKE; ties go to the lower c, then k.
    """

    def run(rows: pd.DataFrame, refits: pd.DataFrame) -> pd.DataFrame:
        y, p, rn = rows["rv"].to_numpy(), rows["rv1_pctile"].to_numpy(), rows["rn"].to_numpy()
        crisis, n = p >= cor.CRISIS, refits["n_train"].to_numpy()
        passes, out = _sigmas(rows, refits), refits.drop(columns="block").reset_index(drop=True)
        if qlike:
            start = np.concatenate([[out[f"{x}_{name}"].to_numpy(float) for x in ("alpha", "beta")] for name in REGIMES], axis=1)

            def sums(at: np.ndarray) -> np.ndarray:
                total = np.zeros((9, 3, len(n)))
                for part, sigma in passes():
                    mask = rn[part, None] < n
                    for k, of in enumerate((np.ones(len(y), bool), crisis, ~crisis)):
                        a, b = at[:, k * len(n) : (k + 1) * len(n)]
                        total[:, k] += _qlike_sums(y[part], sigma, mask & of[part, None], a, b)
                return total.reshape(9, -1)

            found, done = qlike_lines(start, sums)
            for k, name in enumerate(REGIMES):
                mine = slice(k * len(n), (k + 1) * len(n))
                few = ~out[f"{name}_stable"].to_numpy(bool) if k else np.zeros(len(n), bool)
                out[f"alpha_d_{name}"], out[f"beta_d_{name}"] = np.where(few, found[0, : len(n)], found[0, mine]), np.where(few, found[1, : len(n)], found[1, mine])
                out[f"converged_d_{name}"] = np.where(few, done[: len(n)], done[mine])
        if blends:
            c, k = np.divmod(np.arange(cor.GRID_C * cor.GRID_K), cor.GRID_K)
            losses = np.zeros((len(blends), len(n), len(c)))
            a, coef = out["har_intercept"].to_numpy(float), np.array(out["har_coef"].tolist(), float)
            for part, sigma in passes():
                w = 1 / (1 + np.exp(-(k + 1) * (p[part, None] - (0.1 + 0.05 * c))))
                har = np.maximum(a + rows[HAR].to_numpy()[part] @ coef.T, FORECAST_FLOOR)
                for i, name in enumerate(blends):
                    line = np.maximum(cor.line_values(name, out, sigma, crisis[part, None]), FORECAST_FLOOR)
                    for lane in range(len(n)):
                        m = max(0, min(int(n[lane] - rn[part][0]), len(w)))
                        f = np.maximum(w[:m] * line[:m, lane, None] + (1 - w[:m]) * har[:m, lane, None], FORECAST_FLOOR)
                        r = (y[part][:m, None] / f) ** 2
                        losses[i, lane] += (r - np.log(r) - 1).sum(axis=0)
            mean = np.round(losses / n[:, None], 12)
            best = mean.argmin(axis=2)
            for i, name in enumerate(blends):
                out[f"c_{name}"], out[f"k_{name}"], out[f"train_qlike_{name}"] = 0.1 + 0.05 * (best[i] // cor.GRID_K), (best[i] % cor.GRID_K + 1).astype(float), mean[i].min(axis=1)
        return out

    more = [f"{x}_d_{name} {t}" for name in REGIMES if qlike for x, t in (("alpha", "double"), ("beta", "double"), ("converged", "boolean"))]
    more += [f"{x}_{name} double" for name in blends for x in ("c", "k", "train_qlike")]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in refits.schema] + more)
    return egarch.over_lanes(scheduled, [*_columns(scheduled), "rv", "rv1_pctile", *HAR], refits, run, schema)


def served_rows(scheduled: DataFrame, refits: DataFrame, columns: list[str]) -> DataFrame:
    """The usable rows with their columns, ``p``, their volatility ``sigma`` and the columns of the refit that serves them."""
    each = refits.select("*", F.inline("served")).drop("served", "sums", "moments")
    rows = scheduled.filter("usable").select("series_id", "rn", "dt", F.col("rv1_pctile").alias("p"), *columns)
    return rows.join(each, ["series_id", "rn"])

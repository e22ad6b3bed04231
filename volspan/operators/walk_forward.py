"""Walk-forward linear models: cumulative moments, one small solve per refit, forecasts by an equi-join.

Sums of products over the history of every row are window aggregates of one ordered pass; a rolling history is a difference of two of them. Only the rows at which
a model is refitted go to the solver, as arrays of at most (k + 1)(k + 2) / 2 numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volspan.functions.volatility import FORECAST_FLOOR, floored
from volspan.operators.features import HAR, LOG_HAR, RETURNS, by_time


@dataclass(frozen=True)
class Spec:
    name: str
    features: tuple[str, ...]
    target: str = "rv"
    log: bool = False
    rolling: int | None = None
    ridge: float = 0.0
    smear: bool = True  # log models: retransform with half the residual variance


# The model zoo's definitions.
SPECS = [
    Spec("M1 HAR+TS", tuple(HAR)),
    Spec("M4 Log-HAR", tuple(LOG_HAR), target="log_rv", log=True),
    Spec("M5 Asym-HAR", (*HAR, "rv_neg")),
    Spec("M6 HAR+Ret", (*HAR, *RETURNS)),
    Spec("M7 Roll-HAR", tuple(HAR), rolling=1000),
    Spec("M8 KitchSink", (*HAR, "rv_neg", *RETURNS), ridge=1.0),
]
TEST_MONTHS, REFIT_EVERY, MIN_TRAIN = 18, 21, 500


def schedule(features: DataFrame, months: int = TEST_MONTHS, every: int = REFIT_EVERY, least: int = MIN_TRAIN) -> DataFrame:
    """Adds ``rn`` (row from 0), ``split_date, is_test, i`` (test row from 0), ``refit_id``, ``usable`` (enough history) and ``is_refit``.

    Test rows are those after the split date; ``i`` counts skipped ones too, and the first usable row of a block is its refit.
    """
    w = by_time()
    out = features.withColumn("rn", F.row_number().over(w) - 1).withColumn("split_date", F.add_months(F.max("dt").over(W.partitionBy("series_id")), -months))
    out = out.withColumn("is_test", F.col("dt") > F.col("split_date"))
    out = out.withColumn("i", F.when(F.col("is_test"), F.sum(F.col("is_test").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1))
    out = out.withColumn("refit_id", F.floor(F.col("i") / every).cast("int")).withColumn("usable", F.col("is_test") & (F.col("rn") >= least))
    block = W.partitionBy("series_id", "refit_id")
    first = F.min(F.when(F.col("usable"), F.col("rn"))).over(block)
    return out.withColumn("is_refit", F.coalesce(F.col("usable") & (F.col("rn") == first), F.lit(False)))


def refit_moments(scheduled: DataFrame, columns: list[str], rollings: list[int], embargo: int = 0) -> DataFrame:
    """At each refit: ``shift`` (the series' first values), ``n`` and ``sums`` (of shifted columns, then of their products) over the history, and ``n_R, sums_R`` over its last R rows."""
    w = by_time()
    upto = w.rowsBetween(W.unboundedPreceding, -1 - embargo)
    z = [f"_z{k}" for k in range(len(columns))]
    first = {f"_f{k}": F.first(c).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) for k, c in enumerate(columns)}
    rows = scheduled.withColumns(first).withColumns({f"_z{k}": F.col(c) - F.col(f"_f{k}") for k, c in enumerate(columns)})
    values = [F.col(a) for a in z] + [F.col(z[a]) * F.col(z[b]) for a in range(len(z)) for b in range(a + 1)]
    sums = F.array(*[F.coalesce(F.sum(v).over(upto), F.lit(0.0)) for v in values])
    rows = rows.withColumn("sums", sums).withColumn("n", F.greatest(F.col("rn") - embargo, F.lit(0)))
    for r in rollings:
        rows = rows.withColumn(f"_old{r}", F.lag("sums", r).over(w))
    out = rows.filter("is_refit").withColumn("shift", F.array(*[F.col(f) for f in first]))
    for r in rollings:
        late = F.col(f"_old{r}").isNotNull()
        out = out.withColumn(f"sums_{r}", F.when(late, F.zip_with("sums", f"_old{r}", lambda a, b: a - b)).otherwise(F.col("sums"))).withColumn(f"n_{r}", F.least("n", F.lit(r)))
    return out.select("series_id", "refit_id", F.col("dt").alias("refit_date"), "shift", "n", "sums", *[c for r in rollings for c in (f"n_{r}", f"sums_{r}")])


def solver(specs: list[Spec], columns: list[str]):
    at = {c: k for k, c in enumerate(columns)}
    p = len(columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                for s in specs:
                    tail = f"_{s.rolling}" if s.rolling else ""
                    n, sums, shift = int(row["n" + tail]), np.asarray(row["sums" + tail]), np.asarray(row["shift"])
                    x, y = [at[f] for f in s.features], at[s.target]
                    if n <= len(x) + 1:
                        continue
                    mean, square = sums[:p] / n, np.zeros((p, p))
                    square[np.tril_indices(p)] = sums[p:]
                    square = np.tril(square) + np.tril(square, -1).T - n * np.outer(mean, mean)
                    gram, xy, mean = square[np.ix_(x, x)], square[x, y], mean + shift
                    inverse = np.linalg.pinv(gram + s.ridge * np.eye(len(x)))
                    b = inverse @ xy
                    sse = max(0.0, float(square[y, y] - 2 * b @ xy + b @ gram @ b))
                    s2, df = sse / (n - len(x) - 1), n - len(x) - 1
                    a = float(mean[y] - b @ mean[x])
                    se = np.sqrt(np.append(s2 * (1 / n + mean[x] @ inverse @ mean[x]), s2 * np.diag(inverse)))
                    out.append((row["series_id"], row["refit_id"], row["refit_date"], n, s.name, a, b.tolist(), sse / (n - 1), se.tolist(), df))
            yield pd.DataFrame(out, columns=["series_id", "refit_id", "refit_date", "n_train", "model", "intercept", "coef", "resid_var", "se", "df"])

    return run


COEFFICIENTS = "series_id string, refit_id int, refit_date date, n_train int, model string, intercept double, coef array<double>, resid_var double, se array<double>, df int"


def fit_models(scheduled: DataFrame, specs: list[Spec], embargo: int = 0) -> DataFrame:
    """A row per series, refit and model: ``intercept, coef, resid_var`` (of residuals, n - 1), ``se`` (intercept first) and ``df``. Models with too little history have no row."""
    columns = list(dict.fromkeys(c for s in specs for c in (s.target, *s.features)))
    moments = refit_moments(scheduled, columns, sorted({s.rolling for s in specs if s.rolling}), embargo)
    return solved(moments, specs, columns)


def solved(moments: DataFrame, specs: list[Spec], columns: list[str]) -> DataFrame:
    """Coefficients in the form of ``fit_models`` from ``refit_moments`` of the columns."""
    return moments.mapInPandas(solver(specs, columns), COEFFICIENTS)


def predict(scheduled: DataFrame, coefs: DataFrame, specs: list[Spec], floor: bool = True) -> DataFrame:
    """``series_id, dt, model, actual, forecast`` for usable test rows; log models are retransformed, with half the residual variance unless ``smear`` is off."""
    targets = list(dict.fromkeys(s.target for s in specs if not s.log))
    rows = scheduled.filter("usable").join(coefs.select("series_id", "refit_id", "model", "intercept", "coef", "resid_var"), ["series_id", "refit_id"])
    linear = F.lit(None).cast("double")
    for s in specs:
        total = F.col("intercept")
        for k, f in enumerate(s.features):
            total = total + F.col("coef")[k] * F.col(f)
        linear = F.when(F.col("model") == s.name, F.exp(total + F.col("resid_var") / 2) if s.log and s.smear else F.exp(total) if s.log else total).otherwise(linear)
    actual = F.col(targets[0]) if targets else F.col("rv")
    return rows.select("series_id", "dt", "model", actual.alias("actual"), (floored(linear, FORECAST_FLOOR) if floor else linear).alias("forecast"))


def walk_forward(features: DataFrame, specs: list[Spec] = SPECS, months: int = TEST_MONTHS, every: int = REFIT_EVERY, least: int = MIN_TRAIN, embargo: int = 0) -> DataFrame:
    """Forecasts of all models: expanding (or rolling) history strictly before the refit, refitted every ``every`` test rows. ``embargo`` rows before the refit are left out."""
    scheduled = schedule(features, months, every, least)
    return predict(scheduled, fit_models(scheduled, specs, embargo), specs)

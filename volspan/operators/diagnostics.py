"""Serial dependence: autocorrelations, partial autocorrelations, Ljung-Box and ARCH-LM tests per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volspan.functions.distributions import chi_squared_p
from volspan.functions.volatility import finite


def acf(rows: DataFrame, key: list[str], value: str, order: str, lags: int) -> DataFrame:
    """``acf``: array of the biased autocorrelations of lags 0 to ``lags``, with ``n``; one ordered pass. A constant series has nulls."""
    w = W.partitionBy(*key).orderBy(order)
    rows = rows.select(*key, order, (F.col(value) - F.avg(value).over(W.partitionBy(*key))).alias("_x"))
    rows = rows.select(*key, "_x", *[F.lag("_x", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    sums = [F.sum(F.col("_x") * F.col("_x" if k == 0 else f"_l{k}")).alias(f"_s{k}") for k in range(lags + 1)]
    out = rows.groupBy(*key).agg(F.count("_x").alias("n"), *sums)
    return out.select(*key, "n", F.array(*[F.when(F.col("_s0") > 0, F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) / F.when(F.col("_s0") > 0, F.col("_s0"))) for k in range(lags + 1)]).alias("acf"))


def with_pacf(found: DataFrame, lags: int) -> DataFrame:
    """Adds ``pacf`` (lags 0 to ``lags``) by the Levinson-Durbin recursion over ``acf``."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(s, k):
        past = F.slice("acf", 2, k - 1)
        phi = (F.element_at("acf", k + 1) - dot(s["phi"], F.reverse(past))) / (1 - dot(s["phi"], past))
        new = F.concat(F.zip_with(s["phi"], F.reverse(s["phi"]), lambda a, b: a - phi * b), F.array(phi))
        return F.struct(new.alias("phi"), F.concat(s["out"], F.array(phi)).alias("out"))

    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("phi"), F.array(F.lit(1.0)).alias("out"))
    return found.withColumn("pacf", F.aggregate(F.sequence(F.lit(1), F.lit(lags)), start, step, lambda s: s["out"]))


def correlogram(found: DataFrame, key: list[str]) -> DataFrame:
    """Long form: ``lag, acf, pacf, significant`` (the pacf beyond 1.96 / sqrt(n), lag 0 never)."""
    long = found.select(*key, "n", F.posexplode(F.arrays_zip("acf", "pacf")).alias("lag", "_v"))
    return long.select(*key, "lag", F.col("_v.acf").alias("acf"), F.col("_v.pacf").alias("pacf"), ((F.col("lag") > 0) & (F.abs("_v.pacf") > 1.96 / F.sqrt("n"))).alias("significant"))


def ljung_box(found: DataFrame, key: list[str], lags: int = 20) -> DataFrame:
    """``q, p_value`` over the first ``lags`` (an even number) autocorrelations."""
    n = F.col("n").cast("double")
    total = F.lit(0.0)
    for k in range(1, lags + 1):
        total = total + F.pow(F.col("acf")[k], 2) / (n - k)
    return found.select(*key, "n", (n * (n + 2) * total).alias("q")).withColumn("p_value", chi_squared_p(F.col("q"), lags))


def arch_lm(rows: DataFrame, key: list[str], value: str, order: str, lags: int = 10) -> DataFrame:
    """Engle's test: n R2 of squared values on ``lags`` (even) own lags, from covariances solved by Gaussian elimination in column expressions."""
    w = W.partitionBy(*key).orderBy(order)
    squares = rows.select(*key, order, F.pow(value, 2).alias("_v0"))
    squares = squares.select("*", *[F.lag("_v0", k).over(w).alias(f"_v{k}") for k in range(1, lags + 1)]).filter(f"_v{lags} is not null")
    out = squares.groupBy(*key).agg(F.count("*").alias("n"), *[F.covar_samp(f"_v{i}", f"_v{j}").alias(f"c{i}_{j}") for i in range(lags + 1) for j in range(i + 1)])
    # Sweeping out the lags one by one leaves the residual variance of the squares in c0_0.
    out = out.withColumn("_total", F.col("c0_0"))
    at = lambda i, j: f"c{max(i, j)}_{min(i, j)}"
    for k in range(lags, 0, -1):
        pivot = F.when(F.col(at(k, k)) > 0, F.col(at(k, k)))
        out = out.select(*key, "n", "_total", *[(F.col(at(i, j)) - F.coalesce(F.col(at(i, k)) * F.col(at(j, k)) / pivot, F.lit(0.0))).alias(at(i, j)) for i in range(k) for j in range(i + 1)])
    return out.select(*key, "n", F.when(F.col("_total") > 0, F.col("n") * (1 - F.col("c0_0") / F.when(F.col("_total") > 0, F.col("_total")))).alias("lm")).withColumn("p_value", chi_squared_p(F.col("lm"), lags))


def residual_tests(forecasts: DataFrame) -> DataFrame:
    """Per series and model: serial dependence of the finite residuals and of their squares (Ljung-Box, 20 lags), and remaining heteroscedasticity (10 lags)."""
    rows = forecasts.withColumn("resid", F.col("actual") - F.col("forecast")).filter(finite(F.col("resid"))).withColumn("resid2", F.pow("resid", 2))
    key = ["series_id", "model"]
    plain, squared = (ljung_box(acf(rows, key, c, "dt", 20), key) for c in ("resid", "resid2"))
    lm = arch_lm(rows, key, "resid", "dt").select(*key, "lm", F.col("p_value").alias("p_lm"))
    return plain.withColumnRenamed("p_value", "p_q").join(squared.select(*key, F.col("q").alias("q_squared"), F.col("p_value").alias("p_q_squared")), key).join(lm, key)

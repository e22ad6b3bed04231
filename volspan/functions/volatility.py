"""Column expressions of range-based volatility, losses and weights. Nulls stay null: floors never turn a null into the floor."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the models.
GK_WEIGHT = 2 * math.log(2) - 1
VARIANCE_FLOOR, LOG_FLOOR, FORECAST_FLOOR = 1e-10, 1e-6, 1e-4


def floored(x: Column, least: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(least)))


def garman_klass(open: Column, high: Column, low: Column, close: Column) -> Column:
    return 0.5 * F.pow(F.log(high / low), 2) - GK_WEIGHT * F.pow(F.log(close / open), 2)


def realized_vol(variance: Column) -> Column:
    return F.sqrt(floored(variance, VARIANCE_FLOOR)) * 100


def log_return(close: Column, before: Column) -> Column:
    return F.log(close / before) * 100


def log_floor(x: Column) -> Column:
    return F.log(floored(x, LOG_FLOOR))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def logistic_weight(p: Column, c: Column, k: Column) -> Column:
    """1 / (1 + exp(-k (p - c))); a half where p isn't finite."""
    return F.when(finite(p), 1 / (1 + F.exp(-k * (p - c)))).otherwise(0.5)


def loss(kind: str, actual: Column, forecast: Column) -> Column:
    if kind == "mse":
        return F.pow(actual - forecast, 2)
    if kind == "mae":
        return F.abs(actual - forecast)
    if kind == "qlike":
        r = F.pow(actual, 2) / F.pow(forecast, 2)
        return r - F.log(r) - 1
    raise ValueError(f"unknown loss {kind}")


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def dm_verdict(stat: Column, p: Column) -> Column:
    return F.when(p >= 0.05, "no difference").when(stat > 0, "second better").otherwise("first better")

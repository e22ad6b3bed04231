"""Bias corrections of a volatility forecast and regime-weighted blends; ``variance_pass`` finds their coefficients, one row a refit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspan.functions.volatility import FORECAST_FLOOR, floored, logistic_weight

# Fixed values of the models.
CRISIS, LEAST_ROWS = 0.90, 30
#: Settings of a blend: c from 0.1 in steps of 0.05, k from 1.
GRID_C, GRID_K = 17, 20
KEY = ["series_id", "refit_id"]
#: A blend's first forecast: how a line corrects the volatility, and the prefix of its coefficients.
LINES = {"pooled": ("pooled", ""), "regime": ("regime", ""), "q_pooled": ("pooled", "d_"), "q_regime": ("regime", "d_"), "switch": ("switch", "d_")}


def in_crisis(p: Column) -> Column:
    return F.coalesce(p >= CRISIS, F.lit(False))


def stable_lines(refits: DataFrame) -> DataFrame:
    """Adds ``crisis_stable, calm_stable`` (30 rows or more by ``n_*``); a regime that isn't takes the pooled line."""
    for name in ("crisis", "calm"):
        stable = F.col(f"n_{name}") >= LEAST_ROWS
        refits = refits.withColumns({f"{name}_stable": stable, **{f"{x}_{name}": F.when(stable, F.col(f"{x}_{name}")).otherwise(F.col(f"{x}_pooled")) for x in ("alpha", "beta")}})
    return refits


def corrected(sigma: Column, p: Column, kind: str, prefix: str = "") -> Column:
    """``pooled``: one line; ``regime``: a line per regime; ``switch``: raw in crises and the calm line otherwise."""
    line = lambda name: F.col(f"alpha_{prefix}{name}") + F.col(f"beta_{prefix}{name}") * sigma
    if kind == "pooled":
        return line("pooled")
    return F.when(in_crisis(p), line("crisis") if kind == "regime" else sigma).otherwise(line("calm"))


def line_values(name: str, refits: pd.DataFrame, sigma: np.ndarray, crisis: np.ndarray) -> np.ndarray:
    """``corrected`` for a matrix of rows x refits: the values of the line ``LINES`` names."""
    kind, prefix = LINES[name]
    line = lambda regime: refits[f"alpha_{prefix}{regime}"].to_numpy(float) + refits[f"beta_{prefix}{regime}"].to_numpy(float) * sigma
    if kind == "pooled":
        return line("pooled")
    return np.where(crisis, line("crisis") if kind == "regime" else sigma, line("calm"))


def blend(p: Column, c: Column, k: Column, first: Column, second: Column) -> tuple[Column, Column]:
    """(weight of the first, blended forecast)."""
    w = logistic_weight(p, c, k)
    return w, floored(w * floored(first, FORECAST_FLOOR) + (1 - w) * second, FORECAST_FLOOR)

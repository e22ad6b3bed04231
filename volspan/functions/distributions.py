"""Tail probabilities as Column expressions, from closed forms that are exact for whole degrees of freedom."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def student_t_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole ``df`` >= 1 (Abramowitz and Stegun 26.7.3 and 26.7.4)."""
    angle = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    sin, cos2 = F.sin(angle), F.pow(F.cos(angle), 2)
    odd = F.pmod(df, F.lit(2)) == 1
    terms = F.when(odd, F.floor((df - 3) / 2)).otherwise(F.floor((df - 2) / 2)).cast("int")
    shift = F.when(odd, F.lit(1.0)).otherwise(F.lit(0.0))
    step = lambda s, j: F.struct((s["total"] + s["term"]).alias("total"), (s["term"] * (2 * j + 1 + shift) / (2 * j + 2 + shift) * cos2).alias("term"))
    series = F.when(terms >= 0, F.aggregate(F.sequence(F.lit(0), F.greatest(terms, F.lit(0))), F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("term")), step, lambda s: s["total"])).otherwise(0.0)
    inside = F.when(odd, 2 / math.pi * (angle + sin * F.cos(angle) * series)).otherwise(sin * series)
    return F.when(t.isNotNull() & (df >= 1), F.greatest(1 - inside, F.lit(0.0)))


def f_two_p(f: Column, df: Column) -> Column:
    """Upper tail of F with 2 and ``df`` degrees of freedom."""
    return F.pow(1 + 2 * f / df, -df / 2)


def chi_squared_p(x: Column, df: int) -> Column:
    """Upper tail of chi-squared with an even number of degrees of freedom."""
    if df % 2:
        raise ValueError("an even number of degrees of freedom is needed")
    total, term = F.lit(0.0), F.lit(1.0)
    for j in range(df // 2):
        total = total + term
        term = term * x / (2 * (j + 1))
    return F.exp(-x / 2) * total

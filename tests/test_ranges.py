"""Ranges of a series give what the whole series gives, and no range holds more than its share of rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspan.operators import diagnostics as dia
from volspan.operators import features as fe
from volspan.operators import ranges as ra
from volspan.operators import walk_forward as wf

DAY, N = dt.date(1995, 1, 1), 5000


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(4)
    out = []
    # A long series with gaps in time, one shorter than a halo, and one of a single row.
    for name, n in (("long", N), ("short", 90), ("one", 1)):
        day = 0
        for x in rng.lognormal(3, 0.2, (n, 4)).round(3).tolist():
            day += 1 if rng.uniform() < 0.9 else int(rng.integers(1, 30))
            out.append((name, DAY + dt.timedelta(day), x[0], max(x), min(x), x[3] if rng.uniform() < 0.999 else None))
    return spark.createDataFrame(out, "series_id string, dt date, open double, high double, low double, close double").repartition(5).persist()


def same(a, b, key):
    a, b = ({tuple(r[k] for k in key): r for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys() and len(a)
    for k, r in a.items():
        for c in r.asDict():
            want, got = ([x] if not isinstance(x, list) else x for x in (r[c], b[k][c]))
            assert len(want) == len(got) and all(y == (pytest.approx(x, rel=1e-9, abs=1e-9) if isinstance(x, float) else x) for x, y in zip(want, got, strict=True)), (k, c)


@pytest.mark.parametrize("ranges", [1, 8])
def test_features_schedule_and_moments(bars, ranges):
    whole, parts = fe.feature_table(bars), ra.feature_table(bars, ranges)
    same(whole, parts, ["series_id", "dt"])
    old, new = wf.schedule(whole).persist(), ra.schedule(parts, ranges).persist()
    same(old, new, ["series_id", "dt"])
    columns = ["rv", *fe.HAR]
    for embargo in (0, 5):
        same(wf.refit_moments(old, columns, [1000, 4000], embargo), ra.refit_moments(new, columns, [1000, 4000], ranges, embargo), ["series_id", "refit_id"])


def test_last_known_and_correlations(bars):
    changes = bars.filter("day(dt) = 3").select("series_id", "dt", F.col("high").alias("level"), F.when(F.col("low") > 15, F.col("low")).alias("base"))
    asked = bars.select("series_id", "dt", "open")
    same(fe.last_known(asked, changes, ["level", "base"]), ra.last_known(asked, changes, ["level", "base"], 8), ["series_id", "dt"])
    series = fe.volatility_series(bars).filter("rv is not null")
    same(dia.acf(series, ["series_id"], "rv", "dt", 30), ra.acf(series, "rv", 30, 8), ["series_id"])


def test_no_range_holds_more_than_a_fifth(bars):
    parts = ra.with_halo(bars, 8, ra.FEATURE_HALO).filter("series_id = 'long'").groupBy("_part").agg(F.count("*").alias("n"), F.count_if("_own").alias("own")).collect()
    assert len(parts) == 8 and max(r["n"] for r in parts) < N / 5 and sum(r["own"] for r in parts) == N
    ahead = ra.in_ranges(fe.volatility_series(bars), fe.forward_mean, 8, 0, 5)
    same(fe.forward_mean(fe.volatility_series(bars)), ahead, ["series_id", "dt"])


def test_empty(spark, bars):
    assert ra.feature_table(bars.limit(0), 8).count() == 0 and ra.last_known(bars.limit(0), bars.select("series_id", "dt", F.lit(1).alias("x")).limit(0), ["x"], 4).count() == 0

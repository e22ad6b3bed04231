"""Exact percentiles and trailing ranks beside direct computation."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspan.operators import features as fe
from volspan.operators import quantiles as qu
from volspan.operators import trailing

DAY = dt.date(2001, 1, 1)


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_equals_percentile(spark, monkeypatch, p, small):
    monkeypatch.setattr(qu, "BROADCAST_BYTES", 1 << 20 if small else 0)
    monkeypatch.setattr(qu, "SALTS", 3)
    rng = np.random.default_rng(5)
    rows = [("heavy", float(x)) for x in np.where(rng.uniform(size=4000) < 0.6, 7.0, rng.normal(7, 3, 4000))]
    rows += [("wide", float(x)) for x in rng.choice([-1, 1], 3000) * 10.0 ** rng.uniform(-300, 300, 3000)]
    rows += [(None, float(k)) for k in range(11)] + [("one", 2.0), ("two", 1.0), ("two", 4.0), ("none", None), ("nan", float("nan")), ("part", None), ("part", 3.0), ("same", 1.5)] + [("same", 1.5)] * 500
    df = spark.createDataFrame(rows, "key string, value double").repartition(4).withColumn("_k", F.lit(1)).persist()
    want = as_dict(df.filter("value is not null and not isnan(value)").groupBy("key").agg(F.percentile("value", p).alias("x")), "key", "x")
    assert as_dict(qu.exact_percentile(df, ["key"], "value", p, "x", most=20), "key", "x") == want and None in want and "none" not in want


def test_whole_table_odd_names_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (4, "b"), (9, "b")], "`odd``name` int, `k.1` string")
    assert [r["percentile"] for r in qu.exact_percentile(df, [], "odd`name", 0.5).collect()] == [4.0]
    assert as_dict(qu.exact_percentile(df, ["k.1"], "odd`name", 0.5), "k.1", "percentile") == {"a": 1.0, "b": 6.5}
    assert qu.exact_percentile(df.limit(0), ["k.1"], "odd`name", 0.5).count() == 0
    with pytest.raises(ValueError):
        qu.exact_percentile(df, [], "odd`name", 1.5)


def test_ten_million_rows_of_one_group(spark):
    df = spark.range(10_000_000).select(F.lit("g").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(4_000_037)) / 7).alias("value"))
    got = qu.exact_percentile(df, ["key"], "value", 0.9, "x").first()["x"]
    assert got == np.percentile(df.select("value").toPandas()["value"], 90)


def test_count_at_most():
    rng = np.random.default_rng(6)
    for n, width in ((0, 3), (1, 1), (50, 7), (300, 300), (400, 60)):
        v = rng.integers(0, 20, n).astype(float)
        first = np.maximum(np.arange(n) - width + 1, 0)
        assert trailing.count_at_most(v, first).tolist() == [int((v[f : i + 1] <= v[i]).sum()) for i, f in enumerate(first)]


def test_a_wide_window_takes_no_longer():
    v = np.random.default_rng(7).normal(size=300_000)
    took = []
    for width in (252, 10_000):
        first = np.maximum(np.arange(len(v)) - width + 1, 0)
        began = time.perf_counter()
        trailing.count_at_most(v, first)
        took.append(time.perf_counter() - began)
    assert took[1] < 2 * took[0] + 0.1


@pytest.mark.parametrize("ranges", [1, 5])
def test_trailing_rank_equals_windows(spark, ranges):
    rng = np.random.default_rng(8)
    rows = [(s, DAY + dt.timedelta(k), None if rng.uniform() < 0.01 else float(rng.integers(0, 30)), k) for s, n in (("a", 700), ("b", 45), ("c", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "series_id string, dt date, x double, other int").repartition(3)
    got = trailing.trailing_rank(df, "x", "p", 40, ranges)
    assert got.columns == ["series_id", "dt", "x", "other", "p"]
    want = df.withColumn("p", fe.percentile_rank(F.col("x"), 40))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(map(tuple, want.collect()), key=lambda r: r[:2])
    assert trailing.trailing_rank(df.limit(0), "x", "p", 40, ranges).count() == 0

"""Readers that meet malformed lines, written tables read back, and a blend rebuilt from its stored refits."""

import datetime as dt

import numpy as np
import pytest

from volspan.operators import reports as rep
from volspan.plans import queries as q
from volspan.sources import bars as src
from volspan.sources.stored import new_folder, stored

SF, SCHEMA = "/root/testdata/sf0.01", "name string, day date, x double"
LINES = ["name,day,x", "a,2020-01-02,1.5", "b,2020-13-02,2.5", "c,2020-01-03", "d,2020-01-04,2,9", "e,2020-01-05,x", "f,,"]


@pytest.fixture(scope="module")
def path(spark):
    path = new_folder(spark)
    spark.createDataFrame([(x,) for x in LINES], "value string").coalesce(1).write.text(path)
    return path


def test_bad_lines_are_reported_whatever_is_read(spark, path):
    found = src.read_csv(spark, path, SCHEMA, "report")
    assert {r["name"]: r["bad_line"] for r in found.select("name", "bad_line").collect()} == {"a": None, **{x[0]: x for x in LINES[2:6]}, "f": None}
    good = found.filter("bad_line is null").select("name", "day", "x").orderBy("name").collect()
    assert [tuple(r) for r in good] == [("a", dt.date(2020, 1, 2), 1.5), ("f", None, None)]


def test_fail_and_null(spark, path):
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        src.read_csv(spark, path, SCHEMA, "fail").select("name").collect()
    assert src.read_csv(spark, path, SCHEMA).count() == 6
    with pytest.raises(ValueError):
        src.read_csv(spark, path, SCHEMA, "other")


def test_stored_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, [1.5, None], None), (2, None, "x")], "a int, b array<double>, c string")
    back = stored(df)
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect()) and stored(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["daily_bars", "mz_tests", "h5_walk_forward", "egarch_h1_fixed", "crisis_thresholds_refined", "regime_blend_rebuilt"])
def test_a_query_derives_its_bars_once(spark, monkeypatch, name):
    derive, calls = src.lineitem_bars, []
    monkeypatch.setattr(src, "lineitem_bars", lambda lines: calls.append(1) or derive(lines))
    q.QUERIES[name](spark, "/root/testdata/sf0.001")
    q.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(calls) == 2


def test_rows_of_a_refined_percentile_are_not_derived_in_every_round(spark, monkeypatch):
    find, seen = q.qu.exact_percentile, []
    monkeypatch.setattr(q.qu, "exact_percentile", lambda rows, *more: seen.append(rows) or find(rows, *more))
    q.QUERIES["crisis_thresholds_refined"](spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert len(seen) == 1 and "FileScan" in plan and "Window" not in plan and "Exchange" not in plan


def test_reconstruction_sees_missing_and_changed_rows(spark):
    schema = "series_id string, dt int, {} double"
    rebuilt = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 1.0), ("c", 1, 5.0)], schema.format("rebuilt"))
    given = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 1.5)], schema.format("forecast"))
    got = {r["series_id"]: (r["n"], r["max_abs_diff"]) for r in rep.reconstruction(rebuilt, given).collect()}
    assert got == {"a": (2, 0.0), "b": (1, 0.5), "c": (1, float("inf"))}


def test_headline_bars_by_direct_computation(spark):
    bars = {(r["series_id"], r["model"]): (r["n"], r["qlike"]) for r in q.QUERIES["headline_crisis_bars"](spark, SF).collect()}
    shared = q.QUERIES["report_crisis_bars"](spark, SF).filter("model <> 'M3 Combined'").collect()
    assert all(bars[r["series_id"], r["model"]] == (r["n"], pytest.approx(r["qlike"], abs=2e-6)) for r in shared) and len(bars) == len(shared) * 6 // 4
    rows = q.scheduled(spark, SF)
    limit = {r["series_id"]: r["threshold"] for r in rep.crisis_threshold(rows, rows).collect()}
    found = q.QUERIES["qlike_corrections"](spark, SF).filter("kind <> 'pooled'").toPandas()
    for (series, kind), g in found.groupby(["series_id", "kind"]):
        g = g[g["actual"] > limit[series]]
        ratio = (g["actual"] / g["forecast"]) ** 2
        n, qlike = bars[series, "M2d Regime-QLIKE" if kind == "regime" else "M2e Switched"]
        assert n == len(g) and qlike == pytest.approx(float(np.mean(ratio - np.log(ratio) - 1)), rel=1e-4)

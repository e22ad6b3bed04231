"""Features on hand-written bars: floors, nulls, window edges, ties, as-of lookups."""

import datetime as dt
import math
import random

import pytest

from volspan.operators import features as fe
from volspan.operators import walk_forward as wf
from volspan.sources import bars as src

DAY = dt.date(2020, 1, 1)


def make(spark, closes, series="s"):
    rows = [(series, DAY + dt.timedelta(k), c, None if c is None else c * (1 + 0.01 * (k % 5)), None if c is None else c * 0.99, c) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, src.BAR_SCHEMA)


def test_flat_bar_has_the_floor_and_null_price_has_null(spark):
    df = spark.createDataFrame([("s", DAY, 5.0, 5.0, 5.0, 5.0), ("s", DAY + dt.timedelta(1), None, 5.0, 5.0, 5.0), ("s", DAY + dt.timedelta(2), 4.0, 8.0, 4.0, 6.0)], src.BAR_SCHEMA)
    rv = [r["rv"] for r in fe.volatility_series(df).orderBy("dt").collect()]
    assert rv[0] == pytest.approx(1e-3) and rv[1] is None
    assert rv[2] == pytest.approx(100 * math.sqrt(0.5 * math.log(2) ** 2 - (2 * math.log(2) - 1) * math.log(1.5) ** 2))


@pytest.mark.parametrize("n, rows", [(100, 0), (252, 0), (253, 1), (260, 8)])
def test_warm_up_is_252_rows(spark, n, rows):
    assert fe.feature_table(make(spark, [10.0 + (k * 7) % 13 for k in range(n)])).count() == rows


def test_percentile_counts_ties_and_itself(spark):
    df = spark.createDataFrame([("s", DAY + dt.timedelta(k), x) for k, x in enumerate([1.0, 2.0, 2.0, 1.0, 3.0])], "series_id string, dt date, x double")
    from pyspark.sql import functions as F

    got = [r["p"] for r in df.select("dt", fe.percentile_rank(F.col("x"), 4).alias("p")).orderBy("dt").collect()]
    assert got == [None, None, None, 0.5, 1.0]


def test_series_do_not_mix(spark):
    both = make(spark, [10.0, 11.0, 12.0], "a").union(make(spark, [50.0, 60.0, 70.0], "b"))
    rows = fe.lag_features(fe.volatility_series(both)).orderBy("series_id", "dt").collect()
    assert rows[0]["rv1"] is None and rows[3]["rv1"] is None and rows[3]["return"] is None


def test_shifted_mean_needs_a_full_window(spark):
    rows = fe.lag_features(fe.volatility_series(make(spark, [10.0, None, *[11.0 + k % 3 for k in range(10)]]))).orderBy("dt").collect()
    assert [r["rv5"] is None for r in rows] == [True] * 7 + [False] * 5


def test_last_known_and_events(spark):
    days = spark.createDataFrame([("s", DAY + dt.timedelta(k)) for k in range(6)], "series_id string, dt date")
    changes = spark.createDataFrame([("s", DAY + dt.timedelta(1), 1.5), ("s", DAY + dt.timedelta(4), 2.5)], "series_id string, dt date, c double")
    assert [r["c"] for r in fe.last_known(days, changes, ["c"]).orderBy("dt").collect()] == [None, 1.5, 1.5, 1.5, 2.5, 2.5]
    marked = fe.mark_events(days, src.event_dates(spark, ["2020-01-03", "2020-01-03", "2021-05-05"]))
    assert [r["event_day"] for r in marked.orderBy("dt").collect()] == [0, 0, 1, 0, 0, 0]


def test_bars_take_first_and_last_by_order(spark):
    rows = [("N", DAY, 10.0 * q, float(q), k, 1, 1, 1) for k, q in ((3, 1), (1, 2), (2, 4))] + [("A", DAY, 8.0, 0.0, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "l_returnflag string, l_shipdate date, l_extendedprice double, l_quantity double, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    df = df.withColumn("l_extendedprice", df["l_extendedprice"] + df["l_orderkey"])
    got = {r["series_id"]: r for r in src.lineitem_bars(df).collect()}
    assert set(got) == {"ALL", "N"} and (got["N"]["open"], got["N"]["close"]) == (10.5, 13.0)
    assert (got["N"]["high"], got["N"]["low"]) == (13.0, 10.5)


TRADES = "l_returnflag string, l_shipdate date, l_extendedprice double, l_quantity double, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"


def test_bars_with_nulls_and_ties_by_direct_computation(spark):
    rng = random.Random(5)
    some = lambda *x: rng.choice(x)
    rows = [(some("A", "N", "ALL", None), some(DAY, DAY + dt.timedelta(1), None), some(10.0, 20.0, 35.0, None), some(1.0, 2.0, 0.0, None), some(1, 2, 3, None), some(1, 2, None), some(1, 2), some(1, None)) for _ in range(400)]
    rows += [("only nulls", DAY, 7.0 + k, 1.0, None, k, 1, 1) for k in range(3)] + [("one", None, 3.0, 1.0, 1, 1, 1, 1), ("no price", DAY, None, 1.0, 1, 1, 1, 1)]
    groups: dict = {}
    for flag, day, total, quantity, *order in rows:
        if quantity:
            px = None if total is None else total / quantity
            for series in ("ALL", flag):
                groups.setdefault((series, day), []).append(([(v is not None, v or 0) for v in (*order, px)], px))
    expected = set()
    for key, trades in groups.items():
        prices = [px for _, px in trades if px is not None]
        expected.add((*key, min(trades)[1], max(prices, default=None), min(prices, default=None), max(trades)[1]))
    got = [tuple(r) for r in src.lineitem_bars(spark.createDataFrame(rows, TRADES)).select("series_id", "dt", "open", "high", "low", "close").collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_bars_sort_only_the_trades_at_their_ends(spark):
    """An aggregate of structs sorts its rows, and spills them; before the join with the bars' ends none may."""
    plan = src.lineitem_bars(spark.createDataFrame([], TRADES))._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    sorting = [k for k, line in enumerate(lines) if "SortAggregate" in line or " Sort " in line]
    joins = [k for k, line in enumerate(lines) if "Join" in line]
    assert sorting and joins and max(sorting) < joins[0]


def test_files_round_trip(spark, tmp_path):
    df = make(spark, [10.0, 11.0])
    for kind in ("csv", "parquet"):
        src.write_table(df, f"{tmp_path}/{kind}", kind)
        assert src.read_bars(spark, f"{tmp_path}/{kind}", kind).orderBy("dt").collect() == df.orderBy("dt").collect()
    src.copy_table(spark, f"{tmp_path}/csv", f"{tmp_path}/copy", src.BAR_SCHEMA)
    assert src.read_csv(spark, f"{tmp_path}/copy", src.BAR_SCHEMA).count() == 2
    src.write_table(df.limit(0), f"{tmp_path}/none", "parquet")
    with pytest.raises(ValueError):
        src.read_bars(spark, f"{tmp_path}/none")
    flat = src.flatten_columns(spark.createDataFrame([(1.0, dt.datetime(2020, 1, 1, 5))], "`Close.X` double, ts timestamp"))
    assert flat.columns == ["close", "dt"]


def test_schedule_counts_skipped_rows(spark):
    rows = spark.createDataFrame([("s", DAY + dt.timedelta(k)) for k in range(800)], "series_id string, dt date")
    got = wf.schedule(rows, months=12, every=21, least=450).orderBy("dt").collect()
    split = got[0]["split_date"]
    test = [r for r in got if r["dt"] > split]
    assert [r["i"] for r in test] == list(range(len(test))) and got[len(got) - len(test) - 1]["dt"] == split
    refits = [(r["i"], r["rn"]) for r in got if r["is_refit"]]
    first = min(r["i"] for r in test if r["rn"] >= 450)
    assert refits[0] == (first, 450) and all(i % 21 == 0 for i, _ in refits[1:])


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    from volspan.streaming.bars import stream_event_bars

    rows = [(k, dt.datetime(2020, 1, 1, k // 40, k % 40), "x" if k % 3 else "y", float((k * 37) % 101)) for k in range(400)] + [(999, dt.datetime(2020, 1, 2, 0, 0), "x", 1.0)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    run = stream_event_bars(stream).writeStream.format("memory").queryName("hour_bars").outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    batch = src.event_bars(events).filter("hour < '2020-01-01 21:00:00'")
    assert sorted(map(tuple, spark.table("hour_bars").collect())) == sorted(map(tuple, batch.collect()))

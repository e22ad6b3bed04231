"""Queries beside their SQL on the smallest tables that hold enough history."""

import duckdb
import pytest

import __spark_entry__
from volspan import catalog

SF = "/root/testdata/sf0.01"
SOME = ["daily_bars", "hourly_bars", "feature_table", "asof_params", "event_dummy", "regime_blend_split", "rolling_ols_1000", "ridge_kitchen_sink", "mz_regime_correction", "dm_tests", "correlogram_rv", "arch_lm", "report_encompassing", "report_residuals", "report_wins", "trailing_rank_in_ranges", "price_percentiles", "crisis_thresholds_refined", "csv_malformed_lines", "bars_csv_round_trip", "bars_parquet_round_trip", "regime_blend_rebuilt"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("lineitem", "orders", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(got.columns))
    expected = db.sql(f"SELECT {columns} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*[f"`{c}`" for c in sorted(got.columns)]).collect()))) == sorted(map(str, expected))


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) >= 60

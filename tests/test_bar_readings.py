"""Queries on bars read the trades in the bars' derivation alone, whatever else they compute."""

import pytest

from volspan.plans import queries as q
from volspan.sources import bars as src

NAMES = ["h5_sim_raw", "egarch_fit", "egarch_fit_chained", "encompassing", "h5_walk_forward", "metrics_by_regime", "row_losses", "regime_blend_split", "regime_blend", "report_metrics", "weight_distribution", "regime_switch_correction", "fixed_refit_ranges", "combined_har_sigma", "egarch_h1_fixed"]


@pytest.mark.parametrize("name", NAMES)
def test_a_query_takes_trades_from_its_bars_alone(spark, monkeypatch, name):
    derive, calls = src.lineitem_bars, []
    monkeypatch.setattr(src, "lineitem_bars", lambda lines: calls.append(1) or derive(lines))
    plan = q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and "l_shipdate" not in plan and "Relation" in plan

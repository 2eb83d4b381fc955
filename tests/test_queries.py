"""Registered queries against their SQL twins on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import check, connect

FAST = [
    "s03_broker_json",
    "s04_equity_json",
    "s07_coverage",
    "s10_bars_1h",
    "s12_deal_counts",
    "c01_fill_missing",
    "c09_clean",
    "v01_issues",
    "f02_ema",
    "f12_value_area",
    "f17_rsi",
    "f19_adx",
    "f27_seasonal",
    "f30_holidays",
    "f43_state_duration",
    "t10_transform",
    "l02_cfs",
    "r01_parse_events",
    "r05_sliding",
    "u03_exact_quantiles",
    "s07_coverage_two_ranges",
    "c02_null_order",
    "c04_off_grid_counts",
    "v13_verdict",
    "f28_stl_sum",
    "f30_far_holidays",
    "f33_two_regimes",
    "f45_cycles",
    "f46_feature_list",
    "t05_column_groups",
    "l01_correlations",
    "r04_newest_updates",
    "r06_live_indicators",
    "r07_sessions",
    "u02_rolling_function",
    "f28_stl",
    "f29_mstl",
    "f34_volatility_regime",
    "l04_rfecv",
    "r05_tumbling",
    "r08_live_counts",
    "s14_landed_responses",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, con, sf_dir, name):
    said, _, _ = check(spark, con, sf_dir, name)
    assert said == "ok"


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_dirty_bars_show_every_finding(spark, sf_dir):
    from tidebars.operators.validate import ISSUES

    found = {r["code"] for r in entry.queries()["v01_issues"](spark, sf_dir).collect()}
    assert found >= set(ISSUES) - {"missing_columns", "few_rows"}
    verdicts = {r["is_valid"] for r in entry.queries()["v13_verdict"](spark, sf_dir).collect()}
    assert verdicts == {True, False}

"""A sample of registered queries against their SQL; run_checks.py runs all."""

import pytest
from compare import compare, oracle_connection

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "d01_daily_activity",
    "e01_e05_rolling_features",
    "e06_e07_baseline_with_prestart_history",
    "c05_modeling_candidates",
    "d12_d20_safe_metrics_by_day",
    "d47_threshold_policies",
    "e08_episode_warning_timing",
    "d39_episode_timing",
    "e13_e14_f05_top_by_capacity",
    "d44_score_drift",
]


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, con, name):
    assert compare(entry.queries()[name], entry.oracle_sql()[name], spark, SF, con) is None


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 4

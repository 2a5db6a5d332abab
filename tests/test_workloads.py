"""Registered queries equal their DuckDB twins; MARKETLENS_FULL=1 runs all of them."""
import os

import pytest

import __spark_entry__ as entry
from workloads import check

SF = "/root/testdata/sf0.001"
QUICK = ["leaderboard_job", "wallet_family_metrics", "asof_forward", "rms_sigma", "variance_ratio", "pnl_summary", "booster_lock", "band_profit_scan",
         "reconcile_positions", "hist_calibration", "time_ema", "score_sheet"]
NAMES = list(entry.oracle_sql()) if os.environ.get("MARKETLENS_FULL") else QUICK
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, name):
    ok, note = check.compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_twins_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())

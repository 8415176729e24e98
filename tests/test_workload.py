"""A cross-section of the registered queries against their SQL.

`python check.py` compares all of them, at any scale factor.
"""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"
SECTION = (
    "s5_scan_universe", "s9_long_from_wide", "k5_sink_rejects",
    "k6_refresh_symbols", "w4_ewm_adjusted", "w7_macd", "w24_rolling_median",
    "a4_first_listing", "a8_weekday_effect", "a12_outcome_histogram",
    "e1_build_universe", "e3_add_indicators", "e11_build_summary",
    "e15_find_similar", "e17_candle_view", "f19_format", "f24_business_days",
    "hourly_indicators",
)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SECTION)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, queries()[name], oracle_sql()[name]) is None


def test_entry(spark):
    assert entry(spark).count() == 10

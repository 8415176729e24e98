import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.operators.arima import forecast_paths
from barweave.operators.forecast import (
    arima_path, forecast_next_week, weekday_effect,
)
from barweave.plans.daily import advance, read_state, run_day, state_of, summary_of_state
from barweave.plans.summary import build_summary, candle_view
from barweave.operators.indicators import add_indicators
from barweave.schemas import UNIVERSE
from barweave.sources.files import read_bar_files
from tests.helpers import GOLDEN, bars, frame, needs_golden, walk

# symbol: close, rsi, label, trend, vol_ratio, forecast, lower, upper
EXPECTED = {
    "285A.T": (69330.0, 42.2, "downtrend", "flat", 0.56, 85281.4, 63308.4, 114880.8),
    "8729.T": (149.7, 62.6, "uptrend", "up", 0.39, 148.4, 136.2, 161.6),
    "GEV": (1091.6, 53.7, "downtrend", "up", 0.52, 1081.4, 938.5, 1246.1),
    "VLTO": (92.7, 65.5, "uptrend", "up", 0.47, 90.8, 84.7, 97.4),
}


@needs_golden
def test_summary_of_real_bars(spark):
    raw = read_bar_files(spark, str(GOLDEN / "raw"))
    listed = spark.createDataFrame(
        [("GEV", "GE Vernova", "us", "Industrials")], UNIVERSE)
    rows = {r.symbol: r for r in build_summary(raw, listed).collect()}
    assert len(rows) == 10
    for symbol, want in EXPECTED.items():
        r = rows[symbol]
        assert (r.close, r.rsi, r.macd_label, r.trend, r.vol_ratio, r.forecast_1w,
                r.forecast_lower, r.forecast_upper) == want
    assert rows["GEV"].name == "GE Vernova"
    assert (rows["VLTO"].name, rows["VLTO"].group) == ("VLTO", "?")


def test_gate_at_80_rows(spark):
    panel = bars(spark, frame("short", walk(1, 79)), frame("long", walk(2, 80)))
    none = spark.createDataFrame([], UNIVERSE)
    assert [r.symbol for r in build_summary(panel, none).collect()] == ["long"]


@pytest.mark.parametrize("last, first_day", [
    ("2024-03-01", "2024-03-04"),   # Friday -> Monday
    ("2024-03-02", "2024-03-05"),   # Saturday -> Tuesday
    ("2024-03-03", "2024-03-05"),   # Sunday -> Tuesday
])
def test_business_days(spark, last, first_day):
    end = datetime.date.fromisoformat(last)
    start = (end - datetime.timedelta(99)).isoformat()
    rows = forecast_next_week(bars(spark, frame("a", walk(1, 100), start))).orderBy(
        "step").collect()
    assert len(rows) == 5 and rows[0].date.isoformat() == first_day
    assert all(r.date.weekday() < 5 and r.lower <= r.forecast <= r.upper
               for r in rows)


def test_unseen_weekday_has_no_effect_row(spark):
    days = [i for i in range(200) if (i + 2) % 7 not in (0, 1)]
    panel = bars(spark, frame("a", walk(1, len(days)), "2020-01-01", days=days))
    seen = {r.weekday for r in weekday_effect(panel).collect()}
    assert len(seen) == 5


def test_candle_view_is_anchored(spark):
    enriched = add_indicators(bars(spark, frame("a", walk(1, 150))))
    rows = candle_view(enriched, "a", 63).orderBy("date", "kind").collect()
    assert sum(r.kind == "bar" for r in rows) == 63
    ahead = [r for r in rows if r.kind == "forecast"]
    last = max(r.date for r in rows if r.kind == "bar")
    assert len(ahead) == 6 and ahead[0].date == last
    assert ahead[0].forecast == ahead[0].lower == ahead[0].upper


def test_arima_finds_the_process():
    rng = np.random.default_rng(5)
    e = rng.normal(0, 0.01, 4000)
    w = np.zeros(4000)
    for t in range(1, 4000):
        w[t] = 0.7 * w[t - 1] + e[t] + 0.2 * e[t - 1]
    path = np.cumsum(w)
    expected, state = path[-1], (w[-1], e[-1])
    move, levels = 0.7 * state[0] + 0.2 * state[1], []
    for _ in range(3):
        expected += move
        levels.append(np.exp(expected))
        move *= 0.7
    got = forecast_paths([path], 3)[0]
    assert np.allclose(np.log(got), np.log(levels), atol=0.003)


def test_arima_cases(spark):
    assert forecast_paths([None, [1.0] * 5, [0.0, np.nan] * 30], 5) == [None] * 3
    assert np.allclose(forecast_paths([[2.0] * 100], 5)[0], np.exp(2.0))
    panel = bars(spark, frame("a", walk(1, 120)), frame("b", walk(2, 400)))
    rows = arima_path(panel).collect()
    assert len(rows) == 10 and all(50 < r.value < 200 for r in rows)
    three = forecast_next_week(panel, with_arima=True).collect()
    assert len(three) == 10 and all(r.lower <= r.forecast <= r.upper for r in three)


def test_thirty_days_one_by_one_equal_the_whole_batch(spark, tmp_path):
    """Long and short histories, a pause, a new symbol, days without a close."""
    long = walk(1, 700)
    long[200:640] = long[200]
    gaps = frame("gaps", walk(2, 300), "2020-12-01")
    gaps.loc[gaps.index % 7 == 3, "close"] = np.nan
    parts = [frame("long", long, "2019-09-01"), gaps, frame("short", walk(3, 90), "2021-05-15"),
             frame("new", walk(4, 100), "2021-06-01"), frame("old", walk(5, 400), "2018-01-01")]
    panel = bars(spark, *parts).withColumn("volume", F.abs(F.hash("date")) % 1000 + 0.5)
    panel = panel.where("date <= DATE'2021-07-31'").cache()
    none = spark.createDataFrame([], UNIVERSE)
    path, day = str(tmp_path / "state"), datetime.date(2021, 7, 1)
    run_day(panel.where(F.col("date") < F.lit(day)), path)
    for k in range(30):
        today = day + datetime.timedelta(k)
        run_day(panel.where(F.col("date") == F.lit(today)), path)
        if k % 10 == 9:
            so_far = panel.where(F.col("date") <= F.lit(today))
            for arima in (False, True):
                got = summary_of_state(read_state(spark, path), none, 80, arima).collect()
                want = build_summary(so_far, none, 80, arima).collect()
                assert sorted(got) == sorted(want) and len(got) >= 3
    again = advance(read_state(spark, path), panel.where(F.col("date") == F.lit(today)))
    assert sorted(again.collect()) == sorted(read_state(spark, path).collect())
    whole = {r.symbol: r for r in state_of(panel.where(F.col("date") <= F.lit(today))).collect()}
    for r in read_state(spark, path).collect():
        assert (r.n_rows, r.seen, r.n_bars, r.tail, r.before) == (
            whole[r.symbol].n_rows, whole[r.symbol].seen, whole[r.symbol].n_bars,
            whole[r.symbol].tail, whole[r.symbol].before)
        assert np.isclose(r.signal, whole[r.symbol].signal, atol=1e-8)
    panel.unpersist()

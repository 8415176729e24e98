"""Indicators against stored results, a plain pandas statement, and edge cases."""

import numpy as np
import pandas as pd
import pytest

from barweave.operators.indicators import (
    add_ema, add_indicators, add_macd, add_rsi,
)
from barweave.operators.panel import number_bars
from barweave.operators.quality import min_history
from barweave.operators.signals import (
    latest_signals, latest_state, signal_columns,
)
from barweave.schemas import INDICATOR_COLUMNS
from barweave.sources.files import read_bar_files
from tests.helpers import GOLDEN, bars, frame, needs_golden, walk


@needs_golden
@pytest.mark.parametrize("symbol", ["Q", "8729.T"])
def test_stored_results(spark, symbol):
    mine = add_indicators(read_bar_files(spark, str(GOLDEN / "raw"))).where(
        f"symbol = '{symbol}'").orderBy("date").toPandas()
    stored = pd.read_csv(GOLDEN / "processed" / f"{symbol}.csv").rename(columns=str.lower)
    assert len(mine) == len(stored)
    for c in INDICATOR_COLUMNS:
        a, b = mine[c].to_numpy(float), stored[c].to_numpy(float)
        assert (np.isnan(a) == np.isnan(b)).all(), c
        assert np.nanmax(abs(a - b)) < 5.01e-4, c


def plain(close):
    out = {f"sma{w}": close.rolling(w).mean() for w in (5, 20, 50)}
    change = close.diff()
    gain = change.clip(lower=0).ewm(alpha=1 / 14, min_periods=14).mean()
    loss = (-change.clip(upper=0)).ewm(alpha=1 / 14, min_periods=14).mean()
    out["rsi"] = 100 - 100 / (1 + gain / loss)
    out["macd"] = (close.ewm(span=12, adjust=False).mean()
                   - close.ewm(span=26, adjust=False).mean())
    out["macd_signal"] = out["macd"].ewm(span=9, adjust=False).mean()
    std = close.rolling(20).std()
    out["bb_upper"] = out["sma20"] + 2 * std
    out["bb_lower"] = out["sma20"] - 2 * std
    return pd.DataFrame(out)


def test_long_histories_and_flat_runs(spark):
    """Several slots and segments, with pauses longer than any memory."""
    paused = walk(1, 6000)
    paused[1500:3300] = paused[1500]
    late = walk(2, 2300)
    late[:1500] = 50.0
    days = np.sort(np.random.default_rng(3).choice(9000, 6000, replace=False))
    panel = [frame("a", paused, "1990-01-01", days=days), frame("b", late),
             frame("c", walk(4, 2049)), frame("d", walk(5, 30))]
    mine = add_indicators(bars(spark, *panel)).orderBy("symbol", "date").toPandas()
    for f in panel:
        got = mine[mine.symbol == f.symbol.iloc[0]].reset_index(drop=True)
        want = plain(f.close.reset_index(drop=True))
        assert len(got) == len(f)
        for c in want:
            a, b = got[c].to_numpy(float), want[c].to_numpy(float)
            assert (np.isnan(a) == np.isnan(b)).all(), c
            assert np.isnan(b).all() or np.nanmax(abs(a - b)) < 1e-8, c


def test_direct_state_equals_enriched(spark):
    panel = bars(spark, frame("a", walk(7, 2500)), frame("b", walk(8, 90)),
                 frame("flat", [5.1] * 100), frame("up", np.arange(1.0, 101)))
    direct = latest_state(number_bars(panel)).select(
        "symbol", "last_date", *signal_columns())
    stored = latest_signals(add_indicators(panel))
    rows = sorted(direct.collect())
    assert rows == sorted(stored.collect())
    by_symbol = {r.symbol: r for r in rows}
    flat, up = by_symbol["flat"], by_symbol["up"]
    assert (flat.rsi, flat.rsi_label, flat.trend) == (None, "na", "flat")
    assert flat.bb_signal == "upper_touch" and flat.macd_label == "downtrend"
    assert (up.rsi, up.rsi_label, up.trend) == (100.0, "overbought", "up")


def test_zero_volume_and_short_history(spark):
    panel = bars(spark, frame("z", walk(1, 49), volume=0.0))
    row = latest_signals(add_indicators(panel)).first()
    assert row.vol_ratio == 0.0 and row.trend == "flat"


def test_one_exchange_per_layout(spark):
    """Numbering and segments each shuffle the bars once; no bars broadcast."""
    df = add_indicators(bars(spark, frame("a", walk(1, 300))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and "SortMergeJoin" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def close_to(got, want):
    a, b = np.asarray(got, float), np.asarray(want, float)
    assert (np.isnan(a) == np.isnan(b)).all()
    assert np.nanmax(abs(a - b)) < 1e-7


def test_any_parameters(spark):
    """Long signals and windows, and memories of one bar."""
    close = pd.Series(walk(11, 7000))
    panel = bars(spark, frame("a", close.to_numpy()))
    got = add_indicators(panel, windows=(5, 3000), rsi_period=1, signal=200,
                         fast=1, slow=30).orderBy("date").toPandas()
    macd = close - close.ewm(span=30, adjust=False).mean()
    close_to(got.macd, macd)
    close_to(got.macd_signal, macd.ewm(span=200, adjust=False).mean())
    close_to(got.sma3000, close.rolling(3000).mean())
    change = close.diff()
    rsi = np.where(change > 0, 100.0, np.where(change < 0, 0.0, np.nan))
    close_to(got.rsi, rsi)
    alone = add_macd(panel, signal=200).orderBy("date").toPandas()
    full = (close.ewm(span=12, adjust=False).mean()
            - close.ewm(span=26, adjust=False).mean())
    close_to(alone.macd_signal, full.ewm(span=200, adjust=False).mean())
    close_to(add_macd(panel, signal=1).orderBy("date").toPandas().macd_hist, full * 0)
    close_to(add_ema(panel, 1).orderBy("date").toPandas().ema, close)


def test_minute_and_second_bars(spark):
    close = pd.Series(walk(12, 20000))
    for step in ("1min", "1s"):
        data = pd.DataFrame({
            "symbol": "m", "date": pd.date_range("2024-01-01", periods=20000, freq=step),
            "open": close, "high": close, "low": close, "close": close, "volume": 1.0})
        panel = spark.createDataFrame(data, "symbol string, date timestamp_ntz, "
                                      "open double, high double, low double, "
                                      "close double, volume double")
        got = add_ema(panel, 20).orderBy("date").toPandas()
        close_to(got.ema, close.ewm(span=20, adjust=False).mean())
        close_to(add_rsi(panel).orderBy("date").toPandas().rsi, plain(close).rsi)


def test_hot_symbol_is_split_behind_a_join(spark):
    """Whatever a join by symbol leaves, bars are sorted by symbol and slot."""
    panel = bars(spark, frame("a", walk(1, 300)), frame("b", walk(2, 300)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = number_bars(min_history(panel, 200))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    joined = [k for k, line in enumerate(plan.splitlines()) if "LeftSemi" in line]
    laid = [k for k, line in enumerate(plan.splitlines())
            if "hashpartitioning(symbol" in line and "slot" in line]
    assert joined and laid and min(laid) < min(joined)
    assert all(any(a < j for a in laid) for j in joined)


def test_repeated_dates(spark):
    """Rows of one date are ordered by price, and counted like others."""
    close = np.sort(walk(13, 20000))
    panel = bars(spark, frame("one", close, days=[0] * 20000),
                 frame("twice", walk(14, 3000), days=np.arange(3000)))
    got = add_indicators(panel.union(panel.where("symbol = 'twice'"))).orderBy(
        "symbol", "pos").toPandas()
    one = got[got.symbol == "one"].reset_index(drop=True)
    want = plain(pd.Series(close))
    for c in want:
        close_to(one[c], want[c])
    assert (one.pos == np.arange(20000)).all()
    two = got[got.symbol == "twice"].reset_index(drop=True)
    want = plain(pd.Series(np.repeat(walk(14, 3000), 2)))
    for c in want:
        close_to(two[c], want[c])


def test_sums_are_carried_over_many_slots(spark):
    """Blocks of slots, weights that underflow, and what is left after a long pause."""
    close = walk(15, 9000)
    close[1000:8000] = close[1000]
    days = np.arange(9000) * 300  # a slot holds three or four bars
    panel = bars(spark, frame("sparse", close, "1900-01-01", days=days % 2_900_000))
    mine = number_bars(panel, slot_rows=4).orderBy("pos").select("close").toPandas().close
    got = add_indicators(panel, rsi_period=5).orderBy("pos").toPandas()
    change = mine.diff()
    gain = change.clip(lower=0).ewm(alpha=1 / 5, min_periods=5).mean()
    loss = (-change.clip(upper=0)).ewm(alpha=1 / 5, min_periods=5).mean()
    close_to(got.macd, plain(mine).macd)
    close_to(got.macd_signal, plain(mine).macd_signal)
    rsi = 100 - 100 / (1 + gain / loss)
    early = slice(0, 4000)
    close_to(got.rsi[early], rsi[early])


def test_no_list_of_earlier_slots(spark):
    """What is carried into a slot is summed by windows, not gathered."""
    plan = add_rsi(bars(spark, frame("a", walk(1, 300))))._jdf.queryExecution(
    ).optimizedPlan().toString()
    lists = [line for line in plan.splitlines() if "collect_list" in line]
    assert lists and all("Aggregate [symbol" in line for line in lists)

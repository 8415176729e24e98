"""The public API end to end."""

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.operators import forecast, patterns, quality, screens, series
from barweave.operators.indicators import add_indicators
from barweave.operators.signals import latest_signals
from barweave.operators.universe import build_universe
from barweave.plans.daily import read_state, run_day, summary_of_state
from barweave.plans.summary import build_summary, candle_view, signal_report
from barweave.session import scratch_dir
from barweave.sources.adapters import (
    bars_from_events, exchange_listing_from_part, index_listing_from_part,
)
from barweave.sources.files import read_summary
from barweave.sources.library import grow_library, read_library
from barweave.sources.sinks import write_table
from workload.registry import query, r, rounded
from workload.rows import SCREEN_FIELDS, chosen
from workload.sql import sql
from workload.windows import curve

INDICATORS = ("sma5", "sma20", "sma50", "rsi", "macd", "macd_signal", "macd_hist",
              "bb_mid", "bb_upper", "bb_lower")
ROUNDED = ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in INDICATORS)


@query("e1_build_universe", sql("SELECT * FROM built", "built"))
def universe(t):
    part = t.table("part")
    return build_universe(
        exchange_listing_from_part(part), index_listing_from_part(part))


@query("e2_quality_gate", sql("""
  SELECT symbol, date, "open", high, low, "close", volume FROM (
    SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM gappy
    WHERE "close" IS NOT NULL) WHERE n >= 100""", "gappy"))
def quality_gate(t):
    return quality.quality_gate(t.gappy)[0]


@query("e3_add_indicators", sql(f"""
  SELECT symbol, date, "open", high, low, "close", volume, {ROUNDED}
  FROM enriched""", "enriched"))
def indicators(t):
    return rounded(add_indicators(t.bars).drop("pos", "n_bars"), 4, *INDICATORS)


@query("e4_latest_signals", sql("""
  SELECT symbol, last_date, "close", rsi, rsi_label, macd_label, trend, bb_signal,
    vol_ratio FROM labels""", "labels"))
def signals(t):
    return latest_signals(add_indicators(t.bars))


@query("e5_line_path", sql("""
  SELECT symbol, CAST(s AS INTEGER) AS step,
    round(base + slope * (m - 1 + s), 5) + 0.0 AS value
  FROM line, range(1, 6) t(s)""", "line"))
def line(t):
    return rounded(forecast.line_path(t.bars), 5, "value")


@query("e6_ema_drift_path", sql("""
  SELECT symbol, CAST(s AS INTEGER) AS step,
    round(last_close + drift * s, 5) + 0.0 AS value
  FROM drift JOIN last_rows USING (symbol), range(1, 6) t(s)""", "drift", "last_rows"))
def drift(t):
    return rounded(forecast.ema_drift_path(t.bars), 5, "value")


@query("e7_arima_path", sql("""
  SELECT symbol, step, round(value, 4) + 0.0 AS value FROM third_path""", "third_path"))
def arima(t):
    return rounded(forecast.arima_path(t.bars), 4, "value")


@query("e8_weekday_effect", sql("""
  SELECT symbol, CAST(weekday AS INTEGER) AS weekday, round(dev, 8) + 0.0 AS dev
  FROM effect""", "effect"))
def weekday_effect(t):
    return rounded(forecast.weekday_effect(t.bars), 8, "dev")


@query("e9_forecast_week", sql(
    "SELECT symbol, step, date, forecast, lower, upper FROM path", "path"))
def forecast_week(t):
    return forecast.forecast_next_week(t.bars)


@query("e9_forecast_week_three_models", sql(
    "SELECT symbol, step, date, forecast, lower, upper FROM path_three", "path_three"))
def forecast_three(t):
    return forecast.forecast_next_week(t.bars, with_arima=True)


@query("e10_forecast_summary", sql("SELECT * FROM week", "week"))
def forecast_summary(t):
    return forecast.forecast_summary(t.bars)


@query("e11_build_summary", sql("SELECT * FROM summary", "summary"))
def summary(t):
    return build_summary(t.bars, t.universe)


@query("e11_daily_summary", sql("SELECT * FROM summary", "summary"))
def daily_summary(t):
    """From a stored state: the history up to some day, then later days one by one."""
    path = scratch_dir(t.spark, "state")
    last = t.last_date
    ends = [last - timedelta(days) for days in (3, 2, 1, 0)]
    run_day(t.bars.where(F.col("date") <= F.lit(ends[0])), path)
    for before, end in zip(ends, ends[1:]):
        run_day(t.bars.where(F.col("date").between(F.lit(before), F.lit(end))), path)
    return summary_of_state(read_state(t.spark, path), t.universe)


@query("e11_build_summary_three_models", sql(
    "SELECT * FROM summary_three", "summary_three"))
def summary_three(t):
    return build_summary(t.bars, t.universe, with_arima=True)


@query("e12_signal_report", sql("""
  SELECT 'rsi_label' AS field, rsi_label AS label, count(*) AS n FROM summary GROUP BY 2
  UNION ALL SELECT 'macd_label', macd_label, count(*) FROM summary GROUP BY 2
  UNION ALL SELECT 'trend', trend, count(*) FROM summary GROUP BY 2""", "summary"))
def report(t):
    return signal_report(build_summary(t.bars, t.universe))


LIBRARY_ROWS = sql("""
  SELECT symbol, widx, start_date, end_date, i AS step, round((win[i] - m) / sd, 6) + 0.0
    AS z, CASE WHEN i <= 20 THEN round(nxt[i] / last - 1, 8) + 0.0 END AS ret
  FROM (SELECT *, unnest(range(1, 61)) AS i FROM windows)""", "windows")


def library_rows(library):
    rows = library.select(
        "symbol", F.col("widx").cast("long").alias("widx"), "start_date", "end_date", "fut",
        F.posexplode("x").alias("i", "z"))
    return rows.select(
        "symbol", "widx", "start_date", "end_date",
        (F.col("i") + 1).cast("long").alias("step"),
        r("z", 6).alias("z"), r(F.get("fut", "i"), 8).alias("ret"))


@query("e13_build_library", LIBRARY_ROWS)
def library(t):
    return library_rows(patterns.build_library(t.bars))


@query("e13_grow_library", LIBRARY_ROWS)
def grown_library(t):
    """Built with the bars of some years, then grown twice by later ones."""
    path = scratch_dir(t.spark, "library")
    for until in ("1995-12-31", "1996-01-20", "9999-01-01"):
        grow_library(t.bars.where(F.col("date") <= F.lit(until).cast("date")), path)
    return library_rows(read_library(t.spark, path))


@query("e14_query_shape", sql("""
  SELECT symbol AS query_id, 60 - age AS i, "close" FROM num
  WHERE age < 60 AND symbol IN ('1', '2')""", "num"))
def query_shape(t):
    shape = patterns.query_shape(t.bars, ["1", "2"])
    return shape.select("query_id", F.posexplode("q").alias("i", "close")).select(
        "query_id", (F.col("i") + 1).cast("long").alias("i"), "close")


def match_rows(chosen):
    return chosen.select(
        "query_id", F.col("rank").cast("long").alias("rank"),
        F.col("n").cast("long").alias("n"), "symbol",
        F.col("widx").cast("long").alias("widx"), "end_date",
        r("sim", 6).alias("sim"), r(F.element_at("fut", -1), 8).alias("ret20"))


MATCH_ROWS = """
  SELECT query_id, rank, n, symbol, widx, end_date, round(sim, 6) + 0.0 AS sim,
    round(fut[20], 8) + 0.0 AS ret20 FROM """


@query("e15_find_similar", sql(f"{MATCH_ROWS} chosen", "chosen"))
def find_similar(t):
    return match_rows(chosen(t))


@query("e15_exclude_self", sql(f"{MATCH_ROWS} chosen_elsewhere", "chosen_elsewhere"))
def find_similar_elsewhere(t):
    return match_rows(chosen(t, exclude_self=True))


@query("e16_screen", sql(f"""
  SELECT {SCREEN_FIELDS} FROM summary
  WHERE "group" IN ('large', 'mid', 'small') AND sector = 'NATION_6'""", "summary"))
def screen(t):
    return screens.screen(
        build_summary(t.bars, t.universe), "all", group="jp", sector="NATION_6")


SCREEN_RULES = {
    "oversold": "rsi <= 30", "golden_cross": "macd_label = 'golden_cross'",
    "band_touch": "bb_signal <> ''", "volume_surge": "vol_ratio >= 2", "all": "true"}


@query("e16_every_screen", sql("\n  UNION ALL ".join(
    f"""SELECT '{name}' AS screen, '{group}' AS of, {SCREEN_FIELDS} FROM summary
  WHERE {rule} AND "group" IN ({members})"""
    for name, rule in SCREEN_RULES.items()
    for group, members in (("jp", "'large', 'mid', 'small'"), ("us", "'us'"))), "summary"))
def every_screen(t):
    """All screens of both markets over a stored summary."""
    path = scratch_dir(t.spark, "summary")
    write_table(build_summary(t.bars, t.universe), path)
    stored = read_summary(t.spark, path)
    shown = [screens.screen(stored, name, group=group).select(
        F.lit(name).alias("screen"), F.lit(group).alias("of"), "*")
        for name in SCREEN_RULES for group in ("jp", "us")]
    return reduce(DataFrame.unionByName, shown)


@query("e17_candle_view", sql("""
  SELECT 'bar' AS kind, date, "close", round(sma50, 4) + 0.0 AS sma50,
    round(rsi, 4) + 0.0 AS rsi, NULL::DOUBLE AS forecast, NULL::DOUBLE AS lower,
    NULL::DOUBLE AS upper
  FROM enriched WHERE symbol = '1' AND age < 126
  UNION ALL SELECT 'forecast', last_date, NULL, NULL, NULL, last_close, last_close,
    last_close FROM last_rows WHERE symbol = '1'
  UNION ALL SELECT 'forecast', date, NULL, NULL, NULL, forecast, lower, upper
  FROM path WHERE symbol = '1'""", "enriched", "last_rows", "path"))
def candles(t):
    view = candle_view(add_indicators(t.bars), "1", 126)
    return view.select(
        "kind", "date", "close", r("sma50", 4).alias("sma50"), r("rsi", 4).alias("rsi"),
        "forecast", "lower", "upper")


@query("e18_fill_smooth_resample", sql("""
  SELECT series_id, i, round(value, 4) + 0.0 AS value FROM resampled""", "resampled"))
def clean_series(t):
    return rounded(series.fill_smooth_resample(curve(t), 60), 4, "value")


@query("hourly_indicators", """
  WITH bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS date,
      last(value ORDER BY ts, event_id) AS "close",
      CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)
  SELECT symbol, date, "close", volume, CASE WHEN count(*) OVER w = 20 THEN
      round(avg("close") OVER w, 4) + 0.0 END AS sma20, CASE WHEN count(*) OVER w = 20
    THEN round(stddev_samp("close") OVER w, 5) + 0.0 END AS std20
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)""")
def hourly(t):
    from barweave.operators.indicators import add_bollinger
    out = add_bollinger(bars_from_events(t.table("events")))
    return out.select("symbol", "date", "close", "volume",
                      r("bb_mid", 4).alias("sma20"), r("bb_std", 5).alias("std20"))

"""Time-series operators on the bars."""

from pyspark.sql import functions as F

from barweave.operators import indicators as ind
from barweave.operators import patterns, screens, series
from barweave.operators.forecast import drift_aggregates, weekday_effect
from barweave.operators.panel import last_bars
from barweave.operators.signals import (
    age, band_label, cross_label, latest_state, rsi_label, trend_label,
    volume_ratio,
)
from barweave.functions.dates import next_business_days
from workload.registry import query, r, rounded
from workload.sql import part, sql


@query("w1_sma", sql("""
  SELECT symbol, date, round(sma5, 4) + 0.0 AS sma5, round(sma20, 4) + 0.0 AS sma20,
    round(sma50, 4) + 0.0 AS sma50 FROM roll""", "roll"))
def sma(t):
    out = ind.add_sma(t.bars).select("symbol", "date", "sma5", "sma20", "sma50")
    return rounded(out, 4, "sma5", "sma20", "sma50")


@query("w2_difference", sql("""
  SELECT symbol, date, round("close" - prev_close, 4) + 0.0 AS change FROM num""",
    "num"))
def difference(t):
    return rounded(ind.add_change(t.bars).select("symbol", "date", "change"),
                   4, "change")


@query("w3_gain_loss", sql("""
  SELECT symbol, date,
    CASE WHEN pos > 0 THEN round(greatest("close" - prev_close, 0), 4) + 0.0 END AS gain,
    CASE WHEN pos > 0 THEN round(greatest(prev_close - "close", 0), 4) + 0.0 END AS loss
  FROM num""", "num"))
def gain_loss(t):
    return rounded(ind.add_change(t.bars).select("symbol", "date", "gain", "loss"),
                   4, "gain", "loss")


@query("w4_ewm_adjusted", sql("""
  SELECT symbol, pos, round(avg_gain, 5) + 0.0 AS avg_gain,
    round(avg_loss, 5) + 0.0 AS avg_loss FROM macd""", "macd"))
def ewm_adjusted(t):
    out = ind.add_gain_loss_means(t.bars)
    return out.select("symbol", "pos", r("avg_gain", 5).alias("avg_gain"),
                      r("avg_loss", 5).alias("avg_loss"))


@query("w5_rsi", sql(
    "SELECT symbol, pos, round(rsi, 6) + 0.0 AS rsi FROM macd", "macd"))
def rsi(t):
    return ind.add_rsi(t.bars).select("symbol", "pos", r("rsi", 6).alias("rsi"))


@query("w6_ema", sql(
    "SELECT symbol, pos, round(ema, 5) + 0.0 AS ema FROM ema20", "ema20"))
def ema(t):
    return ind.add_ema(t.bars, 20).select("symbol", "pos", r("ema", 5).alias("ema"))


@query("w7_macd", sql("""
  SELECT symbol, pos, round(macd, 4) + 0.0 AS macd,
    round(macd_signal, 4) + 0.0 AS macd_signal,
    round(macd - macd_signal, 4) + 0.0 AS macd_hist FROM sig""", "sig"))
def macd(t):
    return rounded(ind.add_macd(t.bars).select(
        "symbol", "pos", "macd", "macd_signal", "macd_hist"),
        4, "macd", "macd_signal", "macd_hist")


@query("w8_rolling_std", sql(
    "SELECT symbol, date, round(std20, 5) + 0.0 AS std20 FROM roll", "roll"))
def rolling_std(t):
    return ind.add_bollinger(t.bars).select(
        "symbol", "date", r("bb_std", 5).alias("std20"))


@query("w9_bollinger", sql("""
  SELECT symbol, date, round(sma20, 4) + 0.0 AS bb_mid,
    round(sma20 + 2 * std20, 5) + 0.0 AS bb_upper,
    round(sma20 - 2 * std20, 5) + 0.0 AS bb_lower FROM roll""", "roll"))
def bollinger(t):
    out = ind.add_bollinger(t.bars)
    return out.select(
        "symbol", "date", r("bb_mid", 4).alias("bb_mid"),
        r("bb_upper", 5).alias("bb_upper"), r("bb_lower", 5).alias("bb_lower"))


@query("w10_latest_rows", sql("""
  SELECT l.symbol, l.date, l."close", p.date AS prev_date, p."close" AS prev_close
  FROM num l JOIN num p ON l.symbol = p.symbol AND l.age = 0 AND p.age = 1""", "num"))
def latest_rows(t):
    last_two = last_bars(t.numbered, 2)
    now, before = age() == 0, age() == 1
    return last_two.groupBy("symbol").agg(
        F.max(F.when(now, F.col("date"))).alias("date"),
        F.max(F.when(now, F.col("close"))).alias("close"),
        F.max(F.when(before, F.col("date"))).alias("prev_date"),
        F.max(F.when(before, F.col("close"))).alias("prev_close"))


@query("w11_macd_cross", sql("SELECT symbol, macd_label FROM labels", "labels"))
def macd_cross(t):
    return latest_state(t.numbered).select("symbol", cross_label(
        F.col("macd"), F.col("macd_signal"), F.col("prev_macd"),
        F.col("prev_macd_signal")).alias("macd_label"))


@query("w12_rsi_zone", sql("""
  SELECT symbol, pos, CASE WHEN rsi IS NULL THEN 'na' WHEN rsi >= 70 THEN 'overbought'
    WHEN rsi <= 30 THEN 'oversold' ELSE 'neutral' END AS rsi_label FROM macd""",
    "macd"))
def rsi_zone(t):
    return ind.add_rsi(t.bars).select(
        "symbol", "pos", rsi_label(F.col("rsi")).alias("rsi_label"))


# With two bars of memory every zone occurs; the weights 1/2 per bar cancel.
part("rsi2", """
  SELECT symbol, pos, CASE WHEN pos >= 2 THEN 100 * g / nullif(g + l, 0) END AS rsi
  FROM (SELECT symbol, pos,
      sum(greatest(change, 0) * pow(2.0, pos)) OVER w AS g,
      sum(greatest(-change, 0) * pow(2.0, pos)) OVER w AS l
    FROM (SELECT symbol, row_number() OVER o - 1 AS pos,
        coalesce("close" - lag("close") OVER o, 0) AS change
      FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY date))
    WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING))""",
    "bars")


@query("w12_rsi_zone_short_memory", sql("""
  SELECT symbol, pos, CASE WHEN rsi IS NULL THEN 'na' WHEN rsi >= 70 THEN 'overbought'
    WHEN rsi <= 30 THEN 'oversold' ELSE 'neutral' END AS rsi_label FROM rsi2""",
    "rsi2"))
def rsi_zone_short_memory(t):
    return ind.add_rsi(t.bars, 2).select(
        "symbol", "pos", rsi_label(F.col("rsi")).alias("rsi_label"))


@query("c1_oversold_every_bar", sql("""
  SELECT symbol, pos, round(rsi, 6) + 0.0 AS rsi FROM rsi2 WHERE rsi <= 30""", "rsi2"))
def oversold_every_bar(t):
    return screens.oversold(ind.add_rsi(t.bars, 2)).select(
        "symbol", "pos", r("rsi", 6).alias("rsi"))


@query("w13_sma_trend", sql("""
  SELECT symbol, date, CASE WHEN sma5 > sma20 AND sma20 > sma50 THEN 'up'
    WHEN sma5 < sma20 AND sma20 < sma50 THEN 'down' ELSE 'flat' END AS trend
  FROM roll""", "roll"))
def sma_trend(t):
    return ind.add_sma(t.bars).select("symbol", "date", trend_label(
        F.col("sma5"), F.col("sma20"), F.col("sma50")).alias("trend"))


@query("w14_band_touch", sql("""
  SELECT symbol, date, CASE WHEN "close" >= sma20 + 2 * std20 THEN 'upper_touch'
    WHEN "close" <= sma20 - 2 * std20 THEN 'lower_touch' ELSE '' END AS bb_signal
  FROM roll""", "roll"))
def band_touch(t):
    return ind.add_bollinger(t.bars).select("symbol", "date", band_label(
        F.col("close"), F.col("bb_upper"), F.col("bb_lower")).alias("bb_signal"))


@query("c3_band_touch_every_bar", sql("""
  SELECT * FROM (SELECT symbol, date,
      CASE WHEN "close" >= sma20 + 2 * std20 THEN 'upper_touch'
        WHEN "close" <= sma20 - 2 * std20 THEN 'lower_touch' ELSE '' END AS bb_signal
    FROM roll) WHERE bb_signal <> ''""", "roll"))
def band_touch_every_bar(t):
    return screens.band_touch(band_touch(t))


@query("w15_volume_ratio", sql("""
  SELECT symbol, round(CASE WHEN vol_avg > 0 THEN volume / vol_avg ELSE 0 END, 6) + 0.0
    AS vol_ratio FROM roll WHERE age = 0""", "roll"))
def latest_volume_ratio(t):
    return latest_state(t.numbered).select("symbol", r(
        volume_ratio(F.col("volume"), F.col("vol_avg")), 6).alias("vol_ratio"))


@query("w16_log_return", sql(
    "SELECT symbol, date, round(lr, 8) + 0.0 AS log_return FROM returns", "returns"))
def log_return(t):
    return ind.add_log_return(t.bars).select(
        "symbol", "date", r("log_return", 8).alias("log_return"))


@query("w17_tail_slice", sql(
    'SELECT symbol, date, "close" FROM num WHERE age < 252', "num"))
def tail_slice(t):
    return last_bars(t.numbered, 252).select("symbol", "date", "close")


@query("w18_ema_drift", sql(
    "SELECT symbol, round(drift, 6) + 0.0 AS drift FROM drift", "drift"))
def ema_drift(t):
    return t.numbered.groupBy("symbol").agg(*drift_aggregates()).select(
        "symbol", r("drift", 6).alias("drift"))


@query("w19_running_sum", sql("""
  SELECT symbol, CAST(step AS INTEGER) AS step, round(adj, 8) + 0.0 AS adj FROM shift""",
    "shift"))
def running_sum(t):
    # One row per symbol and step: five rows at most in a group.
    from pyspark.sql import Window
    last = t.bars.groupBy("symbol").agg(F.max("date").alias("last_date"))
    days = last.select("symbol", F.posexplode(
        next_business_days(F.col("last_date"), 5)).alias("at", "day"))
    days = days.withColumn("weekday", F.weekday("day"))
    joined = days.join(weekday_effect(t.bars), ["symbol", "weekday"], "left")
    steps = Window.partitionBy("symbol").orderBy("at")
    return joined.select(
        "symbol", (F.col("at") + 1).alias("step"),
        r(F.sum(F.coalesce("dev", F.lit(0.0))).over(steps), 8).alias("adj"))


@query("w20_sliding_windows", sql("""
  SELECT symbol, end_date, round(win[1], 2) + 0.0 AS first_close,
    round(win[60], 2) + 0.0 AS last_close, len(win) AS n FROM windows""", "windows"))
def sliding_windows(t):
    cuts = patterns.cut_windows(t.bars)
    return cuts.select(
        "symbol", "end_date", r(F.element_at("raw", 1), 2).alias("first_close"),
        r(F.element_at("raw", -1), 2).alias("last_close"),
        F.size("raw").cast("long").alias("n"))


@query("w21_window_zscore", sql("""
  SELECT symbol, end_date, round((win[1] - m) / sd, 6) + 0.0 AS z_first,
    round((win[30] - m) / sd, 6) + 0.0 AS z_middle,
    round((win[60] - m) / sd, 6) + 0.0 AS z_last FROM windows""", "windows"))
def window_zscore(t):
    return patterns.build_library(t.bars).select(
        "symbol", "end_date", r(F.element_at("x", 1), 6).alias("z_first"),
        r(F.element_at("x", 30), 6).alias("z_middle"),
        r(F.element_at("x", 60), 6).alias("z_last"))


@query("w22_forward_returns", sql("""
  SELECT symbol, end_date, i AS step, round(nxt[i] / last - 1, 8) + 0.0 AS ret
  FROM (SELECT *, unnest(range(1, 21)) AS i FROM windows)""", "windows"))
def forward_returns(t):
    rows = patterns.build_library(t.bars).select(
        "symbol", "end_date", F.posexplode("fut").alias("i", "ret"))
    return rows.select("symbol", "end_date", (F.col("i") + 1).cast("long").alias("step"),
                       r("ret", 8).alias("ret"))


@query("w23_window_ordinal", sql(
    "SELECT symbol, end_date, widx FROM windows", "windows"))
def window_ordinal(t):
    return patterns.build_library(t.bars).select(
        "symbol", "end_date", F.col("widx").cast("long").alias("widx"))


# A series per symbol: the closes, unknown where little was traded.
part("curve", """
  SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos,
    count(*) OVER (PARTITION BY symbol) AS length,
    CASE WHEN volume >= 8 THEN "close" END AS value FROM bars""", "bars")
part("filled", """
  SELECT symbol, pos, length, CASE WHEN lp IS NULL THEN rv WHEN rp IS NULL THEN lv
    WHEN lp = rp THEN lv ELSE lv + (rv - lv) * (pos - lp) / (rp - lp) END AS filled
  FROM (SELECT *,
      last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS lp,
      last_value(value IGNORE NULLS) OVER b AS lv,
      first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS rp,
      first_value(value IGNORE NULLS) OVER a AS rv
    FROM curve WINDOW
      b AS (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING),
      a AS (PARTITION BY symbol ORDER BY pos
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", "curve")
part("smoothed", """
  SELECT symbol, pos, length, quantile_cont(filled, 0.5) OVER (PARTITION BY symbol
    ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth
  FROM filled""", "filled")
part("resampled", """
  SELECT a.symbol AS series_id, i, CASE WHEN b.smooth IS NULL THEN a.smooth
    ELSE a.smooth + (b.smooth - a.smooth) * (x - a.pos) END AS value
  FROM (SELECT symbol, length, i, i * (length - 1) / 59.0::DOUBLE AS x
      FROM (SELECT DISTINCT symbol, length FROM smoothed), range(0, 60) t(i)) g
    JOIN smoothed a ON a.symbol = g.symbol AND a.pos = CAST(floor(g.x) AS BIGINT)
    LEFT JOIN smoothed b ON b.symbol = g.symbol
      AND b.pos = CAST(floor(g.x) AS BIGINT) + 1""", "smoothed")


def curve(t):
    return t.numbered.select(
        F.col("symbol").alias("series_id"), "pos",
        F.when(F.col("volume") >= 8, F.col("close")).alias("value"))


@query("w24_rolling_median", sql("""
  SELECT symbol AS series_id, pos, round(smooth, 4) + 0.0 AS smooth
  FROM smoothed""", "smoothed"))
def rolling_median(t):
    smooth = series.rolling_median(series.fill_gaps(curve(t)), "filled")
    return smooth.select("series_id", "pos", r("smooth", 4).alias("smooth"))

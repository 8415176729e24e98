"""Labels of a symbol's latest state.

The state needs only the newest value of each indicator. An exponential mean's
newest value is one weighted sum over the bars, so the whole state is a single
`groupBy(symbol)` with partial aggregation: no enriched panel, no sort beyond
the numbering. `state_of_enriched` reads the same state off a stored enriched
panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.functions.rounding import round_exact
from barweave.operators.indicators import span_alpha

def age() -> Column:
    return F.col("n_bars") - 1 - F.col("pos")


def _power(ratio: float, n: Column) -> Column:
    return F.pow(F.lit(ratio), n)


def ema_weight(span: float, n: Column) -> Column:
    """Weight of a bar of age n in an exponential mean."""
    alpha = span_alpha(span)
    return F.lit(alpha) * _power(1.0 - alpha, n)


def _chained_weight(outer: float, inner: float, n: Column) -> Column:
    """Weight of a bar of age n in an exponential mean of one."""
    a, b = span_alpha(outer), span_alpha(inner)
    ro, ri = 1.0 - a, 1.0 - b
    if ro == ri:
        kernel = (n + 1) * _power(ro, n)
    else:
        kernel = (_power(ro, n + 1) - _power(ri, n + 1)) / F.lit(ro - ri)
    return F.lit(a * b) * kernel


def tail_mean(value: Column, n: int, skip: int = 0) -> Column:
    return F.avg(F.when((age() >= skip) & (age() < n + skip), value))


def weighted_close(weight: Column, delay: int = 0) -> Column:
    """Sum of weighted closes relative to the first close, `delay` bars ago.

    Taking closes relative to the first one makes the seed of every mean zero.
    """
    moved = F.col("close") - F.col("first_close")
    return F.coalesce(F.sum(F.when(age() >= delay, weight * moved)), F.lit(0.0))


def state_aggregates(
    windows=(5, 20, 50), rsi_period=14, fast=12, slow=26, signal=9, bb_window=20
) -> list[Column]:
    """Aggregates over a numbered panel, grouped by symbol."""
    close, change = F.col("close"), F.col("close") - F.col("prev_close")
    decay = _power(1.0 - 1.0 / rsi_period, age())
    out = [
        F.max("n_bars").alias("n"),
        F.max("n_rows").alias("rows"),
        F.max("date").alias("last_date"),
        F.max(F.when(age() == 0, close)).alias("close"),
        F.max(F.when(age() == 0, F.col("volume"))).alias("volume"),
        tail_mean(F.col("volume"), 20, skip=1).alias("vol_avg"),
        F.max(F.when(
            F.col("prev_close").isNull() | (change != 0), F.col("pos"))
        ).alias("last_change"),
        F.stddev_samp(F.when(age() < bb_window, close)).alias("std_raw"),
        tail_mean(close, bb_window).alias("mid_raw"),
        F.sum(decay * F.greatest(change, F.lit(0.0))).alias("gains"),
        F.sum(decay * F.greatest(-change, F.lit(0.0))).alias("losses"),
    ]
    out += [tail_mean(close, w).alias(f"sma{w}_raw") for w in windows]
    for name, delay in (("", 0), ("prev_", 1)):
        n = age() - delay
        out.append(weighted_close(
            ema_weight(fast, n) - ema_weight(slow, n), delay
        ).alias(f"{name}macd"))
        out.append(weighted_close(
            _chained_weight(signal, fast, n) - _chained_weight(signal, slow, n),
            delay).alias(f"{name}macd_signal"))
    return out


def finish_state(
    grouped: DataFrame, windows=(5, 20, 50), rsi_period=14, bb_window=20,
    num_std=2.0,
) -> DataFrame:
    """Turn the aggregates into indicator values with their warm-up rules."""
    run = F.col("n") - F.col("last_change")

    def mean(raw: str, w: int) -> Column:
        return F.when(F.col("n") >= w, F.when(
            run >= w, F.col("close")).otherwise(F.col(raw)))

    mid = mean("mid_raw", bb_window)
    std = F.when(run >= bb_window, F.lit(0.0)).otherwise(F.col("std_raw"))
    both = F.col("gains") + F.col("losses")
    raw = [f"sma{w}_raw" for w in windows]
    return grouped.select(
        "*",
        *[mean(f"sma{w}_raw", w).alias(f"sma{w}") for w in windows],
        F.when((F.col("n") > rsi_period) & (both > 0),
               F.try_divide(F.lit(100.0) * F.col("gains"), both)).alias("rsi"),
        (mid + F.lit(num_std) * std).alias("bb_upper"),
        (mid - F.lit(num_std) * std).alias("bb_lower"),
    ).drop(*raw, "mid_raw", "std_raw", "gains", "losses", "last_change")


def latest_state(numbered: DataFrame, **parameters) -> DataFrame:
    """Newest indicator values per symbol, straight from a numbered panel."""
    grouped = numbered.groupBy("symbol").agg(*state_aggregates(**parameters))
    keep = {k: v for k, v in parameters.items()
            if k in ("windows", "rsi_period", "bb_window")}
    return finish_state(grouped, **keep)


def state_of_enriched(enriched: DataFrame) -> DataFrame:
    """The same state from the newest rows of an enriched panel."""
    newest = age() == 0

    def now(name: str) -> Column:
        return F.max(F.when(newest, F.col(name))).alias(name)

    def before(name: str) -> Column:
        return F.max(F.when(age() == 1, F.col(name))).alias(f"prev_{name}")

    return enriched.where(age() <= 20).groupBy("symbol").agg(
        F.max("n_bars").alias("n"),
        F.max("date").alias("last_date"),
        now("close"), now("volume"), now("rsi"),
        now("macd"), now("macd_signal"),
        before("macd"), before("macd_signal"),
        now("sma5"), now("sma20"), now("sma50"),
        now("bb_upper"), now("bb_lower"),
        tail_mean(F.col("volume"), 20, skip=1).alias("vol_avg"),
    )


def rsi_label(rsi: Column) -> Column:
    return (F.when(rsi.isNull(), "na").when(rsi >= 70, "overbought")
            .when(rsi <= 30, "oversold").otherwise("neutral"))


def cross_label(macd, signal, prev_macd, prev_signal) -> Column:
    return (
        F.when((prev_macd <= prev_signal) & (macd > signal), "golden_cross")
        .when((prev_macd >= prev_signal) & (macd < signal), "dead_cross")
        .when(macd > signal, "uptrend").otherwise("downtrend"))


def trend_label(short, middle, long) -> Column:
    return (F.when((short > middle) & (middle > long), "up")
            .when((short < middle) & (middle < long), "down").otherwise("flat"))


def band_label(close, upper, lower) -> Column:
    return (F.when(close >= upper, "upper_touch")
            .when(close <= lower, "lower_touch").otherwise(""))


def volume_ratio(volume, average) -> Column:
    return F.when(average > 0, F.try_divide(volume, average)).otherwise(0.0)


def signal_columns() -> list[Column]:
    """The labelled and rounded fields of a summary row, from a state."""
    c = F.col
    return [
        round_exact(c("close"), 1).alias("close"),
        round_exact(c("rsi"), 1).alias("rsi"),
        rsi_label(c("rsi")).alias("rsi_label"),
        cross_label(c("macd"), c("macd_signal"), c("prev_macd"),
                    c("prev_macd_signal")).alias("macd_label"),
        trend_label(c("sma5"), c("sma20"), c("sma50")).alias("trend"),
        band_label(c("close"), c("bb_upper"), c("bb_lower")).alias("bb_signal"),
        round_exact(volume_ratio(c("volume"), c("vol_avg")), 2).alias("vol_ratio"),
    ]


def latest_signals(enriched: DataFrame) -> DataFrame:
    """One labelled row per symbol from an enriched panel."""
    return state_of_enriched(enriched).select(
        "symbol", "last_date", *signal_columns())

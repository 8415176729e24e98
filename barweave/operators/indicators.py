"""Rolling and exponentially weighted indicators over the whole panel.

`add_indicators` runs in one layout, the calendar slots of a symbol. What has
unlimited memory (the exponential means of the close, of gains and losses, and of
the MACD) goes on from sums carried across slots; rolling windows see the last
closes before the slot as rows in front of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.operators.panel import (
    SLOT, Decay, Signal, mean_of, number_bars, with_closes,
)


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def _by_pos():
    """The window of a slot with the rows in front of it."""
    return Window.partitionBy("symbol", SLOT).orderBy("pos")


def _same_run() -> Column:
    """Length of the run of equal closes that ends at this bar, as far as the slot
    and the rows in front of it tell.

    A window inside such a run has exactly this close as its mean and no
    deviation; summing rounded doubles would not give that.
    """
    changed = F.when(
        F.col("prev_close").isNull() | (F.col("close") != F.col("prev_close")),
        F.col("pos"))
    so_far = _by_pos().rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.max(changed).over(so_far), F.min("pos").over(so_far))
    return F.col("pos") - start + 1


def _rolling_mean(w: int) -> Column:
    frame = _by_pos().rowsBetween(-(w - 1), 0)
    value = F.when(F.col("same_run") >= w, F.col("close")).otherwise(
        F.avg("close").over(frame))
    return F.when(F.col("pos") >= w - 1, value)


def _rolling_std(w: int) -> Column:
    frame = _by_pos().rowsBetween(-(w - 1), 0)
    value = F.when(F.col("same_run") >= w, F.lit(0.0)).otherwise(
        F.stddev_samp("close").over(frame))
    return F.when(F.col("pos") >= w - 1, value)


def _rolled(numbered: DataFrame, **columns: Column) -> DataFrame:
    """The rolling columns of bars numbered with enough `back`."""
    laid = with_closes(numbered).withColumn("same_run", _same_run())
    return laid.select("*", *[c.alias(name) for name, c in columns.items()]).where(
        "own").drop("own", "same_run", SLOT)


def _rsi(period: int) -> Column:
    both = F.col("ewm_gain") + F.col("ewm_loss")
    return F.when(
        (F.col("pos") >= period) & (both > 0),
        F.try_divide(F.lit(100.0) * F.col("ewm_gain"), both))


def _gain_loss(period: int) -> tuple[Decay, Decay]:
    ratio = 1.0 - 1.0 / period
    return Decay("ewm_gain", "gain", ratio), Decay("ewm_loss", "loss", ratio)


def add_change(bars: DataFrame) -> DataFrame:
    """First difference of the close, split into gain and loss."""
    change = F.col("close") - F.col("prev_close")
    return number_bars(bars).select(
        "*", change.alias("change"),
        F.greatest(change, F.lit(0.0)).alias("gain"),
        F.greatest(-change, F.lit(0.0)).alias("loss"),
    ).withColumn("gain", F.when(F.col("change").isNotNull(), F.col("gain"))
    ).withColumn("loss", F.when(F.col("change").isNotNull(), F.col("loss")))


def add_log_return(bars: DataFrame) -> DataFrame:
    """Natural-log return against the previous bar."""
    return number_bars(bars).withColumn(
        "log_return", F.log("close") - F.log("prev_close"))


def add_sma(bars: DataFrame, windows: tuple[int, ...] = (5, 20, 50)) -> DataFrame:
    return _rolled(number_bars(bars, back=_reach(windows)),
                   **{f"sma{w}": _rolling_mean(w) for w in windows})


def _reach(windows: tuple[int, ...]) -> int:
    """Closes before a slot that its rolling windows reach."""
    return max(1, max(windows) - 1)


def add_bollinger(
    bars: DataFrame, window: int = 20, num_std: float = 2.0
) -> DataFrame:
    return _bands(_rolled(number_bars(bars, back=_reach((window,))),
                          bb_mid=_rolling_mean(window), bb_std=_rolling_std(window)),
                  num_std)


def _bands(df: DataFrame, num_std: float) -> DataFrame:
    return df.select(
        "*",
        (F.col("bb_mid") + F.lit(num_std) * F.col("bb_std")).alias("bb_upper"),
        (F.col("bb_mid") - F.lit(num_std) * F.col("bb_std")).alias("bb_lower"),
    )


def add_rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    return number_bars(bars, _gain_loss(period)).withColumn("rsi", _rsi(period))


def add_gain_loss_means(bars: DataFrame, period: int = 14) -> DataFrame:
    """Adjusted exponential means of gains and losses, after `period` changes."""
    ratio = 1.0 - 1.0 / period
    weights = (1.0 - F.pow(F.lit(ratio), F.col("pos"))) / F.lit(1.0 - ratio)
    warm = F.col("pos") >= period
    return number_bars(bars, _gain_loss(period)).select(
        "*", F.when(warm, F.col("ewm_gain") / weights).alias("avg_gain"),
        F.when(warm, F.col("ewm_loss") / weights).alias("avg_loss"))


def add_ema(bars: DataFrame, span: float = 20) -> DataFrame:
    decay = Decay("ewm_close", "close", 1.0 - span_alpha(span))
    numbered = number_bars(bars, (decay,))
    return numbered.withColumn("ema", mean_of(decay)).drop("ewm_close")


def _macd_decays(fast: float, slow: float) -> tuple[Decay, Decay]:
    return (Decay("ewm_fast", "close", 1.0 - span_alpha(fast)),
            Decay("ewm_slow", "close", 1.0 - span_alpha(slow)))


def _signal(fast: float, slow: float, signal: float) -> Signal | None:
    """The carried signal line; None if one of the memories is a single bar."""
    means, ratio = _macd_decays(fast, slow), 1.0 - span_alpha(signal)
    if ratio == 0 or any(d.ratio == 0 for d in means):
        return None
    return Signal("ewm_signal", *means, ratio)


def _with_signal(df: DataFrame, carried: Signal | None, signal: float,
                 groups: int | None = None) -> DataFrame:
    if carried:
        return df.withColumn("macd_signal", F.lit(1.0 - carried.ratio)
                             * F.col("ewm_signal")).drop("ewm_signal")
    if span_alpha(signal) == 1:
        return df.withColumn("macd_signal", F.col("macd"))
    return _carried_signal(df, signal, groups)


def _carried_signal(df: DataFrame, signal: float, groups: int | None = None) -> DataFrame:
    """The signal line by numbering the MACD like a close, in another pass."""
    decay = Decay("ewm_again", "close", 1.0 - span_alpha(signal))
    rest = [c for c in df.columns if c not in ("symbol", "date")]
    macd = df.select("symbol", "date", F.col("macd").alias("close"),
                     F.struct(*rest).alias("bar"))
    summed = number_bars(macd, (decay,), groups=groups)
    return summed.select("symbol", "date", "bar.*", mean_of(decay).alias("macd_signal"))


def add_macd(
    bars: DataFrame, fast: float = 12, slow: float = 26, signal: float = 9
) -> DataFrame:
    means, carried = _macd_decays(fast, slow), _signal(fast, slow, signal)
    out = number_bars(bars, means, signal=carried).withColumn(
        "macd", mean_of(means[0]) - mean_of(means[1])).drop("ewm_fast", "ewm_slow")
    out = _with_signal(out, carried, signal)
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def add_indicators(
    bars: DataFrame,
    windows: tuple[int, ...] = (5, 20, 50),
    rsi_period: int = 14,
    fast: float = 12, slow: float = 26, signal: float = 9,
    bb_window: int = 20, num_std: float = 2.0,
    groups: int | None = None,
) -> DataFrame:
    """All indicator columns, in one layout. With `groups`, the rows lie by groups of
    symbols and can be stored by them without being moved again."""
    means, carried = _macd_decays(fast, slow), _signal(fast, slow, signal)
    numbered = number_bars(
        bars, means + _gain_loss(rsi_period), signal=carried,
        back=_reach((*windows, bb_window)), groups=groups)
    numbered = numbered.select(
        "*", (mean_of(means[0]) - mean_of(means[1])).alias("macd"),
        _rsi(rsi_period).alias("rsi"),
    ).drop("ewm_fast", "ewm_slow", "ewm_gain", "ewm_loss", "first_close")
    out = _bands(_rolled(
        numbered, **{f"sma{w}": _rolling_mean(w) for w in windows},
        bb_mid=_rolling_mean(bb_window), bb_std=_rolling_std(bb_window)), num_std)
    out = _with_signal(out, carried, signal, groups)
    return out.select(
        "symbol", "date", "open", "high", "low", "close", "volume",
        *[f"sma{w}" for w in windows], "rsi", "macd", "macd_signal",
        (F.col("macd") - F.col("macd_signal")).alias("macd_hist"),
        "bb_mid", "bb_upper", "bb_lower", "pos", "n_bars",
    )

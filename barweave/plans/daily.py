"""The summary kept up to date day by day.

What a symbol's summary needs of its history is small: the last `TAIL_BARS` bars, the
first close, and decayed sums of the bars before the tail. `state_of` takes it from the
whole history once; `advance` adds new bars to it, folding those that leave the tail into
the sums; `summary_of_state` gives what `build_summary` gives for all bars so far. A day's
run reads the day's bars and the state, not the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.operators.arima import TAIL_BARS, log_tail
from barweave.operators.forecast import DRIFT_BARS, DRIFT_SPAN, forecast_aggregates
from barweave.operators.indicators import span_alpha
from barweave.operators.panel import number_bars
from barweave.operators.quality import SUMMARY_MIN_ROWS
from barweave.operators.signals import age, state_aggregates
from barweave.plans.summary import finish_summary
from barweave.sources.places import versions

# The memories behind the default indicators.
FAST, SLOW, SIGNAL, RSI = 12, 26, 9, 14
#: Decayed sums of closes relative to the first one, and of gains and losses.
RATIOS = {"fast": 1.0 - span_alpha(FAST), "slow": 1.0 - span_alpha(SLOW),
          "signal": 1.0 - span_alpha(SIGNAL), "drift": 1.0 - span_alpha(DRIFT_SPAN)}
RSI_RATIO = 1.0 - 1.0 / RSI

_SUMS = [*RATIOS, "gains", "losses"]
_BAR = "struct<date:date,close:double,volume:double>"


def _bar() -> Column:
    return F.struct(F.col("date").cast("date").alias("date"), "close", "volume")


def state_of(bars: DataFrame) -> DataFrame:
    """One row per symbol, from the whole history.

    symbol, n_rows, seen (last date, with or without a close), n_bars, first_close,
    tail (the last bars in order), before (the close before the tail), last_change
    (position of the last bar before the tail whose close differed from the one before
    it), and the sums. Symbols without any close have an empty tail.
    """
    old = age() >= TAIL_BARS
    moved, change = F.col("close") - F.col("first_close"), F.col("close") - F.col("prev_close")
    away = age() - TAIL_BARS

    def decayed(value: Column, ratio: float) -> Column:
        return F.coalesce(F.sum(F.when(old, value * F.pow(F.lit(ratio), away))), F.lit(0.0))

    priced = number_bars(bars).groupBy("symbol").agg(
        F.max("n_bars").alias("n_bars"), F.max("first_close").alias("first_close"),
        F.array_sort(F.collect_list(F.when(age() < TAIL_BARS, F.struct(
            "pos", _bar().alias("bar")))))["bar"].alias("tail"),
        F.max(F.when(age() == TAIL_BARS, F.col("close"))).alias("before"),
        F.max(F.when(old & (F.col("prev_close").isNull() | (change != 0)), F.col("pos")))
        .alias("last_change"),
        *[decayed(moved, ratio).alias(name) for name, ratio in RATIOS.items()],
        decayed(F.greatest(change, F.lit(0.0)), RSI_RATIO).alias("gains"),
        decayed(F.greatest(-change, F.lit(0.0)), RSI_RATIO).alias("losses"))
    rows = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.col("date").cast("date")).alias("seen"))
    return _complete(rows.join(priced, "symbol", "left"))


def _complete(state: DataFrame) -> DataFrame:
    return state.select(
        "symbol", "n_rows", "seen", F.coalesce("n_bars", F.lit(0)).cast("long").alias("n_bars"),
        "first_close", F.coalesce("tail", F.array().cast(f"array<{_BAR}>")).alias("tail"),
        "before", F.col("last_change").cast("long").alias("last_change"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in _SUMS])


def advance(state: DataFrame, bars: DataFrame) -> DataFrame:
    """The state after new bars, some per symbol; symbols may be new.

    Bars that are not later than what a symbol has seen are left out, so a day that is
    run twice counts once. A symbol's new bars meet in one row: for much history take
    `state_of`.
    """
    known = state.select("symbol", F.col("seen").alias("_seen"))
    late = bars.join(known, "symbol", "left").where(
        F.col("_seen").isNull() | (F.col("date").cast("date") > F.col("_seen")))
    fresh = late.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("more_rows"),
        F.max(F.col("date").cast("date")).alias("seen_now"),
        F.array_sort(F.collect_list(F.when(
            F.col("close").isNotNull() & ~F.isnan("close"), _bar()))).alias("fresh"))
    none = F.array().cast(f"array<{_BAR}>")
    both = state.join(fresh, "symbol", "full").withColumns({
        "all": F.concat(F.coalesce("tail", none), F.coalesce("fresh", none)),
        "n_bars": F.coalesce("n_bars", F.lit(0)) + F.size(F.coalesce("fresh", none))})
    both = both.withColumns({
        "first_close": F.coalesce("first_close", F.get("all", F.lit(0))["close"]),
        "leaving": F.greatest(F.size("all") - TAIL_BARS, F.lit(0))})
    start = F.struct(
        "before", "last_change",
        (F.col("n_bars") - F.size("all")).cast("long").alias("pos"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in _SUMS])

    def leave(acc: Column, bar: Column) -> Column:
        change = bar["close"] - acc["before"]
        moved = bar["close"] - F.col("first_close")

        def grown(name: str, ratio: float, value: Column) -> Column:
            return (acc[name] * F.lit(ratio) + F.coalesce(value, F.lit(0.0))).alias(name)

        return F.struct(
            bar["close"].alias("before"),
            F.when(acc["before"].isNull() | (change != 0), acc["pos"])
            .otherwise(acc["last_change"]).alias("last_change"),
            (acc["pos"] + 1).alias("pos"),
            *[grown(name, ratio, moved) for name, ratio in RATIOS.items()],
            grown("gains", RSI_RATIO, F.greatest(change, F.lit(0.0))),
            grown("losses", RSI_RATIO, F.greatest(-change, F.lit(0.0))))

    folded = both.withColumn("after", F.aggregate(
        F.slice("all", 1, F.col("leaving")), start, leave))
    return _complete(folded.select(
        "symbol", (F.coalesce("n_rows", F.lit(0)) + F.coalesce("more_rows", F.lit(0)))
        .alias("n_rows"), F.coalesce("seen_now", "seen").alias("seen"), "n_bars",
        "first_close", F.slice("all", F.col("leaving") + 1, TAIL_BARS).alias("tail"),
        "after.before", "after.last_change", *[f"after.{c}" for c in _SUMS]))


def _chained(outer: str, inner: str, length: Column) -> Column:
    """What the bars before the tail add to an exponential mean of one."""
    ro, ri = RATIOS[outer], RATIOS[inner]
    kernel = (F.pow(F.lit(ro), length + 1) * F.col(outer)
              - F.pow(F.lit(ri), length + 1) * F.col(inner)) / F.lit(ro - ri)
    return F.lit((1.0 - ro) * (1.0 - ri)) * kernel


def _plain(name: str, length: Column) -> Column:
    ratio = RATIOS[name]
    return F.lit(1.0 - ratio) * F.pow(F.lit(ratio), length) * F.col(name)


def summary_of_state(
    state: DataFrame, universe: DataFrame, min_rows: int = SUMMARY_MIN_ROWS,
    with_arima: bool = False,
) -> DataFrame:
    """The summary table: as `build_summary` of all bars that went into the state."""
    carried = [*_SUMS, "tail_bars", "old_change"]
    rows = state.where(F.col("n_rows") >= min_rows).select(
        "symbol", "n_bars", "n_rows", "first_close", "before", "tail", *_SUMS,
        F.size("tail").alias("tail_bars"), F.col("last_change").alias("old_change"),
        F.posexplode("tail").alias("i", "bar"))
    numbered = rows.select(
        "symbol", "n_bars", "n_rows", "first_close", *carried, "bar.*",
        (F.col("n_bars") - F.col("tail_bars") + F.col("i")).alias("pos"),
        F.when(F.col("i") == 0, F.col("before")).otherwise(
            F.get("tail", F.col("i") - 1)["close"]).alias("prev_close"))
    aggs = state_aggregates() + forecast_aggregates()
    if with_arima:
        aggs.append(log_tail())
    # Sums over the tail and, under names of their own, those carried.
    grouped = numbered.withColumnsRenamed({c: f"old_{c}" for c in _SUMS}).groupBy("symbol").agg(
        *aggs, *[F.first(f"old_{c}").alias(c if c in RATIOS else f"old_{c}") for c in _SUMS
                 if c != "drift"],
        F.first("old_drift").alias("old_drift"), F.first("tail_bars").alias("tail_bars"),
        F.first("old_change").alias("old_change"))
    length = F.col("tail_bars")
    rsi = F.pow(F.lit(RSI_RATIO), length)
    mean = F.lit(RATIOS["drift"])
    both = {"": length, "prev_": length - 1}
    grouped = grouped.withColumns({
        **{f"{p}macd": F.col(f"{p}macd") + _plain("fast", n) - _plain("slow", n)
           for p, n in both.items()},
        **{f"{p}macd_signal": F.col(f"{p}macd_signal") + _chained("signal", "fast", n)
           - _chained("signal", "slow", n) for p, n in both.items()},
        "gains": F.col("gains") + rsi * F.col("old_gains"),
        "losses": F.col("losses") + rsi * F.col("old_losses"),
        "drift": F.col("drift") + F.lit((1.0 - RATIOS["drift"]) / DRIFT_BARS)
        * F.col("old_drift") * (F.pow(mean, length) - F.pow(mean, length - DRIFT_BARS)),
        "last_change": F.greatest("last_change", "old_change")})
    return finish_summary(grouped, universe, with_arima)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete state in a folder of states (`run=<n>`)."""
    return spark.read.parquet(f"{path}/run={versions(spark, path, 'run=')[0]}")


def run_day(bars: DataFrame, path: str) -> None:
    """Add bars to the state in a folder, or begin it with them. The states of earlier
    runs stay; a run that failed halfway is run again."""
    spark = bars.sparkSession
    done = versions(spark, path, "run=")
    state = advance(read_state(spark, path), bars) if done else state_of(bars)
    state.write.mode("overwrite").parquet(f"{path}/run={done[0] + 1 if done else 1}")

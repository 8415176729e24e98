"""Ensemble forecast of the next business days.

Every model is a few per-symbol numbers out of one `groupBy(symbol)` over the
numbered panel; the path itself is algebra on those numbers. The lookbacks are
filters on the bar's age, not windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.functions.dates import next_business_days
from barweave.functions.rounding import round_exact, round_scaled
from barweave.operators.arima import fit_path, log_tail
from barweave.operators.panel import number_bars
from barweave.operators.signals import age, ema_weight, weighted_close

HORIZON = 5
LINE_BARS = 60
VOLATILITY_BARS = 120
WEEKDAY_BARS = 250
DRIFT_SPAN = 20
DRIFT_BARS = 10
BAND_WIDTH = 1.96


def _log_return() -> Column:
    return F.log("close") - F.log("prev_close")


def _line_x() -> Column:
    """0 at the oldest bar of the regression window."""
    length = F.least(F.col("n_bars"), F.lit(LINE_BARS))
    return (length - 1 - age()).cast("double")


def line_aggregates() -> list[Column]:
    recent = age() < LINE_BARS
    y, x = F.when(recent, F.col("close")), F.when(recent, _line_x())
    return [F.regr_slope(y, x).alias("line_slope"),
            F.regr_intercept(y, x).alias("line_start"),
            F.least(F.max("n_bars"), F.lit(LINE_BARS)).alias("line_bars")]


def drift_aggregates() -> list[Column]:
    now = weighted_close(ema_weight(DRIFT_SPAN, age()))
    then = weighted_close(ema_weight(DRIFT_SPAN, age() - DRIFT_BARS), DRIFT_BARS)
    enough = F.max("n_bars") > DRIFT_BARS
    return [F.when(enough, (now - then) / F.lit(float(DRIFT_BARS))).alias("drift"),
            F.max(F.when(age() == 0, F.col("close"))).alias("last_close")]


def volatility_aggregate() -> Column:
    return F.stddev_samp(
        F.when(age() < VOLATILITY_BARS, _log_return())).alias("sigma")


def weekday_aggregate() -> Column:
    """Array by weekday (Monday first) of mean return minus overall mean."""
    value = F.when(age() < WEEKDAY_BARS, _log_return())
    day = F.weekday("date")
    return F.array(*[
        F.avg(F.when(day == d, value)) - F.avg(value) for d in range(7)
    ]).alias("weekday_dev")


def forecast_aggregates() -> list[Column]:
    return (line_aggregates() + drift_aggregates()
            + [volatility_aggregate(), weekday_aggregate()])


def line_path(bars: DataFrame, h: int = HORIZON) -> DataFrame:
    """Least-squares line through the last 60 closes, continued h steps."""
    fit = number_bars(bars).groupBy("symbol").agg(*line_aggregates())
    steps = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))
    return steps.select("symbol", "step", _line_at(F.col("step")).alias("value"))


def ema_drift_path(bars: DataFrame, h: int = HORIZON) -> DataFrame:
    """Last close plus the mean slope of the EMA over its last ten bars."""
    fit = number_bars(bars).groupBy("symbol").agg(*drift_aggregates())
    steps = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))
    return steps.select("symbol", "step", _drift_at(F.col("step")).alias("value"))


def _line_at(step: Column) -> Column:
    return (F.col("line_start")
            + F.col("line_slope") * (F.col("line_bars") - 1 + step))


def _drift_at(step: Column) -> Column:
    return F.col("last_close") + F.col("drift") * step


def weekday_effect(bars: DataFrame) -> DataFrame:
    """Mean log return per weekday seen in the lookback, minus the mean."""
    table = number_bars(bars).groupBy("symbol").agg(weekday_aggregate())
    rows = table.select(
        "symbol", F.posexplode("weekday_dev").alias("weekday", "dev"))
    return rows.where(F.col("dev").isNotNull())


def path_column(date: str = "last_date", h: int = HORIZON,
                arima: str | None = None) -> Column:
    """Array of h structs (step, date, forecast, lower, upper).

    Reads the per-symbol statistics. `arima` names an array column with that
    model's path; a NULL array leaves the mean of the two other models.
    """
    future = next_business_days(F.col(date).cast("date"), h)

    def at(step: Column) -> Column:
        two = _line_at(step) + _drift_at(step)
        level = two / F.lit(2.0)
        if arima:
            third = F.get(F.col(arima), step - 1)
            level = F.when(third.isNull(), level).otherwise(
                (two + third) / F.lit(3.0))
        # Running weekday effect up to this step.
        shift = F.aggregate(
            F.slice(future, 1, step), F.lit(0.0),
            lambda acc, d: acc + F.coalesce(
                F.element_at(F.col("weekday_dev"), F.weekday(d) + 1), F.lit(0.0)))
        value = level * F.exp(shift)
        margin = F.lit(BAND_WIDTH) * F.col("sigma") * F.sqrt(step.cast("double"))
        return F.struct(
            step.alias("step"),
            F.element_at(future, step).alias("date"),
            round_scaled(value, 1).alias("forecast"),
            round_scaled(value * F.exp(-margin), 1).alias("lower"),
            round_scaled(value * F.exp(margin), 1).alias("upper"))

    return F.transform(F.sequence(F.lit(1), F.lit(h)), at)


def forecast_stats(bars: DataFrame, h: int = HORIZON,
                   with_arima: bool = False) -> DataFrame:
    """One row per symbol with the statistics and the forecast `path`."""
    aggs = [F.max("date").alias("last_date"), *forecast_aggregates()]
    if not with_arima:
        stats = number_bars(bars).groupBy("symbol").agg(*aggs)
        return stats.withColumn("path", path_column(h=h))
    stats = number_bars(bars).groupBy("symbol").agg(*aggs, log_tail())
    stats = stats.withColumn("arima", fit_path(F.col("log_tail"), F.lit(h)))
    return stats.withColumn("path", path_column(h=h, arima="arima"))


def forecast_next_week(
    bars: DataFrame, h: int = HORIZON, with_arima: bool = False
) -> DataFrame:
    """Rows (symbol, step, date, forecast, lower, upper)."""
    stats = forecast_stats(bars, h, with_arima)
    return stats.select("symbol", F.inline("path"))


def forecast_columns(close: Column, h: int = HORIZON) -> list[Column]:
    """Summary fields from the last forecast step.

    The percent change uses the forecast as rounded, like the display.
    """
    end = F.element_at(F.col("path"), h)
    change = F.try_divide(end["forecast"], close) - F.lit(1.0)
    return [
        end["forecast"].alias("forecast_1w"),
        round_exact(change * F.lit(100.0), 2).alias("forecast_1w_pct"),
        end["lower"].alias("forecast_lower"),
        end["upper"].alias("forecast_upper"),
    ]


def forecast_summary(
    bars: DataFrame, h: int = HORIZON, with_arima: bool = False
) -> DataFrame:
    """Rows (symbol, forecast_1w, forecast_1w_pct, lower and upper)."""
    stats = forecast_stats(bars, h, with_arima)
    return stats.select("symbol", *forecast_columns(F.col("last_close"), h))


def arima_path(bars: DataFrame, h: int = HORIZON) -> DataFrame:
    """ARIMA(1,1,1) rows (symbol, step, value); none where the fit fails."""
    tails = number_bars(bars).groupBy("symbol").agg(log_tail())
    paths = tails.select(
        "symbol", fit_path(F.col("log_tail"), F.lit(h)).alias("arima"))
    return paths.select("symbol", F.posexplode("arima").alias("at", "value")).select(
        "symbol", (F.col("at") + 1).alias("step"), "value")

"""Whole-panel jobs: the summary table, its report, and a chart's data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.operators.arima import fit_path, log_tail
from barweave.operators.forecast import (
    HORIZON, forecast_aggregates, forecast_columns, forecast_next_week,
    path_column,
)
from barweave.operators.panel import last_bars, number_bars
from barweave.operators.quality import SUMMARY_MIN_ROWS
from barweave.operators.signals import (
    finish_state, signal_columns, state_aggregates,
)
from barweave.operators.universe import with_listing
from barweave.schemas import SUMMARY


def build_summary(
    bars: DataFrame, universe: DataFrame, min_rows: int = SUMMARY_MIN_ROWS,
    with_arima: bool = False,
) -> DataFrame:
    """One row per symbol: listing, latest signals and the week's forecast.

    Indicators, signals and forecast share one numbering of the bars and one
    aggregation by symbol.
    """
    aggs = state_aggregates() + forecast_aggregates()
    if with_arima:
        aggs.append(log_tail())
    grouped = number_bars(bars).where(F.col("n_rows") >= min_rows).groupBy(
        "symbol").agg(*aggs)
    return finish_summary(grouped, universe, with_arima)


def finish_summary(
    grouped: DataFrame, universe: DataFrame, with_arima: bool = False
) -> DataFrame:
    """Summary rows from the aggregates of signals and forecast by symbol."""
    arima = None
    if with_arima:
        grouped = grouped.withColumn(
            "arima", fit_path(F.col("log_tail"), F.lit(HORIZON)))
        arima = "arima"
    state = finish_state(grouped).withColumn("path", path_column(arima=arima))
    rows = state.select(
        "symbol", F.col("last_date").cast("date").alias("last_date"),
        *signal_columns(), *forecast_columns(F.col("last_close")))
    return with_listing(rows, universe).select(*SUMMARY.fieldNames())


def signal_report(summary: DataFrame) -> DataFrame:
    """Counts per label of RSI, MACD and trend, in one pass."""
    labels = summary.unpivot(
        [], ["rsi_label", "macd_label", "trend"], "field", "label")
    return labels.groupBy("field", "label").agg(F.count(F.lit(1)).alias("n"))


def candle_view(enriched: DataFrame, symbol: str, n: int = 252) -> DataFrame:
    """A symbol's last n enriched bars, then its forecast anchored at the last.

    The forecast rows carry forecast, lower and upper only; the anchor row
    repeats the last close in all three.
    """
    one = enriched.where(F.col("symbol") == symbol)
    view = last_bars(one, n).withColumn("kind", F.lit("bar"))
    last = one.where(F.col("pos") == F.col("n_bars") - 1)
    anchor = last.select(
        "symbol", "date", F.col("close").alias("forecast"),
        F.col("close").alias("lower"), F.col("close").alias("upper"),
        F.lit("forecast").alias("kind"))
    path = forecast_next_week(one).select(
        "symbol", "date", "forecast", "lower", "upper",
        F.lit("forecast").alias("kind"))
    return view.unionByName(
        anchor.unionByName(path), allowMissingColumns=True
    ).drop("pos", "n_bars")

"""Named screens over the summary table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.operators.universe import in_group, in_sector

# The displayed columns and the thresholds of the screens.
SCREEN_COLUMNS = (
    "symbol", "name", "sector", "close", "rsi", "rsi_label", "macd_label",
    "trend", "bb_signal", "vol_ratio", "forecast_1w_pct",
)
OVERSOLD_RSI = 30
SURGE_RATIO = 2.0


def oversold(summary: DataFrame) -> DataFrame:
    """By the rounded RSI, so 30.04 is shown although its label is neutral."""
    return summary.where(F.col("rsi") <= OVERSOLD_RSI)


def golden_cross(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("macd_label") == "golden_cross")


def band_touch(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("bb_signal") != "").orderBy("bb_signal", "symbol")


def volume_surge(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("vol_ratio") >= SURGE_RATIO).orderBy(
        F.col("vol_ratio").desc(), "symbol")


def by_forecast(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.col("forecast_1w_pct").desc_nulls_last(), "symbol")


SCREENS = {
    "oversold": oversold,
    "golden_cross": golden_cross,
    "band_touch": band_touch,
    "volume_surge": volume_surge,
    "all": by_forecast,
}


def screen(summary: DataFrame, name: str, group: str | None = None,
           sector: str | None = None) -> DataFrame:
    pool = in_sector(in_group(summary, group), sector)
    return SCREENS[name](pool).select(*SCREEN_COLUMNS)

"""Schemas, label codes and the few literal codes the listings use."""

from pyspark.sql import types as T

DOUBLE, STRING, DATE = T.DoubleType(), T.StringType(), T.DateType()

PRICE_COLUMNS = ("open", "high", "low", "close", "volume")

BARS = T.StructType(
    [T.StructField("symbol", STRING), T.StructField("date", DATE)]
    + [T.StructField(c, DOUBLE) for c in PRICE_COLUMNS]
)

# One file per symbol: the symbol is in the file name, not in the rows.
BAR_FILE = T.StructType(
    [T.StructField("Date", DATE)]
    + [T.StructField(c.capitalize(), DOUBLE) for c in PRICE_COLUMNS]
)

UNIVERSE = T.StructType(
    [T.StructField(c, STRING) for c in ("symbol", "name", "group", "sector")]
)

# The columns of the indicator and summary tables.
INDICATOR_COLUMNS = (
    "sma5", "sma20", "sma50", "rsi", "macd", "macd_signal", "macd_hist",
    "bb_mid", "bb_upper", "bb_lower",
)

SUMMARY = T.StructType(
    [T.StructField(c, STRING) for c in ("symbol", "name", "group", "sector")]
    + [T.StructField("last_date", DATE), T.StructField("close", DOUBLE),
       T.StructField("rsi", DOUBLE)]
    + [T.StructField(c, STRING)
       for c in ("rsi_label", "macd_label", "trend", "bb_signal")]
    + [T.StructField(c, DOUBLE)
       for c in ("vol_ratio", "forecast_1w", "forecast_1w_pct",
                 "forecast_lower", "forecast_upper")]
)

# Size class -> group, and the groups in their listing order.
SIZE_TO_GROUP = {
    "TOPIX Core30": "large",
    "TOPIX Large70": "large",
    "TOPIX Mid400": "mid",
    "TOPIX Small 1": "small",
}
DOMESTIC_MARKET = "内国株式"
GROUP_RANK = {"large": 0, "mid": 1, "small": 2, "us": 3}
HOME_GROUPS = ("large", "mid", "small")

# Chart periods and pattern spans, in bars.
VIEW_BARS = {"3m": 63, "6m": 126, "1y": 252, "3y": 756, "5y": 10000}
SPAN_BARS = {"3m": 60, "6m": 120, "1y": 240}

"""Readers of stored bars, listings and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.operators.universe import keep_last
from barweave.schemas import BAR_FILE, PRICE_COLUMNS, UNIVERSE


def read_bar_files(spark: SparkSession, path: str,
                   lines: DataFrame | None = None) -> DataFrame:
    """CSV files, one per symbol: `<symbol>.csv`, or any file in a folder
    `symbol=<symbol>`. The symbol may hold any character. A file whose header
    names the columns in another order is an error. Damaged lines are left out,
    see `damaged_lines`. `lines` are those of `bar_lines`, if it has been called."""
    lines = bar_lines(spark, path) if lines is None else lines
    return lines.where("not damaged").drop("damaged")


def damaged_lines(spark: SparkSession, path: str,
                  lines: DataFrame | None = None) -> DataFrame:
    """Rows (symbol, n_rows): lines of bar files that are no bars, because a field is
    no number or date, there are too few or too many fields, or the date is missing."""
    lines = bar_lines(spark, path) if lines is None else lines
    return lines.where("damaged").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"))


def bar_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines as bars; `damaged` tells those that are none. The files are listed here,
    once for all that is made from the result.

    Fields are read as text, so what counts as damaged does not depend on the columns
    that a query selects.
    """
    lines = T.StructType([T.StructField(f.name, T.StringType()) for f in BAR_FILE]).add(
        "unread", "string")
    raw = spark.read.schema(lines).option("header", True).option("enforceSchema", False).option(
        "columnNameOfCorruptRecord", "unread").option("columnPruning", False).option(
        "recursiveFileLookup", True).csv(path)
    # The path is a URI; a partition folder is escaped once more by its writer.
    place = _percent_decoded(F.col("_metadata.file_path"))
    folder = F.regexp_extract(place, "/symbol=([^/]+)/", 1)
    stem = F.regexp_extract(place, r"([^/]*)\.csv$", 1)
    symbol = F.when(folder != "", _percent_decoded(folder)).otherwise(stem)
    date = F.col("Date").try_cast("date")
    values = {c: F.col(c.capitalize()).try_cast("double") for c in PRICE_COLUMNS}
    damaged = F.col("unread").isNotNull() | date.isNull()
    for c, value in values.items():
        damaged = damaged | (value.isNull() & F.col(c.capitalize()).isNotNull())
    return raw.select(
        symbol.alias("symbol"), date.alias("date"),
        *[F.nanvl(value, F.lit(None).cast("double")).alias(c)
          for c, value in values.items()], damaged.alias("damaged"))


def _percent_decoded(text: Column) -> Column:
    """Percent escapes decoded once; unlike in forms, a plus sign is itself."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def read_closes(bars: DataFrame) -> DataFrame:
    """Only what the pattern library needs; the scan prunes the rest."""
    return bars.select("symbol", "date", "close")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Listing CSV (a byte-order mark is fine); a symbol's last row counts.

    Raises Spark's own path error if the file is missing.
    """
    rows = spark.read.schema(UNIVERSE).option("header", True).csv(path)
    order = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id())
    return keep_last(rows.select("*", order.alias("at")), F.col("at"))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A stored summary; an empty band signal may have come back as NULL."""
    return refill_band_signal(spark.read.parquet(path))


def refill_band_signal(summary: DataFrame) -> DataFrame:
    if "bb_signal" not in summary.columns:
        return summary
    return summary.fillna("", ["bb_signal"])


def long_from_wide(wide: DataFrame, symbols: list[str],
                   fields: tuple[str, ...] = PRICE_COLUMNS) -> DataFrame:
    """Split a download of many symbols, columns `<symbol>|<field>` by date.

    Symbols without columns give no rows, nor do dates without a close;
    `quality.rejects` with the requested symbols names the missing ones.
    """
    present = [s for s in symbols
               if all(f"{s}|{f}" in wide.columns for f in fields)]
    entry = "array<struct<symbol:string," + ",".join(f"{f}:double" for f in fields) + ">>"
    # Typed, so that it is an array of bars also if none of the symbols arrived.
    entries = F.array(*[
        F.struct(F.lit(s).alias("symbol"), *[
            F.col(f"`{s}|{f}`").cast("double").alias(f) for f in fields])
        for s in present]).cast(entry)
    rows = wide.select("date", F.explode(entries).alias("bar"))
    return rows.select("bar.symbol", "date", *[
        F.col(f"bar.{f}") for f in fields]).where(F.col("close").isNotNull())


def read_exchange_list(listing: DataFrame) -> DataFrame:
    """A landed exchange list under its own headings, in our column names."""
    return listing.select(
        F.col("市場・商品区分").alias("market"), F.col("規模区分").alias("size"),
        F.col("コード").alias("code"), F.col("銘柄名").alias("name"),
        F.col("33業種区分").alias("sector"))


def read_index_list(listing: DataFrame) -> DataFrame:
    """A landed table of index constituents, in our column names."""
    return listing.select(
        F.col("Symbol").alias("symbol"), F.col("Security").alias("security"),
        F.col("GICS Sector").alias("sector"))

"""Gates on incoming bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.functions.rounding import round_scaled
from barweave.operators.panel import priced
from barweave.schemas import PRICE_COLUMNS

INGEST_MIN_ROWS = 100
SUMMARY_MIN_ROWS = 80


def project_bars(bars: DataFrame) -> DataFrame:
    """The bar columns, in their order."""
    return bars.select("symbol", "date", *PRICE_COLUMNS)


def round_prices(bars: DataFrame, digits: int = 2) -> DataFrame:
    return bars.select("symbol", "date", *[
        round_scaled(F.col(c), digits).alias(c) for c in PRICE_COLUMNS])


def symbol_counts(bars: DataFrame) -> DataFrame:
    """Rows and priced rows per symbol, by partial aggregation."""
    has_close = F.col("close").isNotNull() & ~F.isnan("close")
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(has_close).alias("n_priced"))


def min_history(
    bars: DataFrame, min_rows: int = SUMMARY_MIN_ROWS, count: str = "n_rows"
) -> DataFrame:
    """Bars of the symbols with at least `min_rows` rows."""
    kept = symbol_counts(bars).where(F.col(count) >= min_rows).select("symbol")
    return bars.join(kept, "symbol", "left_semi")


def rejects(bars: DataFrame, min_rows: int = INGEST_MIN_ROWS,
            requested: DataFrame | None = None,
            damaged: DataFrame | None = None) -> DataFrame:
    """Rows (symbol, reason, n_rows) of the symbols that did not pass.

    `requested` lists the symbols asked for; those that never arrived are
    rejects as well. `damaged` (symbol, n_rows) counts unreadable lines; a symbol
    that has any is named with that reason too, whether or not the rest passed.
    """
    counts = symbol_counts(bars)
    found = counts.where(F.col("n_priced") < min_rows).select(
        "symbol", F.lit("short_history").alias("reason"),
        F.col("n_priced").alias("n_rows"))
    if damaged is not None:
        found = found.unionByName(damaged.select(
            "symbol", F.lit("damaged_lines").alias("reason"), "n_rows"))
    if requested is None:
        return found
    arrived = counts.select("symbol")
    if damaged is not None:
        arrived = arrived.unionByName(damaged.select("symbol"))
    missing = requested.select("symbol").distinct().join(
        arrived, "symbol", "left_anti")
    return found.unionByName(missing.select(
        "symbol", F.lit("missing").alias("reason"),
        F.lit(0).cast("long").alias("n_rows")))


def quality_gate(
    bars: DataFrame, min_rows: int = INGEST_MIN_ROWS,
    requested: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Accepted bars, rounded to two decimals, and the rejects."""
    kept = min_history(priced(bars), min_rows, "n_priced")
    return round_prices(kept), rejects(bars, min_rows, requested)


def outcome_counts(rejected: DataFrame, requested: DataFrame) -> DataFrame:
    """One row: how many requested symbols were accepted, failed, in total. Lines that
    could not be read do not make a symbol fail."""
    failed = rejected.where("reason <> 'damaged_lines'").select(
        "symbol", F.lit(True).alias("failed")).distinct()
    joined = requested.select("symbol").distinct().join(failed, "symbol", "left")
    return joined.agg(
        F.count_if(F.col("failed").isNull()).alias("ok"),
        F.count_if(F.col("failed").isNotNull()).alias("failed"),
        F.count(F.lit(1)).alias("total"))

"""Bars, universe and listings derived from order, event and part tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.schemas import DOMESTIC_MARKET, GROUP_RANK, SIZE_TO_GROUP


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bars_from_trades(
    trades: DataFrame, symbol: Column, date: Column, price: Column,
    order: Column, volume: Column,
) -> DataFrame:
    """Aggregate trades to one bar per (symbol, date).

    `order` must be total within a bar. The aggregation is partial on the map
    side, so a symbol with very many trades sends one row per date and task.
    """
    keyed = trades.select(
        symbol.alias("symbol"), date.alias("date"), price.alias("price"),
        order.alias("ord"), volume.alias("size"))
    bars = keyed.groupBy("symbol", "date").agg(
        F.min_by("price", "ord").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "ord").alias("close"),
        F.sum("size").alias("volume"))
    return compute_once(bars)


def compute_once(bars: DataFrame) -> DataFrame:
    """Keep later column pruning out of a computed panel.

    Numbering reads a panel twice, with different columns. Pruned differently,
    the two readings would be two aggregations of all trades; left alike, they
    share one exchange (ReusedExchange in the plan). A stored panel does not
    want this: there the second reading is a scan of two columns. Filters on
    the symbol and the date still reach the scan.
    """
    row = F.struct(*[c for c in bars.columns if c not in ("symbol", "date")])
    return bars.select("symbol", "date", F.inline(F.array(row)))


def _packed(major: Column, minor: Column, minor_bits: int) -> Column:
    """Two whole numbers as one sortable decimal.

    A decimal fits the hash aggregation's buffer; a struct would force sorts.
    """
    whole = "decimal(18,0)"
    return (major.cast(whole) * F.lit(1 << minor_bits).cast(whole)
            + minor.cast(whole))


def bars_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Daily bars: a supplier is a symbol, an order line is a trade."""
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    cents = (F.col("l_extendedprice") * 100 + F.lit(0.5)).cast("long")
    return bars_from_trades(
        lineitem, F.col("l_suppkey").cast("string"),
        F.col("l_shipdate").cast("date"), F.col("l_extendedprice"),
        _packed(line, cents, 34), F.col("l_quantity"))


def bars_from_events(events: DataFrame) -> DataFrame:
    """Hourly bars: an event type is a symbol, volume counts the events."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return bars_from_trades(
        events, F.col("event_type"), hour, F.col("value"),
        _packed(micros, F.col("event_id"), 43), F.lit(1.0))


def universe_from_supplier(
    supplier: DataFrame, nation: DataFrame, region: DataFrame
) -> DataFrame:
    """Listing rows: supplier name, a group by region, its nation as sector."""
    placed = supplier.join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    ).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    groups = F.array(*[F.lit(g) for g in GROUP_RANK])
    group = F.element_at(
        groups, F.least(F.col("r_regionkey"), F.lit(len(GROUP_RANK) - 1)) + 1)
    return placed.select(
        F.col("s_suppkey").cast("string").alias("symbol"),
        F.col("s_name").alias("name"), group.alias("group"),
        F.col("n_name").alias("sector"))


def _choice(value: Column, names: list[str]) -> Column:
    """The name at position value mod len(names)."""
    index = F.pmod(value.cast("int"), F.lit(len(names))) + 1
    return F.element_at(F.array(*[F.lit(n) for n in names]), index)


def exchange_listing_from_part(part: DataFrame) -> DataFrame:
    """An exchange list out of parts: the size gives class and market."""
    classes = [*SIZE_TO_GROUP, "TOPIX Small 2", "-"]
    markets = [f"Prime ({DOMESTIC_MARKET})", f"Standard ({DOMESTIC_MARKET})", "ETF"]
    return part.select(
        _choice(F.col("p_size"), markets).alias("market"),
        _choice(F.floor(F.col("p_size") / 3), classes).alias("size"),
        F.col("p_partkey").alias("code"),
        F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")).alias("name"),
        F.col("p_type").alias("sector"))


def index_listing_from_part(part: DataFrame) -> DataFrame:
    """Index constituents out of parts; half of them also in the other list."""
    key = F.col("p_partkey")
    return part.select(
        F.when(key % 2 == 0, F.concat(key.cast("string"), F.lit(".B")))
        .otherwise(F.concat(F.lit(" "), key.cast("string"), F.lit("-T")))
        .alias("symbol"),
        F.col("p_name").alias("security"), F.col("p_brand").alias("sector"))

"""The symbol universe: building, loading, looking up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.schemas import (
    DOMESTIC_MARKET, GROUP_RANK, HOME_GROUPS, SIZE_TO_GROUP,
)

FIELDS = ("name", "group", "sector")


def _text(name: str) -> Column:
    return F.trim(F.col(name).cast("string"))


def size_group(size: Column) -> Column:
    """Size class to group; NULL for other classes."""
    entries = [F.lit(x) for pair in SIZE_TO_GROUP.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), size)


def exchange_members(listing: DataFrame, suffix: str = ".T") -> DataFrame:
    """Universe rows of the exchange list (market, size, code, name, sector)."""
    kept = listing.where(
        F.col("market").cast("string").contains(DOMESTIC_MARKET)
        & F.col("size").isin(*SIZE_TO_GROUP))
    return kept.select(
        F.concat(_text("code"), F.lit(suffix)).alias("symbol"),
        _text("name").alias("name"),
        size_group(F.col("size")).alias("group"),
        _text("sector").alias("sector"))


def index_members(listing: DataFrame) -> DataFrame:
    """Universe rows of the index constituents (symbol, security, sector)."""
    return listing.select(
        F.replace(_text("symbol"), F.lit("."), F.lit("-")).alias("symbol"),
        _text("security").alias("name"),
        F.lit("us").alias("group"),
        _text("sector").alias("sector"))


def first_of_group(universe: DataFrame, group: str, n: int) -> DataFrame:
    """The first n symbols of one group; other groups, and rows without one, stay
    whole."""
    own = F.col("group").eqNullSafe(F.lit(group))
    rest = universe.where(~own)
    head = universe.where(own).orderBy(
        "symbol", "name", "sector").limit(n)
    return rest.unionByName(head)


def group_rank(group: Column) -> Column:
    entries = [F.lit(x) for pair in GROUP_RANK.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), group)


def keep_first(universe: DataFrame, order: Column) -> DataFrame:
    """One row per symbol: the first in `order`."""
    fields = F.struct(*FIELDS)
    first = universe.groupBy("symbol").agg(F.min_by(fields, order).alias("f"))
    return first.select("symbol", "f.*")


def keep_last(universe: DataFrame, order: Column) -> DataFrame:
    """One row per symbol: the last in `order`."""
    fields = F.struct(*FIELDS)
    last = universe.groupBy("symbol").agg(F.max_by(fields, order).alias("f"))
    return last.select("symbol", "f.*")


def build_universe(
    listing_a: DataFrame, listing_b: DataFrame, n_small: int = 100
) -> DataFrame:
    """Exchange list first, index second; a repeated symbol keeps its first row."""
    home = first_of_group(exchange_members(listing_a), "small", n_small)
    both = home.unionByName(index_members(listing_b))
    return keep_first(both, F.struct(group_rank(F.col("group")), "name", "sector"))


def group_counts(universe: DataFrame) -> DataFrame:
    """Symbols per group, and the total in the row `all`."""
    counted = universe.rollup("group").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.coalesce("group", F.lit("all")).alias("group"), "n")


def sectors(universe: DataFrame) -> DataFrame:
    return universe.select("sector").distinct().orderBy("sector")


def in_group(df: DataFrame, group: str | None) -> DataFrame:
    """Filter by group; `jp` stands for the three home groups, None for all."""
    if group is None:
        return df
    if group == "jp":
        return df.where(F.col("group").isin(*HOME_GROUPS))
    return df.where(F.col("group") == group)


def in_sector(df: DataFrame, sector: str | None) -> DataFrame:
    return df if sector is None else df.where(F.col("sector") == sector)


def with_listing(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Look up name, group and sector; unknown symbols get (symbol, ?, ?).

    One row per symbol on the right. Spark broadcasts it if its size is below
    the session's threshold and shuffles both sides otherwise.
    """
    joined = df.join(universe.select("symbol", *FIELDS), "symbol", "left")
    others = [c for c in df.columns if c != "symbol"]
    return joined.select(
        "symbol",
        F.coalesce("name", "symbol").alias("name"),
        F.coalesce("group", F.lit("?")).alias("group"),
        F.coalesce("sector", F.lit("?")).alias("sector"),
        *others)


def split_listed(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Add `listed`: whether the universe has the bar's symbol, in one pass."""
    known = universe.select("symbol", F.lit(True).alias("listed")).distinct()
    return bars.join(known, "symbol", "left").withColumn(
        "listed", F.coalesce("listed", F.lit(False)))


def purge_orphans(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Bars of listed symbols only."""
    return bars.join(universe.select("symbol"), "symbol", "left_semi")


def orphans(bars: DataFrame, universe: DataFrame) -> DataFrame:
    return bars.join(universe.select("symbol"), "symbol", "left_anti")

"""The query registry and the derived inputs the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.operators.panel import number_bars
from barweave.sources.adapters import (
    bars_from_lineitem, read_table, universe_from_supplier,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL whose result it must equal."""

    def wrap(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


def r(value: Column | str, digits: int) -> Column:
    """Rounded for comparison, without a negative zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.select(*[
        r(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


class Tables:
    """Inputs derived from the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @property
    def bars(self) -> DataFrame:
        return bars_from_lineitem(self.table("lineitem"))

    @property
    def last_date(self):
        """The date of the newest bar, from the trades."""
        return self.table("lineitem").agg(
            F.max(F.col("l_shipdate").cast("date"))).first()[0]

    @property
    def numbered(self) -> DataFrame:
        return number_bars(self.bars)

    @property
    def gappy(self) -> DataFrame:
        """Bars whose close is missing where little was traded."""
        return self.bars.withColumn(
            "close", F.when(F.col("volume") >= 8, F.col("close")))

    @property
    def universe(self) -> DataFrame:
        return universe_from_supplier(
            self.table("supplier"), self.table("nation"), self.table("region"))

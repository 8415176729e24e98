"""A stored pattern library that grows with the bars.

Windows are added in generations (`windows/gen=<n>` folders). With each goes a table of
marks (`marks/gen=<n>`), one row per symbol: the date of the first bar of the next window
to cut, and how many windows the symbol has. Marks are written last, so a generation
counts only once it is complete; one that failed halfway is written again. Growing reads
the bars from the marks on, not the history that has been cut already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.operators.panel import number_bars, priced
from barweave.operators.patterns import HORIZON, STEP, build_library
from barweave.sources.places import discard, versions


def generation(spark: SparkSession, path: str) -> int:
    """Number of the last complete generation, 0 without any."""
    return max(versions(spark, f"{path}/marks", "gen="), default=0)


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Rows (symbol, widx, start_date, end_date, x, fut) of all complete generations."""
    return spark.read.parquet(*[
        f"{path}/windows/gen={g}" for g in range(1, generation(spark, path) + 1)])


def grow_library(bars: DataFrame, path: str, window: int = 60, step: int = STEP,
                 horizon: int = HORIZON) -> None:
    """Add the windows that the bars allow beyond those in the library.

    A library that does not exist is built. The bars before a symbol's mark are taken
    to be what they were; later ones, and new symbols, may be added in any number. The
    three sizes must be those that the library was built with; `step` is at most
    window + horizon.
    """
    if step > window + horizon:
        raise ValueError("step is greater than window + horizon")
    spark = bars.sparkSession
    last = generation(spark, path)
    closes = priced(bars.select("symbol", "date", "close"))
    tail = closes
    if last:
        marks = spark.read.parquet(f"{path}/marks/gen={last}")
        sizes = marks.select("window", "step", "horizon").first()
        if sizes is not None and tuple(sizes) != (window, step, horizon):
            raise ValueError(f"the library's sizes are {tuple(sizes)}")
        # A literal date reaches the scan; only symbols without a mark read all of theirs.
        since = marks.agg(F.min("from_date")).first()[0]
        known = closes.where(F.col("date") >= F.lit(since)).join(
            marks.select("symbol", "from_date"), "symbol").where("date >= from_date")
        tail = known.drop("from_date").unionByName(
            closes.join(marks.select("symbol"), "symbol", "left_anti"))
    else:
        marks = tail.select(
            "symbol", F.col("date").alias("from_date"), F.lit(0).cast("long").alias("kept"),
            F.lit(window).alias("window"), F.lit(step).alias("step"),
            F.lit(horizon).alias("horizon")).limit(0)
    # Read three times below; the bars may be made from trades.
    kept_tail, target = f"{path}/tail/gen={last + 1}", f"{path}/windows/gen={last + 1}"
    tail.write.mode("overwrite").parquet(kept_tail)
    tail = spark.read.schema(tail.schema).parquet(kept_tail)
    # A tail begins with the first bar of the next window, so its windows are the next.
    windows = build_library(tail, window, step, horizon)
    if last:
        windows = windows.join(marks.select("symbol", "kept"), "symbol", "left").withColumn(
            "widx", F.col("widx") + F.coalesce("kept", F.lit(0))).drop("kept")
    windows = windows.withColumn("widx", F.col("widx").cast("long"))
    windows.write.mode("overwrite").parquet(target)
    added = spark.read.schema(windows.schema).parquet(target).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("added"))
    ends = F.greatest(F.lit(0), F.expr(
        f"(n_bars - {horizon + 1 + window} + {step}) div {step}"))
    moved = number_bars(tail).where(F.col("pos") == ends * step).select(
        "symbol", F.col("date").alias("new_date"))
    moved.join(marks, "symbol", "full").join(added, "symbol", "left").select(
        "symbol", F.coalesce("new_date", "from_date").alias("from_date"),
        (F.coalesce("kept", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("kept"),
        F.lit(window).alias("window"), F.lit(step).alias("step"),
        F.lit(horizon).alias("horizon")).write.mode("overwrite").parquet(
        f"{path}/marks/gen={last + 1}")
    discard(spark, kept_tail)

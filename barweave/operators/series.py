"""Cleaning of numbered series: gap fill, smoothing, resampling.

Input rows are (series_id, pos, value) with positions 0, 1, 2, ... and NULL
where the value is unknown. Like price panels, long series are split: gaps are
closed from a table with one row per CHUNK positions, and frames of a few rows
run in segments with context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.operators.panel import SEGMENT_ROWS, owned, with_context

CHUNK = 4096


def _known() -> Column:
    return F.when(F.col("value").isNotNull(), F.struct("pos", "value"))


def fill_gaps(series: DataFrame) -> DataFrame:
    """Linear fill between known values, flat beyond the first and last.

    Adds `length` and `filled`; a series without any value stays NULL.
    """
    cut = series.withColumn("chunk", F.expr(f"pos div {CHUNK}"))
    known_pos = F.when(F.col("value").isNotNull(), F.col("pos"))
    chunks = cut.groupBy("series_id", "chunk").agg(
        F.max("pos").alias("top"),
        F.min_by(F.struct("pos", "value"), known_pos).alias("first_in"),
        F.max_by(F.struct("pos", "value"), known_pos).alias("last_in"))
    # Looking ahead is looking back in descending order: a frame that reaches
    # to the end would be scanned again for every row.
    chain = Window.partitionBy("series_id")
    before = (Window.unboundedPreceding, -1)
    heads = chunks.select(
        "series_id", "chunk",
        (F.max("top").over(chain) + 1).alias("length"),
        F.last("last_in", ignorenulls=True).over(
            chain.orderBy("chunk").rowsBetween(*before)).alias("left_in"),
        F.last("first_in", ignorenulls=True).over(
            chain.orderBy(F.desc("chunk")).rowsBetween(*before)).alias("right_in"))
    inside = Window.partitionBy("series_id", "chunk")
    so_far = (Window.unboundedPreceding, 0)
    joined = cut.select(
        "*",
        F.last(_known(), ignorenulls=True).over(
            inside.orderBy(F.desc("pos")).rowsBetween(*so_far)).alias("right_near"),
        F.last(_known(), ignorenulls=True).over(
            inside.orderBy("pos").rowsBetween(*so_far)).alias("left_near"),
    ).join(heads.hint("merge"), ["series_id", "chunk"])
    left, right = F.col("l"), F.col("r")
    share = (F.col("pos") - left["pos"]) / (right["pos"] - left["pos"])
    filled = (
        F.when(left.isNull(), right["value"])
        .when(right.isNull() | (left["pos"] == right["pos"]), left["value"])
        .otherwise(left["value"] + (right["value"] - left["value"]) * share))
    return joined.select(
        "series_id", "pos", "value", "length",
        F.coalesce("left_near", "left_in").alias("l"),
        F.coalesce("right_near", "right_in").alias("r"),
    ).select("series_id", "pos", "value", "length", filled.alias("filled"))


def rolling_median(series: DataFrame, value: str, width: int = 5) -> DataFrame:
    """Centred median over `width` positions, shorter at the ends.

    Needs `length`; adds `smooth`.
    """
    half = width // 2
    size = max(SEGMENT_ROWS, half)
    laid = with_context(
        series.withColumn("n_bars", F.col("length")), half, half, size)
    frame = Window.partitionBy("series_id", "seg").orderBy("pos").rowsBetween(
        -half, half)
    near = F.array_sort(F.collect_list(value).over(frame))
    laid = laid.withColumn("near", near)
    count = F.size("near")
    low = F.get("near", F.floor((count - 1) / 2).cast("int"))
    high = F.get("near", F.floor(count / 2).cast("int"))
    laid = laid.withColumn("smooth", low + (high - low) * F.lit(0.5))
    return owned(laid, size).drop("n_bars", "near")


def resample_series(series: DataFrame, value: str, n: int) -> DataFrame:
    """Linear interpolation at n evenly spaced positions of each series.

    Every position produces the output points that lie between itself and the
    next one, so nothing is joined or gathered. Rows (series_id, i, value).
    """
    laid = with_context(series.withColumn("n_bars", F.col("length")), 0, 1)
    inside = Window.partitionBy("series_id", "seg").orderBy("pos")
    rows = owned(laid.select(
        "series_id", "pos", "length", "seg", F.col(value).alias("v"),
        F.lead(value).over(inside).alias("after")))
    if n == 1:
        first, last = F.lit(0), F.when(F.col("pos") == 0, 0).otherwise(-1)
    else:
        steps = n - 1
        first = F.expr(f"(pos * {steps} + length - 2) div greatest(length - 1, 1)")
        last = F.expr(
            f"((pos + 1) * {steps} + length - 2) div greatest(length - 1, 1) - 1")
        last = F.when(F.col("pos") == F.col("length") - 1, F.lit(steps)).otherwise(last)
        first = F.when(F.col("length") == 1, F.lit(0)).otherwise(first)
    points = rows.withColumn("first", first.cast("long")).withColumn(
        "last", last.cast("long")).where(F.col("first") <= F.col("last"))
    points = points.select(
        "*", F.explode(F.sequence("first", "last")).alias("i"))
    share = (F.col("i") * (F.col("length") - 1) / F.lit(float(max(n - 1, 1)))
             - F.col("pos"))
    between = F.col("v") + (F.col("after") - F.col("v")) * share
    return points.select(
        "series_id", "i",
        F.when(F.col("after").isNull() | (share == 0), F.col("v"))
        .otherwise(between).alias("value"))


def fill_smooth_resample(series: DataFrame, n: int = 60) -> DataFrame:
    """Close gaps, remove spikes, and bring each series to n points."""
    filled = fill_gaps(series)
    return resample_series(rolling_median(filled, "filled"), "smooth", n)

"""Stored bar tables and exports.

Bars are stored in hash buckets of the symbol, sorted by (symbol, date) inside the
files. A folder per symbol would mean one tiny file per symbol; a bucket folder still
prunes a lookup to one bucket, and the row-group statistics prune inside it. Spark
splits the rows of a bucket over as many tasks as their size asks for, and files end at
`FILE_ROWS` rows.

Every write goes to a folder of its own (`gen=<id>/bucket=<n>`). The table `_layout` says
which folder holds each bucket now, the number of buckets and the columns. Its newest
complete version counts, so a refresh writes the touched buckets once and then switches
to them. Folders that a write replaced are removed by the next one.

`write_bar_table` stores a panel as a catalog table instead, bucketed the way bars are
numbered.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.functions.rounding import round_columns
from barweave.operators.panel import SLOT, group_of, reported_bytes, slot_index
from barweave.operators.universe import purge_orphans
from barweave.sources.places import discard, folders, versions

BUCKET_BYTES = 128 << 20
FILE_ROWS = 20_000_000
COMPRESSION = "zstd"
# Tasks move their own files when they end. Else the driver moves one by one, which takes
# most of the time where each symbol has a file.
MOVED_BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}

_LAYOUT = "n_buckets int, columns string, bucket int, folder string"


def bucket_of(symbol: Column, n_buckets: int) -> Column:
    return group_of(symbol, n_buckets)


def input_bytes(df: DataFrame) -> int:
    """Size of what the rows are made from, as the inputs report it."""
    size = reported_bytes(df)
    return df.count() * 8 * len(df.columns) if size is None else size


def buckets_for(df: DataFrame) -> int:
    """Buckets of about BUCKET_BYTES of input, one per task slot at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism,
               -(-input_bytes(df) // BUCKET_BYTES))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a table's layout, the newest first."""
    return versions(spark, f"{path}/_layout", "v=")


def _layout(spark: SparkSession, path: str, version: int | None = None) -> list:
    """Rows of the newest layout: one per stored bucket, one without a bucket."""
    if version is None:
        known = _versions(spark, path)
        if not known:
            raise FileNotFoundError(f"no stored bars in {path}")
        version = known[0]
    return spark.read.schema(_LAYOUT).parquet(f"{path}/_layout/v={version}").collect()


def _write_buckets(bars: DataFrame, path: str, n_buckets: int,
                   grouped: bool = False) -> dict[int, str]:
    """Folders, by bucket, of bars written to a place of their own."""
    laid = bars.withColumn("bucket", bucket_of(F.col("symbol"), n_buckets))
    return _write_laid(laid if grouped else laid.hint("rebalance", "bucket"), path)


def _write_laid(laid: DataFrame, path: str) -> dict[int, str]:
    """Folders, by bucket, of bars that lie by bucket."""
    spark, place = laid.sparkSession, f"gen={uuid.uuid4().hex}"
    laid.sortWithinPartitions("bucket", "symbol", "date").write.options(
        maxRecordsPerFile=FILE_ROWS, compression=COMPRESSION).partitionBy("bucket").parquet(
        f"{path}/{place}")
    return {int(name.removeprefix("bucket=")): f"{place}/{name}"
            for name in folders(spark, f"{path}/{place}") if name.startswith("bucket=")}


def _switch(spark: SparkSession, path: str, known: list[int], n_buckets: int,
            schema: T.StructType, places: dict[int, str]) -> None:
    """Make these folders the table, after the versions `known` when the writing began.
    If another writer has switched since, this one fails and changes nothing."""
    version = known[0] + 1 if known else 1
    columns = schema.json()
    rows = [(n_buckets, columns, None, None)] + [
        (n_buckets, columns, b, f) for b, f in sorted(places.items())]
    spark.createDataFrame(rows, _LAYOUT).coalesce(1).write.parquet(
        f"{path}/_layout/v={version}")
    used = {r.folder for v in [version, *known[:1]] for r in _layout(spark, path, v)}
    for old in known[1:]:
        replaced = {r.folder for r in _layout(spark, path, old)} - used
        for folder in filter(None, replaced):
            discard(spark, f"{path}/{folder}")
            place = folder.split("/")[0]
            if not any(n.startswith("bucket=") for n in folders(spark, f"{path}/{place}")):
                discard(spark, f"{path}/{place}")
        discard(spark, f"{path}/_layout/v={old}")


def write_bars(bars: DataFrame, path: str, n_buckets: int | None = None,
               grouped: bool = False) -> None:
    """Store a bar panel, raw or enriched, in place of what the path held.

    Without `n_buckets`, their number follows the size of the input. Bars that lie by as
    many groups of symbols already (`grouped`) are written where they lie: each task writes
    a file for each bucket it has.
    """
    spark = bars.sparkSession
    known = _versions(spark, path)
    n_buckets = n_buckets or buckets_for(bars)
    places = _write_buckets(bars, path, n_buckets, grouped)
    _switch(spark, path, known, n_buckets, bars.schema, places)


def layout(spark: SparkSession, path: str) -> int:
    """Number of buckets of a stored panel."""
    return _layout(spark, path)[0].n_buckets


def write_enriched(enriched: DataFrame, path: str, **layout) -> None:
    """Store an enriched panel, every number rounded to three decimals."""
    write_bars(round_columns(enriched, 3), path, **layout)


def _read(spark: SparkSession, path: str, rows: list) -> DataFrame:
    """The bars of some rows of a layout, with their bucket. No bars are an empty table."""
    schema = T.StructType.fromJson(json.loads(rows[0].columns)).add("bucket", "integer")
    places = [f"{path}/{r.folder}" for r in rows if r.folder]
    if not places:
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField("gen", T.StringType())])
    return spark.read.schema(whole).option("basePath", path).parquet(*places).drop("gen")


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _layout(spark, path)).drop("bucket")


def read_symbol(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """One symbol's stored history: one bucket, then by statistics."""
    rows = _layout(spark, path)
    return _read(spark, path, rows).where(
        (F.col("bucket") == bucket_of(F.lit(symbol), rows[0].n_buckets))
        & (F.col("symbol") == symbol)).drop("bucket")


def refresh_symbols(spark: SparkSession, fresh: DataFrame, path: str) -> None:
    """Replace the stored bars of just the symbols present in `fresh`.

    Only their buckets are read and written, once each; the other symbols of those
    buckets are carried over. The table switches to the new buckets when they are
    complete. Without any rows nothing happens. Of two refreshes at the same time one
    fails.
    """
    known = _versions(spark, path)
    rows = _layout(spark, path)
    n_buckets = rows[0].n_buckets
    names = fresh.select("symbol").distinct()
    touched = {r.bucket for r in names.select(
        bucket_of(F.col("symbol"), n_buckets).alias("bucket")).distinct().collect()}
    if not touched:
        return
    held = _read(spark, path, [r for r in rows if r.bucket is None or r.bucket in touched])
    columns = [c for c in held.columns if c != "bucket"]
    kept = held.join(names, "symbol", "left_anti").select(*columns)
    places = _write_buckets(kept.unionByName(fresh.select(*columns)), path, n_buckets)
    others = {r.bucket: r.folder for r in rows
              if r.bucket is not None and r.bucket not in touched}
    _switch(spark, path, known, n_buckets, kept.schema, {**others, **places})


def write_purged(spark: SparkSession, path: str, listed: DataFrame, target: str) -> None:
    """Store the bars of listed symbols only, out of a stored panel, in `target`.

    The buckets stay, so bars are written where they are read. The names are stored
    first; Spark then knows how small they are.
    """
    names = f"{target}/_names"
    listed.select("symbol").distinct().write.mode("overwrite").parquet(names)
    known, rows = _versions(spark, target), _layout(spark, path)
    kept = purge_orphans(_read(spark, path, rows), spark.read.schema(
        "symbol string").parquet(names))
    places = _write_laid(kept, target)
    _switch(spark, target, known, rows[0].n_buckets, kept.drop("bucket").schema, places)
    discard(spark, names)


def write_bar_table(bars: DataFrame, table: str, n_buckets: int | None = None) -> None:
    """Store a panel as a catalog table in buckets of (symbol, calendar slot), sorted.

    `spark.table(table)` has the column SLOT, by which numbering, gates and indicators
    find the bars laid out: they read them without an exchange.
    """
    n_buckets = n_buckets or buckets_for(bars)
    laid = bars.drop(SLOT).withColumn(SLOT, slot_index(bars))
    laid.repartition(n_buckets, "symbol", SLOT).sortWithinPartitions(
        "symbol", SLOT, "date").write.bucketBy(n_buckets, "symbol", SLOT).sortBy(
        "symbol", SLOT, "date").mode("overwrite").saveAsTable(table)


def write_table(df: DataFrame, path: str) -> None:
    """Store a summary, a universe or the rejects."""
    df.write.mode("overwrite").parquet(path)


def write_rejects(rejects: DataFrame, path: str, full_run: bool) -> None:
    """Store the rejects of a run over all symbols; a run over some of them leaves the
    list of the last full run as it is."""
    if full_run:
        write_table(rejects, path)


def export_csv(df: DataFrame, path: str) -> None:
    """UTF-8 CSV with a header (Spark writes no byte-order mark)."""
    df.write.mode("overwrite").option("header", True).option(
        "encoding", "UTF-8").csv(path)


def export_bar_files(bars: DataFrame, path: str) -> None:
    """CSV folders `symbol=<symbol>` for tools that want a symbol's file."""
    named = bars.select(
        "symbol", F.col("date").alias("Date"),
        *[F.col(c).alias(c.capitalize())
          for c in ("open", "high", "low", "close", "volume")])
    # Rows of a symbol meet in one file, unless they are very many.
    named.hint("rebalance", "symbol").sortWithinPartitions(
        "symbol", "Date").write.mode("overwrite").options(**MOVED_BY_TASKS).option(
        "header", True).partitionBy("symbol").csv(path)

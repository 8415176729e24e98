"""Sources and sinks: stored by Spark from the given tables, then read back."""

from pyspark.sql import functions as F

from barweave.operators.indicators import add_indicators
from barweave.operators.panel import number_bars
from barweave.operators.quality import rejects
from barweave.operators.universe import (
    build_universe, exchange_members, in_group, index_members, purge_orphans,
)
from barweave.plans.summary import build_summary
from barweave.session import scratch_dir
from barweave.sources import files, sinks
from barweave.sources.adapters import (
    bars_from_events, exchange_listing_from_part, index_listing_from_part,
)
from workload.registry import query, rounded
from workload.sql import sql

BAR_FIELDS = 'symbol, date, "open", high, low, "close", volume'
# Three decimals, without sma20 and bb_mid: the mean of twenty prices in cents
# ends in a tie of the third decimal, which sums in another order decide otherwise.
STORED = """symbol, date, "open", high, low, "close", volume, round(sma5, 3) + 0.0 AS sma5,
  round(sma50, 3) + 0.0 AS sma50, round(rsi, 3) + 0.0 AS rsi,
  round(macd, 3) + 0.0 AS macd, round(macd_signal, 3) + 0.0 AS macd_signal,
  round(macd_hist, 3) + 0.0 AS macd_hist, round(bb_upper, 3) + 0.0 AS bb_upper,
  round(bb_lower, 3) + 0.0 AS bb_lower"""
STORED_COLUMNS = ("symbol", "date", "open", "high", "low", "close", "volume", "sma5", "sma50", "rsi", "macd",
                  "macd_signal", "macd_hist", "bb_upper", "bb_lower")


def store_enriched(bars, path):
    """Bars are moved to their buckets before the indicators, which are stored there."""
    n = sinks.buckets_for(bars)
    sinks.write_enriched(add_indicators(bars, groups=n), path, n_buckets=n, grouped=True)


@query("s1_scan_bar_files", sql(f"SELECT {BAR_FIELDS} FROM bars", "bars"))
def scan_bar_files(t):
    path = scratch_dir(t.spark, "bar-files")
    sinks.export_bar_files(t.bars, path)
    return files.read_bar_files(t.spark, path)


@query("s2_scan_enriched", sql(
    f"SELECT {STORED} FROM enriched WHERE symbol = '1'", "enriched"))
def scan_enriched(t):
    path = scratch_dir(t.spark, "enriched")
    store_enriched(t.bars, path)
    return rounded(sinks.read_symbol(t.spark, path, "1").select(*STORED_COLUMNS),
                   3, *STORED_COLUMNS[7:])


@query("s3_scan_closes", sql('SELECT symbol, date, "close" FROM bars', "bars"))
def scan_closes(t):
    path = scratch_dir(t.spark, "bars")
    sinks.write_bars(t.bars, path)
    return files.read_closes(sinks.read_bars(t.spark, path))


@query("s4_scan_summary", sql("SELECT * FROM summary", "summary"))
def scan_summary(t):
    path = scratch_dir(t.spark, "summary")
    emptied = build_summary(t.bars, t.universe).withColumn(
        "bb_signal", F.nullif("bb_signal", F.lit("")))
    sinks.write_table(emptied, path)
    return files.read_summary(t.spark, path)


@query("s5_scan_universe", sql("""
  SELECT symbol, CASE WHEN length(symbol) = 2 THEN name || ' II' ELSE name END AS name,
    "group", sector FROM universe""", "universe"))
def scan_universe(t):
    path = scratch_dir(t.spark, "universe")
    again = t.universe.where(F.length("symbol") == 2).withColumn(
        "name", F.concat("name", F.lit(" II")))
    rows = t.universe.withColumn("version", F.lit(1)).unionByName(
        again.withColumn("version", F.lit(2)))
    sinks.export_csv(rows.orderBy("version", "symbol").drop("version"), path)
    return files.read_universe(t.spark, path)


@query("s7_exchange_listing", sql(
    'SELECT symbol, name, "group", sector FROM exchange', "exchange"))
def exchange_listing(t):
    listing = exchange_listing_from_part(t.table("part"))
    landed = listing.select(
        F.col("market").alias("市場・商品区分"), F.col("size").alias("規模区分"),
        F.col("code").alias("コード"), F.col("name").alias("銘柄名"),
        F.col("sector").alias("33業種区分"))
    return exchange_members(files.read_exchange_list(landed))


@query("s8_index_listing", sql("SELECT * FROM constituents", "constituents"))
def index_listing(t):
    listing = index_listing_from_part(t.table("part"))
    landed = listing.select(
        F.col("symbol").alias("Symbol"), F.col("security").alias("Security"),
        F.col("sector").alias("GICS Sector"))
    return index_members(files.read_index_list(landed))


@query("s9_long_from_wide", """
  SELECT event_type AS symbol, date_trunc('hour', ts) AS date,
    first(value ORDER BY ts, event_id) AS "open", max(value) AS high,
    min(value) AS low, last(value ORDER BY ts, event_id) AS "close",
    CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2""")
def long_from_wide(t):
    fields = ["open", "high", "low", "close", "volume"]
    wide = bars_from_events(t.table("events")).groupBy("date").pivot("symbol").agg(
        *[F.first(f).alias(f) for f in fields])
    symbols = [c.removesuffix("_open") for c in wide.columns if c.endswith("_open")]
    wide = wide.select("date", *[
        F.col(f"{s}_{f}").alias(f"{s}|{f}") for s in symbols for f in fields])
    return files.long_from_wide(wide, symbols + ["absent"])


@query("k1_sink_bars", sql(f"SELECT {BAR_FIELDS} FROM bars", "bars"))
def sink_bars(t):
    path = scratch_dir(t.spark, "bars")
    sinks.write_bars(t.bars, path)
    return sinks.read_bars(t.spark, path)


@query("k2_sink_enriched", sql(f"SELECT {STORED} FROM enriched", "enriched"))
def sink_enriched(t):
    path = scratch_dir(t.spark, "enriched")
    store_enriched(t.bars, path)
    return rounded(sinks.read_bars(t.spark, path).select(*STORED_COLUMNS),
                   3, *STORED_COLUMNS[7:])


@query("k3_sink_summary", sql("SELECT * FROM summary", "summary"))
def sink_summary(t):
    path = scratch_dir(t.spark, "summary")
    sinks.write_table(build_summary(t.bars, t.universe), path)
    return files.read_summary(t.spark, path)


@query("k4_sink_universe", sql("SELECT * FROM built", "built"))
def sink_universe(t):
    path = scratch_dir(t.spark, "universe")
    part = t.table("part")
    sinks.export_csv(build_universe(
        exchange_listing_from_part(part), index_listing_from_part(part)), path)
    return files.read_universe(t.spark, path)


REJECTED = """
  SELECT symbol, 'short_history' AS reason, n AS n_rows FROM (
    SELECT symbol, count("close") AS n FROM gappy GROUP BY symbol) WHERE n < 500
  UNION ALL
  SELECT CAST(p_partkey AS VARCHAR), 'missing', 0 FROM part
  WHERE CAST(p_partkey AS VARCHAR) NOT IN (SELECT symbol FROM gappy)"""


@query("k5_sink_rejects", sql(REJECTED, "gappy"))
def sink_rejects(t):
    path = scratch_dir(t.spark, "rejects")
    requested = t.table("part").select(
        F.col("p_partkey").cast("string").alias("symbol"))
    sinks.write_rejects(rejects(t.gappy, 500, requested), path, full_run=True)
    sinks.write_rejects(rejects(t.gappy, 500), path, full_run=False)
    return t.spark.read.parquet(path)


DAMAGE = """
  SELECT symbol, date, "open", high, low, "close", volume,
    day(date) = 13 AS torn, day(date) = 14 AS wordy FROM bars"""


@query("s1_damaged_lines", sql(f"""
  SELECT symbol, 'damaged_lines' AS reason, count(*) AS n_rows
  FROM ({DAMAGE}) WHERE torn OR wordy GROUP BY symbol
  UNION ALL
  SELECT symbol, 'short_history', count(*) FROM ({DAMAGE}) WHERE NOT (torn OR wordy)
  GROUP BY symbol HAVING count(*) < 500""", "bars"))
def damaged_lines(t):
    """Bar files in which the lines of some days are cut off or hold words."""
    path = scratch_dir(t.spark, "bar-files")
    bars = t.bars.withColumn("day", F.day("date"))
    cells = [F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")]
    line = F.concat_ws(",", F.col("date").cast("string"), *cells)
    torn = F.concat_ws(",", F.col("date").cast("string"), cells[0])
    wordy = F.concat_ws(",", F.col("date").cast("string"), F.lit("n/a"), *cells[1:])
    bars.groupBy("symbol").agg(F.concat(
        F.lit("Date,Open,High,Low,Close,Volume\n"), F.array_join(F.array_sort(
            F.collect_list(F.when(F.col("day") == 13, torn).when(
                F.col("day") == 14, wordy).otherwise(line))), "\n")).alias("value")
    ).write.options(**sinks.MOVED_BY_TASKS).partitionBy("symbol").text(path)
    lines = files.bar_lines(t.spark, path)
    return rejects(files.read_bar_files(t.spark, path, lines), 500,
                   damaged=files.damaged_lines(t.spark, path, lines))


@query("k1_bucketed_bars", sql("""
  SELECT symbol, date, "open", high, low, "close", volume, pos, n AS n_bars, prev_close
  FROM num""", "num"))
def bucketed_bars(t):
    """A catalog table in buckets, numbered where its rows are."""
    name = scratch_dir(t.spark, "bars").rsplit("/", 1)[1].replace("-", "_")
    sinks.write_bar_table(t.bars, name)
    return number_bars(t.spark.table(name)).select(
        "symbol", "date", "open", "high", "low", "close", "volume", "pos", "n_bars",
        "prev_close")


@query("k6_refresh_symbols", sql("""
  SELECT b.symbol, b.date, b."open", b.high, b.low,
    CASE WHEN u."group" = 'us' THEN b."close" + 1 ELSE b."close" END AS "close",
    b.volume
  FROM bars b LEFT JOIN universe u USING (symbol)""", "bars", "universe"))
def refresh_symbols(t):
    path = scratch_dir(t.spark, "bars")
    sinks.write_bars(t.bars, path)
    fresh = purge_orphans(t.bars, in_group(t.universe, "us"))
    sinks.refresh_symbols(
        t.spark, fresh.withColumn("close", F.col("close") + 1), path)
    return sinks.read_bars(t.spark, path)


@query("k7_purge_orphans", sql(f"""
  SELECT {STORED} FROM enriched
  WHERE symbol IN (SELECT symbol FROM universe WHERE "group" <> 'us')""",
    "enriched", "universe"))
def purge_stored(t):
    old, new = scratch_dir(t.spark, "enriched"), scratch_dir(t.spark, "purged")
    store_enriched(t.bars, old)
    listed = in_group(t.universe, "jp")
    sinks.write_purged(t.spark, old, listed, new)
    return rounded(sinks.read_bars(t.spark, new).select(*STORED_COLUMNS),
                   3, *STORED_COLUMNS[7:])

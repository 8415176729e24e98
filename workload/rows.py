"""Projections, filters, screens, joins, sorts and set operations."""

from pyspark.sql import functions as F

from barweave.functions.dates import next_business_days
from barweave.functions.rounding import round_columns
from barweave.functions.text import (
    currency, option_label, option_symbol, percent_of,
)
from barweave.operators import patterns, quality, screens
from barweave.operators.forecast import weekday_effect
from barweave.operators.universe import (
    exchange_members, first_of_group, in_group, in_sector, index_members,
    size_group, split_listed, with_listing,
)
from barweave.plans.summary import build_summary
from barweave.schemas import DOMESTIC_MARKET, SIZE_TO_GROUP
from barweave.session import scratch_dir
from barweave.sources import sinks
from barweave.sources.adapters import (
    exchange_listing_from_part, index_listing_from_part,
)
from workload.registry import query, r
from workload.sql import sql

BAR_FIELDS = 'symbol, date, "open", high, low, "close", volume'
SCREEN_FIELDS = """symbol, name, sector, "close", rsi, rsi_label, macd_label,
  trend, bb_signal, vol_ratio, forecast_1w_pct"""


def summary(t):
    return build_summary(t.bars, t.universe)


@query("p1_project_bars", sql(f"SELECT {BAR_FIELDS} FROM bars", "bars"))
def project_bars(t):
    return quality.project_bars(t.bars)


@query("p2_round_prices", sql("""
  SELECT symbol, date, round_even("open" / 3 * 100, 0) / 100 AS "open",
    round_even(high / 3 * 100, 0) / 100 AS high,
    round_even(low / 3 * 100, 0) / 100 AS low,
    round_even("close" / 3 * 100, 0) / 100 AS "close", volume FROM bars""", "bars"))
def round_prices(t):
    thirds = t.bars.select("symbol", "date", *[
        (F.col(c) / 3).alias(c) for c in ("open", "high", "low", "close")], "volume")
    return quality.round_prices(thirds)


@query("p3_round_columns", sql("""
  SELECT symbol, date, round_even("close" / 7 * 1000, 0) / 1000 AS seventh,
    round_even(ln("close") * 1000, 0) / 1000 AS log_close FROM bars""", "bars"))
def round_all(t):
    return round_columns(t.bars.select(
        "symbol", "date", (F.col("close") / 7).alias("seventh"),
        F.log("close").alias("log_close")), 3)


@query("p4_drop_null_close", sql(
    f'SELECT {BAR_FIELDS} FROM gappy WHERE "close" IS NOT NULL', "gappy"))
def drop_null_close(t):
    return quality.priced(t.gappy)


@query("p5_ingest_gate", sql("""
  SELECT symbol, date, "close" FROM (SELECT *, count(*) OVER (PARTITION BY symbol)
    AS n FROM gappy WHERE "close" IS NOT NULL) WHERE n >= 500""", "gappy"))
def ingest_gate(t):
    return quality.min_history(quality.priced(t.gappy), 500, "n_priced").select(
        "symbol", "date", "close")


@query("p6_summary_gate", sql("""
  SELECT symbol, date, "close" FROM (SELECT *, count(*) OVER (PARTITION BY symbol)
    AS n FROM gappy) WHERE n >= 530""", "gappy"))
def summary_gate(t):
    return quality.min_history(t.gappy, 530).select("symbol", "date", "close")


@query("p7_group_filter", sql("""
  SELECT symbol, name, "group", sector FROM universe
  WHERE "group" IN ('large', 'mid', 'small')""", "universe"))
def group_filter(t):
    return in_group(t.universe, "jp")


@query("p8_sector_filter", sql(
    """SELECT symbol, name, "group", sector FROM universe
    WHERE sector = 'NATION_3' AND "group" = 'us'""", "universe"))
def sector_filter(t):
    return in_sector(in_group(t.universe, "us"), "NATION_3")


@query("p9_point_lookup", sql("SELECT * FROM summary WHERE symbol = '1'", "summary"))
def point_lookup(t):
    return summary(t).where(F.col("symbol") == "1")


@query("p10_listing_predicate", sql("""
  SELECT code, size FROM listing_a WHERE contains(market, '内国株式') AND size IN
  ('TOPIX Core30', 'TOPIX Large70', 'TOPIX Mid400', 'TOPIX Small 1')""",
    "listing_a"))
def listing_predicate(t):
    listing = exchange_listing_from_part(t.table("part"))
    return listing.where(
        F.col("market").contains(DOMESTIC_MARKET)
        & F.col("size").isin(*SIZE_TO_GROUP)).select("code", "size")


@query("p11_size_to_group", sql("""
  SELECT code, CASE size WHEN 'TOPIX Core30' THEN 'large'
    WHEN 'TOPIX Large70' THEN 'large' WHEN 'TOPIX Mid400' THEN 'mid'
    WHEN 'TOPIX Small 1' THEN 'small' END AS "group" FROM listing_a""", "listing_a"))
def size_to_group(t):
    listing = exchange_listing_from_part(t.table("part"))
    return listing.select("code", size_group(F.col("size")).alias("group"))


@query("p12_option_label", sql("""
  SELECT symbol || '  ' || name AS label, symbol AS parsed FROM universe""",
    "universe"))
def label_options(t):
    labels = t.universe.select(
        option_label(F.col("symbol"), F.col("name")).alias("label"))
    return labels.select("label", option_symbol(F.col("label")).alias("parsed"))


@query("p13_display_columns", sql(f"SELECT {SCREEN_FIELDS} FROM summary", "summary"))
def display_columns(t):
    return summary(t).select(*screens.SCREEN_COLUMNS)


@query("p14_currency", sql("""
  SELECT s, date, CASE WHEN s LIKE '%.T' THEN '¥' || format('{:,.0f}', "close")
    ELSE '$' || format('{:,.2f}', "close") END AS price
  FROM (SELECT *, CASE WHEN "open" > "close" THEN symbol || '.T' ELSE symbol END AS s
    FROM bars)""", "bars"))
def price_text(t):
    named = t.bars.withColumn("s", F.when(
        F.col("open") > F.col("close"), F.concat("symbol", F.lit(".T"))
    ).otherwise(F.col("symbol")))
    return named.select(
        "s", "date", currency(F.col("s"), F.col("close")).alias("price"))


@query("p15_percent", sql("""
  SELECT symbol, date, round(("close" / "open" - 1) * 100, 6) + 0.0 AS pct FROM bars""",
    "bars"))
def percent(t):
    return t.bars.select("symbol", "date", r(
        percent_of(F.col("close") / F.col("open")), 6).alias("pct"))


@query("c1_oversold", sql(
    f"SELECT {SCREEN_FIELDS} FROM summary WHERE rsi <= 30", "summary"))
def screen_oversold(t):
    return screens.screen(summary(t), "oversold")


@query("c2_golden_cross", sql(
    f"SELECT {SCREEN_FIELDS} FROM summary WHERE macd_label = 'golden_cross'",
    "summary"))
def screen_golden_cross(t):
    return screens.screen(summary(t), "golden_cross")


@query("c3_band_touch", sql(
    f"SELECT {SCREEN_FIELDS} FROM summary WHERE bb_signal <> ''", "summary"))
def screen_band_touch(t):
    return screens.screen(summary(t), "band_touch")


@query("c4_volume_surge", sql(
    f"SELECT {SCREEN_FIELDS} FROM summary WHERE vol_ratio >= 2", "summary"))
def screen_volume_surge(t):
    return screens.screen(summary(t), "volume_surge")


@query("c5_by_forecast", sql(
    f"SELECT {SCREEN_FIELDS} FROM summary ORDER BY forecast_1w_pct DESC", "summary"))
def screen_all(t):
    return screens.screen(summary(t), "all")


@query("j1_listing_lookup", sql("""
  SELECT b.symbol, coalesce(u.name, b.symbol) AS name,
    coalesce(u."group", '?') AS "group", coalesce(u.sector, '?') AS sector,
    b.date, b."close"
  FROM bars b LEFT JOIN (SELECT * FROM universe WHERE "group" = 'us') u
    USING (symbol)""", "bars", "universe"))
def listing_lookup(t):
    return with_listing(t.bars.select("symbol", "date", "close"),
                        in_group(t.universe, "us"))


@query("j2_orphan_split", sql("""
  SELECT symbol, date, u.symbol IS NOT NULL AS listed FROM bars
  LEFT JOIN (SELECT symbol FROM universe WHERE "group" = 'us') u USING (symbol)""",
    "bars", "universe"))
def orphan_split(t):
    return split_listed(t.bars.select("symbol", "date"), in_group(t.universe, "us"))


@query("j3_score_windows", sql("""
  SELECT query_id, symbol, widx, end_date, round(sim, 6) + 0.0 AS sim FROM scored""",
    "scored"))
def score_windows(t):
    scored = patterns.score(
        patterns.build_library(t.bars), patterns.query_shape(t.bars, ["1", "2"]))
    return scored.select("query_id", "symbol", F.col("widx").cast("long").alias("widx"),
                         "end_date", r("sim", 6).alias("sim"))


@query("j4_future_weekdays", sql("""
  SELECT s.symbol, CAST(s.step AS INTEGER) AS step, s.day,
    round(coalesce(e.dev, 0), 8) + 0.0 AS dev
  FROM steps s LEFT JOIN effect e
    ON s.symbol = e.symbol AND e.weekday = isodow(s.day) - 1 WHERE s.step <= 5""",
    "steps", "effect"))
def future_weekdays(t):
    last = t.bars.groupBy("symbol").agg(F.max("date").alias("last_date"))
    days = last.select("symbol", F.posexplode(
        next_business_days(F.col("last_date"), 5)).alias("at", "day"))
    days = days.select("symbol", (F.col("at") + 1).alias("step"), "day",
                       F.weekday("day").alias("weekday"))
    return days.join(weekday_effect(t.bars), ["symbol", "weekday"], "left").select(
        "symbol", "step", "day", r(F.coalesce("dev", F.lit(0.0)), 8).alias("dev"))


@query("j5_missing_symbols", sql("""
  SELECT CAST(p_partkey AS VARCHAR) AS symbol FROM part
  WHERE CAST(p_partkey AS VARCHAR) NOT IN (SELECT symbol FROM bars)""", "bars"))
def missing_symbols(t):
    requested = t.table("part").select(
        F.col("p_partkey").cast("string").alias("symbol"))
    return requested.join(t.bars, "symbol", "left_anti")


@query("t1_sort_listing", sql(
    'SELECT symbol, name, "group", sector FROM exchange ORDER BY symbol', "exchange"))
def sort_listing(t):
    return exchange_members(
        exchange_listing_from_part(t.table("part"))).orderBy("symbol", "name")


@query("t2_head_of_group", sql("""
  SELECT symbol, name, "group", sector FROM (SELECT *, row_number() OVER (
    PARTITION BY "group" ORDER BY symbol, name, sector) AS i FROM exchange)
  WHERE "group" <> 'small' OR i <= 100""", "exchange"))
def head_of_group(t):
    listing = exchange_members(exchange_listing_from_part(t.table("part")))
    return first_of_group(listing, "small", 100)


@query("t3_rank_matches", sql("""
  SELECT query_id, place, symbol, widx, round(sim, 6) + 0.0 AS sim FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY sim DESC, symbol, widx DESC) AS place FROM scored)
  WHERE place <= 1100""", "scored"))
def rank_matches(t):
    best = patterns.best_windows(
        stored_library(t), patterns.query_shape(t.bars, ["1", "2"]), 60, 1100)
    return best.select(
        "query_id", F.col("at").cast("long").alias("place"), "symbol",
        F.col("widx").cast("long").alias("widx"), r("sim", 6).alias("sim"))


@query("t4_greedy_choice", sql("""
  SELECT query_id, rank, symbol, widx, end_date, round(sim, 6) + 0.0 AS sim
  FROM chosen""", "chosen"))
def greedy_choice(t):
    return chosen(t).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "symbol",
        F.col("widx").cast("long").alias("widx"), "end_date",
        r("sim", 6).alias("sim"))


def chosen(t, **options):
    return patterns.find_similar(
        stored_library(t), patterns.query_shape(t.bars, ["1", "2"]), **options)


def stored_library(t):
    path = scratch_dir(t.spark, "library")
    sinks.write_table(patterns.build_library(t.bars), path)
    return t.spark.read.parquet(path)


@query("t5_top_matches", sql("""
  SELECT query_id, rank, symbol, strftime(end_date, '%Y-%m-%d') AS end_date,
    round_even(sim * 1000, 0) / 10 AS similarity,
    round_even(fut[20] * 10000, 0) / 100 AS ret_20d_pct
  FROM chosen WHERE rank <= 10""", "chosen"))
def top_matches(t):
    return patterns.matches(chosen(t)).where(F.col("rank") <= 10).withColumn(
        "rank", F.col("rank").cast("long"))


@query("t6_symbol_order", sql(
    "SELECT symbol, count(*) AS n FROM bars GROUP BY symbol ORDER BY symbol", "bars"))
def symbol_order(t):
    return t.bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n")).orderBy("symbol")


@query("u1_concat_groups", sql(
    'SELECT symbol, name, "group", sector FROM exchange', "exchange"))
def concat_groups(t):
    members = exchange_members(exchange_listing_from_part(t.table("part")))
    return members.where(F.col("group").isin("large", "mid", "small"))


@query("u2_concat_sources", sql("""
  SELECT symbol, name, "group", sector FROM exchange
  UNION ALL SELECT symbol, name, "group", sector FROM constituents""",
    "exchange", "constituents"))
def concat_sources(t):
    part = t.table("part")
    return exchange_members(exchange_listing_from_part(part)).unionByName(
        index_members(index_listing_from_part(part)))

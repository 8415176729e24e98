"""Aggregations."""

from pyspark.sql import functions as F

from barweave.operators import patterns, quality, universe
from barweave.operators.forecast import (
    line_aggregates, volatility_aggregate, weekday_effect, ema_drift_path,
    line_path,
)
from barweave.operators.signals import tail_mean
from barweave.plans.summary import build_summary, signal_report
from barweave.sources.adapters import (
    exchange_listing_from_part, index_listing_from_part,
)
from workload.registry import query, r
from workload.rows import chosen
from workload.sql import sql


@query("a1_label_counts", sql("""
  SELECT 'rsi_label' AS field, rsi_label AS label, count(*) AS n FROM summary GROUP BY 2
  UNION ALL SELECT 'macd_label', macd_label, count(*) FROM summary GROUP BY 2
  UNION ALL SELECT 'trend', trend, count(*) FROM summary GROUP BY 2""", "summary"))
def label_counts(t):
    return signal_report(build_summary(t.bars, t.universe))


@query("a2_group_counts", sql("""
  SELECT coalesce("group", 'all') AS "group", count(*) AS n FROM built
  GROUP BY ROLLUP ("group")""", "built"))
def group_counts(t):
    part = t.table("part")
    return universe.group_counts(universe.build_universe(
        exchange_listing_from_part(part), index_listing_from_part(part)))


@query("a3_sectors", sql(
    "SELECT DISTINCT sector FROM universe ORDER BY sector", "universe"))
def sectors(t):
    return universe.sectors(t.universe)


@query("a4_first_listing", sql("""
  SELECT symbol, name, "group", sector FROM (SELECT *, row_number() OVER (
    PARTITION BY symbol ORDER BY origin, name, sector) AS i FROM (
      SELECT p_brand AS symbol, p_name AS name, 'mid' AS "group", p_type AS sector,
        p_size AS origin FROM part)) WHERE i = 1"""))
def first_listing(t):
    listed = t.table("part").select(
        F.col("p_brand").alias("symbol"), F.col("p_name").alias("name"),
        F.lit("mid").alias("group"), F.col("p_type").alias("sector"), "p_size")
    return universe.keep_first(listed, F.struct("p_size", "name", "sector"))


@query("a5_prior_volume", sql("""
  SELECT symbol, round(vol_avg, 6) + 0.0 AS vol_avg FROM roll WHERE age = 0""", "roll"))
def prior_volume(t):
    return t.numbered.groupBy("symbol").agg(
        r(tail_mean(F.col("volume"), 20, skip=1), 6).alias("vol_avg"))


@query("a6_regression", sql("""
  SELECT symbol, round(slope, 6) + 0.0 AS slope, round(base, 5) + 0.0 AS base
  FROM line""", "line"))
def regression(t):
    return t.numbered.groupBy("symbol").agg(*line_aggregates()).select(
        "symbol", r("line_slope", 6).alias("slope"), r("line_start", 5).alias("base"))


@query("a7_volatility", sql(
    "SELECT symbol, round(sigma, 8) + 0.0 AS sigma FROM sigma", "sigma"))
def volatility(t):
    return t.numbered.groupBy("symbol").agg(volatility_aggregate()).select(
        "symbol", r("sigma", 8).alias("sigma"))


@query("a8_weekday_effect", sql("""
  SELECT symbol, CAST(weekday AS INTEGER) AS weekday, round(dev, 8) + 0.0 AS dev
  FROM effect""", "effect"))
def weekdays(t):
    return weekday_effect(t.bars).select("symbol", "weekday", r("dev", 8).alias("dev"))


@query("a9_share_up", sql("""
  SELECT query_id, CAST(h AS INTEGER) AS h,
    round(avg(CASE WHEN fut[h] > 0 THEN 1.0 ELSE 0.0 END), 8) + 0.0 AS p_up
  FROM (SELECT *, unnest([5, 10, 20]) AS h FROM chosen) GROUP BY 1, 2""", "chosen"))
def share_up(t):
    return patterns.horizon_stats(chosen(t)).select(
        "query_id", "h", r("p_up", 8).alias("p_up"))


@query("a10_outcome_quartiles", sql("""
  SELECT query_id, CAST(h AS INTEGER) AS h,
    round(quantile_cont(fut[h], 0.5), 8) + 0.0 AS median,
    round(quantile_cont(fut[h], 0.25), 8) + 0.0 AS q25,
    round(quantile_cont(fut[h], 0.75), 8) + 0.0 AS q75
  FROM (SELECT *, unnest([5, 10, 20]) AS h FROM chosen) GROUP BY 1, 2""", "chosen"))
def outcome_quartiles(t):
    return patterns.horizon_stats(chosen(t)).select(
        "query_id", "h", *[r(c, 8).alias(c) for c in ("median", "q25", "q75")])


@query("a11_fan_paths", sql("""
  SELECT query_id, CAST(i AS INTEGER) AS step,
    round(quantile_cont(fut[i] + 1, 0.10), 8) + 0.0 AS p10,
    round(quantile_cont(fut[i] + 1, 0.25), 8) + 0.0 AS p25,
    round(quantile_cont(fut[i] + 1, 0.50), 8) + 0.0 AS p50,
    round(quantile_cont(fut[i] + 1, 0.75), 8) + 0.0 AS p75,
    round(quantile_cont(fut[i] + 1, 0.90), 8) + 0.0 AS p90
  FROM (SELECT *, unnest(range(1, 21)) AS i FROM chosen) GROUP BY 1, 2""", "chosen"))
def fan_paths(t):
    return patterns.fan_paths(chosen(t)).select(
        "query_id", "step", *[r(f"p{p}", 8).alias(f"p{p}") for p in patterns.FAN])


@query("a12_outcome_histogram", sql("""
  SELECT query_id, CAST(least(floor((ret - low) / (high - low) * 30) + 1, 30) AS BIGINT)
    AS bin, count(*) AS n
  FROM (SELECT query_id, fut[20] * 100 AS ret,
      min(fut[20] * 100) OVER (PARTITION BY query_id) AS low,
      max(fut[20] * 100) OVER (PARTITION BY query_id) AS high FROM chosen)
  GROUP BY 1, 2""", "chosen"))
def outcome_histogram(t):
    return patterns.outcome_histogram(chosen(t)).select(
        "query_id", F.col("bin").cast("long").alias("bin"), "n")


@query("a13_ingest_outcome", sql("""
  SELECT count(*) FILTER (n >= 500) AS ok,
    count(*) FILTER (n IS NULL OR n < 500) AS failed, count(*) AS total
  FROM (SELECT CAST(p_partkey AS VARCHAR) AS symbol FROM part) LEFT JOIN (
    SELECT symbol, count("close") AS n FROM gappy GROUP BY symbol) USING (symbol)""",
    "gappy"))
def ingest_outcome(t):
    requested = t.table("part").select(
        F.col("p_partkey").cast("string").alias("symbol"))
    return quality.outcome_counts(
        quality.rejects(t.gappy, 500, requested), requested)


@query("a14_match_count", sql(
    "SELECT query_id, count(*) AS n FROM chosen GROUP BY 1", "chosen"))
def match_count(t):
    return chosen(t).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query("a15_model_mean", sql("""
  SELECT f.symbol, CAST(s AS INTEGER) AS step,
    round(((f.base + f.slope * (f.m - 1 + s)) + (l.last_close + d.drift * s)) / 2, 5)
      + 0.0 AS value
  FROM line f JOIN drift d USING (symbol) JOIN last_rows l USING (symbol),
    range(1, 6) t(s)""", "line", "drift", "last_rows"))
def model_mean(t):
    paths = line_path(t.bars).unionByName(ema_drift_path(t.bars))
    return paths.groupBy("symbol", "step").agg(r(F.avg("value"), 5).alias("value"))

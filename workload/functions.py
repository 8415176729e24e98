"""Scalar functions on the bars, the universe and the listings."""

from pyspark.sql import functions as F

from barweave.functions import arrays
from barweave.functions.dates import iso_text, next_business_days, weekday
from barweave.functions.rounding import round_exact, round_scaled
from barweave.functions.text import option_label, option_symbol, signed_percent
from barweave.operators import patterns, series
from barweave.operators.universe import with_listing
from barweave.sources.adapters import (
    exchange_listing_from_part, index_listing_from_part,
)
from workload.registry import query, r
from workload.sql import sql
from workload.windows import curve

KEY = ("symbol", "date")


def per_bar(name, column, expression):
    """A query that computes one column on every bar."""
    select = f'SELECT symbol, date, {expression} FROM bars'
    query(name, sql(select, "bars"))(
        lambda t: t.bars.select(*KEY, column().alias(expression.split(" AS ")[-1])))


C = F.col

query("f1_round", sql("""
  SELECT symbol, date, CAST(printf('%.1f', "close") AS DOUBLE) AS exact,
    round_even("close" / 7 * 100, 0) / 100 AS scaled FROM bars""", "bars"))(
    lambda t: t.bars.select(
        *KEY, round_exact(C("close"), 1).alias("exact"),
        round_scaled(C("close") / 7, 2).alias("scaled")))
per_bar("f2_ln", lambda: r(F.log("close"), 8), 'round(ln("close"), 8) + 0.0 AS y')
per_bar("f3_exp", lambda: r(F.exp(C("volume") / -10), 8),
        'round(exp(volume / -10), 8) + 0.0 AS y')
per_bar("f4_sqrt", lambda: r(F.sqrt("volume"), 8), "round(sqrt(volume), 8) + 0.0 AS y")
per_bar("f5_clip", lambda: F.least(F.greatest(C("close") - C("open"), F.lit(0.0)),
                                   F.lit(1000.0)) + 0.0,
        'least(greatest("close" - "open", 0.0::DOUBLE), 1000.0::DOUBLE) + 0.0 AS y')
per_bar("f6_abs_max_div",
        lambda: F.greatest(F.lit(1), F.expr("cast(abs(close - open) as bigint) div 10")),
        'greatest(1, CAST(trunc(abs("close" - "open")) AS BIGINT) // 10) AS y')
per_bar("f7_conditional",
        lambda: F.when(C("close") > C("open"), "rise").when(
            C("close") < C("open"), "fall").otherwise("same"),
        """CASE WHEN "close" > "open" THEN 'rise' WHEN "close" < "open" THEN 'fall'
        ELSE 'same' END AS y""")
query("f8_null_test", sql("""
  SELECT symbol, date, "close" IS NULL AS missing, "close" IS NOT NULL AS known
  FROM gappy""", "gappy"))(
    lambda t: t.gappy.select(*KEY, C("close").isNull().alias("missing"),
                             C("close").isNotNull().alias("known")))
query("f9_fill_null", sql(
    'SELECT symbol, date, coalesce("close", 0.0::DOUBLE) AS "close" FROM gappy',
    "gappy"))(
    lambda t: t.gappy.select(*KEY, "close").fillna(0.0, ["close"]))
query("f10_drop_null", sql(
    'SELECT symbol, date, "close" FROM gappy WHERE "close" IS NOT NULL', "gappy"))(
    lambda t: t.gappy.select(*KEY, "close").dropna(subset=["close"]))
query("f11_lookup_default", sql("""
  SELECT s.s AS symbol, coalesce(u.name, s.s) AS name FROM (
    SELECT CAST(p_partkey AS VARCHAR) AS s FROM part) s
  LEFT JOIN universe u ON u.symbol = s.s""", "universe"))(
    lambda t: with_listing(t.table("part").select(
        C("p_partkey").cast("string").alias("symbol")), t.universe
    ).select("symbol", "name"))
query("f12_strip", sql(
    "SELECT code, trim(name) AS name FROM listing_a", "listing_a"))(
    lambda t: exchange_listing_from_part(t.table("part")).select(
        "code", F.trim("name").alias("name")))
query("f13_replace_dot", sql(
    "SELECT symbol, replace(symbol, '.', '-') AS dashed FROM listing_b", "listing_b"))(
    lambda t: index_listing_from_part(t.table("part")).select(
        "symbol", F.replace("symbol", F.lit("."), F.lit("-")).alias("dashed")))
query("f14_concat", sql("""
  SELECT code || '.T' AS symbol, code || '  ' || name AS label FROM listing_a""",
    "listing_a"))(
    lambda t: exchange_listing_from_part(t.table("part")).select(
        F.concat(C("code").cast("string"), F.lit(".T")).alias("symbol"),
        option_label(C("code").cast("string"), C("name")).alias("label")))
query("f15_contains", sql(
    "SELECT code, contains(market, '内国株式') AS home FROM listing_a", "listing_a"))(
    lambda t: exchange_listing_from_part(t.table("part")).select(
        "code", C("market").contains("内国株式").alias("home")))
query("f16_ends_with", sql(
    "SELECT symbol, symbol LIKE '%.B' AS is_b FROM listing_b", "listing_b"))(
    lambda t: index_listing_from_part(t.table("part")).select(
        "symbol", C("symbol").endswith(".B").alias("is_b")))
query("f17_first_token", """
  SELECT p_partkey AS code, split_part(trim(p_name), ' ', 1) AS token FROM part""")(
    lambda t: t.table("part").select(
        C("p_partkey").alias("code"), option_symbol(C("p_name")).alias("token")))
query("f18_cast_text", sql(
    "SELECT code, CAST(code AS VARCHAR) AS text FROM listing_a", "listing_a"))(
    lambda t: exchange_listing_from_part(t.table("part")).select(
        "code", C("code").cast("string").alias("text")))
query("f19_format", sql("""
  SELECT symbol, date, format('{:,.2f}', "close") AS price,
    format('{:+.2f}%', round(("close" / "open" - 1) * 100, 6)) AS change FROM bars""",
    "bars"))(
    lambda t: t.bars.select(
        *KEY, F.format_number("close", 2).alias("price"),
        signed_percent(r((C("close") / C("open") - 1) * 100, 6)).alias("change")))
query("f20_parse_date", """
  SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem""")(
    lambda t: t.table("lineitem").select(F.to_date(F.date_format(
        "l_shipdate", "yyyy-MM-dd"), "yyyy-MM-dd").alias("day")).distinct())
query("f21_to_date", """
  SELECT event_id, CAST(ts AS DATE) AS day FROM events""")(
    lambda t: t.table("events").select("event_id", F.to_date("ts").alias("day")))
per_bar("f22_date_text", lambda: iso_text(C("date")), "strftime(date, '%Y-%m-%d') AS y")
per_bar("f23_weekday", lambda: weekday(C("date")).cast("long"), "isodow(date) - 1 AS y")
query("f24_business_days", sql("""
  SELECT symbol, CAST(step AS INTEGER) AS step, day FROM (
    SELECT symbol || '@' || date AS symbol, day, row_number() OVER (
      PARTITION BY symbol, date ORDER BY day) AS step
    FROM (SELECT symbol, date, CAST(start + CAST(i AS INTEGER) AS DATE) AS day
      FROM (SELECT symbol, date, CASE WHEN isodow(date) >= 6
          THEN date + CAST(8 - isodow(date) AS INTEGER) ELSE date END AS start
        FROM bars), range(1, 8) t(i))
    WHERE isodow(day) < 6) WHERE step <= 5""", "bars"))(
    lambda t: t.bars.select(
        F.concat("symbol", F.lit("@"), C("date").cast("string")).alias("symbol"),
        F.posexplode(next_business_days(C("date"), 5)).alias("at", "day"),
    ).select("symbol", (C("at") + 1).alias("step"), "day"))


def shapes(t):
    """The last 60 closes of every symbol, as arrays."""
    return patterns.last_shapes(t.bars, 60)


SHAPES = """
  SELECT symbol AS query_id, list("close" ORDER BY pos) AS q, avg("close") AS m,
    stddev_pop("close") AS sd FROM num WHERE age < 60 GROUP BY symbol"""


@query("f25_zscore", sql(f"""
  SELECT query_id, i, round((q[i] - m) / sd, 6) + 0.0 AS z
  FROM (SELECT *, unnest(range(1, 61)) AS i FROM ({SHAPES}))""", "num"))
def zscore(t):
    z = patterns.prepare_queries(shapes(t), 60)
    return z.select("query_id", F.posexplode("zq").alias("i", "z")).select(
        "query_id", (C("i") + 1).cast("long").alias("i"), r("z", 6).alias("z"))


@query("f26_dot", sql(f"""
  SELECT query_id, round(list_dot_product(q, q) / 1e6, 4) + 0.0 AS y
  FROM ({SHAPES})""", "num"))
def dot_product(t):
    return shapes(t).select("query_id", r(
        arrays.dot(C("q"), C("q")) / 1e6, 4).alias("y"))


@query("f27_resample", sql(f"""
  SELECT query_id, i, round(CASE WHEN x = floor(x) THEN q[CAST(x AS INTEGER) + 1]
    ELSE q[CAST(floor(x) AS INTEGER) + 1] + (q[CAST(floor(x) AS INTEGER) + 2]
      - q[CAST(floor(x) AS INTEGER) + 1]) * (x - floor(x)) END, 4) + 0.0 AS y
  FROM (SELECT *, i * 59.0::DOUBLE / 99 AS x FROM (
    SELECT *, unnest(range(0, 100)) AS i FROM ({SHAPES})))""", "num"))
def resample(t):
    out = shapes(t).select("query_id", F.posexplode(
        arrays.resample(C("q"), 100)).alias("i", "y"))
    return out.select("query_id", C("i").cast("long").alias("i"), r("y", 4).alias("y"))


@query("f28_gap_fill", sql("""
  SELECT symbol AS series_id, pos, round(filled, 4) + 0.0 AS filled FROM filled""",
    "filled"))
def gap_fill(t):
    return series.fill_gaps(curve(t)).select(
        "series_id", "pos", r("filled", 4).alias("filled"))


@query("f29_steps", sql("""
  SELECT symbol, step FROM last_rows, range(1, 6) t(step)""", "last_rows"))
def steps(t):
    return t.bars.select("symbol").distinct().select(
        "symbol", F.explode(F.sequence(F.lit(1), F.lit(5)).cast("array<bigint>"))
        .alias("step"))


@query("f30_ratio_path", sql(f"""
  SELECT query_id, i, round(q[i] / q[1] - 1, 8) + 0.0 AS y
  FROM (SELECT *, unnest(range(1, 61)) AS i FROM ({SHAPES}))""", "num"))
def ratio_path(t):
    out = shapes(t).select("query_id", F.posexplode(
        arrays.relative_path(C("q"), F.element_at("q", 1))).alias("i", "y"))
    return out.select("query_id", (C("i") + 1).cast("long").alias("i"),
                      r("y", 8).alias("y"))

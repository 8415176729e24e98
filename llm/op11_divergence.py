"""Divergence between the sources of a language, by three-dimensional cube partitioning.

A group is the documents of one language and source. The terms that at least `MIN_DOCS`
documents of the language hold are kept, and each group gives each of them a smoothed
share. The divergences of all pairs of groups come from a cube of cells (group block,
group block, term block): a cell gets the slices (group block, term block) of its two
blocks, replicated once per opposite block, and adds up its pairs over its terms; the
partial sums are then reduced along the term axis. A cell holds at most 2 * `BLOCK` groups
by about `TERMS` terms, whatever the corpus. Terms that no group of a cell's two blocks
holds add the same amount each, so they are counted instead of shipped.

All arithmetic is on integers. Words are counted where the documents are, in tables of
bounded size, so what is shuffled is one row per term, group and table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.bytescan import pieces, rows_of, sliced
from llm.common import stored

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: Groups and terms along the edges of a cell.
BLOCK = 32
TERMS = 8192
#: Entries that a task counts before it passes them on.
HELD = 400_000
STEP_BYTES = 1 << 20

#: Letters A-Z become a-z; every other ASCII character separates terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))
_SEPARATORS = np.frombuffer(_TERMS, np.uint8) == 32

_PARTIAL = "lang string, source string, term string, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences by group and term; rows without a source hold documents by language
    and term, rows of the empty term name the groups."""
    words: dict[tuple[str, str], Counter] = {}
    docs: dict[str, Counter] = {}

    def passed_on() -> pa.RecordBatch:
        langs, sources, terms, numbers = [], [], [], []
        tables = [*words.items(), *(((lang, None), own) for lang, own in docs.items())]
        for (lang, source), own in tables:
            if source is not None:
                own[b""] = 0
            langs += [lang] * len(own)
            sources += [source] * len(own)
            terms += own.keys()
            numbers += own.values()
        words.clear()
        docs.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(sources, pa.string()),
             pa.array(terms, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64())],
            ["lang", "source", "term", "n"])

    for whole in batches:
        for batch in sliced(whole, "text", STEP_BYTES):
            for lang, source, text in zip(
                    batch.column("lang").to_pylist(), batch.column("source").to_pylist(),
                    rows_of(batch.column("text")), strict=True):
                own, distinct = words.setdefault((lang, source), Counter()), set()
                for piece in pieces(text, _SEPARATORS):
                    found = piece.tobytes().translate(_TERMS).split()
                    own.update(found)
                    distinct.update(found)
                docs.setdefault(lang, Counter()).update(distinct)
            if sum(map(len, words.values())) + sum(map(len, docs.values())) > HELD:
                yield passed_on()
    yield passed_on()


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """A stored table (lang, source, term, n, lang_n) of the kept terms of `docs`
    (lang, source, text).

    n: occurrences in the group, above 0; lang_n: those in the language. Rows of source
    null stand for the language, one per kept term (n: its documents). Rows of the empty
    term name the groups, also those without terms. Null lang, source and text are empty
    strings. Repeated documents count each time; other columns are ignored.
    """
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
               for c in ("lang", "source", "text")]
    counted = docs.select(*columns).mapInArrow(_count, _PARTIAL)
    # Dealt by (lang, term), the sums and what a language knows of a term need one exchange.
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"))
    term = Window.partitionBy("lang", "term")
    known = F.max(F.when(F.col("source").isNull(), F.col("n"))).over(term)
    total = F.sum(F.when(F.col("source").isNotNull(), F.col("n"))).over(term)
    return stored(summed.withColumn("docs", known).withColumn("lang_n", total)
                  .where((F.col("docs") >= min_docs) | (F.col("term") == ""))
                  .select("lang", "source", "term", "n", "lang_n"))


def group_totals(counts: DataFrame) -> DataFrame:
    """A stored table of the groups: lang, source, total, at (number in the language),
    groups (of the language), v (its kept terms), lang_total, base (share of an absent
    term)."""
    langs = counts.where("source is null").groupBy("lang").agg(
        F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    lang = Window.partitionBy("lang")
    return stored(
        counts.where("source is not null").groupBy("lang", "source")
        .agg(F.sum("n").alias("total")).join(langs, "lang", "left")
        .fillna(0, ["v", "lang_total"])
        .withColumn("at", F.row_number().over(lang.orderBy("source")) - 1)
        .withColumn("groups", F.count("*").over(lang).cast("int"))
        .withColumn("base", F.when(F.col("v") > 0, _share(F.lit(0), "total", "v"))
                    .otherwise(1)))


def _share(count: Column, total: str, v: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + v)), exactly."""
    up = (count.cast("decimal(19,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", up, (F.col(total) + F.col(v)).cast("decimal(19,0)"))


def _entries(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """The counts above 0 with what is known of their groups, and their shares."""
    return (counts.where("source is not null and term <> ''")
            .join(groups, ["lang", "source"])
            .withColumn("p", _share(F.col("n"), "total", "v")))


def _cell(table: pa.Table, block: int) -> pa.Table:
    """The partial divergences of one cell of the cube, both ways of each pair."""
    lang, i, j = (table.column(c)[0].as_py() for c in ("lang", "i", "j"))
    heads = table.filter(pc.is_valid(table.column("source"))).sort_by("at")
    rest = table.filter(pc.is_valid(table.column("term")))
    at = heads.column("at").to_numpy()
    codes = rest.column("term").combine_chunks().dictionary_encode()
    n = len(codes.dictionary)
    shares = np.repeat(heads.column("base").to_numpy()[:, None], n + 1, 1)
    shares[np.searchsorted(at, rest.column("at").to_numpy()),
           codes.indices.to_numpy()] = rest.column("p").to_numpy()
    # The last column stays at the shares of an absent term.
    left, right = np.flatnonzero(at // block == i), np.flatnonzero(at // block == j)
    found = []
    for a in left:
        square = shares[a] - shares[right]
        square *= square
        ways = [(np.full(len(right), a), right, square // shares[right])]
        if i != j:
            ways.append((right, ways[0][0], square // shares[a]))
        found += ways
    first, second = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    values = np.concatenate([f[2][:, :n].sum(1) for f in found])
    absent = np.concatenate([f[2][:, n] for f in found])
    other = first != second
    names = heads.column("source")
    size = int(other.sum())
    return pa.table({
        "lang": pa.array([lang] * size, pa.string()),
        "source": names.take(pa.array(first[other])), "item": names.take(
            pa.array(second[other])),
        "value": values[other], "absent": absent[other],
        "present": np.full(size, n, np.int64),
        "v": np.full(size, heads.column("v")[0].as_py(), np.int64)})


def pair_divergences(counts: DataFrame, groups: DataFrame, block: int = BLOCK,
                     terms: int = TERMS) -> DataFrame:
    """lang, source, item (another source of the language), value: the sum over all kept
    terms of floor((p - q)^2 / q), p the source's and q the item's share of a term."""
    blocks = F.ceil(F.col("groups") / block).cast("int")
    term_blocks = F.greatest(F.ceil(F.col("v") / terms), F.lit(1))
    own = F.floor(F.col("at") / block).cast("int")

    def sent(rows: DataFrame, term_block: Column, *columns: Column) -> DataFrame:
        """Each row once to every cell that has its group block on an edge."""
        other = rows.select("*", own.alias("own"), term_block.alias("k"),
                            F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        return other.select("lang", F.least("own", "other").alias("i"),
                            F.greatest("own", "other").alias("j"), "k", "at", *columns)

    slices = sent(_entries(counts, groups), F.pmod(F.xxhash64("term"), term_blocks),
                  F.lit(None).cast("string").alias("source"), F.col("term"), F.col("p"),
                  F.lit(None).cast("long").alias("base"), F.lit(None).cast("long").alias("v"))
    heads = sent(groups, F.explode(F.sequence(F.lit(0), term_blocks - 1)),
                 F.col("source"), F.lit(None).cast("string").alias("term"),
                 F.lit(None).cast("long").alias("p"), F.col("base"), F.col("v"))
    cells = slices.unionByName(heads).groupBy("lang", "i", "j", "k").applyInArrow(
        lambda cell: _cell(cell, block), "lang string, source string, item string, value long, absent long, "
        "present long, v long")
    reduced = cells.groupBy("lang", "source", "item").agg(
        F.sum("value").alias("value"), F.max("absent").alias("absent"),
        F.sum("present").alias("present"), F.max("v").alias("v"))
    return reduced.select("lang", "source", "item", (F.col("value") + F.col("absent") * (
        F.col("v") - F.col("present"))).alias("value"))


def term_divergences(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a term of the group whose share there, p, is above its share in
    the language, q), value floor((p - q)^2 / q)."""
    p, q = F.col("p"), F.col("q")
    return (_entries(counts, groups)
            .withColumn("q", _share(F.col("lang_n"), "lang_total", "v")).where(p > q)
            .select("lang", "source", F.col("term").alias("item"),
                    F.call_function("div", (p - q) * (p - q), q).alias("value")))


def ranked(values: DataFrame, part: str, top: int | None = None) -> DataFrame:
    """The values of each group from the largest on, equal ones by item."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rows = values.withColumn("rank", F.row_number().over(order))
    if top is not None:
        rows = rows.where(F.col("rank") <= top)
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and telling terms of each source, over all `documents`."""
    counts = term_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    groups = group_totals(counts)
    return ranked(pair_divergences(counts, groups), "pair").unionByName(
        ranked(term_divergences(counts, groups), "term", TOP))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source, translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(text,
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term
  HAVING count(DISTINCT k) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term)
  GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total
  FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
    1 + {SCALE}::HUGEINT * (coalesce(n, 0) + 1) // (total + v)::HUGEINT AS p,
    1 + {SCALE}::HUGEINT * (lang_n + 1) // (lang_total + v)::HUGEINT AS q
  FROM totals JOIN kept USING (lang) JOIN langs USING (lang)
    LEFT JOIN c USING (lang, source, term)),
sums AS (
  SELECT a.lang, a.source, b.source AS item,
    sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b
    ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares
  WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part
    ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= {TOP}"""

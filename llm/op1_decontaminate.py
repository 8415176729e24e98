"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised alike: letters A-Z become a-z, and words are the runs of digits,
letters a-z and all characters beyond ASCII. Every run of `WINDOW` words of a benchmark
item (all its words, if there are fewer) is a pattern over the words joined with blanks.
The automaton holds the patterns of all items and reads each document once; word numbers
and offsets in the original text follow from the positions of the matches.

The items are small beside the corpus, which is checked: beyond `BLOCK_BYTES` of item
text they are dealt into several blocks, and a task lets one automaton after the other
read the texts that it holds at the time.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bytescan import rows_of, sliced

WINDOW = 13
#: Item text behind one automaton; an automaton takes up to about 200 times as much.
BLOCK_BYTES = 1 << 19
#: Text that a task reads at a time.
STEP_BYTES = 1 << 23

#: Bytes to normalised bytes: what is no word character becomes a blank.
_WORD = np.full(256, 32, np.uint8)
_WORD[48:58] = np.arange(48, 58)
_WORD[97:123] = np.arange(97, 123)
_WORD[65:91] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)
_TABLE = _WORD.tobytes()

HITS = ("n_words long, n_hit long, items array<string>, "
        "hits array<struct<first:int,last:int>>, "
        "spans array<struct<start:int,end:int>>")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def patterns(items: list[tuple[str | None, bytes]], window: int = WINDOW
             ) -> dict[bytes, set[str | None]]:
    """The windows of the items, each with the items that hold it."""
    found: dict[bytes, set[str | None]] = {}
    for item, text in items:
        words = words_of(text)
        for at in range(max(1, len(words) - window + 1) if words else 0):
            key = b" " + b" ".join(words[at:at + window]) + b" "
            found.setdefault(key, set()).add(item)
    return found


def build(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> ahocorasick.Automaton:
    """Its values: (words in the window, characters of the pattern, items)."""
    automaton = ahocorasick.Automaton()
    for key, owners in patterns(items, window).items():
        # one character per byte
        automaton.add_word(key.decode("latin-1"),
                           (key.count(b" ") - 1, len(key), frozenset(owners)))
    if len(automaton):
        automaton.make_automaton()
    return automaton


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges [first, last] of words as one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def scan(text: bytes, automaton: ahocorasick.Automaton
         ) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, ranges of hit words (both ends included), items that occur."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), [], set()
    line = b" " + b" ".join(words) + b" "
    blanks, ranges, items = None, [], set()
    for end, (width, size, owners) in automaton.iter(line.decode("latin-1")):
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        first = int(np.searchsorted(blanks, end - size + 1))
        ranges.append((first, first + width - 1))
        items |= owners
    return len(words), merged(ranges), items


def char_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Ranges of words as code points [start, end) of the original text."""
    if not ranges:
        return []
    data = np.frombuffer(text, np.uint8)
    edge = np.diff(np.concatenate(([0], (_WORD[data] != 32).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [{"start": int(chars[starts[a]]), "end": int(chars[ends[b]])}
            for a, b in ranges]


def _scans(batch: pa.RecordBatch, blocks: list, kept: dict, window: int
           ) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per row of the batch what `scan` finds in all blocks, one automaton at a time."""
    texts = [view.tobytes() for view in rows_of(batch.column("text"))]
    found = None
    for k, shared in enumerate(blocks):
        if k not in kept:
            kept.clear()
            kept[k] = build(shared.value, window)
        now = [scan(text, kept[k]) for text in texts]
        found = now if found is None else [
            (n, merged(a + b), i | j) for (n, a, i), (_, b, j) in
            zip(found, now, strict=True)]
    return [(n, ranges, sorted(items - {None})) for n, ranges, items in found]


_NAMES = ["doc_id", "n_words", "n_hit", "items", "hits", "spans"]
_ARROW = [pa.int64(), pa.int64(), pa.list_(pa.string()),
          pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])),
          pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]


def shared_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES,
                  texts: tuple[str, ...] = ("text",)) -> list:
    """The items' texts as one broadcast value per block of about `block_bytes`."""
    spark = items.sparkSession
    items = items.select(
        F.col("item_id").cast("string").alias("item_id"),
        F.explode(F.array(*[F.col(c).cast("string") for c in texts])).alias("text")
    ).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"),
                                             F.lit(blocks)))
    return [spark.sparkContext.broadcast([
        (r.item_id, r.text.encode())
        for r in dealt.where(F.col("block") == k).toLocalIterator()])
        for k in range(blocks)]


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW,
              block_bytes: int = BLOCK_BYTES,
              texts: tuple[str, ...] = ("text",)) -> DataFrame:
    """Per row of `docs` (doc_id, text): n_words, n_hit, the `items` that occur (ids as
    strings, sorted), `hits` as ranges of words and `spans` in code points.

    `items` has item_id and one or more text columns (`texts`, such as question and
    answer), each with windows of its own. Null texts and texts without words have no
    words and no windows. Windows of items without an id are hit like others, but no id
    names them. Repeated items count once. Other columns are ignored. Each row of `docs`
    gives one row, repeated ones and those without doc_id too.
    """
    blocks = shared_blocks(items, block_bytes, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for whole in batches:
            for batch in sliced(whole, "text", STEP_BYTES):
                rows = [(n, sum(b - a + 1 for a, b in ranges), owners,
                         [{"first": a, "last": b} for a, b in ranges],
                         char_spans(view.tobytes(), ranges))
                        for (n, ranges, owners), view in zip(
                            _scans(batch, blocks, kept, window),
                            rows_of(batch.column("text")), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array(column, kind) for column, kind in
                     zip(zip(*rows, strict=True), _ARROW, strict=True)]], _NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {HITS}")


def judged(hits: DataFrame) -> DataFrame:
    """Adds `contaminated`: a twentieth of the words or more are hit."""
    return hits.withColumn("contaminated",
                           (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of `documents` by `benchmark`, per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return judged(find_hits(docs, items)).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_FOUND = (f"regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_FOUND} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_FOUND} AS w FROM benchmark),
starts AS (SELECT item, w, least(len(w), {WINDOW}) AS size,
    unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS key
  FROM starts),
places AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i
  FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
occ AS (SELECT rid, i, p.size, item FROM places p JOIN win
  ON p.size = win.size AND array_to_string(w[i:i + p.size - 1], ' ') = key),
hit AS (SELECT rid, count(DISTINCT word) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + size)) AS word FROM occ) GROUP BY rid),
own AS (SELECT rid, count(DISTINCT item) AS n_items,
    string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN own USING (rid)"""


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated, with all their columns.

    Rows are judged where they are: nothing is joined, so repeated and null ids do not
    matter. Items without an id count like any other, as nothing has to name them.
    """
    blocks = shared_blocks(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for whole in batches:
            for batch in sliced(whole, "text", STEP_BYTES):
                hit = [(n, sum(b - a + 1 for a, b in ranges))
                       for n, ranges, _ in _scans(batch, blocks, kept, WINDOW)]
                yield batch.filter(pa.array([not (h and 20 * h >= n) for n, h in hit],
                                            pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

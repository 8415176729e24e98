"""Near duplicates by one-permutation hashing with optimal densification.

A text's words are its runs without ASCII white space, A-Z read as a-z; its set holds
the distinct runs of `SHINGLE` words (all words as one shingle if there are fewer). One
hash per shingle falls into one of `BINS` bins and each bin keeps its smallest hash; an
empty bin borrows from a bin that its own fixed random order of the others finds first.
`BANDS` bands of `ROWS` bins each are the bucket keys. A pair with Jaccard similarity
0.85 misses all of them with probability of about 2e-9.

Equal sets are one node. Members of a bucket are tied to the bucket's hub only (a star),
which bounds the candidate edges by members times bands. The groups that the stars form
are a superset of the linked ones. They are then confirmed on full sets: a group is cut
into blocks of about `BLOCK` nodes or `BLOCK_SHINGLES` shingles and each pair of blocks is one unit of work,
so that no task holds a large group. A unit emits only a spanning forest of its links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bytescan import mix, rows_of, sliced, word_hashes
from llm.common import checkpointed, components

SHINGLE = 5
BINS = 256
ROWS = 6
BANDS = 42
BLOCK = 1024
BLOCK_SHINGLES = 1 << 18

_STEPS = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_PLACES = mix(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)
#: For each bin, all bins in the order in which it looks for one to borrow from.
_PROBES = np.argsort(mix(np.arange(BINS * BINS, dtype=np.uint64)).reshape(BINS, BINS), 1)


def shingle_set(text: np.ndarray) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total += words[k:len(words) - width + 1 + k] * _STEPS[k]
    return np.unique(mix(total))


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin, empty bins densified; the set must not be empty."""
    full, first = np.unique(shingles >> np.uint64(56), return_index=True)
    full = full.astype(np.int64)
    out = np.zeros(BINS, np.uint64)
    out[full] = shingles[first]
    if len(full) < BINS:
        filled = np.zeros(BINS, bool)
        filled[full] = True
        empty = np.flatnonzero(~filled)
        probes = _PROBES[empty]
        out[empty] = out[probes[np.arange(len(empty)), filled[probes].argmax(1)]]
    return out


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row and band."""
    bands = signatures[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS)
    return mix((bands * _PLACES).sum(2, dtype=np.uint64)
               + np.arange(BANDS, dtype=np.uint64))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in sliced(whole, "text"):
            sizes, keys, marks = [], [], []
            for text in rows_of(batch.column("text")):
                shingles = shingle_set(text)
                sizes.append(len(shingles))
                keys.append(set_key(shingles) if len(shingles) else None)
                if len(shingles):
                    marks.append(signature(shingles))
            bands = bucket_keys(np.array(marks)) if marks else np.zeros((0, BANDS))
            ends = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum(np.array(sizes) > 0, out=ends[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends * BANDS),
                                          pa.array(bands.ravel().astype(np.int64)))],
                ["doc_id", "text_hash", "n_shingles", "key", "bands"])


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, key of the set (null if empty) and its bucket keys,
    per row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64("text").alias("text_hash")).mapInArrow(
        _describe, "doc_id long, text_hash long, n_shingles long, key binary, "
        "bands array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Attach the full set, for rows whose text has the wanted key.

    Repeated rows come behind one another; the first one serves.
    """
    last = None
    for whole in batches:
        for batch in sliced(whole, "text"):
            found, fits = [], []
            for text, key in zip(rows_of(batch.column("text")),
                                 batch.column("key").to_pylist(), strict=True):
                found.append(shingle_set(text) if key != last else None)
                fits.append(key != last and set_key(found[-1]) == key)
                last = key if fits[-1] else last
            kept = batch.filter(pa.array(fits, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("grp"), kept.column("blocks"), kept.column("key"),
                 pa.array([s.tobytes() for s, f in zip(found, fits, strict=True) if f],
                          pa.binary())], ["grp", "blocks", "key", "shingles"])


def links_within(sets: list[np.ndarray], numerator: int, denominator: int
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (child, root) of the pairs with
    denominator * |intersection| >= numerator * |union|."""
    sizes = np.array([len(s) for s in sets], np.int64)
    members = np.repeat(np.arange(len(sets)), sizes)
    # shared counts come from the posting lists of shingles that several sets hold
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True,
                               return_counts=True)
    order = np.argsort(ids, kind="stable")
    posting, ends = members[order], np.cumsum(counts)
    starts, label = ends - counts, np.arange(len(sets))
    at = 0
    for x, size in enumerate(sizes.tolist()):
        own = ids[at:at + size]
        at += size
        own = own[counts[own] > 1]
        if not len(own):
            continue
        length = counts[own]
        step = np.repeat(starts[own] - np.cumsum(length) + length, length)
        both = np.bincount(posting[step + np.arange(len(step))], minlength=len(sets))
        union = size + sizes - both
        near = label[denominator * both >= numerator * union]
        if (near != label[x]).any():
            joined = np.unique(np.append(near, label[x]))
            label[np.isin(label, joined)] = joined[0]
    child = np.flatnonzero(label != np.arange(len(sets)))
    return child, label[child]


def _confirm(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit; a unit holds at most two blocks."""
        def close(keys: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
            child, top = links_within(sets, numerator, denominator)
            return pa.RecordBatch.from_arrays(
                [pa.array([keys[c] for c in child.tolist()], pa.binary()),
                 pa.array([keys[t] for t in top.tolist()], pa.binary())], ["a", "b"])

        unit, keys, sets = None, [], []
        for batch in batches:
            for u, key, shingles in zip(batch.column("unit").to_pylist(),
                                        batch.column("key").to_pylist(),
                                        rows_of(batch.column("shingles")), strict=True):
                if u != unit and len(sets) > 1:
                    yield close(keys, sets)
                if u != unit:
                    unit, keys, sets = u, [], []
                if not keys or keys[-1] != key:
                    keys.append(key)
                    sets.append(shingles.copy().view(np.uint64))
        if len(sets) > 1:
            yield close(keys, sets)
    return run


def linked(docs: DataFrame, numerator: int = 85, denominator: int = 100,
           block: int = BLOCK) -> DataFrame:
    """The rows of `near_duplicates` with the `root` of each one's component: a key of
    16 bytes, the same in all its rows and null for a text without words."""
    rows = checkpointed(describe(docs))
    # any row of a key has the key's set; its id may be null or name other texts as well
    nodes = (rows.where("key is not null")
             .groupBy("key").agg(F.min(F.struct("text_hash", "doc_id")).alias("row"),
                                 F.first("n_shingles").alias("n_shingles"))
             .select("key", "row.*", "n_shingles"))
    hashed = (rows.where("key is not null").select("key", "bands").distinct()
              .select("key", F.explode("bands").alias("bucket")))
    hubs = (hashed.groupBy("bucket").agg(F.min("key").alias("hub"),
                                         F.max("key").alias("other"))
            .where("hub <> other").select("bucket", "hub"))
    stars = (hashed.join(hubs, "bucket").where("key <> hub")
             .select(F.col("key").alias("a"), F.col("hub").alias("b")))
    groups = components(stars).join(nodes, F.col("node") == F.col("key"))
    cut = groups.groupBy("root").agg(F.ceil(F.greatest(
        F.count("*") / block, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
        .alias("blocks"))
    wanted = checkpointed(groups.join(cut, "root").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "key",
        F.col("root").alias("grp"), "blocks"))
    sets = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .join(wanted, (F.xxhash64("text") == F.col("_hash"))
                  & F.col("doc_id").eqNullSafe(F.col("_id")))
            .select("grp", "blocks", "key", "text")
            .mapInArrow(_sets, "grp binary, blocks int, key binary, shingles binary"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    units = (sets.withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.concat_ws(":", F.hex("grp"), F.least("own", "other"),
                                 F.greatest("own", "other")).alias("unit"),
                     "key", "shingles"))
    forest = (units.repartition("unit").sortWithinPartitions("unit", "key")
              .mapInArrow(_confirm(numerator, denominator), "a binary, b binary"))
    roots = components(forest)
    named = (rows.where("key is not null").select("key", "doc_id")
             .groupBy("key").agg(F.min("doc_id").alias("lowest"))
             .join(roots, F.col("key") == F.col("node"), "left")
             .select("key", "lowest", F.coalesce("root", "key").alias("root")))
    lowest = named.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = named.join(lowest, "root").select("key", "component_id", "root")
    return rows.select("doc_id", "text_hash", "n_shingles", "key").join(named, "key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("key").isNull(), F.col("doc_id"))
        .otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("key").isNull() | F.col("component_id").isNull(), True)
        .otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
        .alias("kept"), "text_hash", "root")


def near_duplicates(docs: DataFrame, numerator: int = 85, denominator: int = 100,
                    block: int = BLOCK) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept, and the
    text's xxhash64 as text_hash.

    Linked are documents with denominator * |intersection| >= numerator * |union|.
    Null and empty texts have an empty set and are linked with nothing. Repeated rows
    and equal texts are in one component. A row without doc_id is compared like any
    other but names no component; if nothing in its component has an id, component_id
    is null and the row stays. Rows of different texts may share a doc_id. Other columns
    are ignored.
    """
    return linked(docs, numerator, denominator, block).drop("root")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of `documents`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop(
        "text_hash")


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), {_LETTERS}), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT rid, s FROM (SELECT rid, unnest(CASE WHEN len(w) < {SHINGLE}
      THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {SHINGLE} + 2),
        lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' ')) END) AS s
    FROM d WHERE len(w) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM sets GROUP BY rid),
pairs AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c
  FROM sets a JOIN sets b ON a.s = b.s AND a.rid < b.rid GROUP BY a.rid, b.rid),
links AS (SELECT x, y FROM pairs JOIN sizes m ON m.rid = x JOIN sizes o ON o.rid = y
  WHERE 100 * c >= 85 * (m.n + o.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT rid, rid AS other FROM d
  UNION SELECT reach.rid, ways.y FROM reach JOIN ways ON reach.other = ways.x),
lowest AS (SELECT reach.rid, min(doc_id) AS component_id
  FROM reach JOIN d ON d.rid = reach.other GROUP BY reach.rid)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id,
  doc_id = component_id AS kept
FROM d JOIN lowest USING (rid) LEFT JOIN sizes USING (rid)"""

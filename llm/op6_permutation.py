"""Approximate nearest neighbours by a permutation index.

A vector is represented by the pivots in order of their inner product with it. The
vectors are dealt into blocks by hash, and a block holds one inverted file: for each
pivot, the rank it has with each vector of the block (`prefix` where the vector does not
list it among its nearest `prefix`). A query walks the files of its own pivots, which sums
up the footrule distance to every vector of the block; the nearest by footrule, ties
included, are ranked again by exact inner products.

To order pivots well for vectors of unequal length, each vector gets one more component,
sqrt(longest**2 - length**2), and each query a zero: the largest inner product is then
the smallest angle.

Pivots are a sample of `PIVOTS` rows, the lowest by hash of the id; every row is indexed.
Blocks of vectors and blocks of queries of fixed size meet in one unit of work each, which
emits its best `k` per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NEIGHBOURS = 20
PIVOTS = 128
BLOCK = 4096
QUERIES = 8192
#: Share of a block that is ranked again, and the number over all blocks at least.
SHARE = 0.05
LEAST = 2560


def valid_vectors(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding"
                  ) -> DataFrame:
    """(vec_id, vector as array<double>) of the rows that take part.

    Left out: null ids, null, empty and zero vectors, those with null or non-finite
    components, and those of another length than most. Equal rows count once.
    """
    x = F.col("vector")
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"),
                     F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(
        F.col("vec_id").isNotNull() & x.isNotNull() & F.exists(x, lambda v: v != 0)
        & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)))
    lengths = rows.groupBy(F.size(x).alias("n")).count()
    common = lengths.orderBy(F.desc("count"), "n").first()
    return rows.where(F.size(x) == (common.n if common else 0)).dropDuplicates()


def permutation(vectors: np.ndarray, last: np.ndarray, pivots: np.ndarray, prefix: int
                ) -> np.ndarray:
    """Rank of each pivot with each vector, one row per vector."""
    near = vectors @ pivots[:, :-1].T + np.outer(last, pivots[:, -1])
    order = np.argsort(-near, axis=1, kind="stable")[:, :prefix]
    ranks = np.full(near.shape, prefix, np.int16)
    np.put_along_axis(ranks, order, np.arange(prefix, dtype=np.int16)[None, :], axis=1)
    return ranks


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def footrules(ranks: np.ndarray, query: np.ndarray, prefix: int) -> np.ndarray:
    """Summed over the pivots that the query lists: distance of the ranks. `ranks` is the
    inverted file, one row per pivot."""
    total = np.zeros(ranks.shape[1], np.int32)
    for pivot in np.flatnonzero(query < prefix).tolist():
        total += np.abs(ranks[pivot] - query[pivot])
    return total


def search_block(ids: np.ndarray, vectors: np.ndarray, ranks: np.ndarray,
                 query_ids: np.ndarray, queries: np.ndarray, query_ranks: np.ndarray,
                 k: int, prefix: int, share: float):
    """For each query (its id, ids, scores) of the best k in the block."""
    file = np.ascontiguousarray(ranks.T)
    keep = min(len(ids), max(k + 1, int(np.ceil(share * len(ids)))))
    for query_id, query, own in zip(query_ids.tolist(), queries, query_ranks, strict=True):
        near = footrules(file, own, prefix)
        limit = np.partition(near, keep - 1)[keep - 1]
        found = np.flatnonzero(near <= limit)
        found = found[ids[found] != query_id]
        scores = (vectors[found] * query).sum(1)
        best = np.lexsort((ids[found], -scores))[:k]
        yield query_id, ids[found][best], scores[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS,
           pivots: int = PIVOTS, prefix: int | None = None, share: float = SHARE,
           least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest by inner product.

    `vectors` and `queries` are (vec_id, vector) as `valid_vectors` gives them; rows with
    the query's id are not its neighbours. Ties go to the smaller id. With few vectors
    all are ranked exactly. Without vectors or queries there are no rows. Scores beyond
    the range of a double are infinite.
    """
    spark = vectors.sparkSession
    size, largest = vectors.agg(F.count("*"), F.max(F.array_max(F.transform(
        "vector", lambda v: F.abs(v))))).first()
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Pivots are ordered on vectors divided by the largest component, whose squares fit.
    longest = vectors.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, v: s + (
        v / F.lit(largest)) * (v / F.lit(largest))))).first()[0]
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(pivots)
    chosen = np.array([r.vector for r in sample.collect()], np.float64) / largest
    last = np.sqrt(np.maximum(longest - (chosen ** 2).sum(1), 0))
    chosen = np.column_stack([chosen, last])
    prefix = min(prefix or len(chosen), len(chosen))
    share = min(1.0, max(share, least / size))
    shared = spark.sparkContext.broadcast(chosen)  # `pivots` rows

    def ranked(is_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("vector"))
                small = x / largest
                more = np.zeros(len(x)) if is_query else np.sqrt(
                    np.maximum(longest - (small ** 2).sum(1), 0))
                ranks = permutation(small, more, shared.value, prefix) if len(x) else x
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"),
                     pa.array([v.astype("<f8").tobytes() for v in x], pa.binary()),
                     pa.array([r.astype("<i2").tobytes() for r in ranks], pa.binary())],
                    ["vec_id", "vector", "ranks"])
        return run

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit, the vectors of a unit before its queries."""
        def matrices(rows):
            return (np.array([r[0] for r in rows], np.int64),
                    np.frombuffer(b"".join(r[1] for r in rows), "<f8")
                    .reshape(len(rows), -1),
                    np.frombuffer(b"".join(r[2] for r in rows), "<i2")
                    .reshape(len(rows), -1))

        def close(own, asked):
            if own and asked:
                found = list(search_block(*matrices(own), *matrices(asked), k, prefix,
                                          share))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int64()),
                     pa.array([f[1] for f in found], pa.list_(pa.int64())),
                     pa.array([f[2] for f in found], pa.list_(pa.float64()))],
                    ["query_id", "ids", "scores"])

        unit, own, asked = None, [], []
        for batch in batches:
            for u, q, *row in zip(*[batch.column(c).to_pylist() for c in (
                    "unit", "asks", "vec_id", "vector", "ranks")], strict=True):
                if u != unit:
                    yield from close(own, asked)
                    unit, own, asked = u, [], []
                (asked if q else own).append(row)
        yield from close(own, asked)

    kind = "vec_id long, vector binary, ranks binary"
    blocks = -(-size // block)
    lots = max(1, -(-queries.count() // QUERIES))
    index = (vectors.mapInArrow(ranked(False), kind)
             .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
             .withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
             .withColumn("asks", F.lit(False)))
    asked = (queries.mapInArrow(ranked(True), kind)
             .withColumn("lot", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(lots))
                         .cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .withColumn("asks", F.lit(True)))
    unit = (F.col("block") * lots + F.col("lot")).alias("unit")
    columns = [unit, "asks", "vec_id", "vector", "ranks"]
    met = index.select(*columns).unionByName(asked.select(*columns))
    best = (met.repartition("unit").sortWithinPartitions("unit", "asks")
            .mapInArrow(searched, "query_id long, ids array<long>, scores array<double>"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.select("query_id", F.inline(F.arrays_zip(
        F.col("ids").alias("vec_id"), F.col("scores").alias("score"))))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score"))


def op6_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every twentieth id of `embeddings`."""
    vectors = valid_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))

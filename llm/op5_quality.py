"""Quality scores by Bradley-Terry ranking of preference pairs.

A text is described by shares of byte values, of transitions between classes of
characters, and of word lengths, and by a few figures on its words. A pair of a
preferred (label 1) and a rejected (label 0) training text is one comparison; the weights
maximise the likelihood that the preferred text wins, a logistic loss on the difference of
the features. Scores above the quantile of the training scores that equals the share of
rejected labels are accepted; the scale is shifted so that this quantile is `ACCEPT`.

All labels outside the held-out fold train. Every training text meets several of the
other label; the texts are dealt into blocks by hash, and sums over the blocks are all that
a step of the fit gathers. Cut and slope of the scale are those of all training texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bytescan import (
    BLANK, LOWER, SLICE_BYTES, pieces, range_hashes, rows_of, sliced, word_bounds,
)
from llm.common import discard, stored

#: Opponents of each text of the more frequent label, at least, if there are as many.
OPPONENTS = 4
#: Comparisons, at least, if there are as many different ones.
PAIRS = 40_000
#: Texts of the more frequent label in a block, about, and of the other one, at least.
BLOCK, OTHERS = 2_048, 256
PENALTY = 1e-3
ACCEPT = 0.7

_CLASSES = 10
_CLASS = np.full(256, 8, np.uint8)
for _members, _class in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2),
                         ((32, 9), 3), ((10, 11, 12, 13), 4), ((46, 33, 63), 5),
                         ((44, 59, 58), 6), ((124,), 7), (range(128, 256), 9)):
    _CLASS[list(_members)] = _class
_LENGTHS = 24
FEATURES = 256 + _CLASSES ** 2 + _LENGTHS + 4


def features(text: np.ndarray) -> np.ndarray:
    """The description of a text; memory does not grow with its length but for the
    hashes of its words."""
    values, moves = np.zeros(256), np.zeros(_CLASSES ** 2)
    lengths, hashes = np.zeros(_LENGTHS), []
    for piece in pieces(text, BLANK, SLICE_BYTES):
        values += np.bincount(piece, minlength=256)
        kind = _CLASS[piece]
        moves += np.bincount(kind[:-1] * np.int64(_CLASSES) + kind[1:],
                             minlength=_CLASSES ** 2)
        low, high = word_bounds(piece, BLANK)
        lengths += np.bincount(np.minimum(high - low, _LENGTHS - 1), minlength=_LENGTHS)
        hashes.append(range_hashes(LOWER[piece], low, high))
    words = np.concatenate(hashes)
    n = max(1, len(text))
    if len(words):
        _, counts = np.unique(words, return_counts=True)
        repeats = [len(counts) / len(words), counts.max() / len(words)]
    else:
        repeats = [1.0, 0.0]
    return np.concatenate([
        np.sqrt(values / n), np.sqrt(moves / n), np.sqrt(lengths / max(1, len(words))),
        repeats, [np.log1p(len(text)) / 10, np.log1p(len(words)) / 10]])


@dataclass
class Ranker:
    """score = 1 / (1 + exp(-(slope * (weights . x - cut) + logit(ACCEPT))))."""
    weights: np.ndarray
    cut: float
    slope: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        # row by row, so that equal texts have equal scores wherever they are
        z = self.slope * ((x * self.weights).sum(1) - self.cut)
        z = np.clip(z + np.log(ACCEPT / (1 - ACCEPT)), -500, 500)
        return 1 / (1 + np.exp(-z))


#: Rows of training data that are in double precision at a time.
_PART = 1024


@dataclass
class Block:
    """Training texts of both labels that meet. The first `own` ones of each side are
    counted here, the others in another block."""
    good: np.ndarray
    bad: np.ndarray
    own: tuple[int, int]

    def parts(self) -> Iterator[tuple[np.ndarray, int]]:
        """The own texts in double precision, and their label."""
        for x, n, label in ((self.good, self.own[0], 1), (self.bad, self.own[1], 0)):
            for at in range(0, n, _PART):
                yield x[at:min(n, at + _PART)].astype(float), label

    def pairs(self, opponents: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (good, bad) of different comparisons: every text of the larger side
        with `opponents` of the other, or all of them."""
        n = sorted((len(self.good), len(self.bad)))
        each = min(n[0], opponents)
        many = np.repeat(np.arange(n[1]), each)
        few = (many + np.tile(np.arange(each), n[1]) * (n[0] // max(1, each))) % max(1, n[0])
        return (many, few) if len(self.good) >= len(self.bad) else (few, many)


class Blocks:
    """Blocks in memory."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks

    def total(self, of: Callable[[Block], list]) -> list:
        """The sums of a list of figures over all blocks."""
        return reduce(_add, map(of, self.blocks))

    def sorted_at(self, of: Callable[[Block], np.ndarray], places: list[int]) -> list[float]:
        """The values at some places of all values in order."""
        values = np.sort(np.concatenate([*map(of, self.blocks)]))
        return [float(values[k]) for k in places]


class SharedBlocks(Blocks):
    """Blocks that Spark holds; sums travel up a tree."""

    def __init__(self, blocks: RDD):
        self.blocks = blocks

    def total(self, of: Callable[[Block], list]) -> list:
        def run(blocks: Iterator[Block]) -> Iterator[list]:
            sums = None
            for block in blocks:
                sums = of(block) if sums is None else _add(sums, of(block))
            return iter([] if sums is None else [sums])

        return self.blocks.mapPartitions(run).treeReduce(_add)

    def sorted_at(self, of: Callable[[Block], np.ndarray], places: list[int]) -> list[float]:
        wanted = set(places)
        found = dict(self.blocks.flatMap(lambda block: of(block).tolist()).sortBy(
            lambda v: v).zipWithIndex().filter(lambda v: v[1] in wanted).map(
            lambda v: (v[1], v[0])).collect())
        return [found[k] for k in places]


def _add(a: list, b: list) -> list:
    return [x + y for x, y in zip(a, b)]


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS) -> Ranker:
    """The ranker of texts in memory, from `pairs` comparisons or more, if there are as
    many different ones.

    Without both labels there is nothing to compare: every text then scores the label
    that there is, or 1 without labels.
    """
    good, bad = x[y == 1], x[y == 0]
    return fit_blocks(Blocks([Block(good, bad, (len(good), len(bad)))]),
                      len(good), len(bad), x.shape[1], pairs)


def fit_blocks(blocks: Blocks, n_good: int, n_bad: int, width: int = FEATURES,
               pairs: int = PAIRS) -> Ranker:
    """Bradley-Terry weights by Newton steps over the comparisons of all blocks, which
    own `n_good` and `n_bad` texts."""
    if not n_good or not n_bad:
        return Ranker(np.zeros(width), 0, 0, float(n_good > 0 or not n_bad))
    n = n_good + n_bad
    opponents = max(OPPONENTS, -(-pairs // max(n_good, n_bad)))

    def moments(block: Block) -> list:
        return reduce(_add, ([part.sum(0), (part ** 2).sum(0)] for part, _ in block.parts()),
                      [np.zeros(width), np.zeros(width)])

    first, second = blocks.total(moments)
    spread = np.sqrt(np.maximum(second / n - (first / n) ** 2, 0)) + 1e-3

    def state(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, slope and curvature at these weights."""
        def sums(block: Block) -> list:
            won, lost = block.pairs(opponents)
            out = [len(won), 0.0, np.zeros(width), np.zeros((width, width))]
            for at in range(0, len(won), _PART):
                own = slice(at, at + _PART)
                d = (block.good[won[own]].astype(float) - block.bad[lost[own]]) / spread
                z = d @ w
                p = 1 / (1 + np.exp(np.clip(z, -500, 500)))
                out = _add(out, [0, np.logaddexp(0, -z).sum(), -(d.T @ p),
                                 (d * (p * (1 - p))[:, None]).T @ d])
            return out

        many, loss, slope, curve = blocks.total(sums)
        return (loss / many + PENALTY / 2 * w @ w, slope / many + PENALTY * w,
                curve / many + PENALTY * np.eye(width))

    w = np.zeros(width)
    now, slope, curve = state(w)
    for _ in range(30):
        step, size = np.linalg.solve(curve, slope), 1.0
        after = state(w - step)
        while after[0] > now and size > 1e-4:
            size /= 2
            after = state(w - size * step)
        w = w - size * step
        now, slope, curve = after
        if np.abs(size * step).max() < 1e-6:
            break

    def raw_scores(block: Block) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[
            (part / spread) @ w for part, _ in block.parts()]])

    place = n_bad / n * (n - 1)
    low, high = blocks.sorted_at(raw_scores, [int(place), min(int(place) + 1, n - 1)])
    cut = low + (high - low) * (place - int(place))
    # one parameter left: how steeply the score rises around the quantile
    slopes = np.geomspace(0.05, 20, 60)

    def losses(block: Block) -> list:
        return reduce(_add, ([np.logaddexp(0, -(2 * label - 1) * (
            slopes[:, None] * ((part / spread) @ w - cut) + np.log(ACCEPT / (1 - ACCEPT)))
        ).sum(1)] for part, label in block.parts()), [np.zeros(len(slopes))])

    best = slopes[np.argmin(blocks.total(losses)[0])]
    return Ranker(w / spread, cut, float(best))


def held_out(doc_id: Column | None = None) -> Column:
    """The contract's fold: crc32 of the id as text, remainder 2 by 4."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in sliced(whole, "text"):
            x = [features(t).astype("<f4").tobytes() for t in
                 rows_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(x, pa.binary())], ["doc_id", "x"])


def _matrix(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f4").reshape(-1, FEATURES)


def _blocks(rows: DataFrame, n_good: int, n_bad: int) -> DataFrame:
    """Training texts (doc_id, quality, x) dealt into rows (good, bad, own_good, own_bad).

    Texts of the more frequent label are in one block; of the other one, each block has
    about `OTHERS` at least, or all there are, so a text can be in several.
    """
    many, few = max(n_good, n_bad), min(n_good, n_bad)
    n = -(-many // BLOCK)
    copies = min(n, -(-n * OTHERS // few))
    of_many = F.col("quality") == int(n_good >= n_bad)
    dealt = rows.withColumn("hash", F.xxhash64("doc_id", "x")).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.when(of_many, 0).otherwise(copies - 1)))
    ).withColumn("block", F.pmod(F.pmod("hash", F.lit(n)) + F.col("copy"), F.lit(n)))

    def pack(table: pa.Table) -> pa.Table:
        quality, copy = (table.column(c).to_numpy() for c in ("quality", "copy"))
        order = np.lexsort((table.column("hash").to_numpy(), copy > 0))
        x = table.column("x").to_pylist()
        sides = [[k for k in order if quality[k] == label] for label in (1, 0)]
        return pa.table({
            "good": pa.array([b"".join(x[k] for k in sides[0])], pa.binary()),
            "bad": pa.array([b"".join(x[k] for k in sides[1])], pa.binary()),
            "own_good": pa.array([int((copy[sides[0]] == 0).sum())], pa.int64()),
            "own_bad": pa.array([int((copy[sides[1]] == 0).sum())], pa.int64())})

    return dealt.select("block", "quality", "copy", "hash", "x").groupBy(
        "block").applyInArrow(pack, "good binary, bad binary, own_good long, own_bad long")


def _training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, quality, x) of the texts with a label outside the held-out fold.

    Texts are described where they lie; what moves is their descriptions, in the same
    way whatever the number of labels.
    """
    used = labels.where("quality in (0, 1) and doc_id is not null").where(
        ~held_out()).select(F.col("doc_id").alias("label_id"),
                            F.col("quality").cast("int").alias("quality"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    described = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select(
        "doc_id", "text").mapInArrow(_describe, f"doc_id {kind}, x binary")
    return described.join(used.hint("merge"), F.col("doc_id") == F.col("label_id")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "quality", "x")


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Fit on all texts of `docs` with a label (doc_id, quality 0 or 1) outside the
    held-out fold."""
    rows = stored(_training_rows(docs, labels))
    counts = {r.quality: r["count"] for r in rows.groupBy("quality").count().collect()}
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    if not n_good or not n_bad:
        discard(rows)
        return fit_blocks(Blocks([]), n_good, n_bad)
    blocks = stored(_blocks(rows, n_good, n_bad))
    ranker = fit_blocks(SharedBlocks(blocks.rdd.map(lambda r: Block(
        _matrix(r.good), _matrix(r.bad), (r.own_good, r.own_bad)))), n_good, n_bad)
    discard(rows, blocks)
    return ranker


def _scored(shared, batch: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([
        shared.value.score(np.array([features(t) for t in rows_of(part.column("text"))]))
        for part in sliced(batch, "text")] or [np.zeros(0)])


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id and score of each row of `docs` (doc_id, text).

    A null text is empty; an empty text is scored like any other. Repeated rows and rows
    without doc_id have scores of their own. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranker)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(_scored(shared, batch))],
                ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def accepted(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of `docs` that score at least `ACCEPT`, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(shared, batch) >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"))

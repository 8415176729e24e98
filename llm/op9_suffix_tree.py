"""Language-model scores from a probabilistic suffix tree.

A text is the sequence of its words (runs without ASCII white space, A-Z as a-z) joined
by single blanks and closed by an end symbol. The tree predicts this sequence byte by
byte. A context of up to `DEPTH` bytes becomes a state if it occurs `STATE_COUNT` times and
if its next symbols diverge from those of the context one byte shorter: the log-likelihood
gain is at least `GAIN` nats. All suffixes of a state are states, and so are contexts of one
and two bytes. The next-symbol distribution of a state is smoothed with that of its suffix,
and a position is scored by its longest suffix state. The least counts do not depend on the
corpus, so the tree grows with it.

Beyond `WHOLE` distinct grams the tree is never in one place. What it says of a position
depends on contexts that end in the same bytes, so the grams are dealt out by the latest
three bytes of their contexts, and each task builds the part of the tree for its own. The
values of the most frequent positions (`HOT` at most) are looked up where the text is; the
other positions are joined in Spark with values that those parts give to their distinct ones.

The base score of whole words needs the count of every word. Frequent words (a share of
at least `WORD_SHARE`, so a bounded number) are looked up where the text is; the other
words are joined with the counts in Spark, which cannot be skewed since none is frequent.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bytescan import BLANK, range_hashes, rows_of, sliced, word_bounds
from llm.common import stored

DEPTH = 6
#: Least count of a state, and of a symbol in a state.
STATE_COUNT = 16
SYMBOL_COUNT = 2
WORD_SHARE = 2e-7
GAIN = 10.0
#: Weight of the suffix's distribution, in counts.
PRIOR = 16.0
#: Distinct keys that a counting task holds before it merges or hands them on.
HELD = 1 << 20
#: Distinct grams up to which the tree is built in one piece.
WHOLE = 1 << 20
#: Distinct grams that a task holds before it builds the part of the tree for them.
PART = 1 << 19
#: Positions that are looked up where the text is, at most, if it is not.
HOT = 1 << 21
#: Slots of the table of these.
SLOTS = 1 << 22
#: Bytes of context that parts of the tree share: contexts shorter than that are in all of them.
SHARED = 3

_END = b"\n"
_HEAD = _END * DEPTH
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Slice:
    """Some texts as one byte stream, each behind a head of end symbols."""
    stream: np.ndarray
    starts: np.ndarray  # of the texts' own symbols
    ends: np.ndarray    # exclusive, the end symbol is the last

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word and the text that it is in."""
        low, high = word_bounds(self.stream, BLANK)
        return (range_hashes(self.stream, low, high),
                np.searchsorted(self.starts, low, "right") - 1)

    def codes(self) -> np.ndarray:
        """Of each text's own positions: the symbol in the lowest byte, before it the
        DEPTH symbols of its context, latest first."""
        code = self.stream.astype(np.uint64)
        out = code.copy()
        for back in range(1, DEPTH + 1):
            out[back:] |= code[:-back] << np.uint64(8 * back)
        own = np.ones(len(out), bool)
        own[(self.starts[:, None] - 1 - np.arange(DEPTH)).ravel()] = False
        return out[own]


def as_slice(texts: list[bytes]) -> Slice:
    lines = [b" ".join(t.lower().split()) for t in texts]
    sizes = np.array([len(line) + 1 for line in lines], np.int64)
    ends = np.cumsum(sizes + DEPTH)
    stream = np.frombuffer(b"".join([_HEAD + line + _END for line in lines]), np.uint8)
    return Slice(stream, ends - sizes, ends)


def tally(keys: np.ndarray, counts: np.ndarray | None = None
          ) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their (summed) counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is not None:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    else:
        keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: words, 1: grams of DEPTH + 1 symbols, 2: texts."""
    def out(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), kind, np.int32)),
             pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))],
            ["kind", "key", "n"])

    def merged(kind: int) -> None:
        if found[kind]:
            found[kind] = [tally(np.concatenate([k for k, _ in found[kind]]),
                                 np.concatenate([n for _, n in found[kind]]))]

    def size(kind: int) -> int:
        return sum(len(k) for k, _ in found[kind])

    found: dict[int, list] = {0: [], 1: []}
    for whole in batches:
        for batch in sliced(whole, "text"):
            part = as_slice([t.tobytes() for t in rows_of(batch.column("text"))])
            found[0].append(tally(part.words()[0]))
            found[1].append(tally(part.codes()))
            for kind in found:
                if size(kind) > HELD:
                    merged(kind)
                    if size(kind) > HELD // 2:
                        yield out(kind, *found[kind].pop())
        yield out(2, np.zeros(1, np.uint64), np.array([whole.num_rows]))
    for kind in found:
        merged(kind)
        if found[kind]:
            yield out(kind, *found[kind].pop())


def count(docs: DataFrame) -> DataFrame:
    """kind, key, n over all texts of `docs`, stored."""
    return stored(docs.select("text").mapInArrow(_count, "kind int, key long, n long")
                  .groupBy("kind", "key").agg(F.sum("n").alias("n")))


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray]:
    """Which of `wanted` are among the sorted keys, and the values of those."""
    if not len(keys):
        return np.zeros(len(wanted), bool), values[:0]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return found, values[at[found]]


def levels_of(codes: np.ndarray, counts: np.ndarray, first: int, last: int = DEPTH) -> list:
    """Grams of first + 1 to last + 1 symbols, sorted, with their counts."""
    return [tally(codes & np.uint64((1 << 8 * (d + 1)) - 1), counts)
            for d in range(first, last + 1)]


class Table:
    """Positions with their log10, looked up by hash."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.values = codes[order], values[order]
        self.slots = np.zeros(SLOTS if len(codes) else 1, np.int32)
        if len(codes):
            self.slots[self._slot(self.codes)] = np.arange(len(codes), dtype=np.int32)

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        shift = np.uint64(64 - (SLOTS.bit_length() - 1))
        return ((codes * _SPREAD) >> shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which positions are in the table, and the value of each, 0 for the others."""
        out = np.zeros(len(codes))
        if not len(self.codes):
            return np.zeros(len(codes), bool), out
        at = self.slots[self._slot(codes)]
        found = self.codes[at] == codes
        out[found] = self.values[at[found]]
        left = np.flatnonzero(~found)  # their slot may be another's
        there, value = _lookup(self.codes, self.values, codes[left])
        found[left[there]] = True
        out[left[there]] = value
        return found, out


class Tree:
    """States and smoothed distributions; `grams[d]` has all grams of d + 1 symbols as
    (sorted codes, counts).

    Of the grams of more than `SHARED` symbols it may get those of some contexts only, all
    that end in the same `SHARED` bytes; it then speaks of positions behind these.
    """

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], whole: bool = True):
        root = np.full(256, 1.0)
        root[grams[0][0].astype(np.int64)] += grams[0][1]
        root /= root.sum()
        self.root = np.log10(root)
        self.pairs: list = [None]    # per depth: codes and log10 of probabilities
        self.states: list = [None]   # per depth: codes and log10 of the suffix's share
        chances = [root]
        levels = []
        for depth in range(1, len(grams)):
            codes, counts = grams[depth]
            names, owner = np.unique(codes >> np.uint64(8), return_inverse=True)
            times = np.bincount(owner, counts, len(names))
            listed = counts >= SYMBOL_COUNT
            codes, counts = codes[listed], counts[listed]
            seen, owner = np.unique(owner[listed], return_inverse=True)
            names, times = names[seen], times[seen]
            mass = np.bincount(owner, counts, len(names))
            rest = times - mass  # rare symbols, left to the suffix
            short = codes & np.uint64((1 << 8 * depth) - 1)
            lower = (chances[0][short.astype(np.int64)] if depth == 1 else
                     chances[-1][np.searchsorted(levels[-1][0], short)])
            share = (counts + PRIOR * lower) / (mass + rest + PRIOR)[owner]
            # the symbols that the state doesn't list share the remainder like the suffix
            others = np.maximum(1 - np.bincount(owner, lower, len(names)), 1e-9)
            back = (rest / others + PRIOR) / (mass + rest + PRIOR)
            gain = np.bincount(owner, counts * np.log(share / lower), len(names))
            levels.append((codes, owner, names, gain, mass, back, share))
            chances.append(share)
        # a state keeps its suffixes: walk from the deepest contexts up
        needed = np.zeros(0, np.uint64)
        wanted: list[np.ndarray] = []
        for depth in range(len(grams) - 1, 0, -1):
            _, _, names, gain, mass, _, _ = levels[depth - 1]
            good = ((mass >= STATE_COUNT) & (gain >= GAIN)) | (depth < SHARED)
            wanted.append(good | np.isin(names, needed))
            needed = np.unique(names[wanted[-1]]
                               & np.uint64((1 << 8 * (depth - 1)) - 1))
        lower_states = np.zeros(0, np.uint64)
        for depth in range(1, len(grams)):
            codes, owner, names, _, _, back, share = levels[depth - 1]
            keep = wanted[-depth]
            if depth > 1:
                # the suffix must have its own frequent symbols to be a state
                keep = keep & np.isin(names & np.uint64((1 << 8 * (depth - 1)) - 1),
                                      lower_states)
            lower_states = names[keep]
            pair = keep[owner]
            self.pairs.append((codes[pair], np.log10(share[pair])))
            self.states.append((names[keep], np.log10(back[keep])))
        deepest = grams[-1][0]
        self.known = Table(deepest, self._walk(deepest)) if whole else None

    def _walk(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each position, by its longest suffix state."""
        out = np.zeros(len(codes))
        left = np.arange(len(codes))
        for depth in range(len(self.pairs) - 1, 0, -1):
            if not len(left):
                return out
            own = codes[left] & np.uint64((1 << 8 * (depth + 1)) - 1)
            found, value = _lookup(*self.pairs[depth], own)
            out[left[found]] += value
            left, context = left[~found], own[~found] >> np.uint64(8)
            found, value = _lookup(*self.states[depth], context)
            out[left[found]] += value
        out[left] += self.root[(codes[left] & np.uint64(255)).astype(np.int64)]
        return out

    def log10(self, codes: np.ndarray) -> np.ndarray:
        found, out = self.known.find(codes)
        out[~found] = self._walk(codes[~found])
        return out


def _parts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (unit, key, n, wanted) come sorted by unit; values of the wanted keys."""
        def close(rows: list[np.ndarray]) -> pa.RecordBatch:
            _, key, n, wanted = rows
            own = n > 0
            tree = Tree([*shared.value, *levels_of(key[own], n[own], SHARED)], False)
            return pa.RecordBatch.from_arrays(
                [pa.array(key[wanted].view(np.int64)), pa.array(tree._walk(key[wanted]))],
                ["key", "value"])

        held: list[list[np.ndarray]] = []
        size, limit = 0, PART
        for batch in batches:
            held.append([batch.column("unit").to_numpy(),
                         batch.column("key").to_numpy().view(np.uint64),
                         batch.column("n").to_numpy(),
                         batch.column("wanted").to_numpy(zero_copy_only=False)])
            size += batch.num_rows
            if size > limit:
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(rows[0], rows[0][-1]))
                if cut:
                    yield close([c[:cut] for c in rows])
                held = [[c[cut:].copy() for c in rows]]
                size -= cut
                limit = max(PART, 2 * size)
        if size:
            yield close([np.concatenate(c) for c in zip(*held, strict=True)])
    return run


def values(rows: DataFrame, low: list) -> DataFrame:
    """key, value (log10) of the wanted among `rows` (key, n, wanted), which hold all
    training grams; `low` has those of up to SHARED symbols.

    A task holds the grams of one context of SHARED bytes at least.
    """
    unit = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * SHARED) - 1))
    return (rows.select(unit.cast("int").alias("unit"), "key", "n", "wanted")
            .repartition("unit").sortWithinPartitions("unit")
            .mapInArrow(_parts(rows.sparkSession.sparkContext.broadcast(low)),
                        "key long, value double"))


def _low(grams: DataFrame) -> list:
    """All grams of up to SHARED symbols; the alphabet bounds their number."""
    got = (grams.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * SHARED) - 1)).alias("key"))
           .agg(F.sum("n").alias("n"))).toArrow()
    return levels_of(got.column("key").to_numpy().view(np.uint64),
                     got.column("n").to_numpy(), 0, SHARED - 1)


def grow(counts: DataFrame) -> tuple[Tree | None, Table, list]:
    """The tree if the counted grams are few, else the values of the most frequent
    positions and the grams of up to SHARED symbols."""
    grams = counts.where("kind = 1").select("key", "n")
    often = sorted(grams.groupBy(F.least("n", F.lit(1 << 20)).alias("n"))
                   .agg(F.count("*").alias("grams")).collect(), reverse=True)
    if sum(r.grams for r in often) <= WHOLE:
        got = grams.toArrow()
        tree = Tree(levels_of(got.column("key").to_numpy().view(np.uint64),
                              got.column("n").to_numpy(), 0))
        return tree, tree.known, []
    low, held, least = _low(grams), 0, (1 << 62)
    for r in often:
        held += r.grams
        if held > HOT:
            break
        least = r.n
    got = values(grams.withColumn("wanted", F.col("n") >= least), low).toArrow()
    return None, Table(got.column("key").to_numpy().view(np.uint64),
                       got.column("value").to_numpy()), low


@dataclass
class Model:
    tree: Tree | None   # if it is in one piece
    known: Table        # values of frequent positions
    low: list           # grams that all parts of a tree in parts share
    words: np.ndarray   # hashes of the frequent words, sorted
    counts: np.ndarray
    texts: int


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        logs = np.log10(model.counts + 1.0)
        for whole in batches:
            for batch in sliced(whole, "text"):
                part = as_slice([t.tobytes() for t in rows_of(batch.column("text"))])
                n = len(part.starts)
                words, owner = part.words()
                known = np.zeros(len(words), bool)
                if len(model.words) and len(words):
                    at = np.minimum(np.searchsorted(model.words, words),
                                    len(model.words) - 1)
                    known = model.words[at] == words
                    base = np.bincount(owner[known], logs[at[known]], n)
                else:
                    base = np.zeros(n)
                tokens = np.bincount(owner, minlength=n) + 1
                found = np.bincount(owner[known], minlength=n) + (model.texts > 0)
                rare = ~known
                ends = np.zeros(n + 1, np.int32)
                np.cumsum(np.bincount(owner[rare], minlength=n), out=ends[1:])
                sizes = part.ends - part.starts
                first, codes = np.cumsum(sizes) - sizes, part.codes()
                there, value = model.known.find(codes)
                if model.tree is not None:
                    value[~there] = model.tree._walk(codes[~there])
                    there[:] = True
                score = np.add.reduceat(value, first)
                late = np.zeros(n + 1, np.int32)
                np.cumsum(np.add.reduceat((~there).astype(np.int32), first), out=late[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(tokens), pa.array(found),
                     pa.array(base + np.log10(model.texts + 1.0)), pa.array(score),
                     pa.ListArray.from_arrays(pa.array(ends),
                                              pa.array(words[rare].view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(late),
                                              pa.array(codes[~there].view(np.int64)))],
                    ["doc_id", "n_tokens", "n_known", "base", "score", "rare", "late"])
    return run


def fit(training: DataFrame) -> tuple[Model, DataFrame, int, int]:
    """The model, all counts, and of the training tokens: how many, how many distinct."""
    counts = count(training)
    texts = counts.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    words = counts.where("kind = 0")
    n, v = words.agg(F.sum("n"), F.count("*")).first()
    n, v = (n or 0) + texts, v + (texts > 0)
    frequent = words.where(F.col("n") >= WORD_SHARE * n).select("key", "n").toArrow()
    keys = frequent.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return (Model(*grow(counts), keys[order],
                  frequent.column("n").to_numpy()[order].astype(float), texts),
            counts, n, v)


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): n_tokens, n_known, train_tokens, base_score,
    score (log10).

    Null and empty texts are the end symbol alone. Without training texts all 256 symbols
    are equally likely and no word is known. Rows are scored one by one, repeated ones
    and those without doc_id too; other columns are ignored.
    """
    model, counts, n, v = fit(training)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.select("doc_id", "text").mapInArrow(
        _score(shared), f"doc_id {kind}, n_tokens long, n_known long, base double, "
        "score double, rare array<long>, late array<long>")
        .withColumn("row", F.monotonically_increasing_id()))
    rare = (rows.select("row", F.explode("rare").alias("key"))
            .join(counts.where((F.col("kind") == 0) & (F.col("n") < WORD_SHARE * n)
                               ).select("key", "n"), "key")
            .groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"),
                                F.count("*").alias("seen")))
    zero = F.lit(0)
    out = rows.drop("rare", "late").join(rare, "row", "left")
    if model.tree is None:
        late = rows.select("row", F.explode("late").alias("key"))
        asked = (counts.where("kind = 1").select("key", "n", F.lit(False).alias("wanted"))
                 .unionByName(late.select("key").distinct().select(
                     "key", F.lit(0).cast("long").alias("n"), F.lit(True).alias("wanted"))))
        sums = late.join(values(asked, model.low), "key").groupBy("row").agg(
            F.sum("value").alias("rest"))
        out = out.join(sums, "row", "left").withColumn(
            "score", F.col("score") + F.coalesce("rest", F.lit(0.0)))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("seen", zero)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))
         - F.col("n_tokens") * float(np.log10(n + v + 1.0))).alias("base_score"), "score")


def held_out() -> Column:
    """The contract's fold: crc32 of the id as text, remainder 2 by 7."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all `documents`, learnt from those outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, docs.where(~held_out())).withColumn("held_out", held_out())

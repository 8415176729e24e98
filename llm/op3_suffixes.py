"""Removing repeated strings with a sparse suffix array, built by a distributed merge sort.

A byte goes if a `LENGTH`-byte string that covers it starts anywhere else. Of each window
of `LENGTH` bytes the `GRAM`-byte substring with the lowest hash is its anchor, so equal
windows have equal anchors at equal places, and it is enough to sort the suffixes that
start at anchors, each with the bytes before it. Anchors that occur once are dropped first.

A task sorts the suffixes of its texts into runs. Runs are exchanged front-coded: each
suffix (and what precedes it) as the length of the prefix shared with the one before and
the rest; equal ones are one entry. A loser tree merges the runs of a partition. It carries
the common prefix of each run's head with the last suffix given out, so bytes known to be
equal are never compared again, and the common prefixes of neighbours in the merged order
come for free. They say how far the suffixes of one anchor agree to the right; sorting
what precedes them says how far they agree to the left; both together say which windows
around the anchor occur twice.

Equal texts are sorted once: their windows all repeat. An anchor with more than `HOT`
places is dealt out further: the windows that start 0 to 200 bytes before it are cut into
`CUTS` ranges, and the windows of a range that can be equal share the bytes that all of
them cover, so the hash of these bytes names the partition.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bytescan import _tables, mix, rows_of
from llm.common import stored

LENGTH = 400
GRAM = 200
#: Raw bytes of suffixes that a task sorts into one run.
RUN_BYTES = 24 << 20
#: Places of an anchor beyond which it is dealt out by what surrounds it.
HOT = 20_000
CUTS = 8
#: Anchors with more than one place in MANY of all are broadcast, at most MANY of them.
MANY = 10_000
#: Places of anchors behind one part of the merge, about.
PART_PLACES = 250_000
#: Bytes of a text in which anchors are sought at a time.
STRIDE = 1 << 20


def anchors(text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text, for all windows of `length`."""
    places, hashes = [], []
    width = length - gram + 1
    # consecutive parts overlap by all but one byte of a window
    for at in range(0, max(0, len(text) - length + 1), STRIDE):
        part = text[at:at + STRIDE + length - 1]
        powers, inverse = _tables(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[:len(part)],
                  out=total[1:])
        own = mix((total[gram:] - total[:-gram]) * inverse[:len(part) - gram + 1])
        # lowest hash of each window: of a block's tail and the next block's head
        filled = np.full(-(-len(own) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        filled[:len(own)] = own
        block = filled.reshape(-1, width)
        head = np.minimum.accumulate(block, 1).ravel()
        tail = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
        windows = len(own) - width + 1
        low = np.minimum(tail[:windows], head[width - 1:width - 1 + windows])
        found = np.flatnonzero(np.isin(own, low[np.flatnonzero(np.diff(
            low, prepend=~low[:1]))]))
        places.append(found + at)
        hashes.append(own[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


def shared_prefixes(strings: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each string with the one before; 0 for the first."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    wide = max(1, int(sizes.max()))
    grid = np.frombuffer(b"".join([s.ljust(wide, b"\0") for s in strings]), np.uint8)
    grid = grid.reshape(-1, wide)
    out = np.zeros(len(strings), np.int64)
    for at in range(1, len(strings), 16384):
        end = min(at + 16384, len(strings))
        differ = grid[at:end] != grid[at - 1:end - 1]
        out[at:end] = np.where(differ.any(1), differ.argmax(1), wide)
    out[1:] = np.minimum(out[1:], np.minimum(sizes[1:], sizes[:-1]))
    return out


def front_coded(entries: dict[tuple[bytes, bytes], list[bytes]]) -> list[bytes]:
    """A sorted run: prefix lengths and sizes, rests, counts of places, places."""
    order = sorted(entries)
    columns, rests = [], []
    for side in zip(*order, strict=True):
        shared = shared_prefixes(side)
        columns += [shared, np.fromiter(map(len, side), np.int64, len(side)) - shared]
        rests.append([s[n:] for s, n in zip(side, shared.tolist(), strict=True)])
    places = [entries[e] for e in order]
    return [np.stack(columns, 1).astype("<u2").tobytes(),
            b"".join([r for both in zip(*rests, strict=True) for r in both]),
            np.array([len(p) for p in places], "<u4").tobytes(),
            b"".join([x for p in places for x in p])]


def decoded(sizes: bytes, rests: bytes, counts: bytes, places: bytes
            ) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(prefix shared with the entry before, suffix, what precedes, places) in order."""
    after = before = b""
    at = spot = 0
    for (a, b, c, d), n in zip(np.frombuffer(sizes, "<u2").reshape(-1, 4).tolist(),
                               np.frombuffer(counts, "<u4").tolist(), strict=True):
        after = after[:a] + rests[at:at + b]
        before = before[:c] + rests[at + b:at + b + d]
        at += b + d
        yield a, after, before, places[spot:spot + n * PLACE]
        spot += n * PLACE


PLACE = 20  # bytes: two 64-bit hashes of the text, 32-bit position


def _agree(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes need no comparison."""
    most = min(len(a), len(b))
    while known < most and a[known:known + 64] == b[known:known + 64]:
        known += 64
    while known < most and a[known] == b[known]:
        known += 1
    return min(known, most)


def merge(runs: list[Iterator]) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """The runs as one, in the order of the suffixes, by a loser tree.

    Each head carries what it shares with the last suffix given out. Of two heads the one
    that shares more is the smaller; only if they share alike are bytes compared, from
    there on.
    """
    n = len(runs)
    heads: list = [None] * n
    shared = [0] * n
    losers = [-1] * n

    def advance(r: int) -> None:
        heads[r] = next(runs[r], None)
        shared[r] = heads[r][0] if heads[r] else -1

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's share becomes that with the winner."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a][1], heads[b][1]
        both = _agree(x, y, shared[a])
        if x[both:both + 1] <= y[both:both + 1]:
            shared[b] = both
            return a, b
        shared[a] = both
        return b, a

    def build(node: int) -> int:
        if node >= n:
            return node - n
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    for r in range(n):
        advance(r)
        shared[r] = 0 if heads[r] else -1
    winner = build(1) if n > 1 else 0
    while heads[winner] is not None:
        yield shared[winner], *heads[winner][1:]
        advance(winner)
        node = (winner + n) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def repeated_windows(shared: np.ndarray, afters: list[bytes], befores: list[bytes],
                     weights: np.ndarray, length: int, gram: int
                     ) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes of one anchor, in order: the smallest and largest number of bytes
    before the anchor with which a window occurs twice; (1, 0) if none does.

    `shared` is the common prefix with the suffix before. All windows around an anchor
    share it, so their union reaches from the first to the last.
    """
    m, most = len(afters), length - gram
    right = np.fromiter(map(len, afters), np.int64, m)
    left = np.fromiter(map(len, befores), np.int64, m)
    order = np.array(sorted(range(m), key=befores.__getitem__))
    back = shared_prefixes([befores[k] for k in order.tolist()])
    # between these numbers neither side's classes nor the windows' existence change
    turns = np.unique(np.concatenate([
        [0], length - shared[1:], length - right, back[1:] + 1, left + 1]))
    turns = turns[(turns >= 0) & (turns <= most)]
    low, high = np.full(m, most + 1), np.full(m, -1)
    class_left = np.empty(m, np.int64)
    for begin, end in zip(turns.tolist(), [*turns[1:].tolist(), most + 1], strict=True):
        fits = (right >= length - begin) & (left >= begin)
        if not fits.any():
            continue
        class_right = np.cumsum(shared < length - begin)
        class_left[order] = np.cumsum(back < begin)
        _, which = np.unique((class_right * (m + 1) + class_left)[fits],
                             return_inverse=True)
        twice = np.flatnonzero(fits)[np.bincount(which, weights[fits])[which] > 1]
        low[twice] = np.minimum(low[twice], begin)
        high[twice] = end - 1
    none = high < 0
    low[none], high[none] = 1, 0
    return low, high


def _find_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            for k, text in enumerate(rows_of(batch.column("text"))):
                places, hashes = anchors(text, length, gram)
                if len(places):
                    n = len(places)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes.view(np.int64)), pa.array(np.full(n, h1[k])),
                         pa.array(np.full(n, h2[k])), pa.array(places.astype(np.int32))],
                        ["anchor", "h1", "h2", "place"])
    return run


def _gathered(run):
    """Small batches as larger ones, about 64k rows each."""
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in run(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 16:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return out


def _sorted_runs(length: int, gram: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = [{} for _ in range(parts)]
        size, starts = 0, length - gram + 1
        # apart, or a place would meet itself
        ranges = {n: [(c * starts // n, (c + 1) * starts // n - 1) for c in range(n)]
                  for n in (1, min(CUTS, starts))}
        ranges[CUTS] = ranges[min(CUTS, starts)]

        def flush() -> pa.RecordBatch:
            filled = [k for k in range(parts) if held[k]]
            coded = [front_coded(held[k]) for k in filled]
            for k in filled:
                held[k] = {}
            return pa.RecordBatch.from_arrays(
                [pa.array(filled, pa.int32()), *[pa.array([c[j] for c in coded],
                                                          pa.binary()) for j in range(4)]],
                ["part", "sizes", "rests", "counts", "places"])

        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            found = batch.column("found")
            for k, view in enumerate(rows_of(batch.column("text"))):
                text = view.tobytes()
                own = found[k].values
                name = np.array([h1[k], h2[k]], "<i8").tobytes()
                for place, part, cuts in zip(*[own.field(f).to_pylist() for f in (
                        "place", "part", "cuts")], strict=True):
                    ref = name + place.to_bytes(4, "little")
                    for low, high in ranges[cuts]:
                        if cuts > 1:
                            if place < low or place + length - high > len(text):
                                continue  # no window of this range
                            part = zlib.crc32(text[place - low:place + length - high]
                                              ) % parts
                        entry = (text[place:place + length - low],
                                 text[max(0, place - high):place][::-1])
                        held[part].setdefault(entry, []).append(ref)
                        size += len(entry[0]) + len(entry[1]) + 200
                    if size >= RUN_BYTES:
                        yield flush()
                        size = 0
        if size:
            yield flush()
    return run


def _merged(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part; a part's runs are merged together."""
        def ranges(runs: list[tuple]) -> Iterator[pa.RecordBatch]:
            def close() -> None:
                if len(group) > 1 or len(group[0][3]) > PLACE:
                    weights = np.array([len(g[3]) // PLACE for g in group])
                    low, high = repeated_windows(
                        np.array([g[0] for g in group]), [g[1] for g in group],
                        [g[2] for g in group], weights, length, gram)
                    for g, a, b in zip(group, low.tolist(), high.tolist(), strict=True):
                        if a <= b:
                            out.append((g[3], a, b))

            group, out, waiting = [], [], 0
            for entry in merge([decoded(*r) for r in runs]):
                if group and entry[0] < gram:
                    close()
                    waiting += len(group)
                    group = []
                    if waiting > 20_000:
                        yield from written(out)
                        out, waiting = [], 0
                group.append(entry)
            if group:
                close()
            yield from written(out)

        def written(out: list) -> Iterator[pa.RecordBatch]:
            if out:
                refs = np.frombuffer(b"".join([p for p, _, _ in out]), np.dtype(
                    [("h1", "<i8"), ("h2", "<i8"), ("place", "<u4")]))
                times = np.array([len(p) // PLACE for p, _, _ in out])
                low = np.repeat([a for _, a, _ in out], times)
                high = np.repeat([b for _, _, b in out], times)
                place = refs["place"].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(refs["h1"].copy()), pa.array(refs["h2"].copy()),
                     pa.array(place - high), pa.array(place - low + length)],
                    ["h1", "h2", "start", "end"])

        part, runs = None, []
        for batch in batches:
            for p, *row in zip(*[batch.column(c).to_pylist() for c in (
                    "part", "sizes", "rests", "counts", "places")], strict=True):
                if p != part:
                    yield from ranges(runs) if runs else ()
                    part, runs = p, []
                runs.append(row)
        if runs:
            yield from ranges(runs)
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for view, spans in zip(rows_of(batch.column("text")), batch.column("spans"),
                               strict=True):
            edges = np.zeros(len(view) + 1, np.int32)
            np.add.at(edges, spans.values.field("start").to_numpy(), 1)
            np.add.at(edges, spans.values.field("end").to_numpy(), -1)
            gone = np.cumsum(edges[:-1]) > 0
            runs = int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=0) == 1))
            rows.append((int(gone.sum()), runs,
                         hashlib.sha256(view[~gone].tobytes()).hexdigest()))
        removed, spans, kept = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("h1"), batch.column("h2"), pa.array(removed, pa.int64()),
             pa.array(spans, pa.int64()), pa.array(kept, pa.string())],
            ["h1", "h2", "n_removed", "n_spans", "kept_sha256"])


def parts_for(spark: SparkSession, places: int) -> int:
    """Parts of the merge: they grow with the places, so that a part's runs do not."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-places // PART_PLACES))


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT
            ) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 of the bytes that stay.

    Removed is each byte covered by a string of `length` bytes that starts anywhere else
    in any row. Null texts are empty. Repeated rows are copies of each other. A row
    without doc_id is compared and cut like any other. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").alias("size"))
    found = rows.where(F.col("size") >= length).select("h1", "h2", "text").mapInArrow(
        _gathered(_find_anchors(length, gram)),
        "anchor long, h1 long, h2 long, place int")
    found = stored(found)
    # an anchor is repeated if it has two places, copies of one text being one
    spot = F.xxhash64("h1", "h2", "place")
    repeated = stored(found.groupBy("anchor").agg(
        F.min(spot).alias("a"), F.max(spot).alias("b"), F.count("*").alias("n")
    ).where("a <> b").select("anchor", "n", F.when(F.col("n") > hot, CUTS).otherwise(1)
                             .alias("cuts")))
    places = found.count()
    parts = parts_for(spark, places)
    part = F.pmod(F.col("anchor"), F.lit(parts)).cast("int")
    # The rows of an anchor with very many places stay where they are.
    many = F.col("n") > places // MANY
    marked = found.join(F.broadcast(repeated.where(many).drop("n")), "anchor", "left")
    known = marked.where("cuts is not null").unionByName(
        marked.where("cuts is null").drop("cuts").join(
            repeated.where(~many).drop("n"), "anchor"))
    wanted = (known.groupBy("h1", "h2")
              .agg(F.collect_set(F.struct("place", part.alias("part"), "cuts"))
                   .alias("found")))
    copies = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"),
                                          F.count("*").alias("copies"))
    wanted = wanted.join(copies, ["h1", "h2"]).select(
        F.col("h1").alias("w1"), F.col("h2").alias("w2"), "first", "copies", "found")
    texts = stored(rows.join(
        wanted, F.col("doc_id").eqNullSafe(F.col("first"))
        & (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2")))
        .select("h1", "h2", "copies", "text", "found"))
    runs = texts.select("h1", "h2", "text", "found").mapInArrow(
        _sorted_runs(length, gram, parts),
        "part int, sizes binary, rests binary, counts binary, places binary")
    ranges = (runs.repartition(parts, "part").sortWithinPartitions("part")
              .mapInArrow(_merged(length, gram), "h1 long, h2 long, start long, end long"))
    spans = ranges.groupBy("h1", "h2").agg(
        F.collect_set(F.struct("start", "end")).alias("spans"))
    cut = (texts.where("copies = 1").select("h1", "h2", "text").join(spans, ["h1", "h2"])
           .mapInArrow(_cut, "h1 long, h2 long, n_removed long, n_spans long, "
                       "kept_sha256 string"))
    several = copies.where("copies > 1").select("h1", "h2", F.lit(True).alias("several"))
    whole = F.coalesce(F.col("several") & (F.col("size") >= length), F.lit(False))
    return (rows.select("doc_id", "h1", "h2", "size", F.sha2("text", 256).alias("all"))
            .join(several, ["h1", "h2"], "left").join(cut, ["h1", "h2"], "left").select(
        "doc_id", F.col("size").cast("long").alias("n_bytes"),
        F.when(whole, F.col("size")).otherwise(F.coalesce("n_removed", F.lit(0)))
        .cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long")
        .alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "all"))
        .alias("kept_sha256")))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of `documents` without repeated strings of 400 bytes."""
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))

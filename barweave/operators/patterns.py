"""Search of all history for windows whose shape resembles a query.

Windows are cut inside segments of at most SEGMENT_ROWS bars plus context, so
the arrays stay small whatever a symbol's history. Up to LOT queries go to where the
library lies: a task reads its windows batch by batch and keeps the best M per query.
More queries are dealt into lots of bounded size and the library into pieces; a piece
and a lot are one unit of work, which keeps the best M windows per query too.

M = k * (2 * gap - 1) is enough for an exact choice of k windows: a chosen
window rules out at most 2 * (gap - 1) others, so among the best M windows
the greedy choice either reaches k or would have ended there anyway.

Few windows of a unit are compared with a query point by point. The means of
COARSE segments, and the norm of what they leave out, bound the similarity from
above. The M windows with the best means are compared first; a window whose bound
is below the worst of them, or of M windows read before, is none of the best M.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.functions.arrays import (
    FLAT, dot, mean, relative_path, resample, spread, standardize,
)
from barweave.functions.dates import iso_text
from barweave.functions.rounding import round_scaled
from barweave.operators.panel import (
    SEGMENT_ROWS, last_bars, number_bars, with_context,
)

# The defaults of the search.
STEP = 5
HORIZON = 20
CHECKS = (5, 10, 20)
FAN = (10, 25, 50, 75, 90)
MIN_MATCHES = 10
# Queries and windows that meet in one unit of work, about.
LOT = 256
PIECE_ROWS = 32_768
# Segments whose means bound a similarity; queries bounded, pairs compared at once.
COARSE = 15
BOUNDED = 32
COMPARED = 65_536
# What a query tells of the bars that it was taken from.
ORIGIN = ["symbol", "from_date", "to_date"]


def _segments(bars: DataFrame, back: int, ahead: int) -> DataFrame:
    """One row per segment: closes and dates in order, `base` the first pos."""
    numbered = number_bars(bars.select("symbol", "date", "close")).select(
        "symbol", "date", "close", "pos", "n_bars")
    size = max(SEGMENT_ROWS, back, ahead)
    laid = with_context(numbered, back, ahead, size)
    rows = laid.groupBy("symbol", "seg").agg(
        F.max("n_bars").alias("n_bars"),
        F.array_sort(F.collect_list(F.struct("pos", "close", "date"))).alias("rows"))
    return rows.select(
        "symbol", "n_bars", "seg",
        (F.col("seg") * size + 1).alias("from_end"),
        ((F.col("seg") + 1) * size).alias("to_end"), "rows")


def _ended(
    bars: DataFrame, window: int, step: int, horizon: int
) -> DataFrame:
    """Segments with the first and last end of their windows.

    Ends are exclusive: a window's last bar is at position end - 1.
    """
    parts = _segments(bars, window - 1, horizon)
    first = F.lit(window) + F.expr(
        f"(greatest({window}, from_end) - {window} + {step - 1}) div {step}") * step
    last = F.least(F.col("to_end"), F.col("n_bars") - horizon - 1)
    return parts.select(
        "*", first.alias("first_end"), last.alias("last_end"),
        F.col("rows")[0]["pos"].alias("base"),
    ).where(F.col("first_end") <= F.col("last_end"))


def _cuts(window: int, step: int, horizon: int) -> Column:
    """The windows of a segment, flat ones removed."""
    ends = F.sequence(F.col("first_end"), F.col("last_end"), F.lit(step).cast("long"))
    at = (lambda e: (e - F.col("base")).cast("int"))
    # Each step stores what the next one reads more than once.
    cuts = F.transform(ends, lambda e: F.struct(
        e.alias("end"),
        F.slice("rows", at(e) - window + 1, window)["close"].alias("raw"),
        F.slice("rows", at(e) + 1, horizon)["close"].alias("next"),
        F.element_at("rows", at(e) - window + 1)["date"].alias("start_date"),
        F.element_at("rows", at(e))["date"].alias("end_date")))
    cuts = F.transform(cuts, lambda s: F.struct(
        s["end"], s["raw"], s["next"], s["start_date"], s["end_date"],
        F.element_at(s["raw"], window).alias("last"),
        mean(s["raw"]).alias("center")))
    cuts = F.transform(cuts, lambda s: F.struct(
        s["end"].alias("end"), s["raw"].alias("raw"), s["next"].alias("next"),
        s["start_date"].alias("start_date"), s["end_date"].alias("end_date"),
        s["last"].alias("last"), s["center"].alias("center"),
        spread(s["raw"], s["center"]).alias("width")))
    return F.filter(cuts, lambda s: s["width"] >= FLAT)


def cut_windows(
    bars: DataFrame, window: int = 60, step: int = STEP, horizon: int = HORIZON
) -> DataFrame:
    """The kept windows before scaling: raw closes, mean and deviation."""
    return _ended(bars, window, step, horizon).select(
        "symbol", F.inline(_cuts(window, step, horizon)))


def build_library(
    bars: DataFrame, window: int = 60, step: int = STEP, horizon: int = HORIZON
) -> DataFrame:
    """Rows (symbol, widx, start_date, end_date, x, fut).

    x holds the z-scores of `window` closes, fut the returns of the next
    `horizon` closes against the window's last. `widx` counts the kept windows
    of a symbol.
    """
    parts = _ended(bars, window, step, horizon)
    cuts = _cuts(window, step, horizon)
    # Only symbols with several segments need the counts of earlier segments; they
    # meet the segments before these are cut.
    chain = Window.partitionBy("symbol").orderBy("seg")
    counts = parts.where(F.col("n_bars") > max(SEGMENT_ROWS, window, horizon)).select(
        "symbol", "seg", F.size(cuts).alias("kept"))
    before = counts.select(
        "symbol", "seg",
        F.sum("kept").over(chain.rowsBetween(Window.unboundedPreceding, -1))
        .alias("before"))
    placed = parts.join(before.hint("merge"), ["symbol", "seg"], "left")
    rows = placed.select(
        "symbol", F.coalesce("before", F.lit(0)).alias("before"),
        F.posexplode(cuts).alias("i", "cut"))
    return rows.select(
        "symbol", (F.col("before") + F.col("i")).alias("widx"),
        F.col("cut.start_date").alias("start_date"),
        F.col("cut.end_date").alias("end_date"),
        standardize(F.col("cut.raw"), F.col("cut.center"), F.col("cut.width"))
        .alias("x"),
        relative_path(F.col("cut.next"), F.col("cut.last")).alias("fut"))


def last_shapes(bars: DataFrame, window: int = 60) -> DataFrame:
    """The last `window` closes of every symbol, as queries.

    Rows (query_id, q, symbol, from_date, to_date); the last three say where the
    shape is from, so that a search can leave it out.
    """
    return last_bars(number_bars(bars), window).groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("pos", "close")))["close"].alias("q"),
        F.min("date").alias("from_date"), F.max("date").alias("to_date")).select(
        F.col("symbol").alias("query_id"), "q", "symbol", "from_date", "to_date")


def query_shape(bars: DataFrame, symbols: list[str], window: int = 60) -> DataFrame:
    """The last `window` closes of the given symbols as queries."""
    return last_shapes(bars.where(F.col("symbol").isin(*symbols)), window)


def prepare_queries(queries: DataFrame, window: int) -> DataFrame:
    """Resample to the window length and standardize; flat shapes drop out."""
    q = F.col("q")
    rest = [c for c in queries.columns if c != "q"]
    fitted = queries.select(*rest, F.when(
        F.size(q) == window, q).otherwise(resample(q, window)).alias("q"))
    # A column that a lambda reads would be worked out once per element: each step is
    # an element of an array, which the next one reads.
    shapes = F.transform(F.array(q), lambda v: F.struct(v.alias("q"), mean(v).alias("center")))
    shapes = F.transform(shapes, lambda s: F.struct(
        s["q"].alias("q"), s["center"].alias("center"),
        spread(s["q"], s["center"]).alias("width")))
    scaled = F.transform(shapes, lambda s: standardize(s["q"], s["center"], s["width"]))
    return fitted.select(*rest, F.explode(F.array_compact(scaled)).alias("zq"))


def _dealt(library: DataFrame, shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with `lot` and `piece`: every window meets every lot once."""
    lots = max(1, -(-shapes.count() // LOT))
    pieces = max(1, -(-library.count() // PIECE_ROWS))
    lot = F.pmod(F.xxhash64("query_id"), F.lit(lots)).cast("int")
    piece = F.pmod(F.xxhash64("symbol", "widx"), F.lit(pieces)).cast("int")
    return (library.select("*", piece.alias("piece"), F.explode(F.sequence(
                F.lit(0), F.lit(lots - 1))).alias("lot")),
            shapes.select("*", lot.alias("lot"), F.explode(F.sequence(
                F.lit(0), F.lit(pieces - 1))).alias("piece")))


def score(library: DataFrame, queries: DataFrame, window: int = 60) -> DataFrame:
    """Similarity (Pearson correlation) of every window to every query.

    Rows (query_id, symbol, widx, end_date, sim). Any number of queries: each lot
    of about LOT travels as one array to every piece of the library.
    """
    dealt, shapes = _dealt(
        library.select("symbol", "widx", "end_date", "x"),
        prepare_queries(queries, window).select("query_id", "zq"))
    packed = shapes.groupBy("lot", "piece").agg(
        F.collect_list(F.struct("query_id", "zq")).alias("qs"))
    x = F.col("x")
    sims = F.transform("qs", lambda q: F.struct(
        q["query_id"].alias("query_id"),
        (dot(x, q["zq"]) / F.lit(float(window))).alias("sim")))
    return dealt.repartition("lot", "piece").join(packed, ["lot", "piece"]).select(
        F.inline(sims), "symbol", "widx", "end_date")


def _coarse(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled segment means of each row, and the norm of what they leave out."""
    edges = np.linspace(0, rows.shape[1], min(COARSE, rows.shape[1]) + 1).astype(int)
    means = np.add.reduceat(rows, edges[:-1], axis=1) / np.sqrt(np.diff(edges))
    rest = (rows * rows).sum(1) - (means * means).sum(1)
    return means, np.sqrt(np.maximum(rest, 0.0))


def nearest(x: np.ndarray, z: np.ndarray, m: int, barred: np.ndarray | None = None,
            known: np.ndarray | None = None
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The m rows of x with the largest products with each row of z, equal ones in the
    order of x: their places in x and in z, the products, and how many pairs were
    multiplied out. `barred` marks pairs (x, z) that do not count; rows with products
    below `known`, one value per row of z, may be left out."""
    (x_mean, x_rest), (z_mean, z_rest) = _coarse(x), _coarse(z)
    places, queries, products, compared = [], [], [], 0
    slop = 1e-9 * x.shape[1]  # what rounding can add to or take from a bound
    for start in range(0, len(z), BOUNDED):
        part = slice(start, start + BOUNDED)
        middle, slack = x_mean @ z_mean[part].T, np.outer(x_rest, z_rest[part])
        if barred is not None:
            middle[barred[:, part]] = -np.inf
        near = middle > -np.inf
        least = np.full(middle.shape[1], -np.inf) if known is None else known[part].copy()
        new = np.flatnonzero(least == -np.inf)
        if len(x) > m and len(new):
            # The worst of any m products is a bound; these are likely to be large.
            likely = np.argpartition(middle[:, new], len(x) - m, axis=0)[len(x) - m:]
            least[new] = [(x[rows] * z[start + k]).sum(1).min() if near[rows, k].all()
                          else -np.inf for k, rows in zip(new, likely.T)]
            compared += likely.size
        near &= middle + slack >= least - slop
        q, i = np.nonzero(near.T)
        value = np.concatenate([np.zeros(0)] + [
            (x[i[k:k + COMPARED]] * z[start + q[k:k + COMPARED]]).sum(1)
            for k in range(0, len(i), COMPARED)])
        order = np.lexsort((i, -value, q))
        i, q, value = i[order], q[order], value[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < m
        places.append(i[first])
        queries.append(start + q[first])
        products.append(value[first])
        compared += len(order)
    return (np.concatenate(places), np.concatenate(queries), np.concatenate(products),
            compared)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy().reshape(len(values), -1)


def _days(column: pa.ChunkedArray) -> np.ndarray:
    """Dates or timestamps as numbers; null, which nothing overlaps, the least."""
    kind = pa.int32() if pa.types.is_date32(column.type) else pa.int64()
    return column.cast(kind).cast(pa.int64()).fill_null(-1 << 62).to_numpy()


def _overlaps(windows: pa.Table, shapes: pa.Table) -> np.ndarray:
    """Which windows share a bar with the history a shape was taken from."""
    own = windows.column("symbol").combine_chunks().dictionary_encode()
    number = {name: k for k, name in enumerate(own.dictionary.to_pylist())}
    asked = np.array([number.get(s, -1) for s in shapes.column("own_symbol").to_pylist()])
    same = own.indices.to_numpy()[:, None] == asked[None, :]
    return (same & (_days(windows.column("end_date"))[:, None]
                    >= _days(shapes.column("own_from_date"))[None, :])
            & (_days(windows.column("start_date"))[:, None]
               <= _days(shapes.column("own_to_date"))[None, :]))


def best_windows(
    library: DataFrame, queries: DataFrame, window: int, m: int,
    exclude_self: bool = False,
) -> DataFrame:
    """The best m windows per query: rows (query_id, at, symbol, widx, end_date, sim).

    Equal similarities are ordered by symbol, later windows first. With
    `exclude_self`, windows that overlap the bars a query was taken from (its columns
    symbol, from_date and to_date; null for a drawn shape) are left out.
    """
    origin = ORIGIN if exclude_self else []
    shapes = _asked(queries, window, origin)
    return _best(library, shapes, _few(shapes), window, m)


def _asked(queries: DataFrame, window: int, origin: list[str]) -> DataFrame:
    return prepare_queries(queries, window).select(
        "query_id", "zq", *[F.col(c).alias(f"own_{c}") for c in origin])


def _few(shapes: DataFrame) -> pa.Table | None:
    """The shapes, if there are LOT at most."""
    head = shapes.limit(LOT + 1).toArrow()
    return head if len(head) <= LOT else None


def _near(windows: pa.Table, shapes: pa.Table, m: int, known: np.ndarray | None = None
          ) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The best m of the windows per shape: rows (symbol, widx, end_date), places of
    the shapes, and the products. `known` as in `nearest`."""
    windows = windows.sort_by([("symbol", "ascending"), ("widx", "descending")])
    i, q, products = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    if len(windows) and len(shapes):
        barred = _overlaps(windows, shapes) if "own_symbol" in shapes.column_names else None
        i, q, products, _ = nearest(
            _matrix(windows.column("x")), _matrix(shapes.column("zq")), m, barred, known)
    return windows.select(["symbol", "widx", "end_date"]).take(pa.array(i)), q, products


class _Best:
    """The best m windows per shape of those seen so far, and a batch's or two that wait
    to be compared with them."""

    def __init__(self, shapes: pa.Table, m: int):
        self.shapes, self.m = shapes, m
        self.known = np.full(len(shapes), -np.inf)
        self.rows: pa.Table | None = None
        self.sorted = 0

    def add(self, windows: pa.Table) -> None:
        rows, q, products = _near(windows, self.shapes, self.m, self.known)
        rows = rows.append_column("q", pa.array(q)).append_column(
            "product", pa.array(products))
        self.rows = rows if self.rows is None else pa.concat_tables([self.rows, rows])
        if len(self.rows) - self.sorted >= self.m * len(self.shapes) / 2:
            self.settle()

    def settle(self) -> pa.Table | None:
        if self.rows is None:
            return None
        # copied, so that no batch stays in memory for the few rows kept of it
        rows = self.rows.combine_chunks().sort_by([
            ("q", "ascending"), ("product", "descending"), ("symbol", "ascending"),
            ("widx", "descending")])
        q = rows.column("q").to_numpy()
        at = np.arange(len(q)) - np.searchsorted(q, q)
        last = at == self.m - 1
        self.known[q[last]] = rows.column("product").to_numpy()[last]
        self.rows = rows.filter(pa.array(at < self.m)).combine_chunks()
        self.sorted = len(self.rows)
        return self.rows


def _best(library: DataFrame, shapes: DataFrame, few: pa.Table | None, window: int, m: int
          ) -> DataFrame:
    """`best_windows` of prepared shapes; `few` are the same if they fit one lot."""
    library = library.select("symbol", "widx", "start_date", "end_date", "x")
    kinds = {f.name: f.dataType for f in [*shapes.schema, *library.schema]}
    kept = T.StructType([T.StructField(c, kinds[c]) for c in (
        "query_id", "symbol", "widx", "end_date")]).add("sim", "double")

    def result(rows: pa.Table, ids: pa.ChunkedArray, products: np.ndarray) -> pa.Table:
        return pa.table([ids, *[rows.column(c) for c in ("symbol", "widx", "end_date")],
                         pa.array(products / float(window))], kept.names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(few, m)
        for batch in batches:
            best.add(pa.Table.from_batches([batch]))
        rows = best.settle()
        if rows is not None:
            yield from result(rows, few.column("query_id").take(rows.column("q")),
                              rows.column("product").to_numpy()).to_batches()

    def unit(windows: pa.Table, shapes: pa.Table) -> pa.Table:
        rows, q, products = _near(windows, shapes, m)
        return result(rows, shapes.column("query_id").take(pa.array(q)), products)

    if few is not None:
        found = library.mapInArrow(search, kept)
    else:
        dealt, asked = _dealt(library, shapes)
        found = dealt.groupBy("lot", "piece").cogroup(
            asked.groupBy("lot", "piece")).applyInArrow(unit, kept)
    order = Window.partitionBy("query_id").orderBy(
        F.col("sim").desc(), F.col("symbol"), F.col("widx").desc())
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= m)


def choose(best: DataFrame, library: DataFrame, window: int = 60, k: int = 100,
           step: int = STEP, few: bool = False) -> DataFrame:
    """Greedy choice of k windows per query, apart within each symbol.

    Rows (query_id, rank, n, symbol, widx, end_date, sim, fut), best first, from the
    best windows of each query (`enough` of them). Queries with fewer than MIN_MATCHES
    windows give no rows. Only the chosen windows look up their outcomes in the library;
    those of a `few` queries, LOT at most, are sent to where it lies.
    """
    gap = min_gap(window, step)
    entry = F.struct("at", "symbol", "widx", "end_date", "sim")
    listed = best.groupBy("query_id").agg(
        F.array_sort(F.collect_list(entry)).alias("rows"))

    def take(taken: Column, row: Column) -> Column:
        apart = F.forall(taken, lambda t: (t["symbol"] != row["symbol"])
                         | (F.abs(t["widx"] - row["widx"]) >= gap))
        return F.when((F.size(taken) < k) & apart,
                      F.concat(taken, F.array(row))).otherwise(taken)

    rows = F.col("rows")
    taken = listed.select("query_id", F.aggregate(
        rows, F.slice(rows, 1, 0), take).alias("taken"))
    ranked = taken.where(F.size("taken") >= MIN_MATCHES).select(
        "query_id", F.size("taken").alias("n"),
        F.posexplode("taken").alias("i", "m"))
    placed = ranked.select(
        "query_id", (F.col("i") + 1).alias("rank"), "n", "m.symbol", "m.widx",
        "m.end_date", "m.sim")
    return (F.broadcast(placed) if few else placed).join(
        library.select("symbol", "widx", "fut"), ["symbol", "widx"]).select(
        "query_id", "rank", "n", "symbol", "widx", "end_date", "sim", "fut")


def min_gap(window: int, step: int = STEP) -> int:
    """How far apart chosen windows of a symbol are, in windows."""
    return max(1, window // (2 * step))


def enough(window: int, k: int, step: int = STEP) -> int:
    """How many of the best windows the greedy choice of k can need."""
    return k * (2 * min_gap(window, step) - 1)


def matches(chosen: DataFrame) -> DataFrame:
    """Display rows of the chosen windows."""
    last = F.element_at("fut", -1)
    return chosen.select(
        "query_id", "rank", "symbol",
        iso_text(F.col("end_date")).alias("end_date"),
        round_scaled(F.col("sim") * 100, 1).alias("similarity"),
        round_scaled(last * 100, 2).alias("ret_20d_pct"))


def horizon_stats(chosen: DataFrame, checks: tuple[int, ...] = CHECKS) -> DataFrame:
    """Share of rises, median and quartiles after each number of bars."""
    rows = chosen.select(
        "query_id", "fut", F.explode(F.array(*map(F.lit, checks))).alias("h")
    ).select("query_id", "h", F.element_at("fut", F.col("h")).alias("r"))
    cut = F.percentile("r", [0.25, 0.5, 0.75])
    out = rows.groupBy("query_id", "h").agg(
        F.avg((F.col("r") > 0).cast("double")).alias("p_up"), cut.alias("q"))
    return out.select(
        "query_id", "h", "p_up", F.col("q")[1].alias("median"),
        F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"))


def fan_paths(chosen: DataFrame) -> DataFrame:
    """Percentiles of the relative price at each forward step."""
    rows = chosen.select("query_id", F.posexplode("fut").alias("i", "r"))
    out = rows.groupBy("query_id", (F.col("i") + 1).alias("step")).agg(
        F.percentile(F.col("r") + 1, [p / 100 for p in FAN]).alias("q"))
    return out.select("query_id", "step", *[
        F.col("q")[i].alias(f"p{p}") for i, p in enumerate(FAN)])


def outcome_histogram(chosen: DataFrame, bins: int = 30) -> DataFrame:
    """Counts of the last returns (in percent) in bins of equal width."""
    rows = chosen.groupBy("query_id").agg(
        F.collect_list(F.element_at("fut", -1) * 100).alias("r"))
    rows = rows.select(
        "query_id", F.array_min("r").alias("low"), F.array_max("r").alias("high"),
        F.explode("r").alias("r"))
    slot = F.when(F.col("high") > F.col("low"), F.least(
        F.width_bucket("r", "low", "high", F.lit(bins)), F.lit(bins))).otherwise(1)
    return rows.groupBy("query_id", slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def find_similar(
    library: DataFrame, queries: DataFrame, window: int = 60, k: int = 100,
    exclude_self: bool = False,
) -> DataFrame:
    """The chosen windows; feed them to the four result functions.

    The library is read twice (searched, looked up), with more than LOT queries three
    times (counted): store it with `sources.library` unless it is small. `exclude_self`
    as in `best_windows`.
    """
    shapes = _asked(queries, window, ORIGIN if exclude_self else [])
    few = _few(shapes)
    best = _best(library, shapes, few, window, enough(window, k))
    return choose(best, library, window, k, few=few is not None)

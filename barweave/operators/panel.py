"""Bar numbering and layouts that split long histories.

A panel is one long table of bars, ordered by (symbol, date). No operator here
sorts a whole symbol in one task: rows are laid out and sorted in calendar
*slots* of a symbol, and what a slot must know of the slots before it (row
count, last closes, decayed sums) comes from a table about a thousand times
smaller than the panel. A slot's bars are counted off into parts of at most
`slot_rows`, so repeated dates and fine timestamps are numbered like others.

`number_bars` gives every bar its position `pos` and the symbol's `n_bars`.
With these, "latest bar", "last N bars", "at least N bars" and "every fifth
bar" are plain filters, and per-symbol results are partial aggregations.

Sums carried from part to part are scanned in two levels: within blocks of
positions whose weights fit a double, and over the totals of the blocks before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOT_ROWS = 1024
# A stored panel with this column is laid out by it and the symbol already.
SLOT = "calendar_slot"
SEGMENT_ROWS = 2048
# Input behind one part of a panel's layout, as the files report it.
PART_BYTES = 8 << 20
# Parts for each of these, where bars are laid out by the slot of groups.
GROUP_PARTS = 4
# Before the slot of any date.
NO_SLOT = -(1 << 31)
# What precedes a slot, as a column of its bars.
HEAD = "slot_head"
# An input that reports more than this has no statistics.
UNKNOWN_BYTES = 1 << 60
# exp(650) is far from the double limit, with room for the values themselves.
MAX_LOG_SCALE = 650.0


@dataclass(frozen=True)
class Decay:
    """An exponentially decayed sum to carry across slots.

    `of` is "close", "gain" or "loss"; each step back multiplies by `ratio`.
    """

    name: str
    of: str
    ratio: float


@dataclass(frozen=True)
class Signal:
    """A decayed sum of the difference of two exponential means of the close."""

    name: str
    fast: Decay
    slow: Decay
    ratio: float


def scale_rows(ratio: float) -> int:
    """Longest run whose growth factor ratio**-n still fits a double."""
    return int(MAX_LOG_SCALE / -math.log(ratio))


def group_of(symbol: Column, n: int) -> Column:
    """Which of n groups a symbol is in, by its hash."""
    return F.pmod(F.xxhash64(symbol), F.lit(n)).cast("int")


def slot_index(bars: DataFrame, slot_rows: int = SLOT_ROWS) -> Column:
    """Calendar slot of a bar; dates count days, timestamps count hours."""
    kind = bars.schema["date"].dataType
    if isinstance(kind, T.DateType):
        unit = F.unix_date("date")
    elif isinstance(kind, T.TimestampNTZType):
        unit = F.expr(
            "timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', date)"
        )
    else:
        raise TypeError(f"bars.date must be DATE or TIMESTAMP_NTZ, not {kind}")
    return F.floor(unit / F.lit(slot_rows)).cast("int")


def reported_bytes(df: DataFrame) -> int | None:
    """Size of what the rows are made from, as the inputs report it; None if one does not."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes()))
             for i in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < UNKNOWN_BYTES else None


def _parts(size: int | None) -> int:
    return -(-(size or 0) // PART_BYTES)


def _in_parts(df: DataFrame, size: int | None, *columns: str) -> DataFrame | None:
    """Laid out by columns, in parts whose number follows the size of the input.

    Spark would merge parts up to a fixed number of bytes, and each of the many sorts and
    windows of one task holds those rows again. None for a small input, left to Spark.
    """
    n = _parts(size)
    if n <= df.sparkSession.sparkContext.defaultParallelism:
        return None
    return df.repartition(n, *columns)


def keyed_by_slot(bars: DataFrame, size: int | None = None) -> DataFrame:
    """Add the calendar slot and lay the bars out by symbol and slot.

    The layout is asked for here: a join by symbol before would else leave a
    whole symbol in one task. Bars that come with their slot, as a bucketed table
    stores them, are left where they are. `size` is that of the input.
    """
    if SLOT in bars.columns:
        return bars
    # As a generated column, so that a join by slot does not filter the dates of one of
    # the two readings of a panel: they would no longer share an exchange.
    slot = F.struct(slot_index(bars).alias(SLOT))
    keyed = bars.select("*", F.inline(F.array(slot)))
    return _in_parts(keyed, size, "symbol", SLOT) or keyed.repartition("symbol", SLOT)


def keyed_by_group(bars: DataFrame, size: int | None, groups: int) -> DataFrame:
    """Like `keyed_by_slot`, but the symbols of a group stay together: the slot tells the
    group too, and bars are laid out by it alone.

    A task then has the bars of a few groups, and what is computed can be written by group
    where it lies. Groups are split further as the size of the input asks for. Bars without
    a date come before the others, as a null would; those without a symbol are left out.
    The columns come out of a generator, so that all readings share one exchange.
    """
    n = groups * max(1, -(-_parts(size) // groups))
    group = group_of(F.col("symbol"), n).cast("long")
    slot = F.coalesce(slot_index(bars), F.lit(NO_SLOT)).cast("long")
    keyed = bars.drop(SLOT).where("symbol is not null").withColumn(
        SLOT, slot * F.lit(n) + group)
    row = F.struct(*[c for c in bars.columns if c not in ("symbol", SLOT)])
    return _by_slot(keyed, size).select("symbol", SLOT, F.inline(F.array(row)))


def _by_slot(df: DataFrame, size: int | None) -> DataFrame:
    """Laid out by the slot of groups, all tables of one input in as many parts. The hash
    deals out few large pieces; in more parts than usual fewer of them meet."""
    spark = df.sparkSession
    n = GROUP_PARTS * _parts(size) if size is not None else int(
        spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, spark.sparkContext.defaultParallelism), SLOT)


def _with_heads(keyed: DataFrame, heads: DataFrame, size: int | None,
                slot_rows: int) -> DataFrame:
    """Bars laid out by the slot of groups, counted, with the columns of their slot's head.

    A head comes as a row in front of its bars. A join by symbol and slot would lay out the
    bars again. Only the first bar of a slot gets the context.
    """
    names = [c for c in heads.columns if c not in ("symbol", SLOT)]
    first = _by_slot(heads, size).select("symbol", SLOT, F.struct(*names).alias(HEAD))
    rows = _counted(keyed.unionByName(first, allowMissingColumns=True), slot_rows)
    return priced(rows).where("date is not null").select(
        *[c for c in rows.columns if c != HEAD],
        *[F.when(F.col("at") == 0, F.col(HEAD)[c]).alias(c) if c == "context"
          else F.col(HEAD)[c].alias(c) for c in names])


def priced(bars: DataFrame) -> DataFrame:
    """Drop the rows without a close (NULL or NaN)."""
    return bars.where(F.col("close").isNotNull() & ~F.isnan("close"))


def _up(change: Column) -> Column:
    return F.greatest(change, F.lit(0.0))


def _directed(decay: Decay, change: Column) -> Column:
    return _up(change if decay.of == "gain" else -change)


def _addend(decay: Decay) -> Column:
    """A bar's own term; the change of a slot's first bar is not known there."""
    if decay.of == "close":
        return F.col("close")
    return F.coalesce(_directed(decay, F.col("close") - F.col("before")), F.lit(0.0))


def _counted(keyed: DataFrame, slot_rows: int, back: int = 0) -> DataFrame:
    """Add `at` (place in the slot), `part`, `j` (place in the part) and `before`
    (the close before, in the slot), with `back` also `late`: the last ones.

    Rows without a close are not counted. Bars of one date are ordered by their
    prices and volume. A head in front of the bars is handed on to them.
    """
    ties = [c for c in ("close", "open", "high", "low", "volume") if c in keyed.columns]
    by_date = Window.partitionBy("symbol", SLOT).orderBy("date", *ties)
    known = F.when(~F.isnan("close"), F.col("close"))
    so_far = by_date.rowsBetween(Window.unboundedPreceding, 0)
    ranked = keyed.withColumn("close", known).select(
        *[F.first(c, ignorenulls=True).over(so_far).alias(c) if c == HEAD else F.col(c)
          for c in keyed.columns], (F.count("close").over(so_far) - 1).alias("at"),
        F.last("close", ignorenulls=True).over(
            by_date.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        *([(F.count("close").over(by_date.rowsBetween(
            0, Window.unboundedFollowing)) <= back).alias("late")] if back else []))
    return ranked.withColumn(
        "part", F.expr(f"greatest(at, 0) div {slot_rows}").cast("int")).withColumn(
        "j", F.expr(f"at % {slot_rows}"))


def _running(value: Column, ratio: float) -> Column:
    """Sum of ratio**-j times the value over this and the part's earlier bars."""
    part = Window.partitionBy("symbol", SLOT, "part").orderBy("at").rowsBetween(
        Window.unboundedPreceding, 0)
    return F.sum(value * F.pow(F.lit(ratio), -F.col("j"))).over(part)


def _power(ratio: float, n: Column) -> Column:
    return F.pow(F.lit(ratio), n)


def _two_memories(a: float, b: float, n: Column) -> Column:
    """Sum of a**i * b**(n - 1 - i) for i below n."""
    high, low = max(a, b), min(a, b)
    if high == low:
        return n * _power(high, n - 1)
    step = math.log(low / high)
    return _power(high, n - 1) * F.expm1(n * F.lit(step)) / F.lit(math.expm1(step))


def _carried(ratio: float, of_part: Column) -> list[tuple[str, Column]]:
    """Steps (column, value) to `carry`: the sum of the terms of all earlier parts,
    each as `of_part` gives it for the part's last bar, seen from the last bar
    before this part.

    Weights grow by at most scale_rows within a block. What is older than three
    blocks has decayed below the least double.
    """
    block = max(1, scale_rows(ratio) // 2)
    end = F.col("offset") + F.col("cnt")
    chain = Window.partitionBy("symbol", "block").orderBy(SLOT, "part")
    blocks = Window.partitionBy("symbol").orderBy("block")
    steps = [
        ("block", F.expr(f"offset div {block}")),
        ("own", of_part),
        ("grown", F.col("own") * _power(ratio, F.col("block") * block - end)),
        ("shrunk", F.col("own") * _power(ratio, (F.col("block") + 1) * block - end)),
        ("carry", F.coalesce(F.sum("grown").over(chain.rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0.0)) * _power(
            ratio, F.col("offset") - F.col("block") * block)),
    ]
    for m in (1, 2, 3):
        older = F.coalesce(F.sum("shrunk").over(blocks.rangeBetween(-m, -m)), F.lit(0.0))
        steps.append(("carry", F.col("carry") + older * _power(
            ratio, F.col("offset") - (F.col("block") - (m - 1)) * block)))
    return steps


def _scan(heads: DataFrame, name: str, ratio: float, of_part: Column) -> DataFrame:
    for column, value in _carried(ratio, of_part):
        heads = heads.withColumn(column, value)
    return heads.withColumnRenamed("carry", name).drop("block", "own", "grown", "shrunk")


def _slot_heads(
    keyed: DataFrame, decays: tuple[Decay, ...], signal: Signal | None,
    slot_rows: int, back: int, size: int | None,
) -> DataFrame:
    """One row per (symbol, slot): its parts in order, with what precedes each, and
    the `back` closes before the slot."""
    rows = _counted(keyed.select("symbol", SLOT, "date", "close"), slot_rows, back)
    priced_at = F.when(F.col("close").isNotNull(), F.col("at"))
    aggs = [
        F.count(F.lit(1)).alias("rows"),
        F.count("close").alias("cnt"),
        F.min_by("close", priced_at).alias("first_in"),
        F.max_by("close", priced_at).alias("last_in"),
        *[F.coalesce(F.sum(_addend(d) * _power(d.ratio, -F.col("j"))), F.lit(0.0))
          .alias(f"sum_{d.name}") for d in decays]]
    if back:
        aggs.append(F.array_sort(F.collect_list(F.when(
            F.col("late") & F.col("close").isNotNull(), F.struct("at", "close"))))[
                "close"].alias("tail"))
    if signal:
        # What the part's own closes add to the difference of the two means.
        mean = {d: F.lit(1.0 - d.ratio) * _power(d.ratio, F.col("j")) * _running(
            F.col("close"), d.ratio) for d in (signal.fast, signal.slow)}
        rows = rows.where("close is not null or part = 0").withColumn(
            "gap", mean[signal.fast] - mean[signal.slow])
        aggs.append(F.coalesce(F.sum(F.col("gap") * _power(
            signal.ratio, -F.col("j"))), F.lit(0.0)).alias(f"sum_{signal.name}"))
    parts = rows.groupBy("symbol", SLOT, "part").agg(*aggs)
    parts = _in_parts(parts, size, "symbol") or parts

    chain = Window.partitionBy("symbol").orderBy(SLOT, "part")
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("symbol")
    heads = parts.select(
        "*",
        F.coalesce(F.sum("cnt").over(earlier), F.lit(0)).alias("offset"),
        F.sum("cnt").over(whole).alias("n_bars"),
        F.sum("rows").over(whole).alias("n_rows"),
        F.last("last_in", ignorenulls=True).over(earlier).alias("carry_close"),
        F.first("first_in", ignorenulls=True).over(
            chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ).alias("first_close"),
        *([F.lag("tail").over(chain).alias("tail_before")] if back else []))
    if back:
        near = Window.partitionBy("symbol").orderBy("offset").rangeBetween(-(back - 1), 0)
        closes = F.flatten(F.collect_list("tail_before").over(near))
        heads = heads.withColumn("context", closes).withColumn("context", F.slice(
            "context", F.greatest(F.size("context") - back, F.lit(0)) + 1, back))
    shrink = F.col("cnt") - 1
    for d in decays:
        total = F.col(f"sum_{d.name}")
        if d.of != "close":
            first = F.col("first_in") - F.col("carry_close")
            total = total + F.when(F.col("part") == 0, F.coalesce(
                _directed(d, first), F.lit(0.0))).otherwise(0.0)
        heads = _scan(heads, f"carry_{d.name}", d.ratio, total * _power(d.ratio, shrink))
    if signal:
        # The means also hold what was carried into the part, and the first close.
        total = F.col(f"sum_{signal.name}") * _power(signal.ratio, shrink)
        for d, sign in ((signal.fast, 1.0), (signal.slow, -1.0)):
            both = _two_memories(d.ratio, signal.ratio, F.col("cnt"))
            total = total + F.lit(sign * d.ratio) * both * (
                F.lit(1.0 - d.ratio) * F.col(f"carry_{d.name}")
                + _power(d.ratio, F.col("offset")) * F.col("first_close"))
        heads = _scan(heads, f"carry_{signal.name}", signal.ratio, F.when(
            F.col("cnt") > 0, total).otherwise(0.0))
    carries = [f"carry_{d.name}" for d in decays]
    if signal:
        carries.append(f"carry_{signal.name}")
    return heads.groupBy("symbol", SLOT).agg(
        F.array_sort(F.collect_list(F.struct(
            "part", "offset", "carry_close", *carries))).alias("parts"),
        F.max("n_bars").alias("n_bars"), F.max("n_rows").alias("n_rows"),
        F.max("first_close").alias("first_close"),
        *([F.min_by("context", "part").alias("context")] if back else []))


def number_bars(
    bars: DataFrame,
    decays: tuple[Decay, ...] = (),
    slot_rows: int = SLOT_ROWS,
    signal: Signal | None = None,
    back: int = 0,
    groups: int | None = None,
) -> DataFrame:
    """Add pos, n_bars, n_rows, prev_close, first_close and the decayed sums.

    Rows without a close are counted in `n_rows` only. The decayed sum named
    x at a bar is the sum of ratio**age times the addend over this and all
    earlier bars of the symbol, exact across slots. `signal`, whose two means must
    be among the decays, gives the same for the difference of the means. Bars stay
    in their slots; with `back`, the columns SLOT, `at` and `context` tell
    `with_closes` what precedes each slot. With `groups`, symbols lie by `group_of`.
    """
    bars = bars.drop("pos", "n_bars", "n_rows", "prev_close", "first_close")
    # Nothing is left of earlier bars at ratio 0: the sum is the bar's own term.
    own = tuple(d for d in decays if d.ratio == 0)
    decays = tuple(d for d in decays if d.ratio > 0)
    for ratio in [d.ratio for d in decays] + ([signal.ratio] if signal else []):
        slot_rows = max(1, min(slot_rows, scale_rows(ratio) // 4))
    size = reported_bytes(bars)
    keyed = keyed_by_group(bars, size, groups) if groups else keyed_by_slot(bars, size)
    heads = _slot_heads(keyed, decays, signal, slot_rows, back, size)
    if groups:
        joined = _with_heads(keyed, heads, size, slot_rows)
    else:
        # The bars are laid out and sorted by (symbol, slot) already: a merge join
        # moves only the small side, and never makes the bars the broadcast side.
        joined = priced(_counted(keyed, slot_rows)).join(
            heads.hint("merge"), ["symbol", SLOT])
    head = F.get("parts", F.col("part"))
    numbered = (
        joined
        .withColumn("pos", (head["offset"] + F.col("j")).cast("long"))
        .withColumn("prev_close", F.coalesce("before", head["carry_close"]))
    )
    change = F.col("close") - F.col("prev_close")
    for d in decays:
        value = F.col("close") if d.of == "close" else F.coalesce(
            _directed(d, change), F.lit(0.0))
        numbered = numbered.withColumn(f"grown_{d.name}", _running(value, d.ratio))
    for d in decays:
        numbered = numbered.withColumn(d.name, _power(d.ratio, F.col("j")) * (
            F.col(f"grown_{d.name}") + F.lit(d.ratio) * head[f"carry_{d.name}"])
        ).drop(f"grown_{d.name}")
    for d in own:
        numbered = numbered.withColumn(
            d.name, F.col("close") if d.of == "close"
            else F.coalesce(_directed(d, change), F.lit(0.0)))
    if signal:
        gap = mean_of(signal.fast) - mean_of(signal.slow)
        numbered = numbered.withColumn("gap", gap).withColumn(
            "grown", _running(F.col("gap"), signal.ratio)).withColumn(
            signal.name, _power(signal.ratio, F.col("j")) * (
                F.col("grown") + F.lit(signal.ratio) * head[f"carry_{signal.name}"])
        ).drop("gap", "grown")
    numbered = numbered.drop("parts", "part", "j", "before")
    return numbered if back else numbered.drop(SLOT, "at")


def mean_of(decay: Decay) -> Column:
    """Unadjusted exponential mean, seeded with the symbol's first close."""
    return (F.lit(1.0 - decay.ratio) * F.col(decay.name)
            + _power(decay.ratio, F.col("pos") + 1) * F.col("first_close"))


def with_closes(numbered: DataFrame) -> DataFrame:
    """Put the closes that precede a slot in front of it, in the same layout.

    For bars numbered with `back`. Adds `own`, false for the rows put in front;
    these have pos, close and prev_close (null for the first), their other columns
    mean nothing.
    """
    context = F.col("context")
    before = F.transform(context, lambda x, i: F.struct(
        (F.size(context) - i).cast("long").alias("away"), x.alias("close"),
        F.when(i > 0, F.get(context, i - 1)).alias("prev_close")))
    itself = F.array(F.struct(F.lit(0).cast("long").alias("away"), F.col("close"),
                              F.col("prev_close")))
    rows = F.when(F.col("at") == 0, F.concat(before, itself)).otherwise(itself)
    rest = [c for c in numbered.columns
            if c not in ("context", "at", "pos", "close", "prev_close")]
    return numbered.select(*rest, "pos", F.explode(rows).alias("row")).select(
        *rest, (F.col("pos") - F.col("row.away")).alias("pos"),
        F.col("row.close").alias("close"), F.col("row.prev_close").alias("prev_close"),
        (F.col("row.away") == 0).alias("own"))


def last_bars(numbered: DataFrame, n: int) -> DataFrame:
    """The latest n bars of every symbol."""
    return numbered.where(F.col("pos") >= F.col("n_bars") - n)


def with_context(
    numbered: DataFrame, back: int, ahead: int = 0, size: int = SEGMENT_ROWS
) -> DataFrame:
    """Lay bars out in segments of `size` positions plus neighbouring rows.

    Adds `seg`. A segment also receives the `back` bars before it and the
    `ahead` bars after it, so every frame within that reach is complete for
    the segment's own rows (`owned`). Histories of up to `size` bars have one
    segment and no copies.
    """
    if size < max(back, ahead):
        raise ValueError(f"segment of {size} rows is shorter than its context")
    own = F.expr(f"pos div {size}")
    place = F.expr(f"pos % {size}")
    homes = F.array(
        own,
        F.when((place >= size - back) & ((own + 1) * size < F.col("n_bars")),
               own + 1),
        F.when((place < ahead) & (own > 0), own - 1),
    )
    return numbered.select("*", F.explode(F.array_compact(homes)).alias("seg"))


def owned(laid_out: DataFrame, size: int = SEGMENT_ROWS) -> DataFrame:
    """Keep each bar once, in its own segment."""
    return laid_out.where(F.expr(f"pos div {size} = seg")).drop("seg")

"""Sharding by balanced label propagation.

Linked documents are those in one group (an edge is a group of two). Groups above `LARGE`
of a shard are dealt out first, the largest first, each to the emptiest shard; one that does
not fit fills it and goes on in the next, by a hash of the document. Their documents then
stay where they are. The others start in a shard by hash, in proportion to the room that is
left. In each round a group's favourite is the shard that holds most
of its bytes, and documents elsewhere ask to move to the favourite of most of their
groups. A shard admits movers up to its quota, whole groups at a time as far as they fit:
movers are counted by shard and hash cell of their group, and a shard admits cells until
the quota is full. Before and after the rounds shards above the mean give single documents, then linked
ones, then those of large groups, to those below it.

Rounds are joins and groupings over small rows (id, group, size, shard); the texts are
read once. The driver sees counts by shard and cell only (`CELLS` per shard).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import checkpointed

SHARDS = 8
ROUNDS = 3
#: Share above the mean that a shard may hold between rounds.
SLACK = 0.1
CELLS = 4096
#: Share of a shard from which on a group is dealt out at the start. A cell of movers has
#: to fit into the slack, which such groups would not do.
LARGE = 1 / 16
#: Steps of the hash that places documents in proportion.
STEPS = 1 << 20
#: Rows per counting cell of the slots, about.
SLOT_ROWS = 20_000


def _cell(value: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(salt)), F.lit(CELLS)).cast("int")


def _wishes(placed: DataFrame, links: DataFrame) -> DataFrame:
    """`placed` with each document's `wish` and the hash `cell` of the group behind it."""
    held = links.join(placed, "id").groupBy("group", "shard").agg(
        F.sum("size").alias("bytes"))
    favourite = held.groupBy("group").agg(F.max_by(
        "shard", F.struct("bytes", -F.col("shard"))).alias("wish"))
    # one exchange by id serves both groupings and the join
    votes = links.join(favourite, "group").repartition("id").groupBy("id", "wish").agg(
        F.count("*").alias("votes"), F.min("group").alias("group"))
    wishes = votes.groupBy("id").agg(F.max_by(
        F.struct("wish", "group"), F.struct("votes", -F.col("wish"))).alias("w"))
    return placed.join(wishes, "id", "left").select(
        *placed.columns, F.when(~F.col("pinned"), F.col("w.wish")).alias("wish"),
        _cell(F.col("w.group"), 0).alias("cell"))


def _moved(asked: DataFrame, shards: int, slack: float) -> DataFrame:
    """Admit the movers of each shard cell by cell while its quota lasts."""
    moves = F.col("wish") != F.col("shard")
    sums = asked.groupBy("shard", F.when(moves, F.col("wish")).alias("to"),
                         F.when(moves, F.col("cell")).alias("cell")).agg(
        F.sum("size").alias("bytes")).collect()
    loads, leaving = [0] * shards, [0] * shards
    asking: dict[tuple[int, int], int] = {}
    for r in sums:
        loads[r.shard] += r.bytes
        if r.to is not None:
            leaving[r.shard] += r.bytes
            asking[r.to, r.cell] = asking.get((r.to, r.cell), 0) + r.bytes
    room = [sum(loads) / shards * (1 + slack) - loads[s] + leaving[s] / 2
            for s in range(shards)]
    admitted = []
    for (to, cell), size in sorted(asking.items()):
        if size <= room[to]:
            room[to] -= size
            admitted.append((to, cell, True))
    plan = asked.sparkSession.createDataFrame(admitted, "wish int, cell int, moves boolean")
    return asked.join(F.broadcast(plan), ["wish", "cell"], "left").select(
        "id", "size", "tie", "pinned",
        F.when(F.col("moves"), F.col("wish")).otherwise(F.col("shard")).alias("shard"))


def _level(placed: DataFrame, shards: int, salt: int) -> DataFrame:
    """Move documents from shards above the mean to shards below it, single ones first,
    then what a shard holds of a group, then documents of large groups one by one."""
    marked = placed.withColumn("cell", F.when(
        F.col("pinned"), 2 * CELLS + _cell(F.col("id"), salt)).when(
        F.col("tie").isNull(), _cell(F.col("id"), salt))
        .otherwise(CELLS + _cell(F.col("tie"), salt)))
    sums = marked.groupBy("shard", "cell").agg(F.sum("size").alias("bytes")).collect()
    loads = [0] * shards
    for r in sums:
        loads[r.shard] += r.bytes
    mean = sum(loads) / shards
    need = {s: mean - loads[s] for s in range(shards) if loads[s] < mean}
    over = {s: loads[s] - mean for s in range(shards) if loads[s] > mean}
    moves = []
    for r in sorted(sums, key=lambda r: (r.shard, r.cell)):
        if r.bytes <= over.get(r.shard, 0):
            target = max(need, key=need.get)
            if need[target] >= r.bytes / 2:
                moves.append((r.shard, r.cell, target))
                need[target] -= r.bytes
                over[r.shard] -= r.bytes
    if not moves:
        return placed
    plan = placed.sparkSession.createDataFrame(moves, "shard int, cell int, target int")
    return marked.join(F.broadcast(plan), ["shard", "cell"], "left").select(
        "id", "size", "tie", "pinned", F.coalesce("target", "shard").alias("shard"))


def _dealt(sizes: list[tuple], shards: int, total: int) -> tuple[list[tuple], list[float]]:
    """Parts (group, low, high, shard) of the groups (group, bytes), from and to which step
    of the hash, and the room that the shards then have."""
    room = [total / shards] * shards
    parts = []
    for group, size in sorted(sizes, key=lambda g: (-g[1], str(g[0]))):
        low, rest = 0, size
        while low < STEPS:
            to = max(range(shards), key=room.__getitem__)
            held = min(rest, room[to]) if room[to] > 0 else rest
            rest -= held
            high = STEPS if rest <= 0 else round(STEPS * (1 - rest / size))
            if high > low:
                parts.append((group, low, high, to))
            room[to] -= held
            low = high
    return parts, room


def _started(nodes: DataFrame, links: DataFrame, shards: int) -> DataFrame:
    """id, size, tie, pinned, shard: large groups in as few shards as hold them."""
    total = nodes.agg(F.sum("size")).first()[0] or 0
    large = checkpointed(links.join(nodes, "id").groupBy("group").agg(
        F.sum("size").alias("bytes")).where(F.col("bytes") > total / shards * LARGE))
    pins = links.join(F.broadcast(large), "group").groupBy("id").agg(
        F.max(F.struct("bytes", F.col("group").alias("pin"))).alias("p")).select("id", "p.pin")
    pins = checkpointed(pins.join(nodes, "id").select("id", "pin", "size"))
    sizes = pins.groupBy("pin").agg(F.sum("size").alias("bytes")).collect()
    parts, room = _dealt([(g.pin, g.bytes) for g in sizes], shards, total)
    plan = nodes.sparkSession.createDataFrame(parts, T.StructType([
        T.StructField("pin", links.schema["group"].dataType),
        *[T.StructField(c, T.IntegerType()) for c in ("low", "high", "to")]]))
    step = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(STEPS)).cast("int")
    own = pins.withColumn("step", step).join(
        F.broadcast(plan.withColumnRenamed("pin", "_pin")),
        (F.col("pin") == F.col("_pin")) & (F.col("step") >= F.col("low"))
        & (F.col("step") < F.col("high"))).select("id", "to")
    room = [max(left, 0) for left in room]
    if not sum(room):
        room = [1] * shards
    other = F.lit(shards - 1)
    for shard in range(shards - 2, -1, -1):
        below = round(STEPS * sum(room[:shard + 1]) / sum(room))
        other = F.when(step < below, F.lit(shard)).otherwise(other)
    ties = links.groupBy("id").agg(F.min("group").alias("tie"))
    return nodes.join(ties, "id", "left").join(own, "id", "left").select(
        "id", "size", "tie", F.col("to").isNotNull().alias("pinned"),
        F.coalesce("to", other).cast("int").alias("shard"))


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS,
              rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """(id, size, shard) of `nodes` (unique id, size > 0), given `links` (id, group).

    Ids of `links` that are no nodes and groups of one have no effect. Sizes of the
    shards come out near equal; a group larger than a shard
    fills whole ones.
    """
    links = links.join(nodes.select("id"), "id", "left_semi").distinct()
    groups = links.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    links = checkpointed(links.join(groups.select("group"), "group").select("id", "group"))
    placed = checkpointed(_started(nodes, links, shards))
    placed = _level(placed, shards, 3)
    for _ in range(rounds):
        placed = _moved(checkpointed(_wishes(placed, links)), shards, slack)
    for salt in (1, 2):
        placed = _level(placed, shards, salt)
    return checkpointed(placed.select("id", "size", "shard"))


def with_slots(placed: DataFrame) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard.

    Rows are numbered within hash cells of a shard, and the cells' counts are summed up;
    no task sorts a whole shard.
    """
    rows = placed.count()
    cells = max(1, rows // SLOT_ROWS)
    cut = placed.withColumn("cell", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(cells)))
    counts = cut.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = counts.select("shard", "cell", (F.sum("n").over(
        Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id")) - 1
    return cut.withColumn("number", number).join(before, ["shard", "cell"]).select(
        "id", "size", "shard", (F.col("before") + F.col("number")).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in eight shards of near equal bytes, equal texts together."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of `docs`.

    Documents with equal texts are linked. A null text has no bytes and no links. Rows
    are placed one by one, repeated ones and those without doc_id too.
    """
    rows = checkpointed(docs.select(
        F.monotonically_increasing_id().alias("id"), "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.unhex(F.md5("text")).alias("group")))
    placed = propagate(rows.select("id", "size"),
                       rows.where("group is not null").select("id", "group"), shards)
    return rows.select("id", "doc_id", "text_crc32").join(with_slots(placed), "id").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))

"""The trie of conversations that share their first turns, by van Emde Boas recursion.

All sequences are cut at half the depth. A cut prefix gets a name (the smallest
conversation that starts with it), the prefixes form the upper trie, and the rests of the
sequences, each under its prefix's name, the forest of lower tries. All of them are cut
in half again, in parallel, until they are one turn high, so that a trie of depth D takes
log2(D) rounds. Two halves are the same if their digests are, and the digests of blocks
of 2, 4, 8... turns come from pairs of shorter ones.

Back up, the same rounds in reverse graft totals: what lies in a lower trie is added to
the node it hangs from and to that node's ancestors within the upper trie.

A row is one turn, one block of turns or one node; no task gathers a conversation, a
group of equal prefixes or a subtree. Names of prefixes that more than one row in
`HOT` shares, at most `HOT` names, are broadcast to their rows; the others are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import discard, stored

#: A name that more than one row in HOT asks for is broadcast.
HOT = 1000
#: Conversations, by their ids, in one part of a node's list; turns in one join key.
CHUNK = 4096
#: Members share their first turns in groups of FAMILY ids, at most LONGEST - 1 of them.
FAMILY = 5
LONGEST = 9

_PLACED = "conv long, digest binary, size long, n long, part int, before long"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, and how many turns of a conversation precede there."""
    part, conv, before = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        starts = []
        for own, n in zip(batch.column("conv").to_pylist(), batch.column("n").to_pylist(),
                          strict=True):
            if own != conv:
                conv, before = own, 0
            starts.append(before)
            before += n
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * len(starts), pa.int32()),
             pa.array(starts, pa.int64())], [*batch.schema.names, "part", "before"])


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv, pos (from 0), digest (of role and text), size (bytes of the text).

    Turns are ordered by turn (null first), then role, then digest; repeated rows are
    repeated turns. Null role and text are empty; rows without conv_id, which must be an
    integer, belong to no conversation and are left out. Other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text),
                       256)).alias("digest"),
        F.octet_length(text).cast("long").alias("size"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    distinct = rows.groupBy("conv", "turn", "role", "digest", "size").agg(
        F.count("*").alias("n"))
    placed = stored(distinct.repartitionByRange(*order).sortWithinPartitions(*order)
                    .select("conv", "digest", "size", "n").mapInArrow(_number, _PLACED))
    # A conversation goes on in a later partition only across a boundary, so there are
    # fewer such rows than partitions.
    parts = Window.partitionBy("conv").orderBy("part")
    further = (placed.groupBy("conv", "part").agg(F.sum("n").alias("own"))
               .withColumn("earlier", F.sum("own").over(
                   parts.rowsBetween(Window.unboundedPreceding, -1)))
               .where("earlier is not null").drop("own"))
    first = F.col("before") + F.coalesce("earlier", F.lit(0))
    return (placed.join(F.broadcast(further), ["conv", "part"], "left")
            .select("conv", "digest", "size", F.explode(F.sequence(
                first, first + F.col("n") - 1)).alias("pos")))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables of the rebuilt conversations: their turns (conv, pos, digest, size)
    and themselves (conv, length), turnless ones too.

    The first h turns of conversation c - c % 5 (all if fewer, none if it doesn't exist)
    replace the first h of c, with h = crc32(c as text) % 9.
    """
    given = stored(numbered_turns(turns))
    convs = given.groupBy("conv").agg(F.count("*").alias("own")).withColumns({
        "base": F.col("conv") - F.col("conv") % FAMILY,
        "h": F.crc32(F.col("conv").cast("string").cast("binary")) % LONGEST})
    bases = convs.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    convs = stored(convs.join(bases, "base", "left").withColumn(
        "lent", F.least("h", F.coalesce("base_own", F.lit(0)))).withColumn(
        "length", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    lent = (given.where(F.col("pos") < LONGEST).withColumnRenamed("conv", "base")
            .join(convs.select("conv", "base", "lent"), "base").where("pos < lent")
            .select("conv", "pos", "digest", "size"))
    chunks = convs.select("conv", "h", "lent", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("own") - 1) / CHUNK))).alias("chunk"))
    kept = (given.withColumn("chunk", F.floor(F.col("pos") / CHUNK))
            .join(chunks, ["conv", "chunk"]).where("pos >= h")
            .select("conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"),
                    "digest", "size"))
    return stored(lent.unionByName(kept)), convs.select("conv", "length")


def _block_digests(turns: DataFrame, rounds: int) -> list[DataFrame]:
    """Per round the digests (conv, block, digest) of whole blocks of 2 ** round turns."""
    levels = [turns.select("conv", F.col("pos").alias("block"), "digest")]
    odd = F.col("block") % 2 == 1
    for _ in range(rounds - 1):
        pairs = levels[-1].groupBy("conv", F.shiftright("block", 1).alias("block")).agg(
            F.max(F.when(~odd, F.col("digest"))).alias("left"),
            F.max(F.when(odd, F.col("digest"))).alias("right"))
        levels.append(stored(pairs.where("right is not null").select(
            "conv", "block", F.unhex(F.sha2(F.concat("left", "right"), 256)).alias("digest"))))
    return levels


def _named(rows: DataFrame, names: DataFrame, *keys: str) -> DataFrame:
    """Adds `name` from `names` (keys, name, n_convs: rows that ask for it).

    One hot key is no hot partition: names that many rows ask for are broadcast, at most
    HOT of them as each stands for more than one row in HOT.
    """
    total = names.agg(F.sum("n_convs")).first()[0] or 0
    asked = names.select(*keys, "name", (F.col("n_convs") * HOT > total).alias("hot"))
    hot, rest = (asked.where(c).drop("hot") for c in ("hot", "not hot"))
    marked = rows.join(F.broadcast(hot), [*keys], "left")
    return marked.where("name is not null").unionByName(
        marked.where("name is null").drop("name").join(rest, [*keys]))


def _members(rows: DataFrame, *keys: str, **more: Column) -> DataFrame:
    """The name (smallest conversation) and size of each group of equal prefixes."""
    return stored(rows.groupBy(*keys).agg(
        F.min("conv").alias("name"), F.count("*").alias("n_convs"),
        *[c.alias(name) for name, c in more.items()]))


def _paths(turns: DataFrame, convs: DataFrame, rounds: int, root: int) -> DataFrame:
    """conv, block, tree: the name of the first `block` turns, for every turn that
    follows."""
    digests = _block_digests(turns, rounds)
    trees = convs.where("length > 0").select(
        "conv", "length", F.lit(0).cast("long").alias("block"),
        F.lit(root).cast("long").alias("tree"))
    for half in reversed(range(rounds)):
        upper = trees.withColumn("block", F.col("block") * 2)
        whole = stored(upper.join(digests[half], ["conv", "block"]))
        names = _members(whole, "block", "tree", "digest")
        lower = _named(whole.where((F.col("block") + 1) * (1 << half) < F.col("length")),
                       names, "block", "tree", "digest")
        before, trees = trees, stored(upper.unionByName(lower.select(
            "conv", "length", (F.col("block") + 1).alias("block"),
            F.col("name").alias("tree"))))
        discard(before, whole, names, digests[half])
    return trees


def _grafted(nodes: DataFrame, paths: DataFrame, rounds: int) -> DataFrame:
    """depth, conv_id, parent, leaves, saved: totals over whole subtrees.

    `nodes` has these columns for single nodes. In each round tries of 2 ** round turns
    hang under the nodes of every second cut; their sums go to those nodes and to their
    ancestors down from the cut above.
    """
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    single = nodes
    for height in (1 << r for r in range(rounds)):
        cut = F.col("depth") - 1
        hanging = nodes.where(cut % (2 * height) == height).groupBy(
            cut.alias("depth"), F.col("parent").alias("conv_id")).agg(*sums)
        below = nodes.select("depth", "conv_id", "leaves", "saved", "parent").unionByName(
            hanging.withColumn("parent", F.lit(None).cast("long")))
        if height > 1:
            above = hanging.select(
                F.col("conv_id").alias("conv"), "leaves", "saved", F.explode(F.sequence(
                    F.col("depth") - height + 1, F.col("depth") - 1)).alias("pos"))
            below = below.unionByName(above.join(paths, ["conv", "pos"]).select(
                F.col("pos").alias("depth"), F.col("tree").alias("conv_id"), "leaves", "saved",
                F.lit(None).cast("long").alias("parent")))
        before, nodes = nodes, stored(below.groupBy("depth", "conv_id").agg(
            F.max("parent").alias("parent"), *sums))
        if before is not single:
            discard(before)
    return nodes


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's parts, which follow one another in order."""
    node, digest = None, None

    def row(found):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(
                zip(*found, strict=True) if found else ([], [], []),
                (pa.int64(), pa.int64(), pa.string()), strict=True)],
            ["depth", "conv_id", "ends_sha256"])

    for batch in batches:
        done = []
        for depth, conv_id, ids in zip(*(batch.column(c).to_pylist() for c in (
                "depth", "conv_id", "ids")), strict=True):
            if (depth, conv_id) != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (depth, conv_id), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield row(done)
    if node is not None:
        yield row([(*node, digest.hexdigest())])


def _ends(ends: DataFrame) -> DataFrame:
    """depth, conv_id, ends_sha256 of the nodes at which conversations end.

    Ids come in parts of at most CHUNK; a node's parts are hashed one after the other as
    they are read, never held together.
    """
    parts = ends.groupBy("depth", "conv_id", F.floor(F.col("conv") / CHUNK).alias("part")).agg(
        F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids"))
    keys = ["depth", "conv_id"]
    return parts.repartition(*keys).sortWithinPartitions(*keys, "part").mapInArrow(
        _hash_lists, "depth long, conv_id long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences `turns` (conv, pos from 0 without gaps, digest,
    size) of the conversations `convs` (conv, length), which may be turnless.

    conv_id (the smallest conversation that starts with the node's turns), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves (in the subtree),
    saved_tokens (bytes that sharing saves in the subtree), ends_sha256 (of the sorted
    ids of conversations that end there, comma-joined). Without conversations there is
    no node.
    """
    spark = turns.sparkSession
    deepest, root, n_all = convs.agg(F.max("length"), F.min("conv"), F.count("*")).first()
    if not n_all:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, "
                                     "n_convs long, n_children long, n_leaves long, "
                                     "saved_tokens long, ends_sha256 string")
    rounds = max(0, (deepest - 1).bit_length())
    paths = _paths(turns, convs, rounds, root)
    paths = paths.withColumnRenamed("block", "pos")
    last = stored(paths.join(turns, ["conv", "pos"]))
    keys = ("pos", "tree", "digest")
    members = _members(last, *keys, size=F.max("size"))
    nodes = members.select(
        (F.col("pos") + 1).alias("depth"), F.col("name").alias("conv_id"),
        F.col("tree").alias("parent"), "n_convs", "size")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"),
                             F.col("parent").alias("conv_id")).agg(
        F.count("*").alias("n_children"))
    top = spark.createDataFrame([(0, root, None, n_all, 0)],
                                "depth long, conv_id long, parent long, n_convs long, size long")
    single = stored(nodes.unionByName(top).join(children, ["depth", "conv_id"], "left")
                    .fillna(0, ["n_children"]))
    totals = _grafted(single.where("depth > 0").select(
        "depth", "conv_id", "parent", (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved")), paths, rounds)
    totals = totals.select("depth", "conv_id", "leaves", "saved").unionByName(
        totals.where("depth = 1").groupBy(
            F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("conv_id"))
        .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    ends = _named(last.where(F.col("pos") + 1 == F.col("length")),
                  members.select(*keys, "name", "n_convs"), *keys).select(
        F.col("length").alias("depth"), F.col("name").alias("conv_id"), "conv")
    turnless = convs.where("length = 0").select(
        F.col("length").alias("depth"), F.lit(root).cast("long").alias("conv_id"), "conv")
    node = ["depth", "conv_id"]
    return (single.join(totals, node, "left")
            .join(_ends(ends.unionByName(turnless)), node, "left")
            .select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs",
                    "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
                    F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
                    .alias("ends_sha256")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt `conversations`."""
    return prefix_trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: CRC-32 of a decimal number, by its definition, one bit at a time.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(
    string_split(CAST(conv AS VARCHAR), ''), lambda c : ascii(c)::BIGINT)),
  lambda r, b : list_reduce(list_concat([xor(r, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, z : xor(x >> 1, (x & 1) * 3988292384 + z))), 4294967295::BIGINT)"""

ORACLE_SQL = f"""
WITH own AS (
  SELECT CAST(conv_id AS BIGINT) AS conv, row_number() OVER (
      PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv, conv - conv % {FAMILY} AS base, {_CRC32} % {LONGEST} AS h, own
  FROM (SELECT conv, count(*) AS own FROM own GROUP BY conv)),
built AS (
  SELECT c.conv, pos, role, text FROM convs c JOIN own o ON o.conv = c.base AND pos < h
  UNION ALL
  SELECT conv, pos + 100000000, role, text FROM own JOIN convs USING (conv)
  WHERE pos >= h),
seq AS (
  SELECT conv, row_number() OVER w AS depth, strlen(text) AS size,
    string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '') OVER w AS key
  FROM built WINDOW w AS (PARTITION BY conv ORDER BY pos)),
tip AS (SELECT conv, coalesce(max(depth), 0) AS depth, coalesce(max_by(key, depth), '') AS key
  FROM convs LEFT JOIN seq USING (conv) GROUP BY conv),
path AS (SELECT conv, depth, key, size FROM seq
  UNION ALL SELECT conv, 0, '', 0 FROM convs),
node AS (SELECT depth, key, min(conv) AS conv_id, count(*) AS n_convs,
  (count(*) - 1) * max(size) AS own FROM path GROUP BY depth, key),
link AS (SELECT u.depth, u.conv_id, u.own, p.depth AS above, p.key,
    u.depth - p.depth AS gap
  FROM node u JOIN path p ON p.conv = u.conv_id AND p.depth <= u.depth),
child AS (SELECT above AS depth, key, count(*) AS n_children FROM link WHERE gap = 1
  GROUP BY above, key),
named AS (SELECT n.*, coalesce(n_children, 0) AS n_children
  FROM node n LEFT JOIN child USING (depth, key)),
total AS (SELECT above AS depth, l.key, sum(l.own) AS saved,
    count(*) FILTER (n.n_children = 0) AS leaves
  FROM link l JOIN named n USING (depth, conv_id) GROUP BY above, l.key),
up AS (SELECT l.depth, l.conv_id, n.conv_id AS parent FROM link l
  JOIN node n ON n.depth = l.above AND n.key = l.key WHERE gap = 1),
ends AS (SELECT depth, key, string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) AS ids
  FROM tip GROUP BY depth, key)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id,
  CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM named JOIN total USING (depth, key) LEFT JOIN up USING (depth, conv_id)
  LEFT JOIN ends USING (depth, key)"""

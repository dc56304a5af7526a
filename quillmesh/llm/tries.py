"""Prefix tries of conversations: partial tries of partitions, merged by keys that name paths, then rolled up from the ends of paths.

A node is named by 16 bytes of BLAKE2b, chained over role and text of each turn from the root on (two paths with one name would share a
node). Each partition combines its conversations into a node table of its own, in tables of bounded size: members, smallest member and
lists of the conversations that end there, in runs of bounded length. Tables of a fixed number of partitions are merged at a time, again
and again, so that a node every partition has never meets in one task unmerged. Runs of ends are taken apart behind the shuffle by key
and sorted there, so a node where a third of all conversations end takes no row or task memory in proportion.

The roll-up doesn't go level by level, as a conversation may have very many turns. A node belongs to its smallest member, and a
conversation owns the last part of its path, if any. Sums over what a conversation owns run from the end of its path upwards; what
reaches a node from all paths through it, added by key, is the sum over its subtree.

Nulls: rows without a conversation's id belong to none and are left out; a null turn comes first, a null role or text is empty. Ties of a
turn and repeated rows all stay, in order of role and text. Conversations without a turn end at the root. The remainder
of a negative id has its sign, as in SQL. Very long texts are hashed
whole, and only their lengths go on. No conversations, no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import Scratch, as_batch, columns, integer_ids, tune

#: Nodes of a partial trie before it is emitted; ends in one run; partial tries merged at a time.
MOST_NODES = 1 << 17
RUN = 1 << 10
FAN_IN = 32
#: Shares of the paths through a node.
SALTS = 64
ROOT = bytes(16)


def numbered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 0), role and text of every turn that belongs to a conversation."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text")).filter("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "role", "text")


def branched(turns: DataFrame, group: int, most: int) -> DataFrame:
    """Numbered turns, rebuilt: conversation c starts with the first h turns of conversation c - c % group, then goes on with its own after h; h = crc32(c) % most.

    Every conversation has a row without a turn too, at -1.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = turns.filter(F.col("pos") >= h)
    convs = turns.select("conv_id").distinct()
    heads = turns.filter((F.col("conv_id") % group == 0) & (F.col("pos") < most - 1)).select(F.col("conv_id").alias("base"), "pos", "role", "text")
    taken = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h")).filter("h > 0").join(heads, "base").filter("pos < h")
    return own.unionByName(taken.select(own.columns)).unionByName(convs.select("conv_id", F.lit(-1).alias("pos"), F.lit("").alias("role"), F.lit("").alias("text")))


PATHS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("chars", pa.int64()), ("ends", pa.bool_())])


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key, chars (of the last text) and ends (whether the conversation ends there) of every node on every conversation's path."""
    # by a hash of the id: a shuffle by the id itself is left out above a union whose sides claim that partitioning, and adaptive reads may then part a conversation
    rows = turns.repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            done = []
            for c, pos, role, text in zip(*columns(b, "conv_id", "pos", "role", "text"), strict=True):
                if pos < 0:
                    node = (c, 0, ROOT, 0)
                else:
                    said = role.encode()
                    key = hashlib.blake2b(b"%b%d:%b%b" % (last[2], len(said), said, text.encode()), digest_size=16).digest()
                    node = (c, last[1] + 1, key, len(text))
                if last:
                    done.append((*last, pos < 0))
                last = node
            if done:
                yield as_batch(done, PATHS)
        if last:
            yield as_batch([(*last, True)], PATHS)

    return rows.mapInArrow(run, "conv_id long, depth long, key binary, chars long, ends boolean")


TRIE = pa.schema([("part", pa.int64()), ("key", pa.binary()), ("depth", pa.int64()), ("chars", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("n_ends", pa.int64()), ("ends", pa.list_(pa.int64()))])


def partial_tries(nodes: DataFrame) -> DataFrame:
    """Node tables of the partitions: part, key, depth, chars, n_convs, conv_id (smallest member), n_ends and a run of ends; a node has a row for each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, trie = TaskContext.get().partitionId(), {}

        def emitted() -> Iterator[pa.RecordBatch]:
            rows = [(part, key, *node[:4], len(node[4]), node[4]) for key, node in trie.items()]
            trie.clear()
            for i in range(0, len(rows), 4096):
                yield as_batch(rows[i : i + 4096], TRIE)

        for b in batches:
            full = []
            for c, depth, key, chars, ends in zip(*columns(b, "conv_id", "depth", "key", "chars", "ends"), strict=True):
                node = trie.get(key)
                if node is None:
                    node = trie[key] = [depth, chars, 0, c, []]
                node[2] += 1
                node[3] = min(node[3], c)
                if ends:
                    node[4].append(c)
                    if len(node[4]) == RUN:
                        full.append((part, key, depth, chars, node[2], node[3], RUN, node[4]))
                        del trie[key]
            if full:
                yield as_batch(full, TRIE)
            if len(trie) > MOST_NODES:
                yield from emitted()
        yield from emitted()

    return nodes.mapInArrow(run, "part long, key binary, depth long, chars long, n_convs long, conv_id long, n_ends long, ends array<long>")


def merged(tries: DataFrame, parts: int) -> DataFrame:
    """key, depth, chars, n_convs, conv_id and n_ends of each node, from partial tries numbered below parts, FAN_IN at a time."""
    sums = [F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_ends").alias("n_ends")]
    nodes = tries.drop("ends")
    while parts > FAN_IN:
        nodes = nodes.groupBy("key", F.floor(F.col("part") / FAN_IN).alias("part")).agg(*sums)
        parts = -(-parts // FAN_IN)
    return nodes.groupBy("key").agg(*sums)


def ends_digests(tries: DataFrame) -> DataFrame:
    """key and ends_sha256: the digest of the ids of the conversations that end there, in ascending order, joined by commas."""
    runs = tries.filter("n_ends > 0").select("key", "ends").repartition("key")
    ids = runs.select("key", F.explode("ends").alias("conv_id")).sortWithinPartitions("key", "conv_id")
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for b in batches:
            done = []
            for key, c in zip(*columns(b, "key", "conv_id"), strict=True):
                if key == now:
                    held.update(b",%d" % c)
                    continue
                if now is not None:
                    done.append((now, held.hexdigest()))
                now, held = key, hashlib.sha256(b"%d" % c)
            if done:
                yield as_batch(done, schema)
        if now is not None:
            yield as_batch([(now, held.hexdigest())], schema)

    return ids.mapInArrow(run, "key binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, walked: DataFrame) -> DataFrame:
    """depth, conv_id, n_convs, parent_conv_id, n_children, n_leaves and saved_tokens of each node, from nodes and the paths through them."""
    about = nodes.select("key", F.col("conv_id").alias("owner"), "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_convs") == F.col("n_ends")).cast("long").alias("leaf"))
    mine = F.col("owner") == F.col("conv_id")
    # a node on very many paths: its facts go to SALTS shares of them first, then each share meets its own copy
    dealt = walked.select("conv_id", "depth", "key", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).alias("salt"))
    facts = dealt.select("key", "salt").distinct().join(about, "key")
    steps = dealt.join(facts, ["key", "salt"]).withColumn("mine", mine.cast("long"))
    path = Window.partitionBy("conv_id").orderBy("depth")
    below = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select(
        "key", "depth", "owner", "n_convs", F.lag("owner").over(path).alias("above"), F.coalesce(F.lead("mine").over(path), F.lit(0)).alias("child"),
        F.sum(F.col("mine") * F.col("leaf")).over(below).alias("leaves"), F.sum(F.col("mine") * F.col("saved")).over(below).alias("saved"),
    )
    return steps.groupBy("key").agg(
        F.first("owner").alias("conv_id"), F.first("depth").alias("depth"), F.first("above").alias("parent_conv_id"), F.first("n_convs").alias("n_convs"),
        F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )


def trie(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """key and all that the roll-up and the ends tell of each node, from rows conv_id, pos, role and text with one row at -1 for each conversation."""
    tune(spark)
    scratch = Scratch(spark, "tries")
    walked = scratch.write(paths(turns), "paths")
    tune(spark, 4096)
    tries = scratch.write(partial_tries(walked), "tries")
    parts = (tries.agg(F.max("part")).first()[0] or 0) + 1
    nodes = merged(tries, parts)
    found = rolled_up(nodes, walked).join(ends_digests(tries), "key", "left")
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def branched_trie(spark: SparkSession, turns: DataFrame, group: int = 100, most: int = 6, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of conversations that were rebuilt upon the head of the first of their group, see branched."""
    integer_ids(turns, conv_id)
    return trie(spark, branched(numbered(turns, conv_id, turn, role, text), group, most))

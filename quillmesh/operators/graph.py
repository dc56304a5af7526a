"""Traversals of code graphs.

A frontier moves level by level: a join with the edges, then an anti join with what was seen. In walks of over three levels each frontier is
checkpointed, so a level costs one pass over the edges and not one for each way back to the root, and an empty frontier ends the walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.lineage import cut


def reachable(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """node, depth: the first level at which each node is reached from the roots (level 0), breadth first (G1, T1, T5, T9). edges: src, dst."""
    front = roots.select("node").distinct().withColumn("depth", F.lit(0))
    seen = front
    for level in range(1, depth + 1):
        nxt = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = nxt.join(seen, "node", "left_anti").withColumn("depth", F.lit(level))
        if depth > 3 and level < depth:
            front = cut(front)
            if front.isEmpty():
                break
        seen = seen.unionByName(front)
    return seen


def walked_edges(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """src, dst, depth: the edges that a bounded walk follows; each node is expanded once."""
    levels = reachable(edges, roots, depth - 1)
    return levels.select(F.col("node").alias("src"), (F.col("depth") + 1).alias("depth")).join(edges, "src").select("src", "dst", "depth")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def trimmed(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges less those that can't be on a cycle, as nothing leads to their start or away from their end, in some rounds."""
    for _ in range(rounds):
        edges = edges.join(edges.select(F.col("dst").alias("src")), "src", "left_semi").join(edges.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
    return edges


def simple_cycles(edges: DataFrame, longest: int, roots: DataFrame | None = None, depth: int = 10) -> DataFrame:
    """cycle: every simple cycle of up to `longest` nodes, as its nodes from the least one on, joined by arrows; with roots, of nodes within `depth` levels of them.

    A path grows only over nodes greater than its first, so every cycle is found once, in one rotation; nodes that can't be on a cycle go first.
    """
    e = edges.filter("src is not null and dst is not null").select("src", "dst").distinct()
    if roots is not None:
        near = reachable(e, roots, depth).select("node")
        e = e.join(near.select(F.col("node").alias("src")), "src", "left_semi").join(near.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    e = cut(trimmed(e))
    paths = e.filter("src < dst").select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    found = e.filter("src = dst").select(F.array("src").alias("path"))
    for size in range(2, longest + 1):
        step = paths.join(e.withColumnRenamed("src", "last"), "last")
        found = found.unionByName(step.filter("dst = first").select("path"))
        if size < longest:
            paths = step.filter((F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst"))).select("first", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path"))
    return found.select(F.array_join("path", " -> ").alias("cycle"), F.size("path").cast("long").alias("length"))


def by_depth(levels: DataFrame) -> DataFrame:
    """A line for each level: how many nodes, and the first and last of them."""
    return levels.groupBy("depth").agg(F.count("*").alias("nodes"), F.min("node").alias("first"), F.max("node").alias("last"))


def resolve_reexports(exports: DataFrame, wanted: DataFrame, depth: int = 5) -> DataFrame:
    """file, name -> home, the nearest file that declares the name, along re-exports of that name or of everything.

    exports: file, name, source (the file it comes from, null where declared).
    """
    front = wanted.select(F.col("file").alias("start"), "name", F.col("file").alias("at")).distinct()
    declared = exports.filter("source is null").select(F.col("file").alias("at"), "name")
    via = exports.filter("source is not null").select(F.col("file").alias("at"), F.col("name").alias("via"), "source")
    out, seen = None, front
    for level in range(depth + 1):
        hits = front.join(declared, ["at", "name"]).select("start", "name", F.col("at").alias("home"), F.lit(level).alias("hops"))
        out = hits if out is None else out.unionByName(hits)
        front = front.join(via, "at").filter((F.col("via") == F.col("name")) | (F.col("via") == "*")).select("start", "name", F.col("source").alias("at")).distinct()
        front = cut(front.join(seen, ["start", "name", "at"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    best = out.groupBy("start", "name").agg(F.min(F.struct("hops", "home")).alias("b"))
    return best.select(F.col("start").alias("file"), "name", "b.home", "b.hops")

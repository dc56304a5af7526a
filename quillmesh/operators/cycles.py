"""Strongly connected components, and shortest cycles within them, of graphs of any size.

Components are found by colours: every node takes the greatest node that reaches it, and what reaches that node backwards within its
colour is its component. Nodes that nothing reaches or that reach nothing are trimmed before, as no cycle passes through them. All
steps are joins over edges and are written to the shared folder; the driver sees counts only. Rounds follow the longest shortest path
within a colour, not the size of the graph. Null ends and repeated edges are left out; a loop is a cycle of one node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.lineage import stored

#: Steps that are taken between two writes.
UNROLL = 3


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges between nodes that have edges in and out, and how many these are."""
    n = edges.count()
    while n:
        kept = edges
        for _ in range(UNROLL):
            enters, leaves = kept.select(F.col("dst").alias("src")).distinct(), kept.select(F.col("src").alias("dst")).distinct()
            kept = kept.join(enters, "src", "left_semi").join(leaves, "dst", "left_semi").select("src", "dst")
        edges = stored(kept)
        left = edges.count()
        if left == n:
            break
        n = left
    return edges, n


def _coloured(edges: DataFrame) -> DataFrame:
    """node, colour: the greatest node that reaches each."""
    found = edges.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("colour"))
    while True:
        step = found.withColumnRenamed("colour", "before")
        for _ in range(UNROLL):
            colour = F.col("colour") if "colour" in step.columns else F.col("before")
            here = step.select("node", "before", colour.alias("colour"))
            sent = edges.join(here.select(F.col("node").alias("src"), F.col("colour").alias("sent")), "src").groupBy(F.col("dst").alias("node")).agg(F.max("sent").alias("sent"))
            step = here.join(sent, "node", "left").select("node", "before", F.greatest("colour", "sent").alias("colour"))
        step = stored(step)
        found = step.select("node", "colour")
        if not step.filter("colour <> before").limit(1).count():
            return found


def _backwards(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """node, colour of nodes that reach the node their colour is named after, within the colour."""
    ends = [colours.select(F.col("node").alias(c), F.col("colour").alias(f"{c}_colour")) for c in ("src", "dst")]
    inside = stored(edges.join(ends[0], "src").join(ends[1], "dst").filter("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")))
    found = colours.filter("node = colour")
    n = 0
    while True:
        for _ in range(UNROLL):
            more = inside.join(found.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "colour")
            found = found.union(more).distinct()
        found = stored(found)
        if (now := found.count()) == n:
            return found
        n = now


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), size and on_cycle of every node of the edges (src, dst)."""
    whole = stored(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    live, n = _trimmed(whole.filter("src <> dst"))
    done: list[DataFrame] = []
    while n:
        found = _backwards(live, _coloured(live))
        done.append(_named(found))
        for end in ("src", "dst"):
            live = live.join(found.select(F.col("node").alias(end)), end, "left_anti").select("src", "dst")
        live, n = _trimmed(stored(live))
    nodes = whole.select(F.col("src").alias("node")).union(whole.select(F.col("dst").alias("node"))).distinct()
    found = nodes.limit(0).select("node", F.col("node").alias("component"))
    for d in done:
        found = found.union(d)
    named = nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    sizes = named.groupBy("component").agg(F.count("*").alias("size"))
    loops = whole.filter("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop"))
    out = named.join(sizes, "component").join(loops, "node", "left")
    return out.select("node", "component", "size", ((F.col("size") > 1) | F.coalesce("loop", F.lit(False))).alias("on_cycle"))


def _named(found: DataFrame) -> DataFrame:
    least = found.groupBy("colour").agg(F.min("node").alias("component"))
    return stored(found.join(least, "colour").select("node", "component"))


def shortest_cycles(edges: DataFrame, components: DataFrame, asked: DataFrame) -> DataFrame:
    """node, length and cycle (its nodes from the node on, the least of the shortest) for each asked node that lies on a cycle. asked: node.

    Each asked node's search stays in its component and ends when all have closed; its cost is the component's edges for each asked node.
    """
    ends = [components.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")) for c in ("src", "dst")]
    inside = stored(edges.select("src", "dst").distinct().join(ends[0], "src").join(ends[1], "dst").filter("src_in = dst_in").select("src", "dst"))
    front = stored(asked.select("node").distinct().join(components.filter("on_cycle"), "node", "left_semi").select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path")))
    seen, closed = front.select("start", "at"), None
    while front.limit(1).count():
        ahead = front.join(inside.select(F.col("src").alias("at"), "dst"), "at").select("start", F.col("dst").alias("at"), "path")
        ahead = ahead.groupBy("start", "at").agg(F.min("path").alias("path"))
        back = stored(ahead.filter("at = start").select("start", "path"))
        closed = back if closed is None else stored(closed.union(back))
        fresh = ahead.join(seen, ["start", "at"], "left_anti").join(closed.select("start"), "start", "left_anti")
        front = stored(fresh.select("start", "at", F.concat("path", F.array("at")).alias("path")))
        seen = stored(seen.union(front.select("start", "at")))
    found = front.select("start", "path") if closed is None else closed
    return found.select(F.col("start").alias("node"), F.size("path").alias("length"), F.col("path").alias("cycle"))

"""Connected components by repeated contraction, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import Scratch


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for each node of the edges (u, v); root is the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour, follows the pointers to their ends by doubling, and keeps the
    edges between different ends; at least half of the nodes go in every round. Loops and repeated edges do no harm.
    """
    both = edges.filter("u <> v").select("u", "v").union(edges.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
    live = scratch.write(both.distinct(), "edges-0")
    roots, n, left = None, 0, live.count()
    while left or roots is None:
        hooks = live.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        ends = scratch.write(hooks, f"hooks-{n}-0")
        jump, moved = 0, left
        while moved:
            above = ends.select(F.col("node").alias("root"), F.col("root").alias("end"))
            jump += 1
            far = scratch.write(ends.join(above, "root").select("node", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")), f"hooks-{n}-{jump}")
            scratch.drop(f"hooks-{n}-{jump - 1}")
            moved = far.filter("moved").count()
            ends = far.select("node", "root")
        a, b = (ends.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in ("u", "v"))
        kept = live.join(a, "u").join(b, "v").filter("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct()
        live_next = scratch.write(kept, f"edges-{n + 1}")
        if roots is None:
            all_roots = scratch.write(ends, f"roots-{n}")
        else:
            on = ends.select(F.col("node").alias("root"), F.col("root").alias("end"))
            all_roots = scratch.write(roots.join(on, "root", "left").select("node", F.coalesce("end", "root").alias("root")), f"roots-{n}")
            scratch.drop(f"roots-{n - 1}")
        scratch.drop(f"hooks-{n}-{jump}", f"edges-{n}")
        roots, live, n = all_roots, live_next, n + 1
        left = live.count()
    return roots

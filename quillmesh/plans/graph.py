"""Queries over graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.operators import cycles as scc
from quillmesh.operators import graph as g
from quillmesh.plans.markov import RELS
from quillmesh.plans.registry import query
from quillmesh.sources import bindings as b

LAYERS = """layers AS (SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer
UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey FROM lineitem)"""


def bfs_sql(edges: str, root: str, depth: int) -> str:
    """Breadth-first levels; UNION drops repeated (node, depth) pairs."""
    return f"""walk(node, depth) AS (SELECT '{root}', 0 UNION SELECT dst, depth + 1 FROM walk JOIN {edges} ON src = node WHERE depth < {depth}),
levels AS (SELECT node, min(depth) AS depth FROM walk GROUP BY 1)"""


def _root(spark: SparkSession, node: str) -> DataFrame:
    return spark.createDataFrame([(node,)], "node string")


@query("g1_dependencies", f"WITH RECURSIVE {LAYERS}, {bfs_sql('layers', 'r:1', 3)} SELECT node, depth FROM levels")
def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a root depends on within three levels."""
    return g.reachable(b.layered_edges(spark, sf_dir), _root(spark, "r:1"), 3)


@query("g4_dependencies_by_depth", f"WITH RECURSIVE {LAYERS}, {bfs_sql('layers', 'r:1', 4)} SELECT depth, count(*) AS nodes, min(node) AS first, max(node) AS last FROM levels GROUP BY 1")
def dependencies_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.by_depth(g.reachable(b.layered_edges(spark, sf_dir), _root(spark, "r:1"), 4))


EVENT_EDGES = "ev AS (SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"


@query("g2_cycles", f"""WITH RECURSIVE {EVENT_EDGES}, p(first, last, path) AS (SELECT src, dst, [src, dst] FROM ev WHERE src < dst UNION ALL SELECT first, dst, list_append(path, dst) FROM p JOIN ev ON src = last WHERE dst > first AND NOT list_contains(path, dst) AND len(path) < 4),
c AS (SELECT path FROM p JOIN ev ON src = last AND dst = first UNION ALL SELECT [src] FROM ev WHERE src = dst) SELECT array_to_string(path, ' -> ') AS cycle, len(path) AS length FROM c""")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All simple cycles of up to four event types, each in one rotation."""
    return g.simple_cycles(b.event_edges(spark, sf_dir), 4)


@query("t1_trace_callees", f"WITH RECURSIVE {LAYERS}, {bfs_sql('layers', 'c:5', 1)} SELECT src, dst, depth + 1 AS depth FROM levels JOIN layers ON src = node")
def trace_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls from one symbol, two levels down."""
    return g.walked_edges(b.layered_edges(spark, sf_dir), _root(spark, "c:5"), 2)


@query("t1_trace_callers", f"WITH RECURSIVE {LAYERS}, rev AS (SELECT dst AS src, src AS dst FROM layers), {bfs_sql('rev', 'p:7', 2)} SELECT src, dst, depth + 1 AS depth FROM levels JOIN rev ON src = node")
def trace_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of one symbol, three levels up."""
    edges = b.layered_edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return g.walked_edges(edges, _root(spark, "p:7"), 3)


@query("t5_type_hierarchy", f"WITH RECURSIVE {RELS}, e AS (SELECT source AS src, target AS dst FROM rels UNION ALL SELECT target, source FROM rels), {bfs_sql('e', 'n:3', 3)} SELECT node, depth FROM levels")
def type_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types above and below one."""
    edges = b.type_relations(spark, sf_dir).select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return g.reachable(g.both_ways(edges), _root(spark, "n:3"), 3)


@query("t6_subtypes", f"WITH {RELS} SELECT DISTINCT source, kind FROM rels WHERE target = 'n:3' AND kind IN ('implements', 'extends') UNION SELECT source, kind FROM rels WHERE target = 'n:3'")
def subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implementations and subtypes, each once."""
    of = b.type_relations(spark, sf_dir).filter("target = 'n:3'")
    return of.filter(F.col("kind").isin("implements", "extends")).unionByName(of).select("source", "kind").distinct()


@query("t2_call_references", """WITH c AS (SELECT o_custkey AS caller FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey = 3 AND l_returnflag = 'R') SELECT DISTINCT caller FROM c""")
def call_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls a symbol, from references where no edges are known."""
    lines = b.table(spark, sf_dir, "lineitem").filter("l_partkey = 3 and l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return b.table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("caller")).distinct()


@query("t8_reexports", """WITH RECURSIVE ex AS (SELECT 'o:' || o_orderkey AS file, 'x' || (o_orderkey % 10) AS name, CASE WHEN o_orderkey % 10 <> 0 AND o_orderkey % 3 > 0 THEN 'o:' || (o_orderkey - 10) END AS source FROM orders
  UNION ALL SELECT 'o:' || o_orderkey, '*', 'o:' || (o_orderkey - 20) FROM orders WHERE o_orderkey % 4 = 1),
w(first, name, place, hops) AS (SELECT DISTINCT file, name, file, 0 FROM ex WHERE name <> '*' UNION SELECT first, w.name, source, hops + 1 FROM w JOIN ex ON ex.file = place AND (ex.name = w.name OR ex.name = '*') AND source IS NOT NULL WHERE hops < 4),
h AS (SELECT first, w.name, place AS home, hops FROM w JOIN ex ON ex.file = place AND ex.name = w.name AND ex.source IS NULL)
SELECT first AS file, name, arg_min(home, ROW(hops, home)) AS home, min(hops) AS hops FROM h GROUP BY 1, 2""")
def reexports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where re-exported names are declared, four steps away at most."""
    key = F.col("o_orderkey")
    name = lambda c: F.concat(F.lit("o:"), c.cast("string"))
    orders = b.table(spark, sf_dir, "orders")
    own = orders.select(name(key).alias("file"), F.concat(F.lit("x"), (key % 10).cast("string")).alias("name"), F.when((key % 10 != 0) & (key % 3 > 0), name(key - 10)).alias("source"))
    every = orders.filter(key % 4 == 1).select(name(key).alias("file"), F.lit("*").alias("name"), name(key - 20).alias("source"))
    return g.resolve_reexports(own.unionByName(every), own, 4)


_STEPS = """st AS (SELECT DISTINCT u || ':' || k AS src, u || ':' || lead(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, u FROM (SELECT *, user_id % 100 AS u, json_extract_string(props, '$.k') AS k FROM events)),
ed AS (SELECT DISTINCT src, dst, u FROM st WHERE src IS NOT NULL AND dst IS NOT NULL)"""


def step_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users of one hundredth go on to from each thing they use: a hundred graphs with cycles of any length."""
    events = b.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("user_id") % 100).cast("string").alias("u"), F.get_json_object("props", "$.k").alias("k"))
    after = F.lead("k").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    named = lambda c: F.concat("u", F.lit(":"), c)
    return events.select(named("k").alias("src"), named(after).alias("dst")).filter("src is not null and dst is not null").distinct()


@query("g2_components", f"""WITH RECURSIVE {_STEPS}, reach(src, dst) AS (SELECT src, dst FROM ed UNION SELECT r.src, e.dst FROM reach r JOIN ed e ON r.dst = e.src),
nodes AS (SELECT src AS node FROM ed UNION SELECT dst FROM ed), c AS (SELECT a.src AS node, min(a.dst) AS other FROM reach a JOIN reach z ON a.src = z.dst AND a.dst = z.src GROUP BY 1),
n AS (SELECT node, least(coalesce(other, node), node) AS component FROM nodes LEFT JOIN c USING (node)), s AS (SELECT component, count(*) AS size FROM n GROUP BY 1)
SELECT node, component, size, node IN (SELECT src FROM reach WHERE src = dst) AS on_cycle FROM n JOIN s USING (component)""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nodes lie on a cycle, of whatever length, and with which others."""
    return scc.strong_components(step_edges(spark, sf_dir))

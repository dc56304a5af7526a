"""Queries over what is left: neighbours by name, chain support, configuration trees, public surfaces, ordering, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.operators import bundles, graph
from quillmesh.operators import retrieval as r
from quillmesh.plans.graph import LAYERS, bfs_sql
from quillmesh.plans.markov import ALL, EVERY, chains
from quillmesh.operators.markov import hot_keys, paired
from quillmesh.plans.registry import query
from quillmesh.sources import bindings as b


@query("l8_symbols_by_id", "SELECT p_partkey AS symbol_id, p_name AS name, p_type AS kind, p_size AS line_start FROM part WHERE p_partkey IN (1, 7, 42, 150)")
def symbols_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols by their ids; the filter reaches the scan."""
    return b.symbols(spark, sf_dir).filter(F.col("symbol_id").isin(1, 7, 42, 150)).select("symbol_id", "name", "kind", "line_start")


@query("l10_callers_and_callees", "SELECT 'caller' AS role, CAST(l_orderkey AS VARCHAR) AS name, count(*) AS call_count FROM lineitem WHERE l_partkey = 7 GROUP BY 2 UNION ALL SELECT 'callee', CAST(l_partkey AS VARCHAR), count(*) FROM lineitem WHERE l_orderkey = 7 GROUP BY 2")
def callers_and_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    side = lambda role, keep, other: calls.filter(keep).groupBy(F.col(other).cast("string").alias("name")).agg(F.count("*").alias("call_count")).select(F.lit(role).alias("role"), "name", "call_count")
    return side("caller", F.col("l_partkey") == 7, "l_orderkey").unionByName(side("callee", F.col("l_orderkey") == 7, "l_partkey"))


@query("l13_chain_support", f"WITH {ALL}, {EVERY} SELECT chain, count(DISTINCT from_id) AS states FROM every WHERE from_id IN ('1', 'n:3', 'c:1') GROUP BY 1")
def chain_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chains know which of some states."""
    wanted = chains(spark, sf_dir).filter(F.col("from_id").isin("1", "n:3", "c:1"))
    return wanted.groupBy("chain").agg(F.countDistinct("from_id").alias("states"))


ORDER_TREE = "t AS (SELECT o_orderkey AS file, to_json({status: o_orderstatus, detail: {priority: o_orderpriority, key: o_custkey}}) AS doc FROM orders)"


@query("l15_config_children", f"WITH {ORDER_TREE} SELECT file, json_extract_string(doc, '$.detail.priority') AS priority, CAST(json_extract_string(doc, '$.detail.key') AS BIGINT) AS key, len(json_keys(doc, '$.detail')) AS children FROM t")
def config_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of one path of every configuration."""
    doc = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("key")).alias("detail")))
    rows = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), doc.alias("doc"))
    at = lambda p: F.get_json_object("doc", f"$.detail.{p}")
    return rows.select("file", at("priority").alias("priority"), at("key").cast("long").alias("key"), F.size(F.json_object_keys(F.get_json_object("doc", "$.detail"))).cast("long").alias("children"))


@query("f13_value_types", "SELECT event_type, json_type(props, '$.k') AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def value_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of value a key holds."""
    kind = F.upper(F.schema_of_variant(F.try_variant_get(F.parse_json("props"), "$.k", "variant")))
    kind = F.when(kind == "BIGINT", "UBIGINT").otherwise(kind)  # the test data holds no negative ones
    return b.table(spark, sf_dir, "events").groupBy("event_type", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("t9_callee_closure", f"WITH RECURSIVE {LAYERS}, {bfs_sql('layers', 'o:1', 2)} SELECT node, depth FROM levels WHERE depth > 0")
def callee_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callees of a symbol and theirs."""
    return graph.reachable(b.layered_edges(spark, sf_dir), spark.createDataFrame([("o:1",)], "node string"), 2).filter("depth > 0")


@query("q15_frameworks", """SELECT CASE WHEN regexp_matches(text, 'import pytest|def test_') THEN 'pytest' WHEN regexp_matches(text, 'import unittest') THEN 'unittest' WHEN regexp_matches(text, '\\bdescribe\\(|\\bit\\(') THEN 'mocha' ELSE 'unknown' END AS framework, count(*) AS n
FROM (SELECT CASE turn % 4 WHEN 0 THEN 'import pytest' WHEN 1 THEN 'describe(' WHEN 2 THEN 'import unittest' ELSE '' END || ' ' || text AS text FROM conversations) GROUP BY 1""")
def frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("turn") % 4
    head = F.when(n == 0, "import pytest").when(n == 1, "describe(").when(n == 2, "import unittest").otherwise("")
    rows = b.table(spark, sf_dir, "conversations").select(r.framework(F.concat_ws(" ", head, "text")).alias("framework"))
    return rows.groupBy("framework").agg(F.count("*").alias("n"))


@query("q17_first_tests", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS k FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)) WHERE k <= 5")
def first_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of each role, each place once (Q17; a top-k report)."""
    return bundles.first_places(b.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["role"], ["conv_id", "turn"])


_FILE = """ln AS (SELECT conv_id, role = 'user' AS head, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS line FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)),
placed AS (SELECT *, max(CASE WHEN head THEN line END) OVER (PARTITION BY conv_id ORDER BY line) AS head_at FROM ln)"""


@query("q16_tests_of_symbols", f"""WITH {_FILE} SELECT DISTINCT 'x' || (a.turn % 3) AS symbol_name, 'tests/' || a.conv_id || '.test.ts' AS file_path, CAST(a.head_at AS BIGINT) AS line_number, 'turn ' || h.turn AS name, 'vitest' AS framework
FROM placed a JOIN ln h ON h.conv_id = a.conv_id AND h.line = a.head_at WHERE NOT a.head""")
def tests_of_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11, Q15-Q17: conversations as test files; users' turns begin tests, the others refer to symbols."""
    turns = b.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    files = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    path = F.concat(F.lit("tests/"), F.col("conv_id").cast("string"), F.lit(".test.ts")).alias("file_path")
    line = lambda t: F.when(t["role"] == "user", F.concat(F.lit("it('turn "), t["turn"].cast("string"), F.lit("', () => {"))).otherwise(F.concat(F.lit("  x"), (t["turn"] % 3).cast("string"), F.lit("()")))
    texts = files.select(path, F.array_join(F.transform("turns", line), "\n").alias("content"))
    refs = files.select(path, F.posexplode("turns").alias("at", "t")).filter("t.role <> 'user'")
    refs = refs.select(F.concat(F.lit("x"), (F.col("t.turn") % 3).cast("string")).alias("symbol_name"), "file_path", (F.col("at") + 1).alias("line_number"))
    return bundles.enclosing_tests(refs, texts).withColumn("line_number", F.col("line_number").cast("long"))


@query("q20_even_shares", """WITH i AS (SELECT o_orderkey AS id, o_custkey AS symbol, CASE WHEN o_orderkey % 4 = 0 THEN 'types' WHEN o_orderkey % 4 = 1 THEN 'tests' WHEN o_orderkey % 4 = 2 THEN 'symbol' ELSE 'callees' END AS section FROM orders)
SELECT id, section, CAST(floor(floor(8000 * CASE section WHEN 'symbol' THEN CAST(0.4 AS DOUBLE) WHEN 'tests' THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END + CAST(1e-9 AS DOUBLE)) / count(*) OVER (PARTITION BY symbol, section)) AS BIGINT) AS tokens FROM i""")
def even_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q20: customers as symbols, their orders as what belongs to them."""
    n = F.col("o_orderkey") % 4
    section = F.when(n == 0, "types").when(n == 1, "tests").when(n == 2, "symbol").otherwise("callees")
    items = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("symbol"), section.alias("section"))
    return bundles.shared_out(items, ["symbol"], F.lit(8000), True).select("id", "section", "tokens")


@query("q31_public_api", """WITH d AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 40), re AS (SELECT DISTINCT p_name AS name FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
a AS (SELECT name FROM d UNION SELECT name FROM re) SELECT name, name IN (SELECT p_name FROM part WHERE p_type = 'PROMO') AS resolved FROM a""")
def public_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared and re-exported names, each once, and whether something declares them."""
    part = b.table(spark, sf_dir, "part")
    again = b.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    names = part.filter("p_size > 40").select(F.col("p_name").alias("name")).union(part.join(again, "p_partkey", "left_semi").select("p_name")).distinct()
    known = part.filter("p_type = 'PROMO'").select(F.col("p_name").alias("name")).distinct().withColumn("yes", F.lit(True))
    return names.join(known, "name", "left").select("name", F.coalesce("yes", F.lit(False)).alias("resolved"))


@query("q33_kind_order", "SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 WHEN 'PROMO' THEN 2 ELSE 3 END, p_name, p_partkey) AS place FROM part")
def kind_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q33, O1: symbols of a file by kind, then name."""
    kind = F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "STANDARD", 1).when(F.col("p_type") == "PROMO", 2).otherwise(3)
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(kind, "p_name", "p_partkey"))
    return b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), place.cast("long").alias("place"))


@query("x2_intersection", "SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two searches both find."""
    lines = b.table(spark, sf_dir, "lineitem")
    return lines.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")).intersect(lines.filter("l_quantity > 45").select("l_partkey"))


@query("j7_owned_rows", "SELECT count(*) AS kept FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#17')")
def owned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when the rows of a file are deleted."""
    gone = b.table(spark, sf_dir, "part").filter("p_brand = 'Brand#17'").select(F.col("p_partkey").alias("l_partkey"))
    return b.table(spark, sf_dir, "lineitem").join(gone, "l_partkey", "left_anti").agg(F.count("*").alias("kept"))


@query("j9_enriched", "SELECT l_orderkey AS edge, count(*) AS n, count(p_name) AS named FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 20) ON p_partkey = l_partkey GROUP BY 1")
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with what is known of their targets, or null."""
    known = b.table(spark, sf_dir, "part").filter("p_size > 20").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    rows = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(known, "l_partkey", "left")
    return rows.groupBy(F.col("l_orderkey").alias("edge")).agg(F.count("*").alias("n"), F.count("p_name").alias("named"))


@query("j11_matching_terms", "SELECT p_partkey AS id, term FROM part, (SELECT unnest(['red', 'gear', 'wid']) AS term) WHERE contains(p_name, term)")
def matching_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with each expansion term it holds; the terms are a literal array, so no join is needed."""
    found = F.filter(F.array(*[F.lit(t) for t in ("red", "gear", "wid")]), lambda t: F.contains(F.col("p_name"), t))
    return b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(found).alias("term"))


@query("o9_math", "SELECT o_orderkey AS id, round(ln(o_totalprice) + sqrt(o_totalprice), 6) AS a, CAST(floor(o_totalprice / 7) AS BIGINT) AS b, CAST(ceil(abs(o_totalprice - 100000)) AS BIGINT) AS c, CAST(epoch_ms(o_orderdate) AS BIGINT) AS ms FROM orders")
def math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arithmetic and time stamps that scores use."""
    p = F.col("o_totalprice")
    return b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.log(p) + F.sqrt(p), 6).alias("a"), F.floor(p / 7).cast("long").alias("b"), F.ceil(F.abs(p - 100000)).cast("long").alias("c"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"))


@query("c6_redistributed_weights", "WITH w AS (SELECT * FROM (VALUES ('call_flow', CAST(0.4 AS DOUBLE)), ('cooccurrence', CAST(0.25 AS DOUBLE))) AS v(chain, w)) SELECT chain, round(w / sum(w) OVER (), 6) AS weight FROM w")
def redistributed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the chains that know a part, shared out anew."""
    from quillmesh.operators.markov import CHAIN_WEIGHTS

    known = chains(spark, sf_dir).filter("from_id = '1' and chain in ('call_flow', 'cooccurrence')").select("chain").distinct()
    w = F.create_map(*[F.lit(x) for kv in CHAIN_WEIGHTS.items() for x in kv])[F.col("chain")]
    rated = known.withColumn("w", w)
    return rated.join(F.broadcast(rated.agg(F.sum("w").alias("t")))).select("chain", F.round(F.col("w") / F.col("t"), 6).alias("weight"))


@query("j10_same_supplier_pairs", "WITH d AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) SELECT a.s AS x, b.s AS y, count(*) AS n FROM d a JOIN d b ON a.o = b.o AND a.s < b.s GROUP BY 1, 2")
def same_order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs i < j of one key (J10); keys of many rows are dealt in blocks."""
    d = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).distinct()
    return paired(d, "o", "s", hot_keys(d, "o")).select(F.col("a_s").alias("x"), F.col("b_s").alias("y")).filter("x < y").groupBy("x", "y").agg(F.count("*").alias("n"))

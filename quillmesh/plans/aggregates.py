"""Queries over roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import aggregates as a
from quillmesh.plans.registry import query
from quillmesh.sources import bindings as b

FILES = """files AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS file_path, source || '/' || lang AS directory, lang AS language, sha256(text) AS checksum,
  CAST(strlen(text) AS BIGINT) AS file_size, CAST(len(string_split(text, chr(10))) AS BIGINT) AS line_count, source, doc_id FROM documents)"""
KIND = "CASE WHEN p_type = 'ECONOMY' THEN 'class' WHEN p_type = 'STANDARD' THEN 'function' WHEN p_type = 'PROMO' THEN 'interface' WHEN p_type = 'SMALL' THEN 'type' ELSE 'variable' END"
KINDS = {"ECONOMY": "class", "STANDARD": "function", "PROMO": "interface", "SMALL": "type"}


def kind_of(c: str = "p_type"):
    out = F.lit("variable")
    for k, v in KINDS.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


@query("a1_language_stats", f"""WITH {FILES}, s AS (SELECT lang AS language, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM documents JOIN labels USING (doc_id) GROUP BY 1),
f AS (SELECT language, count(*) AS n, sum(file_size) AS bytes FROM files GROUP BY 1), l AS (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS language)
SELECT language, coalesce(n, 0) AS n_files, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes, CAST(coalesce(good, 0) AS BIGINT) AS n_good, CAST(coalesce(bad, 0) AS BIGINT) AS n_bad FROM l LEFT JOIN f USING (language) LEFT JOIN s USING (language)""")
def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = b.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("kind"))
    marked = b.files(spark, sf_dir).select("doc_id", "language").join(labels, "doc_id")
    return a.language_stats(b.files(spark, sf_dir), marked, ["de", "en", "es", "fr", "it"], {"good": ["1"], "bad": ["0"]})


@query("a4_directory_rollup", f"WITH {FILES} SELECT directory, count(*) AS n_files, CAST(sum(line_count) AS BIGINT) AS lines, CAST(sum(file_size) AS BIGINT) AS bytes FROM files GROUP BY 1")
def directory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.directory_rollup(b.files(spark, sf_dir))


@query("a5_collapse_calls", """SELECT l_orderkey AS caller, l_suppkey AS callee, count(*) AS call_count, arg_min(l_returnflag, ROW(l_linenumber, l_partkey, l_shipdate, l_extendedprice, l_returnflag, l_linestatus)) AS returnflag,
  arg_min(l_linestatus, ROW(l_linenumber, l_partkey, l_shipdate, l_extendedprice, l_returnflag, l_linestatus)) AS linestatus FROM lineitem GROUP BY 1, 2""")
def collapse_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("caller"), F.col("l_suppkey").alias("callee"), "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"))
    return a.collapse_calls(rows, ["caller", "callee"], ["l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"], ["returnflag", "linestatus"])


@query("a8_popularity", """WITH e AS (SELECT p_name AS name, 1 AS n FROM part UNION ALL SELECT p_name, count(*) FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_partkey, p_name
  UNION ALL SELECT c_name, 1 FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT s_name, 1 FROM supplier)
SELECT trim(name) AS name, CAST(sum(n) AS BIGINT) AS score FROM e WHERE trim(name) <> '' GROUP BY 1""")
def popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = b.table(spark, sf_dir, "part")
    count = b.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("call_count"))
    called = part.join(count, part.p_partkey == count.l_partkey).select(F.col("p_name").alias("name"), "call_count")
    orders, customer = b.table(spark, sf_dir, "orders").select("o_custkey"), b.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return a.popularity(part.select(F.col("p_name").alias("name")), called, orders.join(customer, orders.o_custkey == customer.c_custkey).select("name"), b.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")))


@query("a9_module_rollup", f"""WITH {FILES} SELECT string_split(file_path, '/')[1] AS module, count(*) AS n_files, CAST(sum(line_count) AS BIGINT) AS lines, count(DISTINCT language) AS languages FROM files GROUP BY 1""")
def module_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.module_rollup(b.files(spark, sf_dir).withColumn("module", a.module_name(F.col("file_path"))))


@query("a10_fan_out", """WITH rels AS (SELECT 'n:' || n_nationkey AS source, 'r:' || n_regionkey AS target, 'extends' AS kind FROM nation UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'implements' FROM supplier UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'mixin' FROM customer)
SELECT target, kind, count(DISTINCT source) AS children, min(source) AS first, max(source) AS last FROM rels GROUP BY 1, 2 HAVING count(DISTINCT source) >= 2""")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.fan_out(b.type_relations(spark, sf_dir))


@query("a11_dependency_edges", """WITH i AS (SELECT s_nationkey AS f, c_nationkey AS t, l_partkey AS specifier, l_returnflag = 'R' AS type_only FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT f AS from_module, t AS to_module, count(DISTINCT specifier) AS specifiers, count(*) FILTER (type_only) AS type_only, count(*) FILTER (NOT type_only) AS values FROM i WHERE f <> t GROUP BY 1, 2""")
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: b.table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey", F.col("l_partkey").alias("specifier"), (F.col("l_returnflag") == "R").alias("type_only"))
    rows = lines.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("to_module")), "o_custkey")
    return a.dependency_edges(rows.join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("from_module")), "l_suppkey"))


@query("a12_metric_summary", "SELECT event_type, min(value) AS least, round(quantile_cont(value, 5e-1), 6) AS median, max(value) AS most FROM events GROUP BY 1")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.metric_summary(b.table(spark, sf_dir, "events"), "event_type", "value").withColumn("median", F.round("median", 6))


@query("a13_file_summary", "SELECT p_brand AS file_path, count(*) || ' symbols, ' || count(*) FILTER (p_size > 25) || ' exported: ' || array_to_string(list_sort(list(DISTINCT p_type)), ', ') AS summary FROM part GROUP BY 1")
def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.file_summary(b.symbols(spark, sf_dir))


EXPORTS = f"""e AS (SELECT p_partkey AS id, p_name AS name, p_brand AS file_path, {KIND} AS kind, p_brand || ' ' || p_type || ' ' || p_name AS signature, p_size % 7 AS methods, p_size % 5 AS params, coalesce(n, 0) AS refs
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE p_size > 25),
s AS (SELECT *, CASE kind WHEN 'class' THEN 30 + 4 * refs + 3 * methods + params WHEN 'function' THEN 20 + 4 * refs + params WHEN 'interface' THEN 10 + 4 * refs + params + methods WHEN 'type' THEN 8 + 4 * refs ELSE 6 + 4 * refs END AS score FROM e),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, name ORDER BY score DESC, length(signature) || ':' || file_path, id) AS r FROM s) WHERE r = 1)"""


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"))
    part = b.table(spark, sf_dir, "part").filter("p_size > 25").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), kind_of().alias("kind"), F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("signature"),
        (F.col("p_size") % 7).alias("methods"), (F.col("p_size") % 5).alias("params"),
    )
    rated = part.join(refs, "id", "left").withColumn("refs", F.coalesce("n", F.lit(0)))
    rated = rated.withColumn("score", a.export_score(F.col("kind"), F.col("refs"), F.col("methods"), F.col("params")).cast("long"))
    return a.best_of(rated, ["kind", "name"], [F.desc("score"), F.concat_ws(":", F.length("signature").cast("string"), "file_path").asc(), F.col("id").asc()])


@query("q26_export_dedupe", f"WITH {EXPORTS} SELECT kind, name, file_path, id, CAST(score AS BIGINT) AS score FROM d")
def export_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q24, Q25, Q26: exports with their score, the best of each kind and name."""
    return _exports(spark, sf_dir).select("kind", "name", "file_path", "id", "score")


@query("q27_top_exports", f"WITH {EXPORTS}, t AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, name, id) AS k FROM d) SELECT kind, name, CAST(score AS BIGINT) AS score FROM t WHERE k <= 5")
def top_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best exports of each kind (a top-k report)."""
    return a.best_of(_exports(spark, sf_dir), ["kind"], [F.desc("score"), F.col("name").asc(), F.col("id").asc()], 5).select("kind", "name", "score")

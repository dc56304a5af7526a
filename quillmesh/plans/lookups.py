"""Queries over lookups and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import lookups as k
from quillmesh.plans.aggregates import FILES
from quillmesh.plans.markov import IMPORTS, RELS
from quillmesh.plans.registry import query
from quillmesh.sources import bindings as b


@query("l1_file_by_checksum", f"WITH {FILES} SELECT checksum, min(file_path) AS file_path, count(*) AS n FROM files GROUP BY 1")
def by_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 for all checksums at once."""
    return b.files(spark, sf_dir).groupBy("checksum").agg(F.min("file_path").alias("file_path"), F.count("*").alias("n"))


@query("l2_list_files", f"WITH {FILES} SELECT file_path, file_size, line_count FROM files WHERE file_path ILIKE 'SRC1%' AND language = 'en'")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.list_files(b.files(spark, sf_dir), "SRC1", "en").select("file_path", "file_size", "line_count")


@query("l3_all_paths", f"WITH {FILES} SELECT file_path FROM files")
def all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.files(spark, sf_dir).select("file_path")


NAMES = ["red widget", "blue gear", "widget", "gear", "nothing here", "bolt"]


@query("l4_function_cascade", f"""WITH w AS (SELECT unnest({NAMES}) AS query), s AS (SELECT p_partkey AS id, p_name AS name, string_split(p_name, ' ')[-1] AS local FROM part),
h AS (SELECT query, 1 AS rank, id, name FROM w JOIN s ON query = name UNION ALL SELECT query, 2, id, name FROM w JOIN s ON query = local),
c AS (SELECT query, rank, count(DISTINCT name) AS names, min(id) AS id FROM h GROUP BY 1, 2), o AS (SELECT query, arg_min(id, rank) AS id, min(rank) AS rank FROM c WHERE rank = 1 OR names = 1 GROUP BY 1)
SELECT w.query, o.id AS symbol_id, CASE WHEN o.rank = 1 THEN 'exact' WHEN o.rank = 2 THEN 'local' WHEN EXISTS (SELECT 1 FROM c WHERE c.query = w.query AND c.rank = 2) THEN 'ambiguous' ELSE 'missing' END AS status FROM w LEFT JOIN o USING (query)""")
def function_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact name, then the only symbol of that last part."""
    return k.function_cascade(b.symbols(spark, sf_dir), spark.createDataFrame([(n,) for n in NAMES], "query string"))


@query("m7_resolve_names", """WITH s AS (SELECT p_name AS name, min(p_partkey) AS symbol_id, count(*) AS candidates FROM part GROUP BY 1), e AS (SELECT p_partkey AS edge, p_name AS name FROM part UNION ALL SELECT c_custkey, c_name FROM customer)
SELECT edge, name, symbol_id, candidates FROM e LEFT JOIN s USING (name)""")
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = b.symbols(spark, sf_dir).select(F.col("symbol_id").alias("edge"), "name").unionByName(b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("edge"), F.col("c_name").alias("name")))
    return k.resolve_names(edges, b.symbols(spark, sf_dir), "name").select("edge", "name", "symbol_id", "candidates")


@query("l9_references_in_files", f"""WITH {FILES} SELECT d.doc_id, f.file_path, pos AS line_number, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) d JOIN files f USING (doc_id)
CROSS JOIN LATERAL (SELECT unnest(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}]+')) AS tok) WHERE tok = 'the' GROUP BY 1, 2, 3""")
def references_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every file that name a symbol, with how often."""
    lines = b.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file_path"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    n = F.size(F.filter(F.regexp_extract_all("line", F.lit(b.WORD), 0), lambda t: t == "the"))
    return lines.select("doc_id", "file_path", (F.col("pos") + 1).cast("long").alias("line_number"), n.cast("long").alias("n")).filter("n > 0")


@query("l11_implementations", f"WITH {RELS} SELECT DISTINCT source, kind, target FROM rels WHERE target = 'n:3' AND kind IN ('implements', 'extends')")
def implementations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.implementations(b.type_relations(spark, sf_dir), "n:3").select("source", "kind", "target")


@query("j6_existing_references", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS tok FROM documents) WHERE tok IN (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) FROM benchmark) GROUP BY 1")
def existing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose name is that of a symbol."""
    refs = b.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(b.WORD), 0)).alias("tok"))
    names = b.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(b.WORD), 0)).alias("name")).distinct()
    return k.existing_references(refs, names, "tok").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("l16_config_files", """WITH e AS (SELECT event_type AS file, unnest(json_keys(props)) AS path, event_id FROM events) SELECT file, path, count(DISTINCT event_id) AS entries FROM e GROUP BY 1, 2""")
def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each configuration file and key."""
    rows = b.table(spark, sf_dir, "events").select(F.col("event_type").alias("file"), F.explode(F.json_object_keys("props")).alias("path"), "event_id")
    return rows.groupBy("file", "path").agg(F.countDistinct("event_id").alias("entries"))


@query("l14_config_value", "SELECT event_id, event_type AS file, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def config_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at one path of every configuration."""
    return b.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("file"), F.get_json_object("props", "$.k").cast("long").alias("value")).filter("value is not null")


@query("l17_file_imports", f"WITH {IMPORTS} SELECT file, pos, source FROM imps")
def file_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.imports(spark, sf_dir).withColumn("pos", F.col("pos").cast("long"))


@query("l18_reverse_dependencies", f"""WITH {IMPORTS}, t AS (SELECT source, min(file) AS resolved FROM imps GROUP BY 1) SELECT DISTINCT resolved, file AS importer FROM imps JOIN t USING (source) WHERE file <> resolved""")
def reverse_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who imports each file; the first page with a link stands for the file behind it."""
    imports = b.imports(spark, sf_dir)
    homes = imports.groupBy(F.col("source").alias("path")).agg(F.min("file").alias("file"))
    return k.reverse_dependencies(imports, homes).filter("importer <> resolved")


PATHS = ["src1/en/1.txt", "en/7.txt", "7.txt", "fr/nowhere.txt", "src3/de"]
OVERLAP = "CASE WHEN greatest(len({a}), len({b})) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / CAST(greatest(len({a}), len({b}), 1) AS DOUBLE) END"


@query("l20_path_scores", f"""WITH {FILES}, q AS (SELECT unnest({PATHS}) AS query), j AS (SELECT query, file_path, lower(string_split(file_path, '/')[-1]) AS base, lower(regexp_extract(file_path, '^(.*)/[^/]*$', 1)) AS dir, lower(query) AS q, lower(string_split(query, '/')[-1]) AS qb, lower(regexp_extract(query, '^(.*)/[^/]*$', 1)) AS qd FROM files, q),
c AS (SELECT *, list_distinct(string_split(base, '')) AS a1, list_distinct(string_split(qb, '')) AS b1, list_distinct(string_split(dir, '')) AS a2, list_distinct(string_split(qd, '')) AS b2 FROM j),
s AS (SELECT query, file_path, (CASE WHEN base = qb THEN 100 WHEN contains(base, qb) THEN 50 WHEN contains(qb, base) THEN 30 ELSE 0 END) + (CASE WHEN qd <> '' AND contains(dir, qd) THEN 25 ELSE 0 END) + (CASE WHEN contains(lower(file_path), q) THEN 20 ELSE 0 END)
  + 15 * ({OVERLAP.format(a='a1', b='b1')}) + CASE WHEN qd <> '' AND dir <> '' THEN 10 * ({OVERLAP.format(a='a2', b='b2')}) ELSE 0 END AS score FROM c)
SELECT query, file_path, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, file_path) AS r FROM s WHERE score > 10) WHERE r <= 5""")
def path_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best paths for each request (a top-k report)."""
    from quillmesh.operators.aggregates import best_of

    few = F.broadcast(spark.createDataFrame([(p,) for p in PATHS], "query string"))  # the requests
    scored = b.files(spark, sf_dir).select("file_path").join(few).withColumn("score", k.path_score(F.col("query"), F.col("file_path"))).filter("score > 10")
    return best_of(scored, ["query"], [F.desc(F.round("score", 9)), F.col("file_path").asc()], 5).select("query", "file_path", F.round("score", 6).alias("score"))


@query("l19_resolve_paths", f"""WITH {FILES}, q AS (SELECT unnest({PATHS}) AS query), j AS (SELECT query, file_path, lower(string_split(file_path, '/')[-1]) AS base, lower(regexp_extract(file_path, '^(.*)/[^/]*$', 1)) AS dir, lower(query) AS q, lower(string_split(query, '/')[-1]) AS qb, lower(regexp_extract(query, '^(.*)/[^/]*$', 1)) AS qd FROM files, q),
c AS (SELECT *, list_distinct(string_split(base, '')) AS a1, list_distinct(string_split(qb, '')) AS b1, list_distinct(string_split(dir, '')) AS a2, list_distinct(string_split(qd, '')) AS b2 FROM j),
s AS (SELECT query, file_path, (CASE WHEN base = qb THEN 100 WHEN contains(base, qb) THEN 50 WHEN contains(qb, base) THEN 30 ELSE 0 END) + (CASE WHEN qd <> '' AND contains(dir, qd) THEN 25 ELSE 0 END) + (CASE WHEN contains(lower(file_path), q) THEN 20 ELSE 0 END)
  + 15 * ({OVERLAP.format(a='a1', b='b1')}) + CASE WHEN qd <> '' AND dir <> '' THEN 10 * ({OVERLAP.format(a='a2', b='b2')}) ELSE 0 END AS score FROM c),
x AS (SELECT query, count(*) AS n, min(file_path) AS path, max(CAST(file_path = query AS INT)) AS exact FROM files, q WHERE file_path = query OR ends_with(file_path, '/' || query) GROUP BY 1),
k AS (SELECT query, file_path, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, file_path) AS r FROM s WHERE score > 10),
y AS (SELECT query, max(score) FILTER (r = 1) AS s1, max(score) FILTER (r = 2) AS s2, min(file_path) FILTER (r = 1) AS fuzzy FROM k WHERE r <= 2 GROUP BY 1),
z AS (SELECT q.query, path, fuzzy, CASE WHEN exact = 1 THEN 'exact' WHEN n = 1 THEN 'suffix' WHEN n > 1 THEN 'ambiguous' WHEN s1 >= 80 AND s1 - coalesce(s2, 0) >= 20 THEN 'fuzzy' ELSE 'not_found' END AS status FROM q LEFT JOIN x USING (query) LEFT JOIN y USING (query))
SELECT query, status, CASE status WHEN 'exact' THEN query WHEN 'suffix' THEN path WHEN 'fuzzy' THEN fuzzy END AS path FROM z""")
def resolve_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.resolve_paths(spark.createDataFrame([(p,) for p in PATHS], "query string"), b.files(spark, sf_dir).select("file_path"))


AMBIGUOUS = ["1.txt", "en/7.txt", "7.txt", "19.txt", "nothing.txt"]


@query("l19_path_suggestions", f"""WITH f AS (SELECT DISTINCT source || '/' || lang || '/' || (doc_id % 20) || '.txt' AS file_path FROM documents), q AS (SELECT unnest({AMBIGUOUS}) AS query),
x AS (SELECT query, file_path, row_number() OVER (PARTITION BY query ORDER BY file_path) AS rank, count(*) OVER (PARTITION BY query) AS n FROM f, q WHERE ends_with(file_path, '/' || query))
SELECT query, rank, file_path FROM x WHERE n > 1 AND rank <= 5""")
def path_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five files that an ambiguous name may mean (the report's limit); twenty names recur in all folders."""
    name = F.concat((F.col("doc_id") % 20).cast("string"), F.lit(".txt"))
    files = b.table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", name).alias("file_path")).distinct()
    found = k.path_suggestions(spark.createDataFrame([(p,) for p in AMBIGUOUS], "query string"), files)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query("l21_nearest_directory", f"""WITH {FILES}, h AS (SELECT * FROM files WHERE contains(lower(directory), 'src1')), t AS (SELECT directory FROM h GROUP BY 1 ORDER BY count(*) DESC, directory LIMIT 1)
SELECT directory, file_path FROM h JOIN t USING (directory) ORDER BY file_path LIMIT 15""")
def nearest_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.nearest_directory(b.files(spark, sf_dir), "src1")

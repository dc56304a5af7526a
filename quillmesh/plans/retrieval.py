"""Queries over retrieval, imports, sessions and change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import imports as im
from quillmesh.operators import retrieval as r
from quillmesh.plans.aggregates import FILES
from quillmesh.plans.markov import IMPORTS
from quillmesh.plans.registry import query
from quillmesh.sources import bindings as b
from quillmesh.streaming import awareness, watch


@query("q1_list_page", f"WITH {FILES}, k AS (SELECT file_path, line_count FROM files WHERE NOT regexp_matches(file_path, '^src1/.*$')) SELECT file_path, line_count, (SELECT count(*) FROM k) AS total FROM k ORDER BY file_path LIMIT 50 OFFSET 50")
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of files that a glob doesn't exclude (a page is the feature)."""
    kept = b.files(spark, sf_dir).select("file_path", "line_count").filter(~F.col("file_path").rlike(r.glob_regex("src1/**")))
    return r.paginate(kept, [F.col("file_path").asc()], 2, 50)


CAND = """c AS (SELECT p_partkey AS id, p_name AS name, p_brand AS file, coalesce(n, 0) AS refs, p_size * 20 AS complexity, p_size * 7 AS n_lines, p_type = 'SMALL' AS is_method, length(p_name) * 300 AS chars FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
sc AS (SELECT *, refs * 100 + least(complexity, 500) + least(n_lines, 200) + CASE WHEN is_method THEN 5 ELSE 0 END AS score FROM c)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"))
    part = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), (F.col("p_size") * 20).alias("complexity"), (F.col("p_size") * 7).alias("n_lines"), (F.col("p_type") == "SMALL").alias("is_method"), (F.length("p_name") * 300).alias("chars"))
    joined = part.join(n, "id", "left").withColumn("refs", F.coalesce("n", F.lit(0)))
    return joined.withColumn("score", r.candidate_score(F.col("refs"), F.col("complexity"), F.col("n_lines"), F.col("is_method")))


@query("q5_rank_candidates", f"WITH {CAND} SELECT file, id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, refs DESC, n_lines DESC, name, id) AS k FROM sc) WHERE k <= 10")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of each file (a top-k report)."""
    from quillmesh.operators.aggregates import best_of

    top = best_of(_candidates(spark, sf_dir), ["file"], [F.desc("score"), F.desc("refs"), F.desc("n_lines"), F.col("name").asc(), F.col("id").asc()], 10)
    return top.select("file", "id", F.col("score").cast("long").alias("score"))


@query("q4_first_rank", "WITH k AS (SELECT p_partkey AS id, p_brand AS file, CASE WHEN p_size > 45 THEN 1 WHEN p_type = 'PROMO' THEN 2 ELSE 3 END AS k FROM part) SELECT file, id FROM (SELECT *, min(k) OVER (PARTITION BY file) AS m FROM k) WHERE k = m")
def first_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rung of the ladder that a file has."""
    rank = F.when(F.col("p_size") > 45, 1).when(F.col("p_type") == "PROMO", 2).otherwise(3)
    return r.first_rank(b.table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("id"), "p_size", "p_type"), ["file"], rank).select("file", "id")


@query("q6_reference_counts", "WITH i AS (SELECT l_partkey AS id, count(*) FILTER (l_returnflag = 'R') AS by_id, count(*) FILTER (l_linestatus = 'O') AS by_name, count(*) FILTER (l_returnflag = 'A') AS local FROM lineitem GROUP BY 1) SELECT id, coalesce(nullif(by_id, 0), greatest(by_name, local)) AS refs FROM i")
def reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(n(F.col("l_returnflag") == "R").alias("by_id"), n(F.col("l_linestatus") == "O").alias("by_name"), n(F.col("l_returnflag") == "A").alias("local"))
    return g.select("id", r.reference_count(F.col("by_id"), F.col("by_name"), F.col("local")).alias("refs"))


@query("q7_within_budget", f"""WITH {CAND}, u AS (SELECT *, sum(chars) OVER (PARTITION BY file ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS upto FROM sc)
SELECT file, id, CAST(CASE WHEN upto <= 16000 THEN chars ELSE 16000 - (upto - chars) END AS BIGINT) AS shown FROM u WHERE upto <= 16000 OR (upto - chars <= 16000 AND 16000 - (upto - chars) >= 160)""")
def within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fits 16,000 characters of each file (the budget is the feature)."""
    kept = r.within_budget(_candidates(spark, sf_dir), ["file"], [F.desc("score"), F.col("id").asc()], "chars", 16_000)
    return kept.select("file", "id", F.col("shown").cast("long").alias("shown"))


@query("q12_type_names", "SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: regexp_matches(x, '^[A-Z][A-Za-z0-9_]*$') AND x NOT IN ('The', 'And')))), ',') AS names FROM conversations")
def type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(r.type_names(F.col("text"), ["The", "And"]), ",").alias("names"))


@query("q16_enclosing", """WITH t AS (SELECT conv_id, turn, role = 'user' AS head, substr(text, 1, 20) AS label FROM conversations) SELECT conv_id, turn,
  max(CASE WHEN head THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS head_at FROM t""")
def enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest user turn at or before each turn."""
    rows = b.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return r.enclosing(rows, ["conv_id"], "turn", F.col("role") == "user", F.substring("text", 1, 20)).select("conv_id", "turn", "head_at")


@query("q20_token_budgets", "SELECT o_orderkey AS id, CAST(floor(o_custkey * CAST(0.4 AS DOUBLE) + CAST(1e-9 AS DOUBLE)) AS BIGINT) AS symbol, CAST(floor(o_custkey * CAST(0.25 AS DOUBLE) + CAST(1e-9 AS DOUBLE)) AS BIGINT) AS types, CAST(floor(o_custkey * CAST(0.25 AS DOUBLE) + CAST(1e-9 AS DOUBLE)) AS BIGINT) AS callees, CAST(floor(o_custkey * CAST(0.1 AS DOUBLE) + CAST(1e-9 AS DOUBLE)) AS BIGINT) AS tests FROM orders")
def token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = r.token_budgets(F.col("o_custkey"), True)
    return b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), *[c.alias(n) for n, c in shares.items()])


@query("q14_test_paths", f"WITH {FILES}, p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'tests/' || file_path WHEN 1 THEN file_path || '.test.ts' WHEN 2 THEN 'src/test_' || doc_id || '.py' ELSE file_path END AS path FROM files) SELECT doc_id, doc_id % 5 < 3 AS is_test FROM p")
def test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 5
    path = F.when(n == 0, F.concat(F.lit("tests/"), "file_path")).when(n == 1, F.concat("file_path", F.lit(".test.ts"))).when(n == 2, F.concat(F.lit("src/test_"), F.col("doc_id").cast("string"), F.lit(".py"))).otherwise(F.col("file_path"))
    return b.files(spark, sf_dir).select("doc_id", r.is_test_path(path).alias("is_test"))


CALLEES = ["useThing", "React.memo", "_.map", "debounce", "console.log", "readFileSync", "join", "Promise.all", "used", "Userspace", "mergeAll", "statSync"]


@query("q19_callee_packages", f"""SELECT p_partkey AS symbol_id, ({CALLEES})[1 + p_size % 12] AS callee, (['react', 'react', 'lodash', 'lodash', 'node', 'node:fs', 'node:path', 'async', NULL, NULL, NULL, 'node:fs'])[1 + p_size % 12] AS package FROM part""")
def callee_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, CALLEES)), (F.col("p_size") % 12 + 1).cast("int"))
    return b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), name.alias("callee")).withColumn("package", r.callee_package(F.col("callee")))


PAIRS = "pairs AS (SELECT o_orderkey AS id, 'src/m' || (o_orderkey % 40) || '/f' || o_orderkey || '.ts' AS file, CASE o_orderkey % 6 WHEN 0 THEN './f' || (o_orderkey + 40) WHEN 1 THEN '../m' || ((o_orderkey + 1) % 40) || '/f' || (o_orderkey + 1) WHEN 2 THEN 'node:fs' WHEN 3 THEN '@scope/pkg/deep' WHEN 4 THEN 'lodash/map' ELSE './f' || (o_orderkey + 40) || '.js' END AS source FROM orders)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = lambda c: c.cast("string")
    near = F.concat(F.lit("./f"), t(k + 40))
    source = F.when(k % 6 == 0, near).when(k % 6 == 1, F.concat(F.lit("../m"), t((k + 1) % 40), F.lit("/f"), t(k + 1))).when(k % 6 == 2, "node:fs").when(k % 6 == 3, "@scope/pkg/deep").when(k % 6 == 4, "lodash/map").otherwise(F.concat(near, F.lit(".js")))
    return b.table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("src/m"), t(k % 40), F.lit("/f"), t(k), F.lit(".ts")).alias("file"), source.alias("source"))


@query("i2_resolve_imports", f"""WITH {PAIRS}, f AS (SELECT DISTINCT file FROM pairs), x AS (SELECT id, file, source, CASE id % 6 WHEN 1 THEN 'src/m' || ((id + 1) % 40) || '/f' || (id + 1) || '.ts' WHEN 0 THEN 'src/m' || (id % 40) || '/f' || (id + 40) || '.ts' WHEN 5 THEN 'src/m' || (id % 40) || '/f' || (id + 40) || '.ts' END AS path FROM pairs)
SELECT x.id, f.file AS resolved_path, CASE WHEN source = 'node:fs' THEN 'builtin' WHEN source LIKE '.%' THEN 'internal' ELSE 'external' END AS kind FROM x LEFT JOIN f ON f.file = x.path""")
def resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative sources to the first file that exists."""
    pairs = _pairs(spark, sf_dir)
    return im.resolve(pairs, pairs.select(F.col("file").alias("file_path")).distinct()).select("id", "resolved_path", "kind")


@query("i5_packages", f"WITH {PAIRS} SELECT id, CASE WHEN source LIKE '@%' THEN string_split(source, '/')[1] || '/' || string_split(source, '/')[2] ELSE string_split(source, '/')[1] END AS package FROM pairs WHERE source NOT LIKE '.%'")
def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).filter(~im.is_relative(F.col("source")))
    return rows.select("id", im.package_name(F.col("source")).alias("package"))


@query("q30_entry_sources", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'src/a' || o_orderkey || '.ts' WHEN 1 THEN 'src/b.ts' ELSE 'lib2/c.py' END AS source FROM orders")
def entry_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("./dist/a"), k.cast("string"), F.lit(".mjs"))).when(k % 3 == 1, "build/b.js").otherwise("lib2/c.py")
    return b.table(spark, sf_dir, "orders").select(k.alias("id"), im.entry_source(path).alias("source"))


@query("q23_excluded", f"WITH {FILES} SELECT directory, count(*) AS n FROM files WHERE NOT regexp_matches(file_path, '(^|/)(tests?|dist|build)/') GROUP BY 1")
def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.files(spark, sf_dir).filter(~im.excluded(F.col("file_path"))).groupBy("directory").agg(F.count("*").alias("n"))


SESSIONS = """c AS (SELECT user_id AS session, event_id, ts, event_type AS tool, json_extract_string(props, '$.k') AS target, event_type = 'signup' AS is_sync FROM events),
e AS (SELECT *, sum(CAST(is_sync AS INT)) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch, tool || '|' || coalesce(target, '') AS key FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY session, epoch, key ORDER BY ts, event_id) AS rn, row_number() OVER (PARTITION BY session, key ORDER BY ts, event_id) AS pn FROM e),
t AS (SELECT *, CAST(sum(CASE WHEN NOT is_sync AND rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total,
  CAST(sum(CASE WHEN NOT is_sync AND pn = 1 AND target IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS novel FROM n),
o AS (SELECT *, CASE WHEN total > 25 OR novel > 15 THEN 'finalize' WHEN novel > 12 THEN 'synthesize_warning' WHEN novel > 8 THEN 'synthesize_note' ELSE 'explore' END AS own FROM t),
w AS (SELECT *, first_value(own) OVER (PARTITION BY session, epoch, key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS first_own FROM o)"""


@query("w6_call_awareness", f"WITH {SESSIONS} SELECT session, event_id, total, novel, CASE WHEN is_sync THEN 'sync' WHEN rn = 1 THEN own WHEN first_own = 'finalize' THEN 'finalize' ELSE 'cache_hit' END AS state FROM w")
def call_awareness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6-W9 in batch form."""
    return awareness.label_calls(b.session_calls(spark, sf_dir))


@query("w2_debounce", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS s FROM events), b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id, arg_max(event_id, ROW(ts, event_id)) AS event_id, arg_max(event_type, ROW(ts, event_id)) AS kind, count(*) AS n FROM b GROUP BY user_id, burst""")
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("kind"))
    return watch.debounce(events, "user_id", "6 hours").select("user_id", "event_id", "kind", "n")


@query("w3_debounce_unlink", """WITH n AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' OR event_type = 'logout' OR event_type = 'signup' THEN 'unlink' ELSE event_type END AS kind, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
SELECT user_id, event_id, CASE WHEN kind = 'unlink' THEN 'removed' ELSE 'indexed' END AS action FROM n WHERE kind = 'unlink' OR nx IS NULL OR epoch(nx) - epoch(ts) >= 3600""")
def debounce_unlink(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("error", "logout", "signup"), "unlink").otherwise(F.col("event_type"))
    return watch.debounce_unlink(b.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", kind.alias("kind")), "user_id", 3600.0)


@query("s3_changed_files", f"""WITH {FILES}, o AS (SELECT file_path, checksum FROM files WHERE doc_id % 10 <> 0), n AS (SELECT file_path, CASE WHEN doc_id % 7 = 0 THEN 'x' || checksum ELSE checksum END AS checksum FROM files WHERE doc_id % 11 <> 0)
SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.checksum IS NULL THEN 'added' WHEN n.checksum IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.file_path = n.file_path WHERE o.checksum IS DISTINCT FROM n.checksum""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two snapshots, here two derived states of the same files."""
    files = b.files(spark, sf_dir)
    new = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), "checksum")).otherwise(F.col("checksum"))
    return watch.snapshot_diff(files.filter("doc_id % 10 <> 0"), files.filter("doc_id % 11 <> 0").withColumn("checksum", new))

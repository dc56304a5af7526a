"""Queries over search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.thesaurus import builtin_rows, thesaurus
from quillmesh.operators import search as s
from quillmesh.plans.registry import query
from quillmesh.sources import bindings as b

PREFIXES = ["widg", "eco", "blu"]
TEXT_PREFIXES = ["ther", "und", "que"]


def bm25_sql(source: str, key: str, text: str, prefixes: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: starts_with(x, '{p}'))) AS tf{i}" for i, p in enumerate(prefixes))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(prefixes)))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN greatest(CAST(1e-6 AS DOUBLE), ln((n - df{i} + 5e-1) / (df{i} + 5e-1))) * tf{i} * (CAST(12e-1 AS DOUBLE) + 1) / (tf{i} + 12e-1 * (1 - 75e-2 + 75e-2 * dl / mean)) ELSE 0 END" for i in range(len(prefixes)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(prefixes)))
    return f"""bm_t AS (SELECT {key} AS key, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS t FROM {source}), bm_c AS (SELECT key, CAST(len(t) AS BIGINT) AS dl, {tf} FROM bm_t),
bm_s AS (SELECT count(*) AS n, avg(dl) AS mean, {df} FROM bm_c), bm AS (SELECT key, {score} AS score FROM bm_c, bm_s WHERE {hit})"""


SIGNATURE = "p_brand || ' ' || p_type || ' ' || p_name"


@query("r1_symbol_search", f"WITH {bm25_sql('part', 'p_partkey', 'p_name || chr(32) || ' + SIGNATURE, PREFIXES)} SELECT key AS symbol_id, round(score, 6) AS score FROM bm")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix search over name and signature, all hits."""
    found = s.bm25(b.symbols(spark, sf_dir), "symbol_id", F.concat_ws(" ", "name", "signature"), PREFIXES)
    return found.withColumn("score", F.round("score", 6))


@query("r1_text_search", f"WITH {bm25_sql('documents', 'doc_id', 'text', TEXT_PREFIXES)} SELECT key AS doc_id, round(score, 6) AS score FROM bm")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.bm25(b.table(spark, sf_dir, "documents"), "doc_id", F.col("text"), TEXT_PREFIXES)
    return found.withColumn("score", F.round("score", 6))


@query("r3_config_search", f"WITH {bm25_sql('events', 'event_id', 'event_type || chr(32) || props', ['cl', '4'])} SELECT key AS event_id, round(score, 6) AS score FROM bm")
def config_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values of configuration entries."""
    found = s.bm25(b.table(spark, sf_dir, "events"), "event_id", F.concat_ws(" ", "event_type", "props"), ["cl", "4"])
    return found.withColumn("score", F.round("score", 6))


@query("r2_fuzzy_search", """WITH s AS (SELECT p_partkey, lower(p_name) AS t FROM part), p AS (SELECT p_partkey, t, unnest(range(1, length(t) + 1)) AS i FROM s), w AS (SELECT p_partkey, substring(t, i, n) AS x FROM p, (SELECT unnest(range(4, 9)) AS n))
SELECT p_partkey AS symbol_id, round(1 - min(levenshtein(x, 'widgte')) / CAST(6 AS DOUBLE), 6) AS score FROM w GROUP BY 1 HAVING min(levenshtein(x, 'widgte')) <= 2""")
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.fuzzy(b.symbols(spark, sf_dir), "symbol_id", ["name"], "widgte").withColumn("score", F.round("score", 6))


TYPES = """ty AS (SELECT p_partkey AS symbol_id, p_name AS name, CASE p_size % 4 WHEN 0 THEN 'Promise<' || p_type || '>' WHEN 1 THEN p_type || '[]' WHEN 2 THEN p_type || ' | null' ELSE p_type END AS raw,
  CASE p_size % 4 WHEN 0 THEN 'promise' WHEN 1 THEN 'array' ELSE lower(p_type) END AS base, CASE WHEN p_size % 4 < 2 THEN lower(p_type) ELSE '' END AS inner_t, p_size % 4 = 0 AS is_async FROM part)"""


def symbol_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_size") % 4
    raw = F.when(kind == 0, F.concat(F.lit("Promise<"), "p_type", F.lit(">"))).when(kind == 1, F.concat("p_type", F.lit("[]"))).when(kind == 2, F.concat("p_type", F.lit(" | null"))).otherwise(F.col("p_type"))
    return b.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), raw.alias("raw"), F.when(kind == 0, "promise").when(kind == 1, "array").otherwise(F.lower("p_type")).alias("base"),
        F.when(kind < 2, F.lower("p_type")).otherwise("").alias("inner_t"), (kind == 0).alias("is_async"),
    )


@query("r4_type_search", f"WITH {TYPES} SELECT 'exact' AS mode, symbol_id FROM ty WHERE lower(raw) = 'economy' UNION ALL SELECT 'base', symbol_id FROM ty WHERE base = 'economy' OR (is_async AND contains(inner_t, 'economy')) UNION ALL SELECT 'inner', symbol_id FROM ty WHERE contains(inner_t, 'economy') UNION ALL SELECT 'partial', symbol_id FROM ty WHERE contains(lower(raw), 'economy')")
def type_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4, R7 in all four modes."""
    types, out = symbol_types(spark, sf_dir), None
    for mode in ("exact", "base", "inner", "partial"):
        hit = types.filter(s.type_filter(mode, "ECONOMY", *map(F.col, ("base", "inner_t", "raw", "is_async")))).select(F.lit(mode).alias("mode"), "symbol_id")
        out = hit if out is None else out.unionByName(hit)
    return out


@query("r6_combined_type_search", f"WITH {TYPES}, p AS (SELECT DISTINCT l_partkey AS symbol_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 3) SELECT symbol_id, name FROM ty JOIN p USING (symbol_id) WHERE contains(lower(raw), 'promo')")
def combined_type_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that match by return type and by parameter."""
    hits = symbol_types(spark, sf_dir).filter(s.type_filter("partial", "PROMO", *map(F.col, ("base", "inner_t", "raw", "is_async"))))
    supplier = b.table(spark, sf_dir, "supplier").filter("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    by_param = b.table(spark, sf_dir, "lineitem").join(supplier, "l_suppkey", "left_semi").select(F.col("l_partkey").alias("symbol_id"))
    return hits.join(by_param, "symbol_id", "left_semi").select("symbol_id", "name")


QUERIES = ["fetch user", "get_account", "red-widget", "member load x", "nothing"]
THESAURUS = "th AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}', CAST({w} AS DOUBLE))" for c, _, t, w, _ in builtin_rows()) + ") AS v(canonical, term, weight))"
EXPANDED = THESAURUS + f""", q AS (SELECT query, word FROM (SELECT query, unnest(string_split_regex(regexp_replace(lower(query), '[_-]', ' ', 'g'), '\\s+')) AS word FROM (SELECT unnest({QUERIES}) AS query)) WHERE length(word) > 1),
hit AS (SELECT query, word, canonical AS c, weight AS w FROM q JOIN th ON word = term),
ev AS (SELECT query, word AS term, CAST(1 AS DOUBLE) AS weight, 'original' AS source FROM q UNION ALL SELECT query, term, weight, 'synonym' FROM q JOIN th ON word = canonical UNION ALL SELECT query, c, w * CAST(0.9 AS DOUBLE), 'canonical' FROM hit
  UNION ALL SELECT query, term, w * weight, 'synonym' FROM hit JOIN th ON c = canonical WHERE term <> word),
ex AS (SELECT query, term, max(weight) AS weight, arg_max(source, ROW(weight, source)) AS source FROM ev GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(weight, 9) DESC, term) AS rank FROM ex)"""


def _expanded(spark: SparkSession, queries: list[str]) -> DataFrame:
    words = [(q, w) for q in queries for w in s.query_terms(q)]
    return s.expand_terms(spark.createDataFrame(words, "query string, word string"), thesaurus(spark))


@query("r10_expand_query", f"WITH {EXPANDED} SELECT query, term, round(weight, 6) AS weight, source, rank FROM ranked WHERE rank <= 15")
def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of every request with their synonyms."""
    return _expanded(spark, QUERIES).select("query", "term", F.round("weight", 6).alias("weight"), "source", F.col("rank").cast("long").alias("rank"))


@query("r9_thesaurus", f"WITH {THESAURUS} SELECT canonical, term, weight FROM th WHERE canonical NOT IN ('red', 'click') UNION ALL SELECT 'red', 'rosso', CAST(0.9 AS DOUBLE) UNION ALL SELECT 'blue', 'azure', CAST(0.7 AS DOUBLE)")
def effective_thesaurus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom entry, an override, and a disabled one."""
    return thesaurus(spark, [("blue", "adjective", "azure", 0.7, True)], [("red", "adjective", "rosso", 0.9, True)], ["click"]).select("canonical", "term", "weight")


RERANK_TERMS = [("widget", 1.0, "original"), ("gadget", 0.8, "synonym"), ("gear", 0.8, "synonym"), ("eco", 0.72, "canonical")]
_W = {"original": 0.2, "canonical": 0.1}
_HAY = "lower(p_name || ' ' || " + SIGNATURE + ")"
_N = " + ".join(f"CAST(contains(h, '{t}') AS INT)" for t, _, _ in RERANK_TERMS)
_SUM = " + ".join(f"CASE WHEN contains(h, '{t}') THEN CAST({w + _W.get(x, 0.0)} AS DOUBLE) ELSE 0 END" for t, w, x in RERANK_TERMS)


@query("r14_rerank", f"""WITH {bm25_sql('part', 'p_partkey', 'p_name || chr(32) || ' + SIGNATURE, PREFIXES)}, h AS (SELECT p_partkey AS key, {_HAY} AS h FROM part), y AS (SELECT bm.key, score, {_N} AS n, {_SUM} AS t FROM bm JOIN h USING (key)),
z AS (SELECT key, score, least(CAST(1 AS DOUBLE), CASE WHEN n > 1 THEN t * (1 + CAST(0.1 AS DOUBLE) * (n - 1)) ELSE t END / 2) AS syn FROM y)
SELECT key AS symbol_id, round(syn, 6) AS synonym_score, round(score * CAST(0.6 AS DOUBLE) / greatest(max(score) OVER (), CAST(1e-9 AS DOUBLE)) + syn * CAST(0.4 AS DOUBLE), 6) AS combined FROM z""")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits of a search, scored anew by synonyms."""
    symbols = b.symbols(spark, sf_dir)
    hits = s.bm25(symbols, "symbol_id", F.concat_ws(" ", "name", "signature"), PREFIXES).join(symbols.select("symbol_id", "name", "signature"), "symbol_id")
    return s.rerank(hits, RERANK_TERMS).select("symbol_id", F.round("synonym_score", 6).alias("synonym_score"), F.round("combined", 6).alias("combined"))


@query("r17_name_filter", f"SELECT p_partkey AS symbol_id FROM part WHERE contains(lower({SIGNATURE}), 'red') AND contains(lower({SIGNATURE}), 'economy')")
def name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text holds every word of the filter."""
    words = F.array(*[F.lit(w) for w in "RED economy".lower().split()])
    return b.symbols(spark, sf_dir).filter(F.forall(words, lambda w: F.contains(F.lower("signature"), w))).select("symbol_id")


def _name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all names, as query_terms makes them of a request."""
    words = F.split(F.regexp_replace(F.lower("p_name"), "[_-]", " "), "\\s+")
    return b.table(spark, sf_dir, "part").select(F.col("p_name").alias("query"), F.explode(words).alias("word")).filter("length(word) > 1").distinct()


_NAMES = EXPANDED.replace(f"SELECT unnest({QUERIES}) AS query", "SELECT DISTINCT p_name AS query FROM part")


@query("r10_expand_names", f"WITH {_NAMES} SELECT query, term, round(weight, 6) AS weight, source, rank FROM ranked WHERE rank <= 15")
def expand_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that every name of a symbol leads to."""
    found = s.expand_terms(_name_words(spark, sf_dir), thesaurus(spark))
    return found.select("query", "term", F.round("weight", 6).alias("weight"), "source", F.col("rank").cast("long").alias("rank"))


@query("r9_names_by_canonical", f"""WITH {THESAURUS}, w AS (SELECT DISTINCT p_partkey, unnest(string_split_regex(regexp_replace(lower(p_name), '[_-]', ' ', 'g'), '\\s+')) AS word FROM part),
m AS (SELECT DISTINCT canonical, term AS word FROM th UNION SELECT canonical, canonical FROM th) SELECT canonical, count(DISTINCT p_partkey) AS parts FROM m JOIN w USING (word) GROUP BY 1""")
def names_by_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many symbols a canonical term stands for, by any of its synonyms in their names."""
    th = thesaurus(spark)
    members = th.select("canonical", F.col("term").alias("word")).union(th.select("canonical", F.col("canonical"))).distinct()
    parts = b.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("query"))
    hits = parts.join(_name_words(spark, sf_dir), "query").join(members, "word")
    return hits.groupBy("canonical").agg(F.countDistinct("p_partkey").alias("parts"))

"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import scalars as f
from quillmesh.plans.registry import query
from quillmesh.plans.search import symbol_types
from quillmesh.sources import bindings as b


@query("f1_token_estimates", "SELECT doc_id, CAST(ceil(length(text) / CAST(4 AS DOUBLE)) AS BIGINT) AS tokens, CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' B' WHEN strlen(text) < 1048576 THEN CAST(round(strlen(text) / CAST(1024 AS DOUBLE), 1) AS DECIMAL(18, 1)) || ' KB' ELSE CAST(round(strlen(text) / CAST(1048576 AS DOUBLE), 1) AS DECIMAL(18, 1)) || ' MB' END AS size FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F11."""
    return b.table(spark, sf_dir, "documents").select("doc_id", f.estimate_tokens(F.col("text")).alias("tokens"), f.format_bytes(F.octet_length("text")).alias("size"))


@query("f2_truncate_lines", """WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
c AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n FROM l),
k AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (n <= 500), '') AS kept FROM c GROUP BY 1)
SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE kept || chr(10) || '...' END AS cut FROM documents JOIN k USING (doc_id)""")
def truncate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", f.truncate_lines(F.col("text"), 500).alias("cut"))


@query("f3_cut_bytes", "SELECT doc_id, CASE WHEN strlen(text) <= 300 THEN text ELSE substring(text, 1, coalesce(list_max(list_filter(range(1, 298), lambda i: strlen(substring(text, 1, i)) <= 297)), 0)) || '...' END AS cut FROM documents")
def cut_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole characters of at most 300 bytes, the mark included."""
    return b.table(spark, sf_dir, "documents").select("doc_id", f.bytes_within(F.col("text"), 300).alias("cut"))


@query("f4_tsv", "SELECT conv_id, turn, conv_id || chr(9) || turn || chr(9) || regexp_replace(regexp_replace(text, '\\t', '    ', 'g'), '\\r?\\n', '\\\\n', 'g') AS line FROM conversations")
def tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.concat_ws("\t", *[f.tsv_cell(F.col(c)) for c in ("conv_id", "turn", "text")]).alias("line"))


@query("f5_numbered_lines", "WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations) SELECT conv_id, turn, lpad(CAST(pos AS VARCHAR), 4, ' ') || ' | ' || line AS source FROM l")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source blocks with padded line numbers."""
    lines = b.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("conv_id", "turn", f.numbered_line(F.col("pos") + 1, F.col("line")).alias("source"))


@query("f6_parse_types", """SELECT p_partkey AS symbol_id, CASE p_size % 4 WHEN 0 THEN 'promise' WHEN 1 THEN 'array' ELSE lower(p_type) END AS base, p_size % 4 = 0 AS is_async, p_size % 4 = 2 AS is_nullable, p_size % 4 = 1 AS is_array FROM part""")
def parse_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asynchronous, array and nullable types taken apart."""
    parsed = symbol_types(spark, sf_dir).select("symbol_id", f.parse_type_column()("raw").alias("t"))
    return parsed.select("symbol_id", "t.base", "t.is_async", "t.is_nullable", "t.is_array")


TYPED = [
    ("typescript", "Promise<User[]>", "Promise<Array<User>>", "promise", "array<user>"), ("typescript", "string | null", "String | null", "string", ""), ("typescript", "Map<string, Set<number>>", "Map<String, Set<Number>>", "map", "string,set<number>"),
    ("typescript", "A | B", "Union<A, B>", "union", "a,b"), ("python", "Optional[int]", "Nullable<Number> | null", "nullable", "number"), ("python", "Dict[str, List[float]]", "Map<String, Array<Number>>", "map", "string,array<number>"),
    ("python", "Coroutine[Any, Any, bytes]", "Promise<Any, Any, ByteArray>", "promise", "any,any,bytearray"), ("python", "str", "String", "string", ""), ("typescript", "void", None, None, None), ("python", "Sequence[str]", "Array<String>", "array", "string"),
]
_TEXT = lambda v: "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"


@query("f8_normalized_types", f"SELECT p_partkey AS id, t.n AS normalized, t.b AS base, t.i AS inner_types FROM part JOIN (VALUES {', '.join(f'({k}, {_TEXT(n)}, {_TEXT(x)}, {_TEXT(i)})' for k, (_, _, n, x, i) in enumerate(TYPED))}) AS t(k, n, b, i) ON t.k = p_size % 10")
def normalized_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of both languages brought together, also within type arguments."""
    at = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in TYPED]), (F.col("p_size") % 10 + 1).cast("int"))
    parsed = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), at(0).alias("language"), at(1).alias("raw")).withColumn("t", f.parse_types_of()("raw", "language"))
    return parsed.select("id", "t.normalized", "t.base", F.col("t.inner").alias("inner_types"))


@query("f12_char_overlap", "SELECT p_partkey AS symbol_id, round(len(list_intersect(a, b)) / CAST(greatest(len(a), len(b), 1) AS DOUBLE), 6) AS overlap FROM (SELECT p_partkey, list_distinct(string_split(p_name, '')) AS a, list_distinct(string_split('bread winner', '')) AS b FROM part)")
def char_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.operators.lookups import overlap

    return b.symbols(spark, sf_dir).select("symbol_id", F.round(overlap(F.col("name"), F.lit("bread winner")), 6).alias("overlap"))


@query("f15_relative_paths", "SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN substring(url, 9) ELSE url END AS path FROM pages")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", F.when(F.col("url").startswith("https://m."), f.relative_path(F.col("url"), "https:/")).otherwise(F.col("url")).alias("path")).withColumn("path", F.regexp_replace("path", "^/", ""))


@query("f17_usage_cost", "SELECT o_orderkey AS run, round((o_custkey * 3 + o_orderkey * 15 + o_custkey * CAST(0.3 AS DOUBLE) + o_orderkey * CAST(3.75 AS DOUBLE)) / 1000000, 9) AS cost FROM orders")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    return b.table(spark, sf_dir, "orders").select(o.alias("run"), F.round(f.usage_cost(c, o, c, o, (3.0, 15.0, 0.3, 3.75)), 9).alias("cost"))


@query("f18_rubric", """WITH s AS (SELECT conv_id, turn, (CAST(regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)of') AS INT) + CAST(regexp_matches(text, '(?i)der') AS INT)) / CAST(2 AS DOUBLE) AS complete,
  CAST(regexp_matches(text, 'and') AS INT) + CAST(regexp_matches(text, 'que') AS INT) AS made, CAST(regexp_matches(text, 'and') AS INT) AS hits,
  len(list_distinct(regexp_extract_all(text, '[0-9A-Za-z_/]+\\.[a-z]{2,4}'))) + len(regexp_extract_all(text, ':[0-9]+')) AS places FROM conversations)
SELECT conv_id, turn, round(complete, 6) AS completeness, round(CASE WHEN made > 0 THEN hits / CAST(made AS DOUBLE) ELSE 0 END, 6) AS accuracy, places AS specificity,
  round(complete * CAST(0.5 AS DOUBLE) + CASE WHEN made > 0 THEN hits / CAST(made AS DOUBLE) ELSE 0 END * CAST(0.4 AS DOUBLE) + least(places / CAST(8 AS DOUBLE), 1) * CAST(0.1 AS DOUBLE), 6) AS composite FROM s""")
def rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = f.rubric(F.col("text"), [["(?i)the", "(?i)of"], ["(?i)der"]], ["and", "que"], ["and"])
    rated = b.table(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in parts.items()])
    return rated.withColumns({c: F.round(c, 6) for c in ("completeness", "accuracy", "composite")})


@query("f20_signatures", "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS signature, regexp_replace(regexp_replace(text, '\\|', '\\\\|', 'g'), '\\r?\\n', ' ', 'g') AS cell FROM conversations")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20, F21."""
    return b.table(spark, sf_dir, "conversations").select("conv_id", "turn", f.one_blank(F.col("text")).alias("signature"), f.markdown_cell(F.col("text")).alias("cell"))


@query("f22_semantic_tokens", "SELECT tok AS token, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(p_type || '_' || p_name), '[^\\p{L}\\p{N}]+')) AS tok FROM part) WHERE length(tok) > 2 AND tok NOT IN ('the', 'and', 'of', 'to', 'in', 'a', 'is') GROUP BY 1")
def semantic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names are about."""
    tokens = b.symbols(spark, sf_dir).select(F.explode(f.semantic_tokens(F.concat_ws("_", "kind", "name"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))

"""The queries of this subpackage, by name, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import centroids, chats, decontam, licenses, lm, media, packing, pii, quality, sharding, simhash, suffix, tries
from quillmesh.llm.common import fold

N_SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaked(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(spark, docs, _table(spark, sf_dir, "labels"))
    rated = quality.scores(spark, docs, model)
    return rated.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_documents(spark, _table(spark, sf_dir, "documents"), N_SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(spark, _table(spark, sf_dir, "documents"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark, _table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, _table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.spans(spark, docs, pii.fit(spark, docs))
    base = F.filter("spans", lambda s: s["by_pattern"])
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    of_kind = lambda kind: F.filter("spans", lambda s: s["by_pattern"] & (s["kind"] == kind))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.digests(spark, _table(spark, sf_dir, "documents"))
    return stored.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(":", F.col("n_peaks").cast("string"), F.col("n_codes").cast("string"), F.substring("codes_sha256", 1, 32)).alias("feature"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, _table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(spark, _table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroids.centroid_digest().alias("centroid_sha256"))


def op12_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    posing = "</s>[INST] ok [/INST]"
    turns = turns.union(spark.createDataFrame([(-1, 0, "user", posing), (-1, 1, "assistant", posing)], turns.schema))
    return chats.read_back(chats.format_chats(spark, turns))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.branched_trie(spark, _table(spark, sf_dir, "conversations")).drop("key")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_quality, op3_sharding, op4_suffix_dedup, op5_language_model, op6_packing, op7_pii, op8_media, op9_simhash, op10_licenses, op11_centroids, op12_chats, op13_prefix_trie)}


#: op4 by brute force: windows of 100 bytes as 200 hex digits, all but the first of equal ones, their unions, and what is left.
OP4_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, substring(h, 2 * i + 1, 200) AS x FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM g) GROUP BY doc_id, span),
k AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM s GROUP BY 1),
o AS (SELECT d.doc_id, n, coalesce(removed, 0) AS removed, coalesce(spans, 0) AS spans,
  CASE WHEN spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, spans + 1), lambda j: substring(h, 2 * CASE WHEN j = 0 THEN 0 ELSE ends[j] END + 1, 2 * (CASE WHEN j = spans THEN n ELSE starts[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE ends[j] END))), '') END AS kept
  FROM d LEFT JOIN k USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM o"""


#: op3: checksums by a table made from its polynomial; the least capacity by a search whose every step is one greedy cut; the cuts at it.
OP3_SQL = """WITH RECURSIVE crc_table AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) + 16 AS size, substring(md5(coalesce(text, '')), 1, 16) AS g FROM documents),
c AS (SELECT doc_id, size, g, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, size - 16), lambda i: CAST(instr('0123456789ABCDEF', h[2 * i + 1]) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 17 AS BIGINT))), lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)])), 4294967295) AS crc FROM d, crc_table),
gr AS (SELECT g, sum(size) AS b FROM d GROUP BY 1),
hv AS (SELECT g, b, row_number() OVER (ORDER BY b DESC, g) AS k, sum(b) OVER (ORDER BY b DESC, g ROWS UNBOUNDED PRECEDING) AS upto, (SELECT sum(b) FROM gr) AS total FROM gr),
ok AS (SELECT *, bool_and(41 - k > 2 AND b * (41 - k) > total - upto + b) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS heavy FROM hv),
nh AS (SELECT count(*) FILTER (heavy) AS n FROM ok),
o AS (SELECT g, b, heavy, row_number() OVER (ORDER BY g) AS pos, sum(CASE WHEN heavy THEN 0 ELSE b END) OVER (ORDER BY g ROWS UNBOUNDED PRECEDING) AS e FROM ok),
walls AS (SELECT e FROM o WHERE heavy UNION SELECT max(e) FROM o),
total AS (SELECT max(e) AS t, list(DISTINCT e ORDER BY e) AS es FROM o), ws AS (SELECT list(e ORDER BY e) AS ws FROM walls),
s(lo, hi, pos, used, step) AS (
  SELECT CAST(1 AS HUGEINT), t, CAST(0 AS HUGEINT), 0, 0 FROM total
  UNION ALL
  SELECT CASE WHEN used = 40 - n AND pos < t THEN (lo + hi) // 2 + 1 ELSE lo END, CASE WHEN pos >= t THEN (lo + hi) // 2 ELSE hi END,
    CASE WHEN pos >= t OR used = 40 - n THEN 0 ELSE least(coalesce(list_max(list_filter(es, lambda x: x <= pos + ((lo + hi) // 2))), pos), list_min(list_filter(ws, lambda x: x > pos))) END,
    CASE WHEN pos >= t OR used = 40 - n THEN 0 ELSE used + 1 END, step + 1
  FROM s, total, ws, nh WHERE lo < hi),
least_c AS (SELECT max(lo) AS cap FROM s),
cuts(pos, used) AS (SELECT CAST(0 AS HUGEINT), 0 UNION ALL SELECT least(list_max(list_filter(es, lambda x: x <= pos + cap)), list_min(list_filter(ws, lambda x: x > pos))), used + 1 FROM cuts, least_c, total, ws WHERE pos < t AND used < 41),
lab AS (SELECT o.g, o.heavy, o.pos, CASE WHEN heavy THEN NULL ELSE (SELECT min(c.used) FROM cuts c WHERE c.pos >= o.e) END AS run FROM o),
ch AS (SELECT g, pos, CASE WHEN heavy OR lag(heavy) OVER (ORDER BY pos) OR run IS DISTINCT FROM lag(run) OVER (ORDER BY pos) THEN 1 ELSE 0 END AS new FROM lab),
sh AS (SELECT g, CAST(sum(new) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS INT) AS shard FROM ch)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, g) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM c JOIN sh USING (g)"""


def _op11_sql(k: int = 16, rounds: int = 3) -> str:
    """op11 by all distances in every round."""
    steps = [f"""q AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT k - 1 AS c, v FROM (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) AS k FROM q) WHERE k <= {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, v, (n).c AS c, (n).d AS d FROM (SELECT r, any_value(vec_id) AS vec_id, any_value(q.v) AS v, min({{'d': d, 'c': c}}) AS n
FROM (SELECT r, vec_id, q.v, c, list_sum(list_transform(list_zip(q.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM q, c{i} AS m) AS q GROUP BY r))""")
        steps.append(f"""s{i} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m, v) AS v FROM c{i} LEFT JOIN (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS m FROM s{i} GROUP BY c) USING (c))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS m USING (c)"""


#: op12 from the rows themselves; what formatting adds is counted: marks of each role, and an escape for each control string and escape character.
OP12_SQL = r"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '</s>[INST] ok [/INST]' FROM range(2) AS t(i)),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, lag(CASE WHEN role IN ('system', 'user', 'assistant') THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS last,
  len(text) + len(regexp_extract_all(text, '\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[/ROLE\]|\[/TURN\]'))
  + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 18 ELSE 22 + len(role) + len(regexp_extract_all(role, '\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[/ROLE\]|\[/TURN\]')) END AS n FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256, CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars,
  bool_and(coalesce(CASE role WHEN 'system' THEN last IS NULL WHEN 'user' THEN last IS NULL OR last IN ('system', 'assistant') WHEN 'assistant' THEN last = 'user' END, false)) AS in_order, coalesce(arg_max(role, pos) FILTER (role IN ('system', 'user', 'assistant')) = 'assistant', false) AS ended
FROM e GROUP BY conv_id"""


#: op13: nodes by digests of all that was said up to them, subtrees by the paths of the smallest members of their nodes.
OP13_SQL = """WITH crc_table AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
c AS MATERIALIZED (SELECT c, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, len(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(c AS VARCHAR)[i]) AS BIGINT))), lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), crc_table),
o AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT c.c, pos, role, text FROM c JOIN o ON o.c = c.c - c.c % 100 AND pos < h UNION ALL SELECT c.c, pos, role, text FROM c JOIN o ON o.c = c.c AND pos >= h),
p AS MATERIALIZED (SELECT c, 0 AS depth, '' AS k, 0 AS chars FROM c
  UNION ALL SELECT c, row_number() OVER w, md5(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER w), len(text) FROM b WINDOW w AS (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING)),
e AS (SELECT c, max(depth) AS depth FROM p GROUP BY c),
n AS MATERIALIZED (SELECT k, any_value(p.depth) AS depth, min(p.c) AS c, count(*) AS n, any_value(chars) AS chars, count(*) FILTER (p.depth = e.depth) AS ends, coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (p.depth = e.depth), '') AS ids FROM p JOIN e USING (c) GROUP BY k),
above AS (SELECT p.k, n.k AS below, n.depth - p.depth AS apart, (n.n - 1) * n.chars AS saved, n.n = n.ends AS leaf FROM n JOIN p ON p.c = n.c AND p.depth <= n.depth),
up AS (SELECT below, k FROM above WHERE apart = 1),
s AS (SELECT k, count(*) FILTER (apart = 1) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved FROM above GROUP BY k)
SELECT n.c AS conv_id, CAST(n.depth AS BIGINT) AS depth, m.c AS parent_conv_id, n.n AS n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM n JOIN s USING (k) LEFT JOIN up ON up.below = n.k LEFT JOIN n AS m ON m.k = up.k"""


def oracle_sql() -> dict[str, str]:
    """What SQL can answer: the other operators hash, tokenize or train by what DuckDB lacks."""
    return {"op3_sharding": OP3_SQL, "op4_suffix_dedup": OP4_SQL, "op11_centroids": _op11_sql(), "op12_chats": OP12_SQL, "op13_prefix_trie": OP13_SQL}

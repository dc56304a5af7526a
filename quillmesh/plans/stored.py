"""Queries over the index at rest: the inverted index, and tables that are merged as they are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import lineage, lookups
from quillmesh.plans.index import _SCORE, MATCHED
from quillmesh.plans.registry import query
from quillmesh.plans.search import bm25_sql
from quillmesh.sources import bindings as b
from quillmesh.sources.model import RELATIONS
from quillmesh.sources.store import Store, migrated


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{lineage.shared_dir(spark)}/store-{uuid.uuid4().hex}")


def _whole(spark: SparkSession, rows: DataFrame, relation: str) -> DataFrame:
    return migrated(rows, spark.createDataFrame([], RELATIONS[relation]).schema)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols, brands as their files."""
    part = b.table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("file_path"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_brand", "p_type").alias("signature"), F.col("p_size").alias("line_start"))


def _saved(store: Store, symbols: DataFrame, files: DataFrame | None = None) -> Store:
    store.save({"symbols": _whole(store.spark, symbols, "symbols")}, (symbols if files is None else files).select("file_path"))
    return store


def _scores(found: DataFrame, key: str = "symbol_id") -> DataFrame:
    return found.select(F.col("id").cast("long").alias(key), F.round("score", 6).alias("score"))


@query("r1_stored_index", f"WITH {MATCHED} SELECT key AS symbol_id, round({_SCORE}, 6) AS score FROM v, w WHERE n0 > 0 OR n1 > 0 OR (n2 > 0 AND n3 > 0)")
def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix, a phrase and words that must all occur, by the postings of their terms alone."""
    store = _saved(_store(spark), _parts(spark, sf_dir))
    return _scores(store.search("symbols", 'blu* OR "economy brushed" OR red tin', (2.0, 1.0, 1.0)))


WORDS = ["red", "widget", "brushed"]
_WORD_SQL = bm25_sql("part", "p_partkey", "p_name || ' ' || p_brand || ' ' || p_type", WORDS)
for _w in WORDS:
    _WORD_SQL = _WORD_SQL.replace(f"starts_with(x, '{_w}')", f"x = '{_w}'")


@query("r1_best_of_index", f"WITH {_WORD_SQL} SELECT key AS symbol_id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, CAST(key AS VARCHAR) LIMIT 40")
def best_of_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty best for three words (the search's top-k), without the levels of impact that cannot reach them."""
    store = _saved(_store(spark), _parts(spark, sf_dir))
    return _scores(store.search("symbols", " OR ".join(f'"{w}"' for w in WORDS), k=40))


_CHANGED = """part_now AS (SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN 'new ' || p_name ELSE p_name END AS text FROM part WHERE (p_brand NOT LIKE '%1' OR p_size % 3 = 0) AND p_brand <> 'Brand#22')"""


@query("r1_index_after_update", f"WITH {_CHANGED}, {bm25_sql('part_now', 'p_partkey', 'text', ['new', 'wid'])} SELECT key AS symbol_id, round(score, 6) AS score FROM bm")
def index_after_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files replaced and a file deleted; only their postings are written or left out."""
    parts = _parts(spark, sf_dir)
    store = _saved(_store(spark), parts)
    some = parts.filter("file_path like '%1'")
    _saved(store, some.filter("line_start % 3 = 0").withColumn("name", F.concat(F.lit("new "), "name")), some)
    store.delete(["Brand#22"])
    return _scores(store.search("symbols", "new* OR wid*", (1.0, None, None)))


@query("r3_stored_config_index", f"WITH {bm25_sql('events', 'event_id', 'event_type', ['cl'])} SELECT key AS event_id, round(score, 6) AS score FROM bm")
def stored_config_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys alone of an index over keys and values; a plain word is a prefix."""
    store, events = _store(spark), b.table(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("file_path"), F.col("event_type").alias("path"), F.col("props").alias("value"))
    store.save({"config_entries": _whole(spark, rows, "config_entries")}, rows.select("file_path"))
    return _scores(store.search("config_entries", "cl", (1.0, None)), "event_id")


@query("m1_compacted", """SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_brand LIKE '%3' THEN 'third ' WHEN p_brand LIKE '%1' THEN 'new ' ELSE '' END || p_name AS name FROM part WHERE (p_brand NOT LIKE '%1' OR p_size % 3 = 0) AND p_brand <> 'Brand#22'""")
def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replaced and deleted files, read after their segments were merged, and once more replaced after that."""
    parts = _parts(spark, sf_dir)
    store = _saved(_store(spark), parts)
    some = parts.filter("file_path like '%1'")
    _saved(store, some.filter("line_start % 3 = 0").withColumn("name", F.concat(F.lit("new "), "name")), some)
    store.delete(["Brand#22"])
    store.compact(full=True)
    _saved(store, parts.filter("file_path like '%3'").withColumn("name", F.concat(F.lit("third "), "name")))
    return store.read("symbols").select("id", "name")


@query("m1_earlier_version", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part")
def earlier_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: what a reader of the first version sees after files were replaced, deleted and compacted."""
    parts = _parts(spark, sf_dir)
    store = _saved(_store(spark), parts)
    _saved(store, parts.filter("file_path like '%1'").withColumn("name", F.lit("gone")))
    store.delete(["Brand#22"])
    store.compact(full=True)
    return store.read("symbols", version=1).select("id", "name")


_TREE = """en AS (SELECT CAST(o_orderkey AS VARCHAR) AS file, unnest([
  {p: 'status', parent: NULL, v: o_orderstatus}, {p: CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'detail' END, parent: NULL, v: '{}'}, {p: 'detail.priority', parent: 'detail', v: o_orderpriority}, {p: 'detail.key', parent: 'detail', v: CAST(o_custkey AS VARCHAR)}]) AS e FROM orders),
c AS (SELECT file, e.p AS path, e.parent AS parent, e.v AS value FROM en WHERE e.p IS NOT NULL)"""


def _orders_as_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as configuration files; in a third of them nothing is stored at the path of the folder itself."""
    entry = lambda p, parent, v: F.struct(p.alias("path"), parent.cast("string").alias("parent_path"), v.cast("string").alias("value"))
    none, detail = F.lit(None), F.lit("detail")
    rows = [entry(F.lit("status"), none, F.col("o_orderstatus")), entry(F.when(F.col("o_orderkey") % 3 != 0, "detail"), none, F.lit("{}")), entry(F.lit("detail.priority"), detail, F.col("o_orderpriority")), entry(F.lit("detail.key"), detail, F.col("o_custkey"))]
    orders = b.table(spark, sf_dir, "orders")
    return _whole(spark, orders.select(F.col("o_orderkey").cast("string").alias("file_path"), F.explode(F.array(*rows)).alias("e")).select("file_path", "e.*").filter("path is not null"), "config_entries")


@query("l14_config_rungs", f"WITH {_TREE}, x AS (SELECT *, count(*) FILTER (path = 'detail') OVER (PARTITION BY file) AS n FROM c WHERE path = 'detail' OR starts_with(path, 'detail.')) SELECT file AS file_path, path, value FROM x WHERE n = 0 OR path = 'detail'")
def config_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry at a path, or where a file has none, those below it."""
    return lookups.config_value(_orders_as_config(spark, sf_dir), "detail").select("file_path", "path", "value")


@query("l15_children_of_entries", f"WITH {_TREE} SELECT file AS file_path, path, value FROM c WHERE parent = 'detail'")
def children_of_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.config_children(_orders_as_config(spark, sf_dir), "detail").select("file_path", "path", "value")


@query("l15_top_entries", f"WITH {_TREE} SELECT path, count(*) AS n FROM c WHERE parent IS NULL GROUP BY 1")
def top_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.config_children(_orders_as_config(spark, sf_dir), None).groupBy("path").agg(F.count("*").alias("n"))

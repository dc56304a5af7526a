"""Canonical relations projected from relational tables: files, symbols, calls, type relations, imports, configuration, sessions.

Every projection reads only the columns it needs, so scans stay narrow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path is source/language/id."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file_path"), F.concat_ws("/", "source", "lang").alias("directory"),
        F.col("lang").alias("language"), F.sha2(text, 256).alias("checksum"), F.octet_length(text).cast("long").alias("file_size"), F.size(F.split(text, "\n")).cast("long").alias("line_count"), "source", "doc_id",
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("signature"),
        F.col("p_brand").alias("file_path"), F.col("p_size").alias("line_start"), (F.col("p_size") > 25).alias("is_exported"),
    )


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller and callee of each order line, repeats included."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("callee"))


def occurrence_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file and symbol of each order line, repeats included."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("symbol")).join(part, "symbol", "left_semi")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as call edges: order calls part; flags are those of the first line."""
    first = F.struct("l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice", "l_returnflag", "l_linestatus")
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("callee")).agg(F.count("*").alias("call_count"), F.min(first).alias("f"))
    return grouped.select("caller", "callee", "call_count", (F.col("f.l_returnflag") == "R").alias("is_async"), (F.col("f.l_linestatus") == "O").alias("is_conditional"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order as symbols of a file; the brand is the class that holds them."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_brand").alias("parent"))
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("symbol")).distinct()
    return pairs.join(part, "symbol").select("file", "symbol", "parent")


def type_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations extend regions, suppliers implement nations, customers mix nations in."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda t, s, d, kind: table(spark, sf_dir, t).select(s.alias("source"), d.alias("target"), F.lit(kind).alias("kind"))
    return (
        edge("nation", name("n:", "n_nationkey"), name("r:", "n_regionkey"), "extends")
        .unionByName(edge("supplier", name("s:", "s_suppkey"), name("n:", "s_nationkey"), "implements"))
        .unionByName(edge("customer", name("c:", "c_custkey"), name("n:", "c_nationkey"), "mixin"))
    )


def layered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> customer -> order -> part, as edges of prefixed names."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda t, s, d: table(spark, sf_dir, t).select(s.alias("src"), d.alias("dst"))
    return (
        edge("nation", name("r:", "n_regionkey"), name("n:", "n_nationkey"))
        .unionByName(edge("customer", name("n:", "c_nationkey"), name("c:", "c_custkey")))
        .unionByName(edge("orders", name("c:", "o_custkey"), name("o:", "o_orderkey")))
        .unionByName(edge("lineitem", name("o:", "l_orderkey"), name("p:", "l_partkey")).distinct())
    )


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which event type follows which, per user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).filter("dst is not null").distinct()


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages as imports."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), F.posexplode(hrefs).alias("pos", "source")).select("file", "pos", "source")


def session_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls: a session per user, sign-ups synchronise the index."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), "event_id", "ts", F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").alias("target"), (F.col("event_type") == "signup").alias("is_sync")
    )

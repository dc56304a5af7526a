"""Roll-ups over files, symbols, calls and modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def language_stats(files: DataFrame, symbols: DataFrame, languages: list[str], kinds: dict[str, list[str]]) -> DataFrame:
    """Files, bytes and symbols of each kind group, per language; languages without files count zero (A1)."""
    spark = files.sparkSession
    every = spark.createDataFrame([(x,) for x in languages], "language string")
    own = files.groupBy("language").agg(F.count("*").alias("n_files"), F.sum("file_size").alias("bytes"))
    sums = symbols.groupBy("language").agg(*[F.sum(F.when(F.col("kind").isin(ks), 1).otherwise(0)).alias(f"n_{k}") for k, ks in kinds.items()])
    return F.broadcast(every).join(own, "language", "left").join(sums, "language", "left").na.fill(0)


def directory_rollup(files: DataFrame) -> DataFrame:
    """Files, lines and bytes of each directory, the fullest first (A4)."""
    return files.groupBy("directory").agg(F.count("*").alias("n_files"), F.sum("line_count").alias("lines"), F.sum("file_size").alias("bytes"))


def collapse_calls(calls: DataFrame, keys: list[str], order: list[str], flags: list[str]) -> DataFrame:
    """One edge for each caller and callee, with the flags of the first occurrence (A5)."""
    return calls.groupBy(*keys).agg(F.count("*").alias("call_count"), F.min(F.struct(*order, *flags)).alias("f")).select(*keys, "call_count", *[F.col(f"f.{x}").alias(x) for x in flags])


def popularity(refs: DataFrame, called: DataFrame, callers: DataFrame, imported: DataFrame) -> DataFrame:
    """name, score: one for each reference, call made and import, and the call count for each callee."""
    one = lambda df: df.select(F.trim("name").alias("name"), F.lit(1).cast("long").alias("n"))
    every = one(refs).unionByName(called.select(F.trim("name").alias("name"), F.greatest("call_count", F.lit(1)).cast("long").alias("n"))).unionByName(one(callers)).unionByName(one(imported))
    return every.filter("name <> ''").groupBy("name").agg(F.sum("n").alias("score"))


def module_name(path: Column) -> Column:
    """src/<x> for three parts and more under src, src, the first directory, or a dot (Q22)."""
    parts = F.split(path, "/")
    n, first = F.size(parts), F.element_at(parts, 1)
    return F.when(n == 1, ".").when((first == "src") & (n >= 3), F.concat_ws("/", first, F.element_at(parts, 2))).otherwise(first)


def module_rollup(files: DataFrame) -> DataFrame:
    """Files, lines and distinct languages of each module."""
    return files.groupBy("module").agg(F.count("*").alias("n_files"), F.sum("line_count").alias("lines"), F.countDistinct("language").alias("languages"))


def fan_out(relations: DataFrame, least: int = 2) -> DataFrame:
    """Targets with at least `least` distinct sources of a kind (A10)."""
    return relations.groupBy("target", "kind").agg(F.countDistinct("source").alias("children"), F.min("source").alias("first"), F.max("source").alias("last")).filter(F.col("children") >= least)


def dependency_edges(imports: DataFrame) -> DataFrame:
    """Edges between modules, with how many specifiers and how many of them only types; own edges are left out."""
    return imports.filter("from_module <> to_module").groupBy("from_module", "to_module").agg(F.countDistinct("specifier").alias("specifiers"), F.sum(F.when(F.col("type_only"), 1).otherwise(0)).alias("type_only"), F.sum(F.when(F.col("type_only"), 0).otherwise(1)).alias("values"))


def metric_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Least, median and most of a metric."""
    return rows.groupBy(by).agg(F.min(value).alias("least"), F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("most"))


def file_summary(symbols: DataFrame) -> DataFrame:
    """A line of text for each file: how many symbols, exported ones, and kinds."""
    g = symbols.groupBy("file_path").agg(F.count("*").alias("n"), F.sum(F.col("is_exported").cast("int")).alias("exported"), F.array_join(F.sort_array(F.collect_set("kind")), ", ").alias("kinds"))
    return g.select("file_path", F.concat(F.col("n").cast("string"), F.lit(" symbols, "), F.col("exported").cast("string"), F.lit(" exported: "), F.col("kinds")).alias("summary"))


def export_score(kind: Column, refs: Column, methods: Column, params: Column) -> Column:
    """How much an export matters, by kind, references and size (Q25)."""
    return (
        F.when(kind == "class", 30 + 4 * refs + 3 * methods + params).when(kind == "function", 20 + 4 * refs + params)
        .when(kind == "interface", 10 + 4 * refs + params + methods).when(kind == "type", 8 + 4 * refs).otherwise(6 + 4 * refs)
    )


def best_of(rows: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group in this order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")

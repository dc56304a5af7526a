"""What the operators share: shared-folder tables, batch sizes, stable hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Rows and bytes of one Arrow batch: long texts must not fill a Python worker.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


def tune(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches that carry texts to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one for local masters only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/quillmesh"


class Scratch:
    """Tables written to the shared folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df, and return what reads it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def body(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def integer_ids(docs: DataFrame, doc_id: str) -> None:
    """Refuse ids that have no order of integers."""
    kind = docs.schema[doc_id].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{doc_id} must be an integer, not {kind.simpleString()}")


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def rebatch(rows: Iterator[tuple], schema: pa.Schema, every: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= every:
            yield as_batch(held, schema)
            held = []
    if held:
        yield as_batch(held, schema)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def rank_in(keys: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The running number of each element among equal keys, from seen[key] on; seen is advanced."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    counts = np.bincount(keys, minlength=len(seen))
    starts = np.cumsum(counts) - counts
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - starts[ordered] + seen[ordered]
    seen += counts
    return out

"""Cutting lineage in loops, by checkpoints in a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on a local master without that setting a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (base or "file:///tmp/checkpoints/quillmesh").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to spark.checkpoint.dir; on a local master without that setting, to a folder of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, written as a table to the shared folder and read back: computed once, where a checkpoint computes twice, and scans of it prune."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Scalar functions by name in SQL, built in and the user's own."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import scalars


def register(spark: SparkSession, own: dict[str, tuple[Callable, str]] | None = None) -> list[str]:
    """Makes parse_type and cut_bytes_300 callable in SQL, and own: name -> (function of a value, result type) as Arrow functions."""
    spark.udf.register("parse_type", scalars.parse_type_column())
    spark.udf.register("cut_bytes_300", scalars.cut_bytes_column(300))
    for name, (f, kind) in (own or {}).items():
        spark.udf.register(name, _batched(f, kind))
    return ["parse_type", "cut_bytes_300", *(own or {})]


def _batched(f: Callable, kind: str):
    @F.pandas_udf(kind)
    def batch(values: pd.Series) -> pd.Series:
        return values.map(f)

    return batch

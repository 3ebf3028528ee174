"""Readers of the engine's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tracelode.schemas import DELIVERY, prune


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def deliveries(spark: SparkSession, root: str, record: T.StructType) -> DataFrame:
    """pi_polar_task_status with only the members in ``record``: the scan skips all other nested columns."""
    paths = ["delivery_id", *_paths(record)]
    return spark.read.schema(prune(DELIVERY, paths)).parquet(f"{root}/pi_polar_task_status.parquet")


def _paths(kind: T.DataType) -> list[str]:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    if not isinstance(kind, T.StructType):
        return [""]
    return [f"{f.name}.{p}" if p else f.name for f in kind.fields for p in _paths(f.dataType)]


class SchemaMismatch(ValueError):
    """A table's schema isn't exactly the expected one."""


def strict_parquet(spark: SparkSession, path: str, expected: T.StructType) -> DataFrame:
    """The Parquet table at ``path``, refused unless names, order and types equal ``expected``.

    Nullability isn't compared. The schema is never handed to the reader, which would coerce.
    """
    df = spark.read.parquet(path)
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    want = [(f.name, f.dataType.simpleString()) for f in expected.fields]
    if have != want:
        raise SchemaMismatch(f"have {have}, want {want}")
    return df

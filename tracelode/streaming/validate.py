"""Deliveries validated and routed as they arrive.

The same rules as in batch run over each micro-batch of a stream; a micro-batch is one commit: its rows are
written below its batch id, by disposition, and a batch that is run again overwrites what it
wrote, so a restart neither loses nor repeats any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_available(spark: SparkSession, source: str, schema: T.StructType, rules: Callable[[DataFrame], DataFrame], sink: str, files_per_batch: int = 64) -> None:
    """All Parquet files at ``source`` not yet seen, through ``rules`` to ``sink``/batch=N/disposition=...; returns when they are done."""

    def commit(rows: DataFrame, batch: int) -> None:
        rules(rows).write.mode("overwrite").partitionBy("disposition").parquet(f"{sink}/rows/batch={batch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{sink}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def routed(spark: SparkSession, sink: str) -> DataFrame:
    """What has been routed so far."""
    return spark.read.option("basePath", f"{sink}/rows").parquet(f"{sink}/rows")


def counters(rows: DataFrame) -> DataFrame:
    """Rows by disposition; on a stream, in complete mode, the running counts."""
    return rows.groupBy("disposition").agg(F.count("*").alias("n"))


def latest(spark: SparkSession, sink: str, key: str, order: list[str]) -> DataFrame:
    """Of each ``key`` the row that came last: by batch, then by ``order``. What is written is never rewritten; a later row takes the
    earlier one's place when it is read (rows of a null key stay as they are)."""
    rows = routed(spark, sink)
    by = Window.partitionBy(key).orderBy(F.col("batch").desc(), *[F.col(c).desc() for c in order])
    last = rows.where(F.col(key).isNotNull()).withColumn("__nth", F.row_number().over(by)).where("__nth = 1").drop("__nth")
    return last.unionByName(rows.where(F.col(key).isNull()))

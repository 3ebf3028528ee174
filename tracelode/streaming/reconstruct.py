"""Token streams rebuilt as completions arrive.

A micro-batch appends its completions and rebuilds the sessions that it touches, from all of their completions so far;
other sessions aren't read again beyond their keys. What was built before is superseded when it is read
(``current``), so a batch that is run again only writes the same once more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.operators.trajectory import reconstruct


def run_available(spark: SparkSession, source: str, schema: T.StructType, completions: Callable[[DataFrame], DataFrame], keys: list[str], sink: str, files_per_batch: int = 64, **how) -> None:
    """All Parquet files at ``source`` not yet seen, their ``completions`` into ``sink``; returns when they are done."""

    def commit(rows: DataFrame, batch: int) -> None:
        completions(rows).write.mode("overwrite").parquet(f"{sink}/completions/batch={batch}")
        held = spark.read.option("basePath", f"{sink}/completions").parquet(f"{sink}/completions")
        touched = held.where(F.col("batch") == batch).select(*keys).distinct()
        mine = held.where(F.col("batch") <= batch).join(touched, keys, "left_semi").drop("batch")
        reconstruct(mine, keys, **how).write.mode("overwrite").parquet(f"{sink}/merged/batch={batch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{sink}/state").trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """The streams as the last batch that touched their session built them."""
    rows = spark.read.option("basePath", f"{sink}/merged").parquet(f"{sink}/merged")
    last = F.max("batch").over(Window.partitionBy(*keys))
    return rows.withColumn("last", last).where("batch = last").drop("batch", "last")

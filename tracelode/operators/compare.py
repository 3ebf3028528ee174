"""Comparisons: of tables as bags or lists, of censuses, of JSON objects by their members."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.wire import canonical


def bag_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows by which two tables differ, each as often as it is too many: side (a or b) and the columns."""
    more, less = a.exceptAll(b), b.exceptAll(a)
    return more.select(F.lit("a").alias("side"), *a.columns).unionByName(less.select(F.lit("b").alias("side"), *a.columns))


def list_diff(a: DataFrame, b: DataFrame, position: str) -> DataFrame:
    """The positions at which two numbered tables differ: position, and whether a side lacks it."""
    cols = [c for c in a.columns if c != position]
    x, y = a.select(position, F.struct(*cols).alias("x")), b.select(position, F.struct(*cols).alias("y"))
    both = x.join(y, position, "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.select(position, F.col("x").isNull().alias("not_in_a"), F.col("y").isNull().alias("not_in_b"))


def census_diff(served: DataFrame, wanted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys served or wanted alone, and columns that differ: key, finding."""
    both = served.select(key, F.struct(*columns).alias("s")).join(wanted.select(key, F.struct(*columns).alias("w")), key, "full_outer")
    found = F.when(F.col("w").isNull(), F.array(F.lit("not_wanted"))).when(F.col("s").isNull(), F.array(F.lit("not_served"))).otherwise(
        F.filter(F.array(*[F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"w.{c}")), F.lit(f"differs:{c}")) for c in columns]), lambda x: x.isNotNull())
    )
    return both.select(key, F.explode(found).alias("finding"))


def prefix_census(pages: DataFrame, timesteps: DataFrame) -> DataFrame:
    """Of each case and timestep the pages up to it: case_id, timestep, n_pages, complete (1 .. timestep all there).

    ``pages`` and ``timesteps`` are counted per case and page first; the running count needs no pairs of pages and timesteps.
    """
    from pyspark.sql import Window

    events = pages.select("case_id", F.col("page").cast("bigint").alias("at")).distinct().withColumn("is_page", F.lit(1)).unionByName(
        timesteps.select("case_id", F.col("timestep").cast("bigint").alias("at")).distinct().withColumn("is_page", F.lit(0)))
    upto = Window.partitionBy("case_id").orderBy("at", F.col("is_page").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = events.withColumn("n_pages", F.sum(F.when((F.col("is_page") == 1) & (F.col("at") >= 1), 1).otherwise(0)).over(upto))
    return counted.where("is_page = 0").select("case_id", F.col("at").alias("timestep"), "n_pages", (F.col("n_pages") == F.col("at")).alias("complete"))


def member_diff(rows: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """How the JSON objects ``a`` and ``b`` of each row differ: key, member, change (only_a, only_b, changed).

    Values are compared in canonical form, so 1 and 1.0 differ and order doesn't matter; a text that isn't an object has no members.
    """

    def load(text):
        try:
            value = json.loads(text) if text is not None else None
        except (ValueError, RecursionError):
            value = None
        return value if isinstance(value, dict) else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, names, changes = [], [], []
            for i, (x, y) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                p, q = load(x), load(y)
                for m in sorted(set(p) | set(q)):
                    change = "only_a" if m not in q else "only_b" if m not in p else "changed" if canonical(p[m]) != canonical(q[m]) else None
                    if change:
                        parent.append(i)
                        names.append(m)
                        changes.append(change)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(parent, pa.int64())), pa.array(names, pa.string()), pa.array(changes, pa.string())], names=[key, "member", "change"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, a.alias("a"), b.alias("b")).mapInArrow(run, f"`{key}` {kind}, member string, change string")

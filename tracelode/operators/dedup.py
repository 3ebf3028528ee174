"""Exactly one copy of messages that were delivered at least once.

A message is identified by all of its key columns; among deliveries with equal keys the one that
arrived first is kept, on equal arrival the lowest tie-break. Defined results: if the first key
column is null the row identifies nothing and is kept; the other key columns compare null-safe;
a null arrival ranks last; rows equal in every rank column are copies, one of which is kept; an
empty table gives an empty table; other columns, of any name, pass through unchanged.

Ranking keeps only rank 1, so Spark limits each key to one row per map task before the shuffle
(``WindowGroupLimit``): a key that holds a third of all rows sends one row per map task, not its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _rank(keys: list[str], arrival: str, tie: str) -> Column:
    order = [F.col(arrival).asc_nulls_last(), F.col(tie).asc_nulls_last()]
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def first_deliveries(df: DataFrame, keys: list[str], arrival: str, tie: str) -> DataFrame:
    """The rows of ``df`` with the first delivery of each message only."""
    rank = unused(df, "__rank")
    named = df.where(F.col(keys[0]).isNotNull())
    first = named.withColumn(rank, _rank(keys, arrival, tie)).where(F.col(rank) == 1).drop(rank)
    return first.unionByName(df.where(F.col(keys[0]).isNull()))


def redundant_deliveries(df: DataFrame, keys: list[str], arrival: str, tie: str) -> DataFrame:
    """The ``tie`` column of every delivery that ``first_deliveries`` leaves out.

    What is kept is subtracted row by row (``EXCEPT ALL``), so of two rows with one delivery id and
    one arrival, one is redundant.
    """
    cols = list(dict.fromkeys([*keys, arrival, tie]))
    narrow = df.select(*cols)
    return narrow.select(tie).exceptAll(first_deliveries(narrow, keys, arrival, tie).select(tie))


def admit(batch: DataFrame, stored: DataFrame, keys: list[str], arrival: str, tie: str) -> DataFrame:
    """The rows of a new ``batch`` that are first deliveries of messages not in ``stored``.

    Both sides hold a key at most once when they meet, so no key can be hot in the join.
    """
    new = first_deliveries(batch, keys, arrival, tie)
    mine = [unused(batch, f"__known{i}") for i in range(len(keys))]
    known = stored.where(F.col(keys[0]).isNotNull()).select(*[F.col(k).alias(m) for k, m in zip(keys, mine)]).distinct()
    same = F.col(keys[0]) == F.col(mine[0])
    for k, m in zip(keys[1:], mine[1:]):
        same = same & F.col(k).eqNullSafe(F.col(m))
    return new.join(known, same, "left_anti")

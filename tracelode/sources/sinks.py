"""Writers: sessions by disposition, session files, findings, reports. Every write replaces what it wrote before."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_dispositions(rows: DataFrame, path: str) -> None:
    """Rows as Parquet by disposition, so that a reader of one prunes the other."""
    rows.write.mode("overwrite").partitionBy("disposition").parquet(path)


def write_sessions(rows: DataFrame, path: str) -> None:
    """Session results as JSON lines, null members left out."""
    rows.write.mode("overwrite").json(path)


def quarantine(rows: DataFrame, session: str, findings: str) -> DataFrame:
    """The wrapper of a quarantined result: body = {findings, session_result}."""
    return rows.select(F.to_json(F.struct(F.col(findings).alias("findings"), F.col(session).alias("session_result"))).alias("body"))


def totals(findings: DataFrame, by: str = "scope") -> DataFrame:
    """Findings by scope, as a table for reading."""
    return findings.groupBy(by).agg(F.count("*").alias("n")).orderBy(by)


def report(summary: DataFrame, name: str) -> str:
    """A small summary (one row a group) as a JSON document with sorted members."""
    rows = [r.asDict(recursive=True) for r in summary.limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("a report is of at most 10,000 rows; write the table instead")
    return json.dumps({"name": name, "rows": rows}, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n"

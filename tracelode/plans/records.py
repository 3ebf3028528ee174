"""Queries over session results: flat tables (p1) and exactly-once deliveries (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators.dedup import admit, first_deliveries, redundant_deliveries
from tracelode.operators.nested import flatten_bodies, flatten_rows, record_schema
from tracelode.sources.tables import deliveries, table

MESSAGE_KEY = ["session_id", "task_id"]


def _flat(name: str):
    def query(spark: SparkSession, root: str) -> DataFrame:
        rows = flatten_rows(deliveries(spark, root, record_schema(name)), name)
        bodies = flatten_bodies(table(spark, root, "wire_bodies"), name)
        return rows.unionByName(bodies)

    return query


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return redundant_deliveries(table(spark, root, "pi_polar_task_status"), MESSAGE_KEY, "received_at", "delivery_id")


def p6_kept(spark: SparkSession, root: str) -> DataFrame:
    """The whole rows of the deliveries that remain, the nested trajectory shown by its number of traces."""
    kept = first_deliveries(table(spark, root, "pi_polar_task_status"), MESSAGE_KEY, "received_at", "delivery_id")
    return kept.select("delivery_id", "batch_id", F.unix_micros("received_at").alias("received_us"), "session_id", "task_id", "status", F.size(F.coalesce("trajectory.traces", F.array())).cast("bigint").alias("n_traces"))


def p6_admitted(spark: SparkSession, root: str) -> DataFrame:
    """What the later half of the batches adds to the store of the earlier half."""
    t = table(spark, root, "pi_polar_task_status").select("delivery_id", "batch_id", "received_at", *MESSAGE_KEY)
    last = t.agg(F.max("batch_id")).first()[0] or 0
    split = t.withColumn("late", F.col("batch_id") * 2 > last)
    new = admit(split.where("late"), split.where("not late"), MESSAGE_KEY, "received_at", "delivery_id")
    return new.select("delivery_id", "batch_id", F.unix_micros("received_at").alias("received_us"), *MESSAGE_KEY)


QUERIES = {"p1_found": _flat("trace_sessions")} | {f"p1_{n}": _flat(n) for n in ("sessions", "traces", "tokens", "messages", "tool_calls", "completions")}
QUERIES |= {"p6_found": p6_found, "p6_kept": p6_kept, "p6_admitted": p6_admitted}

# DuckDB: a body is one whole JSON object if json_valid holds and its type is OBJECT; the same three shapes.
MEMBERS = """
WITH whole AS MATERIALIZED (SELECT body_id, body::JSON AS j FROM wire_bodies WHERE json_valid(body)),
objects AS MATERIALIZED (SELECT body_id, j FROM whole WHERE json_type(j) = 'OBJECT'),
listed AS (SELECT body_id, json_extract(j, '$.results[*]') AS r FROM objects WHERE json_type(j, '$.results') = 'ARRAY'),
members AS MATERIALIZED (
  SELECT body_id, (k - 1)::INT AS member_no, r[k] AS m FROM listed, unnest(range(1, len(r) + 1)) AS u(k)
  UNION ALL
  SELECT body_id, 0::INT, CASE WHEN json_type(j, '$.session_result') = 'OBJECT' THEN j -> '$.session_result' ELSE j END
  FROM objects WHERE json_type(j, '$.results') IS DISTINCT FROM 'ARRAY'),
body_traces AS (
  SELECT body_id, member_no, m, (k - 1)::INT AS trace_no, t[k] AS t
  FROM (SELECT *, json_extract(m, '$.trajectory.traces[*]') AS t FROM members WHERE json_type(m, '$.trajectory.traces') = 'ARRAY'), unnest(range(1, len(t) + 1)) AS u(k)
  WHERE json_type(t[k]) = 'OBJECT'),
row_traces AS (
  SELECT d.*, (k - 1)::INT AS trace_no, d.trajectory.traces[k] AS t
  FROM pi_polar_task_status d, unnest(range(1, coalesce(len(d.trajectory.traces), 0) + 1)) AS u(k) WHERE d.trajectory.traces[k] IS NOT NULL)
"""


def _text(path: str, of: str = "m") -> str:
    return f"CASE WHEN json_type({of}, '{path}') = 'VARCHAR' THEN json_extract_string({of}, '{path}') END"


_SESSION = f"coalesce({_text('$.metadata.session_id', 't')}, {_text('$.trajectory.metadata.session_id')}, {_text('$.session_id')})"

ORACLE = {
    "p1_found": MEMBERS + f"""
SELECT 'row' AS origin, delivery_id AS record_id, 0::INT AS member_no, trace_no, coalesce(t.metadata.session_id, trajectory.metadata.session_id, session_id) AS session_id FROM row_traces
UNION ALL SELECT 'body', body_id, member_no, trace_no, {_SESSION} FROM body_traces""",
    "p1_sessions": MEMBERS + f"""
SELECT 'row' AS origin, delivery_id AS record_id, 0::INT AS member_no, session_id, task_id, status, trajectory.status AS trajectory_status, trajectory.error AS error,
  trajectory.metadata.builder AS builder, trajectory.metadata.reconstruction_stats.chains_total AS chains_total, trajectory.metadata.reconstruction_stats.completions_total AS completions_total,
  trajectory.metadata.reconstruction_stats.completions_merged AS completions_merged, len(trajectory.traces)::INT AS n_traces, timing.init_ms AS init_ms, timing.run_ms AS run_ms, node_id
FROM pi_polar_task_status
UNION ALL SELECT 'body', body_id, member_no, {_text('$.session_id')}, {_text('$.task_id')}, {_text('$.status')}, {_text('$.trajectory.status')}, {_text('$.trajectory.error')},
  {_text('$.trajectory.metadata.builder')}, (m ->> '$.trajectory.metadata.reconstruction_stats.chains_total')::INT, (m ->> '$.trajectory.metadata.reconstruction_stats.completions_total')::INT,
  (m ->> '$.trajectory.metadata.reconstruction_stats.completions_merged')::INT,
  CASE WHEN json_type(m, '$.trajectory.traces') = 'ARRAY' THEN json_array_length(m, '$.trajectory.traces')::INT END,
  (m ->> '$.timing.init_ms')::DOUBLE, (m ->> '$.timing.run_ms')::DOUBLE, {_text('$.node_id')}
FROM members WHERE json_type(m) = 'OBJECT'""",
    "p1_traces": MEMBERS + f"""
SELECT 'row' AS origin, delivery_id AS record_id, 0::INT AS member_no, trace_no, coalesce(t.metadata.session_id, trajectory.metadata.session_id, session_id) AS session_id,
  t.metadata.task_id AS task_id, t.metadata.case_id AS case_id, t.metadata.timestep AS timestep, t.metadata.prompt_source AS prompt_source, t.finish_reason AS finish_reason,
  len(t.prompt_ids)::INT AS n_prompt, len(t.response_ids)::INT AS n_response, len(t.loss_mask)::INT AS n_mask FROM row_traces
UNION ALL SELECT 'body', body_id, member_no, trace_no, {_SESSION}, {_text('$.metadata.task_id', 't')}, {_text('$.metadata.case_id', 't')}, (t ->> '$.metadata.timestep')::INT,
  {_text('$.metadata.prompt_source', 't')}, {_text('$.finish_reason', 't')}, {', '.join(f"CASE WHEN json_type(t, '$.{c}') = 'ARRAY' THEN json_array_length(t, '$.{c}')::INT END" for c in ('prompt_ids', 'response_ids', 'loss_mask'))}
FROM body_traces""",
    "p1_completions": MEMBERS + f"""
SELECT 'row' AS origin, delivery_id AS record_id, 0::INT AS member_no, trace_no, (k - 1)::INT AS completion_no, c[k].session_id AS session_id, c[k].completion_id AS completion_id
FROM (SELECT *, t.metadata.completion_metadata AS c FROM row_traces), unnest(range(1, coalesce(len(c), 0) + 1)) AS u(k) WHERE c[k] IS NOT NULL
UNION ALL SELECT 'body', body_id, member_no, trace_no, (k - 1)::INT, {_text('$.session_id', 'c[k]')}, {_text('$.completion_id', 'c[k]')}
FROM (SELECT *, json_extract(t, '$.metadata.completion_metadata[*]') AS c FROM body_traces), unnest(range(1, len(c) + 1)) AS u(k) WHERE json_type(c[k]) = 'OBJECT'""",
    "p6_found": """
SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY session_id, task_id ORDER BY received_at, delivery_id) AS k FROM pi_polar_task_status WHERE session_id IS NOT NULL) WHERE k > 1""",
    "p6_kept": """
SELECT delivery_id, batch_id, epoch_us(received_at) AS received_us, session_id, task_id, status, coalesce(len(trajectory.traces), 0) AS n_traces FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, task_id ORDER BY received_at, delivery_id) AS k FROM pi_polar_task_status) WHERE k = 1 OR session_id IS NULL""",
    "p6_admitted": """
WITH t AS (SELECT delivery_id, batch_id, received_at, session_id, task_id, batch_id * 2 > max(batch_id) OVER () AS late FROM pi_polar_task_status),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id, task_id ORDER BY received_at, delivery_id) AS k FROM t WHERE late)
SELECT delivery_id, batch_id, epoch_us(received_at) AS received_us, session_id, task_id FROM k WHERE (k = 1 OR session_id IS NULL)
AND NOT EXISTS (SELECT 1 FROM t WHERE NOT late AND t.session_id = k.session_id AND t.task_id IS NOT DISTINCT FROM k.task_id)""",
}


def _token_sql(part: str) -> str:
    mask = "t.loss_mask[k]" if part == "response" else "NULL::INT"
    lp = "t.response_logprobs[k]" if part == "response" else "NULL::DOUBLE"
    bmask = "CASE WHEN json_type(lm[k]) IN ('UBIGINT', 'BIGINT') THEN lm[k]::INT END" if part == "response" else "NULL::INT"
    blp = "CASE WHEN json_type(lp[k]) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN lp[k]::DOUBLE END" if part == "response" else "NULL::DOUBLE"
    return f"""
SELECT 'row' AS origin, delivery_id AS record_id, 0::INT AS member_no, trace_no, '{part}' AS part, (k - 1)::INT AS pos, t.{part}_ids[k] AS token_id, {mask} AS mask, {lp} AS logprob
FROM row_traces, unnest(range(1, coalesce(len(t.{part}_ids), 0) + 1)) AS u(k)
UNION ALL SELECT 'body', body_id, member_no, trace_no, '{part}', (k - 1)::INT, CASE WHEN json_type(ids[k]) IN ('UBIGINT', 'BIGINT') THEN ids[k]::INT END, {bmask}, {blp}
FROM (SELECT *, json_extract(t, '$.{part}_ids[*]') AS ids, json_extract(t, '$.loss_mask[*]') AS lm, json_extract(t, '$.response_logprobs[*]') AS lp FROM body_traces), unnest(range(1, len(ids) + 1)) AS u(k)"""


def _message_sql(part: str) -> str:
    return f"""
SELECT 'row' AS origin, delivery_id AS record_id, 0::INT AS member_no, trace_no, '{part}' AS part, (k - 1)::INT AS message_no, m[k].role AS role, m[k].content AS content,
  m[k].tool_call_id AS tool_call_id, len(m[k].tool_calls)::INT AS n_tool_calls
FROM (SELECT *, t.{part}_messages AS m FROM row_traces), unnest(range(1, coalesce(len(m), 0) + 1)) AS u(k) WHERE m[k] IS NOT NULL
UNION ALL SELECT 'body', body_id, member_no, trace_no, '{part}', (k - 1)::INT, {_text('$.role', 'm[k]')}, {_text('$.content', 'm[k]')}, {_text('$.tool_call_id', 'm[k]')},
  CASE WHEN json_type(m[k], '$.tool_calls') = 'ARRAY' THEN json_array_length(m[k], '$.tool_calls')::INT END
FROM (SELECT body_id, member_no, trace_no, json_extract(t, '$.{part}_messages[*]') AS m FROM body_traces), unnest(range(1, len(m) + 1)) AS u(k) WHERE json_type(m[k]) = 'OBJECT'"""


def _call_sql(part: str) -> str:
    return f"""
SELECT 'row' AS origin, delivery_id AS record_id, 0::INT AS member_no, trace_no, '{part}' AS part, (k - 1)::INT AS message_no, (n - 1)::INT AS call_no, c[n].id AS call_id, c[n].type AS call_type,
  c[n].function.name AS name, c[n].function.arguments AS arguments
FROM (SELECT delivery_id, trace_no, k, m[k].tool_calls AS c FROM (SELECT *, t.{part}_messages AS m FROM row_traces), unnest(range(1, coalesce(len(m), 0) + 1)) AS u(k)), unnest(range(1, coalesce(len(c), 0) + 1)) AS w(n) WHERE c[n] IS NOT NULL
UNION ALL SELECT 'body', body_id, member_no, trace_no, '{part}', message_no, (n - 1)::INT, {_text('$.id', 'c[n]')}, {_text('$.type', 'c[n]')}, {_text('$.function.name', 'c[n]')}, {_text('$.function.arguments', 'c[n]')}
FROM {part}_calls, unnest(range(1, len(c) + 1)) AS w(n) WHERE json_type(c[n]) = 'OBJECT'"""


def _calls_cte(part: str) -> str:
    return f"""{part}_calls AS MATERIALIZED (SELECT body_id, member_no, trace_no, (k - 1)::INT AS message_no, json_extract(m[k], '$.tool_calls[*]') AS c
  FROM (SELECT body_id, member_no, trace_no, json_extract(t, '$.{part}_messages[*]') AS m FROM body_traces), unnest(range(1, len(m) + 1)) AS u(k))"""


for _name, _sql in (("p1_tokens", _token_sql), ("p1_messages", _message_sql)):
    ORACLE[_name] = MEMBERS + _sql("prompt") + "\nUNION ALL" + _sql("response")
ORACLE["p1_tool_calls"] = MEMBERS + f", {_calls_cte('prompt')}, {_calls_cte('response')}" + _call_sql("prompt") + "\nUNION ALL" + _call_sql("response")

"""Nested session results to related flat tables, by Arrow offsets and parent indices.

Every level is opened by two kernels: ``list_flatten`` gives the children of all rows as one
array, ``list_parent_indices`` gives the parent of each child, and the parents' keys follow by one
``take``. No row is visited; the ordinal of a child is its index less the start of its parent's list.

Defined results, for all tables: a null or empty list gives no child rows; a null element of
``traces`` (or of a message list) holds its position but gives no row; null members give null
columns; a table without rows gives an empty table; other columns of the input are ignored.
Repeated records are records of their own. Keys of a row: ``origin``, ``record_id``,
``member_no``, then ``trace_no``, then the ordinals below it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tracelode.schemas import SESSION_RESULT, ddl, prune

_KEY = "origin string, record_id bigint, member_no int"

#: Output schema of each flat table, and the members of a session result that it reads.
TABLES: dict[str, tuple[str, list[str]]] = {
    "sessions": (
        f"{_KEY}, session_id string, task_id string, status string, trajectory_status string, error string, builder string, "
        "chains_total int, completions_total int, completions_merged int, n_traces int, init_ms double, run_ms double, node_id string",
        ["session_id", "task_id", "status", "trajectory.status", "trajectory.error", "trajectory.metadata", "trajectory.traces.finish_reason", "timing", "node_id"],
    ),
    "traces": (
        f"{_KEY}, trace_no int, session_id string, task_id string, case_id string, timestep int, prompt_source string, finish_reason string, "
        "n_prompt int, n_response int, n_mask int",
        ["session_id", "trajectory.metadata.session_id", "trajectory.traces.prompt_ids", "trajectory.traces.response_ids", "trajectory.traces.loss_mask",
         "trajectory.traces.finish_reason", "trajectory.traces.metadata.session_id", "trajectory.traces.metadata.task_id", "trajectory.traces.metadata.case_id",
         "trajectory.traces.metadata.timestep", "trajectory.traces.metadata.prompt_source"],
    ),
    "trace_sessions": (
        f"{_KEY}, trace_no int, session_id string",
        ["session_id", "trajectory.metadata.session_id", "trajectory.traces.metadata.session_id"],
    ),
    "tokens": (
        f"{_KEY}, trace_no int, part string, pos int, token_id int, mask int, logprob double",
        ["trajectory.traces.prompt_ids", "trajectory.traces.response_ids", "trajectory.traces.loss_mask", "trajectory.traces.response_logprobs"],
    ),
    "messages": (
        f"{_KEY}, trace_no int, part string, message_no int, role string, content string, tool_call_id string, n_tool_calls int",
        ["trajectory.traces.prompt_messages", "trajectory.traces.response_messages"],
    ),
    "tool_calls": (
        f"{_KEY}, trace_no int, part string, message_no int, call_no int, call_id string, call_type string, name string, arguments string",
        ["trajectory.traces.prompt_messages.tool_calls", "trajectory.traces.response_messages.tool_calls"],
    ),
    "completions": (
        f"{_KEY}, trace_no int, completion_no int, session_id string, completion_id string",
        ["trajectory.traces.metadata.completion_metadata"],
    ),
}


def record_schema(table: str) -> T.StructType:
    """The part of a session result that ``table`` is made of; read the source with it."""
    return prune(SESSION_RESULT, TABLES[table][1])


# --- kernels ------------------------------------------------------------------------------------


def member(arr: pa.Array, *names: str) -> pa.Array:
    """The nested member of a struct array, null where any level is."""
    for n in names:
        arr = pc.struct_field(arr, n)
    return arr


def children(lists: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of a list array: the parent index, the ordinal and the value of each child."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parent = pc.list_parent_indices(lists)
    starts = np.cumsum(lengths) - lengths
    at = parent.to_numpy(zero_copy_only=False)
    return parent, pa.array((np.arange(len(at)) - starts[at]).astype(np.int32)), pc.list_flatten(lists)


def _lookup(lists: pa.Array, parent: np.ndarray, ordinal: np.ndarray) -> pa.Array:
    """Element ``ordinal`` of list ``parent`` for each pair, null where that list is shorter."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    ok = ordinal < lengths[parent] if len(parent) else np.zeros(0, bool)
    flat = pc.list_flatten(lists)
    return flat.take(pa.array(np.where(ok, starts[parent] + ordinal, 0) if len(parent) else np.zeros(0, np.int64), mask=~ok))


class Level:
    """Rows at one depth: the columns that lead back to the record, and a value array beside them."""

    def __init__(self, keys: dict[str, pa.Array], value: pa.Array | None):
        self.keys, self.value = keys, value

    def down(self, lists: pa.Array, ordinal: str) -> tuple[Level, pa.Array]:
        """The non-null children of ``lists`` with their ordinals; the parent index of each."""
        parent, at, value = children(lists)
        if value.null_count:
            keep = value.is_valid()
            parent, at, value = parent.filter(keep), at.filter(keep), value.filter(keep)
        return Level({k: v.take(parent) for k, v in self.keys.items()} | {ordinal: at}, value), parent


def _const(text: str, n: int) -> pa.Array:
    return pa.array([text], pa.string()).take(pa.array(np.zeros(n, np.int64)))


def _nulls(kind: pa.DataType, n: int) -> pa.Array:
    return pa.nulls(n, kind)


def _size(lists: pa.Array) -> pa.Array:
    return pc.list_value_length(lists).cast(pa.int32())


# --- tables -------------------------------------------------------------------------------------


def _traces(records: Level) -> tuple[Level, pa.Array]:
    return records.down(member(records.value, "trajectory", "traces"), "trace_no")


def _sessions(r: Level) -> Iterator[dict]:
    v, meta = r.value, member(r.value, "trajectory", "metadata")
    stats = member(meta, "reconstruction_stats")
    yield r.keys | {
        "session_id": member(v, "session_id"), "task_id": member(v, "task_id"), "status": member(v, "status"),
        "trajectory_status": member(v, "trajectory", "status"), "error": member(v, "trajectory", "error"), "builder": member(meta, "builder"),
        "chains_total": member(stats, "chains_total"), "completions_total": member(stats, "completions_total"), "completions_merged": member(stats, "completions_merged"),
        "n_traces": _size(member(v, "trajectory", "traces")), "init_ms": member(v, "timing", "init_ms"), "run_ms": member(v, "timing", "run_ms"), "node_id": member(v, "node_id"),
    }


def _session_of(r: Level, t: Level, parent: pa.Array) -> pa.Array:
    return pc.coalesce(member(t.value, "metadata", "session_id"), member(r.value, "trajectory", "metadata", "session_id").take(parent), member(r.value, "session_id").take(parent))


def _trace_sessions(r: Level) -> Iterator[dict]:
    t, parent = _traces(r)
    yield t.keys | {"session_id": _session_of(r, t, parent)}


def _trace_rows(r: Level) -> Iterator[dict]:
    t, parent = _traces(r)
    meta = member(t.value, "metadata")
    yield t.keys | {"session_id": _session_of(r, t, parent)} | {n: member(meta, n) for n in ("task_id", "case_id", "timestep", "prompt_source")} | {
        "finish_reason": member(t.value, "finish_reason"), "n_prompt": _size(member(t.value, "prompt_ids")),
        "n_response": _size(member(t.value, "response_ids")), "n_mask": _size(member(t.value, "loss_mask")),
    }


def _token_rows(r: Level) -> Iterator[dict]:
    t, _ = _traces(r)
    for part in ("prompt", "response"):
        ids = member(t.value, f"{part}_ids")
        parent, pos, token = children(ids)
        n, at, o = len(token), parent.to_numpy(zero_copy_only=False), pos.to_numpy(zero_copy_only=False)
        sampled = part == "response"
        yield {k: v.take(parent) for k, v in t.keys.items()} | {
            "part": _const(part, n), "pos": pos, "token_id": token,
            "mask": _lookup(member(t.value, "loss_mask"), at, o) if sampled else _nulls(pa.int32(), n),
            "logprob": _lookup(member(t.value, "response_logprobs"), at, o) if sampled else _nulls(pa.float64(), n),
        }


def _message_levels(r: Level) -> Iterator[Level]:
    t, _ = _traces(r)
    for part in ("prompt", "response"):
        m, _ = t.down(member(t.value, f"{part}_messages"), "message_no")
        m.keys["part"] = _const(part, len(m.value))
        yield m


def _message_rows(r: Level) -> Iterator[dict]:
    for m in _message_levels(r):
        yield m.keys | {n: member(m.value, n) for n in ("role", "content", "tool_call_id")} | {"n_tool_calls": _size(member(m.value, "tool_calls"))}


def _call_rows(r: Level) -> Iterator[dict]:
    for m in _message_levels(r):
        c, _ = m.down(member(m.value, "tool_calls"), "call_no")
        yield c.keys | {"call_id": member(c.value, "id"), "call_type": member(c.value, "type"), "name": member(c.value, "function", "name"), "arguments": member(c.value, "function", "arguments")}


def _completion_rows(r: Level) -> Iterator[dict]:
    t, _ = _traces(r)
    c, _ = t.down(member(t.value, "metadata", "completion_metadata"), "completion_no")
    yield c.keys | {"session_id": member(c.value, "session_id"), "completion_id": member(c.value, "completion_id")}


_ROWS: dict[str, Callable[[Level], Iterator[dict]]] = {
    "sessions": _sessions, "traces": _trace_rows, "trace_sessions": _trace_sessions, "tokens": _token_rows,
    "messages": _message_rows, "tool_calls": _call_rows, "completions": _completion_rows,
}


def _emit(table: str, level: Level, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for columns in _ROWS[table](level):
        yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


# --- sources of records -------------------------------------------------------------------------


def _fit(value, kind: T.DataType):
    """A JSON value as ``kind``; null where it is of another kind."""
    if isinstance(kind, T.StructType):
        return {f.name: _fit(value.get(f.name), f.dataType) for f in kind.fields} if isinstance(value, dict) else None
    if isinstance(kind, T.ArrayType):
        return [_fit(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(kind, T.StringType):
        return value.encode("utf-8", "replace").decode() if isinstance(value, str) else None
    if isinstance(kind, T.IntegerType):
        return value if type(value) is int and -(2**31) <= value < 2**31 else None
    if isinstance(kind, T.DoubleType) and type(value) in (int, float):
        try:
            return float(value)
        except OverflowError:
            return None
    return None


def members_of(body: str | None) -> list:
    """The session results in one wire body: its ``results``, the wrapped ``session_result``, or itself.

    A body that is null or isn't one whole JSON object has none. A member that isn't an object is
    None and holds its position.
    """
    try:
        whole = json.loads(body) if body else None
    except (ValueError, RecursionError):
        return []
    if not isinstance(whole, dict):
        return []
    if isinstance(whole.get("results"), list):
        return whole["results"]
    return [whole["session_result"] if isinstance(whole.get("session_result"), dict) else whole]


def flatten_rows(df: DataFrame, table: str, record_id: str = "delivery_id") -> DataFrame:
    """Flat ``table`` of the session results in ``df``, one per row; ``origin`` is ``row``."""
    out = ddl(TABLES[table][0])
    want, schema = record_schema(table), pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = {"origin": _const("row", b.num_rows), "record_id": b.column(0), "member_no": pa.array(np.zeros(b.num_rows, np.int32))}
            yield from _emit(table, Level(keys, b.column(1)), schema)

    have = {c.lower() for c in df.columns}
    record = F.struct(*[(F.col(f.name) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields])
    return df.select(F.col(record_id).cast("bigint").alias("record_id"), record.alias("record")).mapInArrow(run, out)


def flatten_bodies(df: DataFrame, table: str, body_id: str = "body_id", body: str = "body") -> DataFrame:
    """Flat ``table`` of the session results in the JSON texts of ``df``; ``origin`` is ``body``.

    The text is parsed once into a nested Arrow array, which the same kernels then open.
    """
    out = ddl(TABLES[table][0])
    want, schema = record_schema(table), pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])
    kind = to_arrow_type(want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                ids, no, values = [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for k, m in enumerate(members_of(text)):
                        if isinstance(m, dict):
                            ids.append(key)
                            no.append(k)
                            values.append(_fit(m, want))
                level = Level({"origin": _const("body", len(ids)), "record_id": pa.array(ids, pa.int64()), "member_no": pa.array(no, pa.int32())}, pa.array(values, kind))
                yield from _emit(table, level, schema)

    return df.select(F.col(body_id).cast("bigint").alias("body_id"), F.col(body).cast("string").alias("body")).mapInArrow(run, out)

"""Schemas of the engine's records and a pruner that keeps only the wanted nested members."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_ATOMS = {"string": T.StringType, "int": T.IntegerType, "bigint": T.LongType, "double": T.DoubleType, "boolean": T.BooleanType, "timestamp": T.TimestampType, "binary": T.BinaryType}


def ddl(text: str) -> T.DataType:
    """A type written as ``struct<a:int,b:array<string>>`` or as columns ``a int, b string``.

    Needs no session, so that executors can import the modules that use it.
    """
    tokens = re.findall(r"\w+|[<>,:]", text)
    at = 0

    def fields(end: str | None) -> T.StructType:
        nonlocal at
        out = []
        while at < len(tokens) and tokens[at] != end:
            name, at = tokens[at], at + 1
            at += tokens[at] == ":"
            out.append(T.StructField(name, kind()))
            at += at < len(tokens) and tokens[at] == ","
        at += end is not None
        return T.StructType(out)

    def kind() -> T.DataType:
        nonlocal at
        word, at = tokens[at], at + 1
        if word == "struct":
            at += 1
            return fields(">")
        if word == "array":
            at += 1
            inner = kind()
            at += 1
            return T.ArrayType(inner)
        return _ATOMS[word]()

    return kind() if tokens[0] in ("struct", "array") and tokens[1] == "<" else fields(None)


MESSAGE = ddl(
    "struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,"
    "function:struct<name:string,arguments:string>>>,tool_call_id:string>"
)

SESSION_RESULT = ddl(
    "session_id string, task_id string, status string, trajectory struct<status:string,error:string,"
    "metadata:struct<builder:string,session_id:string,reconstruction_stats:struct<chains_total:int,completions_total:int,completions_merged:int>>,"
    "traces:array<struct<prompt_ids:array<int>,response_ids:array<int>,loss_mask:array<int>,"
    f"prompt_messages:array<{MESSAGE.simpleString()}>,response_messages:array<{MESSAGE.simpleString()}>,"
    "finish_reason:string,response_logprobs:array<double>,"
    "metadata:struct<session_id:string,task_id:string,case_id:string,timestep:int,prompt_source:string,"
    "completion_metadata:array<struct<session_id:string,completion_id:string>>>>>>,"
    "timing struct<init_ms:double,run_ms:double>, node_id string"
)

DELIVERY = T.StructType(
    [T.StructField("delivery_id", T.LongType()), T.StructField("batch_id", T.LongType()), T.StructField("received_at", T.TimestampType())] + SESSION_RESULT.fields
)

BODY = T.StructType([T.StructField("body_id", T.LongType()), T.StructField("received_at", T.TimestampType()), T.StructField("body", T.StringType())])


def prune(schema: T.DataType, paths: list[str]) -> T.DataType:
    """``schema`` with only the members on ``paths`` (dotted; arrays are passed through).

    A path to a struct or array keeps all of it. Given to ``spark.read.schema``, it makes the
    Parquet scan skip every other nested column while null elements of arrays stay visible.
    """
    if isinstance(schema, T.ArrayType):
        return T.ArrayType(prune(schema.elementType, paths), schema.containsNull)
    if not isinstance(schema, T.StructType) or "" in paths:
        return schema
    fields = []
    for f in schema.fields:
        below = [p.partition(".")[2] for p in paths if p.partition(".")[0] == f.name]
        if below:
            fields.append(T.StructField(f.name, prune(f.dataType, below), f.nullable))
    return T.StructType(fields)

BODY = ddl("body_id bigint, received_at timestamp, body string")

import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tracelode.operators.nested import TABLES, flatten_bodies, flatten_rows, members_of
from tracelode.schemas import DELIVERY


def delivery(i, trajectory, session="s"):
    return (i, 1, None, session, "t", "COMPLETED", trajectory, None, None)


def trace(prompt=None, response=None, mask=None, sid=None, messages=None):
    meta = (sid, "t", "c", 1, "free", [("s", "c1"), None]) if sid is not False else None
    return (prompt, response, mask, messages, [("assistant", "a", [("id1", "function", ("f", "{}")), None], None), None], "stop", [0.5], meta)


def frame(spark):
    data = [
        delivery(1, ("OK", None, ("b", "meta", (1, 2, 3)), [trace([1, 2], [3, 4, 5], [1, 0], "own"), None, trace(None, [], None, None), trace([7], None, None, False)])),
        delivery(2, None), delivery(3, ("OK", None, None, None)), delivery(4, ("OK", None, None, [])), delivery(5, ("OK", None, None, [trace(sid=None)]), session=None),
        delivery(1, ("OK", None, None, [trace(sid="twice")])),
    ]
    return spark.createDataFrame(data, DELIVERY)


def test_session_of_a_trace(spark):
    df = frame(spark).withColumn("record", F.lit(1)).withColumn("origin", F.lit("x"))  # names of our own
    assert rows(flatten_rows(df, "trace_sessions")) == sorted([("row", 1, 0, 0, "own"), ("row", 1, 0, 2, "meta"), ("row", 1, 0, 3, "meta"), ("row", 5, 0, 0, None), ("row", 1, 0, 0, "twice")], key=repr)


def test_tokens_lead_back_and_align(spark):
    got = rows(flatten_rows(frame(spark).limit(1), "tokens"), "trace_no", "part", "pos", "token_id", "mask", "logprob")
    assert got == sorted([
        (0, "prompt", 0, 1, None, None), (0, "prompt", 1, 2, None, None), (0, "response", 0, 3, 1, 0.5), (0, "response", 1, 4, 0, None), (0, "response", 2, 5, None, None), (3, "prompt", 0, 7, None, None)], key=repr)


def test_messages_and_calls(spark):
    one = frame(spark).limit(1)
    assert rows(flatten_rows(one, "messages"), "trace_no", "message_no", "role", "n_tool_calls") == [(0, 0, "assistant", 2), (2, 0, "assistant", 2), (3, 0, "assistant", 2)]
    assert rows(flatten_rows(one, "tool_calls"), "trace_no", "message_no", "call_no", "call_id", "name") == [(0, 0, 0, "id1", "f"), (2, 0, 0, "id1", "f"), (3, 0, 0, "id1", "f")]


def test_sessions_keep_every_record(spark):
    assert sorted(r[0] for r in flatten_rows(frame(spark), "sessions").select("record_id").collect()) == [1, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("table", sorted(TABLES))
def test_empty_table(spark, table):
    empty = frame(spark).limit(0)
    assert flatten_rows(empty, table).count() == 0
    bodies = spark.createDataFrame([], "body_id bigint, body string")
    assert flatten_bodies(bodies, table).schema == flatten_rows(empty, table).schema
    assert flatten_bodies(bodies, table).count() == 0


def test_bodies(spark):
    result = {"session_id": "s", "trajectory": {"metadata": {"session_id": "m"}, "traces": [{"prompt_ids": [1, "x", True, 2**40]}, None, 5, {"metadata": {"session_id": 7}}]}}
    texts = [json.dumps(result), json.dumps({"results": [None, result, 3]}), json.dumps({"findings": [], "session_result": result}), json.dumps(result)[:-3], "[1]", "", None, json.dumps(result) + "x", "{}", json.dumps({"results": None, "trajectory": 1})]
    df = spark.createDataFrame(list(enumerate(texts)), "body_id bigint, body string")
    want = [("body", b, m, t, "m") for b, m in ((0, 0), (1, 1), (2, 0)) for t in (0, 3)]
    assert rows(flatten_bodies(df, "trace_sessions")) == want
    ids = flatten_bodies(df.where("body_id = 0"), "tokens").orderBy("pos").select("token_id").collect()
    assert [r[0] for r in ids] == [1, None, None, None]


def test_members_never_fail():
    for text in ("[" * 100_000, '{"a": NaN}', "nul", "{'a': 1}", '"x"', '{"results": []}'):
        members_of(text)
    assert members_of('{"results": []}') == [] and members_of('{"a": 1} {"b": 2}') == []


def test_against_plain_python(spark):
    """Random nesting, opened by loops."""
    import random

    rnd = random.Random(4)
    maybe = lambda f: f() if rnd.random() < 0.8 else None
    ids = lambda: [rnd.randrange(300) for _ in range(rnd.randrange(5))]
    data = [delivery(i, maybe(lambda: ("OK", None, None, maybe(lambda: [maybe(lambda: trace(maybe(ids), maybe(ids), maybe(ids), "s")) for _ in range(rnd.randrange(4))])))) for i in range(60)]
    want = []
    for d in data:
        for no, t in enumerate((d[6] and d[6][3]) or []):
            for part, values in (("prompt", t and t[0]), ("response", t and t[1])):
                for pos, v in enumerate(values or []):
                    mask = t[2][pos] if part == "response" and t[2] and pos < len(t[2]) else None
                    want.append((d[0], no, part, pos, v, mask))
    got = rows(flatten_rows(spark.createDataFrame(data, DELIVERY).repartition(3), "tokens"), "record_id", "trace_no", "part", "pos", "token_id", "mask")
    assert got == sorted(want, key=repr)

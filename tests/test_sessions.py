"""Session operators on small fixtures: nulls, empty tables, order."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tracelode.operators import gate as G
from tracelode.operators import sessions as S
from tracelode.schemas import SESSION_RESULT

MSG = "struct<role:string,content:string>"


def test_completion_filter(spark):
    log = spark.createDataFrame([("a", 1, [("system", "s"), ("user", "q")], [1]), ("a", 2, [("user", "q")], [1]), ("a", 3, [("user", "q"), ("user", "q")], [1]), ("a", 4, [("system", "s"), ("user", "q")], []), ("b", 5, None, None)], f"s string, n int, m array<{MSG}>, r array<int>")
    f = S.completion_filter(log, ["s"], F.col("m"), F.col("r"))
    assert rows(f, "n", "reason") == [(1, None), (2, "single_message"), (3, "no_system"), (4, "no_response"), (5, "single_message")]
    found = dict(rows(S.excluded_findings(f, ["s"], "n", "n")))
    assert found == {"a": "A12:completion_filter_excluded_nonempty:2,3,4", "b": "A12:completion_filter_excluded_nonempty:5"}
    assert S.excluded_findings(f.limit(0), ["s"], "n", "n").count() == 0


def test_leaks(spark):
    docs = spark.createDataFrame([(1, "see case_000001 and case_000002", "case_000001"), (2, None, "x"), (3, "case_000009 case_000002 case_000002", None)], "doc_id int, text string, case_id string")
    known = spark.createDataFrame([("case_000001",), ("case_000002",), (None,)], "case_id string")
    assert rows(S.leaks(docs, "doc_id", "text", "case_id", known, "case_[0-9]{6}")) == [(1, "case_000002"), (3, "case_000002")]


def test_request_diff(spark):
    r = spark.createDataFrame([(1, '{"a":1,"b":2}', '{"a":1}', '{"a":2,"c":null}'), (2, "x", None, "{}")], "k int, o string, t string, w string")
    got = rows(S.request_diff(r, "k", {"o": F.col("o"), "t": F.col("t"), "w": F.col("w")}))
    assert got == [(1, "a", "o,t,w", False), (1, "b", "o", True), (1, "c", "w", True)]


def test_refs(spark):
    lines = spark.createDataFrame([("a" * 40 + "\trefs/heads/timestep-12",), ("b" * 40 + " refs/tags/v1",), ("nonsense",), (None,)], "line string")
    assert rows(S.refs(lines, "line", r"^refs/heads/timestep-([0-9]+)$")) == [("refs/heads/timestep-12", "a" * 40, 12), ("refs/tags/v1", "b" * 40, None)]


def test_document(spark):
    d = S.document(spark.createDataFrame([(1, "x")], "k int, c string"), "k", {"c": F.col("c"), "n": {"m": [1, 2], "none": {}}, "t": True})
    assert rows(d) == [(1, '{"c":"x","n":{"m":[1,2]},"t":true}')]


BODY = '{"results":[{"session_id":"s1","status":"COMPLETED","trajectory":{"metadata":{"validation":{"findings":["X:1"]},"reconstruction_stats":{"chains_total":1,"completions_total":1,"completions_merged":1}},"traces":[%s]}},{"session_id":"s1","status":"FAILED","trajectory":{"traces":[]}}]}'
TRACE = '{"prompt_ids":[258],"response_ids":[7,8],"loss_mask":[1,%s],"response_logprobs":[-1,-2.5],"finish_reason":"stop","prompt_messages":[{"role":"system","content":"s"}],"metadata":{"timestep":1,"prompt_source":"free"%s}}'


@pytest.mark.parametrize("mask, more, want", [
    ("1", "", []), ("true", "", ["LP9:loss_mask_value_not_binary:first=1:count=1"]), ('"1"', "", ["LP9:loss_mask_value_not_binary:first=1:count=1"]), ("1.0", "", ["LP9:loss_mask_value_not_binary:first=1:count=1"]),
    ("1", ',"split":null', ["TR3:split_not_train_or_eval:None"]), ("1", ',"split":"train"', []), ("1", ',"reasoning_loss_mask":{"masked_tokens":12}', ["TR2:reasoning_loss_mask_masked_tokens:12"]), ("1", ',"reasoning_loss_mask":{"masked_tokens":"0"}', []),
])
def test_raw_gate(spark, mask, more, want):
    """Raw kinds tell; of a session's members the last counts; an envelope with an unfit member is refused whole."""
    import hashlib

    pins = G.Pins(system_prompts=[hashlib.sha256(b"s").hexdigest()], tails=[[258]])
    whole = BODY % (TRACE % (mask, more))
    first = whole.replace('"session_id":"s1","status":"FAILED"', '"session_id":"s2","status":"FAILED"')
    unfit = whole.replace('"session_id":"s1","status":"FAILED"', '"session_id":"../x","status":"FAILED"')
    df = spark.createDataFrame([(1, whole), (2, first), (3, unfit), (4, None), (5, "[]")], "body_id bigint, body string")
    got = {(r["body_id"], r["session_id"]): (r["disposition"], r["findings"]) for r in G.gate_bodies(df, pins).collect()}
    assert got[(1, "s1")] == ("quarantined", ["ADM1:status_not_completed:FAILED", "ADM4:no_traces", "G7:missing_evidence:reconstruction_stats"])
    assert got[(2, "s1")] == ("quarantined", ["ADM2:builder_findings_present:1", "X:1", *want]) and (2, "s2") in got
    assert got[(3, None)] == ("rejected", ["unsafe_session_id"]) and got[(4, None)] == got[(5, None)] == ("rejected", ["no_member"]) and len(got) == 6
    assert G.gate_bodies(df.limit(0), pins).count() == 0


def test_gate_order(spark):
    """Findings of a record come in the order of the checks, a null trace in its place."""
    trace = ([1], [2], [1], None, None, "abort", None, (None, None, None, None, "free", None))
    record = ("s", "t", "FAILED", ("x", None, ("b", "s", None), [None, trace]), None, None)
    df = spark.createDataFrame([record], SESSION_RESULT).withColumn("id", F.lit(1))
    got = G.gate(df, ["id"], G.Pins()).first()["findings"]
    assert got == ["ADM1:status_not_completed:FAILED", "G7:missing_evidence:reconstruction_stats", "ADM5:malformed_trace", "LP1:response_logprobs_absent", "TR1:finish_reason_not_allowed:abort", "G5:missing_evidence:timestep", "G2:missing_evidence:system_prompt", "G6:prompt_suffix_ne_tail_ids"]
    with pytest.raises(ValueError):
        G.Pins(cards=["x"] * (G.MAX_PINS + 1))

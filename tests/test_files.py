"""Loose files, comparisons and logged completions over small fixtures."""

import json

from pyspark.sql import functions as F

from conftest import rows
from tracelode.operators import analytics as A
from tracelode.operators import compare as K
from tracelode.operators import corpus as C
from tracelode.operators import trajectory as J
from tracelode.operators.nested import flatten_bodies
from tracelode.sources import files as S


def test_session_files(spark, tmp_path):
    result = {"session_id": "s", "trajectory": {"traces": [{"prompt_ids": [1]}]}}
    (tmp_path / "a.json").write_text(json.dumps(result, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"findings": ["x"], "session_result": result}))
    (tmp_path / "c.json").write_text("oops")
    got = flatten_bodies(S.session_files(spark, str(tmp_path)), "trace_sessions")
    assert [r["session_id"] for r in got.collect()] == ["s", "s"]


def test_logs_and_timings(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"tool": "a", "k": 5}\nbroken\n{"tool": "b"}\n')
    assert rows(S.json_lines(spark, str(tmp_path / "log.jsonl"), "tool string, k int")) == [("a", 5), ("b", None)]
    (tmp_path / "t.csv").write_text("attempt,exit,seconds\n1,0,7.5\n2,1,\n")
    assert rows(S.timings(spark, str(tmp_path / "t.csv"))) == [(1, 0, 7.5), (2, 1, None)]


def test_prompts(spark, tmp_path):
    def put(case, entries):
        p = tmp_path / f"train/cases/{case}/timestep-1/prompts.yaml"
        p.parent.mkdir(parents=True)
        p.write_bytes(entries if isinstance(entries, bytes) else json.dumps({"prompts": entries}).encode())  # JSON is YAML

    skill = {"id": "skill:s", "source": "skill", "name": "s"}
    free = {"id": "free:q", "source": "free", "text": "why?"}
    put("a", [skill, free, free, free | {"id": "free:a b"}, free | {"text": ""}, {"id": "skill:u", "source": "skill", "name": "u"}, skill | {"x": 1}, 5, skill | {"id": "skill:t"}, {"source": "odd"}])
    put("b", b"prompts: [")
    put("c", b" \n")
    put("d", b"- 1")
    put("e", b"\xff\xfe")
    got = S.prompt_rows(C.tree_files(spark, str(tmp_path)), ["s"])
    assert rows(got.where("finding IS NULL"), "case_id", "prompt_id", "name", "text") == [("a", "free:q", None, "why?"), ("a", "skill:s", "s", None)]
    assert rows(got.where("finding IS NOT NULL"), "case_id", "finding") == [
        ("a", "duplicate_id:2"), ("a", "empty_text:4"), ("a", "id:3"), ("a", "id:8"), ("a", "members:6"), ("a", "source:7"), ("a", "source:9"), ("a", "unknown_skill:5"), ("b", "not_a_document"), ("d", "not_a_list_of_prompts"), ("e", "not_utf8")]


def test_manifest(spark):
    good = {"name": "n", "owner": "org", "git": {"name": "a", "email": "b", "date": "c"}, "sandbox_image": "i"}
    read = lambda v, **k: S.manifest(json.dumps(v).encode(), ["org"], **k)
    assert read(good) == (good, [])
    bad, found = read(good | {"owner": "me", "x": 1, "name": "", "sandbox_image": 5, "git": {"name": "a"}})
    assert bad is None and {k for k, _ in found} == {"owner", "x", "name", "sandbox_image", "git"}
    assert read(good, more={"host": dict})[1] == [("host", "missing")] and read(good | {"host": {"a": 1}}, more={"host": dict})[1] == []
    assert S.manifest(b"\xff", [])[1] == [("manifest", "not UTF-8")] and S.manifest(b"a: [", [])[1] == [("manifest", "can't be parsed")] and S.manifest(b"[1]", [])[0] is None and S.manifest(b"{}", [])[0] is None
    assert rows(S.findings_frame(spark, [("a", "b")])) == [("manifest", "a", "b")] and S.findings_frame(spark, []).count() == 0


def test_comparisons(spark):
    a = spark.createDataFrame([(0, "x"), (0, "x"), (1, None), (2, "z")], "n int, v string")
    b = spark.createDataFrame([(0, "x"), (1, None), (3, "w"), (3, "w")], "n int, v string")
    assert rows(K.bag_diff(a, b)) == [("a", 0, "x"), ("a", 2, "z"), ("b", 3, "w"), ("b", 3, "w")]
    assert rows(K.list_diff(a.distinct(), b.distinct(), "n")) == [(2, False, True), (3, True, False)]
    assert rows(K.census_diff(a.distinct(), b.distinct().withColumn("v", F.coalesce("v", F.lit("new"))), "n", ["v"])) == [(1, "differs:v"), (2, "not_wanted"), (3, "not_served")]


def test_member_diff(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": [1, 2], "c": null}', '{"b": [2, 1], "a": 1.0, "d": 0}'), (2, '{"x": {"p": 1, "q": 2}}', '{"x": {"q": 2, "p": 1}}'), (3, "oops", None), (4, None, '{"k": 1}')], "k int, a string, b string")
    assert rows(K.member_diff(df, "k", F.col("a"), F.col("b"))) == [(1, "a", "changed"), (1, "b", "changed"), (1, "c", "only_a"), (1, "d", "only_b"), (4, "k", "only_b")]


def test_prefix_census(spark):
    pages = spark.createDataFrame([("c", 1), ("c", 1), ("c", 2), ("c", 4), ("c", 0)], "case_id string, page int")
    steps = spark.createDataFrame([("c", 2), ("c", 3), ("c", 4), ("d", 1)], "case_id string, timestep bigint")
    assert rows(K.prefix_census(pages, steps)) == [("c", 2, 2, True), ("c", 3, 2, False), ("c", 4, 3, False), ("d", 1, 0, False)]


def test_units(spark):
    lp = "array<struct<token_id:int,logprob:double>>"
    schema = f"s string, seq int, completion_id string, response struct<prompt_ids:array<int>,choices:array<struct<input_token_ids:array<int>,prompt_token_ids:array<int>,token_ids:array<int>,finish_reason:string,logprobs:{lp}>>>"
    data = [
        ("a", 0, "c0", ([9], [([1], [2], [5, 6], "stop", [(5, -1.0), (6, -2.0)])])), ("a", 1, "c1", ([9], [(None, [2], None, "length", [(7, -1.0)])])),
        ("a", 2, "c2", ([9], [(None, None, [5], None, [(5, -1.0), (6, -1.0)])])), ("a", 3, "c3", (None, [])), ("a", 4, "c4", None),
    ]
    got = rows(J.units(spark.createDataFrame(data, schema), ["s"]), "seq", "prompt_ids", "response_ids", "logprobs", "finish_reason", "n_choices")
    assert got == [(0, [1], [5, 6], [-1.0, -2.0], "stop", 1), (1, [2], [7], [-1.0], "length", 1), (2, [9], [5], None, None, 1), (3, [], [], None, None, 0), (4, [], [], None, None, 0)]


def test_log_findings(spark):
    data = [("a", 0, "c0", 1, True, "[]", 1), ("a", 1, "c1", 2, True, '["t"]', 1), ("a", 2, "c2", 1, None, "[]", None), ("b", 0, "c0", 1, True, None, None), ("b", 1, "c1", 1, True, None, None)]
    df = spark.createDataFrame(data, "s string, seq int, completion_id string, n_choices int, agent_shaped boolean, roster string, policy int")
    assert rows(J.log_findings(df, ["s"])) == [("a", "A12:non_agent_shape:c2"), ("a", "R11:roster_changed_across_completions"), ("a", "S8:choices_len_ne_1:c1:2"), ("a", "S9:policy_version_mixed:1,None")]
    assert rows(J.log_findings(df.where("s = 'b'"), ["s"], None)) == [("b", "A15:end_of_turn_token_id_not_configured")]
    assert rows(J.aborted(spark.createDataFrame([("a", "abort"), ("a", "abort"), ("b", "stop"), ("c", None)], "s string, finish_reason string"), ["s"])) == [("a",)]


def test_marked_tokens(spark):
    df = spark.createDataFrame([(1, [5, 9, 5, 8, 9, 5], [1, 1, 0, 1, 0, 1]), (1, [5, 9, 5, 8, 9, 5], [1, 1, 0, 1, 0, 1]), (2, None, None)], "trace_id int, response_ids array<int>, loss_mask array<int>")
    assert rows(A.marked_tokens(df, 9, 8)) == [(1, 2, 5, 3, 0.75), (2, 0, 0, 0, 0.0)]


def test_opening_kinds(spark):
    df = spark.createDataFrame([(1, [1, 2], [3, 7, 7, 4], [1, 0, 0, 1]), (2, None, [5], [1]), (3, [2], None, None)], "k int, prompt_ids array<int>, response_ids array<int>, loss_mask array<int>")
    assert rows(A.opening_kinds(df, ["k"], {"long": [7, 7], "short": [2]})) == [(1, "long", 1), (1, "short", 1), (2, "other", 1)]


def test_sinks(spark, tmp_path):
    from tracelode.sources import sinks as W

    df = spark.createDataFrame([(1, "accepted", [], ("s", None)), (2, "quarantined", ["x"], ("t", 5))], "k int, disposition string, findings array<string>, r struct<session_id:string,n:int>")
    for _ in range(2):
        W.write_dispositions(df, str(tmp_path / "d"))
    assert rows(spark.read.parquet(str(tmp_path / "d")).where("disposition = 'accepted'"), "k") == [(1,)]
    W.write_sessions(df.select("r.*"), str(tmp_path / "s"))
    assert rows(spark.read.text(str(tmp_path / "s"))) == [('{"session_id":"s"}',), ('{"session_id":"t","n":5}',)]
    wrapped = W.quarantine(df.where("k = 2"), "r", "findings").first()["body"]
    assert json.loads(wrapped) == {"findings": ["x"], "session_result": {"session_id": "t", "n": 5}}
    assert json.loads(W.report(W.totals(df, "disposition"), "r")) == {"name": "r", "rows": [{"disposition": "accepted", "n": 1}, {"disposition": "quarantined", "n": 1}]}


def test_small_functions(spark):
    from tracelode.functions import text as X

    one = lambda t, f: spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("x")).first()[0]
    assert one("ab abc", lambda c: X.redact(c, ["ab", "abc", ""])) == "*** ***"
    assert tuple(one("aXbXX", lambda c: X.substitute(c, "X", "yy"))) == ("ayybyyyy", 3)
    for u, port in (("http://h:81/x", 81), ("https://h/x:9", 443), ("http://h", 80), ("h:5", None)):
        assert one(u, X.url_port) == port
    assert [one(u, X.api_root) for u in ("http://h/v1", "http://h/v1/", "http://h/v12", None)] == [True, True, False, False]
    facts = one("x\nFACT-case_1-0004-2: A holds B.\r\nFACT-bad: no\nFACT-c-0001-1: ", X.facts)
    assert [tuple(f) for f in facts] == [("case_1", 4, 2, "A holds B."), ("c", 1, 1, "")]


def test_message_ids(spark):
    from tracelode.functions import text as X

    msg = "array<struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,tool_call_id:string>>"
    df = spark.createDataFrame([([("system", "é", None, None), None, ("user", '{"type": "text", "text": "q"}', None, None), ("assistant", None, [("i", "function", ("f", "{}"))], None), ("odd", "x", None, None)],), (None,), ([],)], f"m {msg}")
    got = [r[0] for r in df.select(X.message_ids(F.col("m"))).collect()]
    assert got == [[256, 195, 169, 260, 257, 113, 260, 258, 123, 125, 260, 120, 260, 258], [258], [258]]


def test_corpus_helpers(spark):
    import pytest

    rows_ = spark.createDataFrame([("a", "train"), ("b", "eval"), ("c", None)], "case_id string, split string")
    assert rows(C.only(rows_, ["a"])) == [("a", "train")]
    with pytest.raises(ValueError):
        C.only(rows_, ["a", "z"])
    assert rows(C.split_mismatch(rows_, spark.createDataFrame([("a", "train"), ("b", "train")], "case_id string, split string"))) == [("b", "split:eval!=train"), ("c", "not_locked")]
    src = spark.createDataFrame([("a", "t", 1, "x"), ("a", "t", 2, "y"), ("a", "t", 3, "z")], "case_id string, branch string, page int, sha256 string")
    clone = spark.createDataFrame([("a", "t", 1, "x"), ("a", "t", 2, "n"), ("a", "t", 4, "q")], "case_id string, branch string, page int, sha256 string")
    assert rows(C.page_diff(src, clone), "page", "finding") == [(2, "differs"), (3, "missing"), (4, "extra")]
    req = spark.createDataFrame([([("system",), ("user",)], [1], ["stream"]), ([("user",), ("user",)], [1], ["stream"]), ([("system",), ("user",)], [], ["stream"]), ([("system",), ("user",)], [1], ["x"]), (None, None, None)], "m array<struct<role:string>>, t array<int>, k array<string>")
    assert [r[0] for r in req.select(C.agent_shaped(F.col("m"), F.col("t"), F.col("k"))).collect()] == [True, False, False, False, False]


def test_embedding(spark):
    import numpy as np

    from tracelode.operators import retrieval as R

    df = spark.createDataFrame([(1, "aa"), (2, None), (3, "b")], "k int, t string")
    got = dict(rows(R.embed(df, "k", "t", lambda texts: np.array([[len(t), 1.0] for t in texts]), batch=2)))
    assert np.allclose(got[1], [2 / 5**0.5, 1 / 5**0.5]) and np.allclose(got[2], [0, 1])
    hits = spark.createDataFrame([(3, 0.5), (9, 0.1)], "k int, score double")
    assert rows(R.attach_pages(hits, df.withColumnRenamed("t", "text"), ["k"])) == [(3, 0.5, "b"), (9, 0.1, None)]

"""One doctored trace for each rule: the findings are exactly those."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tracelode.operators import envelopes as E
from tracelode.operators import rules as R

NAN, INF = float("nan"), float("inf")


def findings(spark, schema, values, expr):
    return spark.createDataFrame([values], schema).select(expr.alias("f")).first()[0]


LP = "r array<int>, m array<int>, lp array<double>"


@pytest.mark.parametrize("r, m, lp, want", [
    ([1, 2], [1, 0], [-1.0, -1.0], []),
    ([1, 2], [1, 0], None, ["LP1:response_logprobs_absent"]),
    ([1, 2], [0, 0], None, []),
    ([1, 2], None, None, ["LP7:empty_loss_mask", "LP1:response_logprobs_absent"]),
    ([1, 2], [1], [-1.0, -1.0], ["LP8:loss_mask_length_ne_response_ids:1!=2"]),
    ([1, 2], [1, 0], [-1.0], ["LP2:response_logprobs_length_ne_response_ids:1!=2"]),
    ([1, 2], [1, 2], [-1.0, -1.0], ["LP9:loss_mask_value_not_binary:first=1:count=1"]),
    ([1, 2, 3], [0, 1, 1], [-9999.0, -9000.0, -9999.0], ["LP3:sentinel_logprob_at_mask1:first=1:count=2"]),
    ([1, 2, 3], [0, 0, 1], [NAN, -INF, -1.0], ["LP4:nonfinite_logprob:first=0:count=2"]),
    ([1, 2], [0, 1], [0.5, -1.0], ["LP5:positive_logprob:first=0:count=1"]),
    ([1, 2, 3], [1, 1, 1], [0.0, -1.0, -1.0], ["LP6:zero_logprob_rate_at_mask1:1/3>0.25"]),
    ([1, 2, 3, 4], [1, 1, 1, 1], [0.0, -1.0, -1.0, -1.0], []),
    (None, None, None, []),
])
def test_logprobs(spark, r, m, lp, want):
    assert findings(spark, LP, (r, m, lp), R.logprob_rules(F.col("r"), F.col("m"), F.col("lp"))) == want


@pytest.mark.parametrize("p, r, m, want", [
    ([1, 258], [5, 260, 258, 6], [1, 0, 0, 1], []),
    ([1], [5], [1], ["G6:prompt_suffix_ne_tail_ids"]),
    ([258], [5, 260, 6, 260, 7], [1, 0, 1, 0, 1], ["G6:interstitial_ne_tail_ids:first=2:count=2"]),
    ([1], [5, 260, 6], [1, 0, 1], ["G6:prompt_suffix_ne_tail_ids", "G6:interstitial_ne_tail_ids:first=2:count=1"]),
    ([258], [5], [0], ["G6:missing_evidence:turns"]),
    (None, None, None, ["G6:missing_evidence:turns"]),
])
def test_tails(spark, p, r, m, want):
    assert findings(spark, "p array<int>, r array<int>, m array<int>", (p, r, m), R.tail_rules(F.col("p"), F.col("r"), F.col("m"), [[258]])) == want


def test_no_approved_tail_never_passes(spark):
    assert findings(spark, "p array<int>, r array<int>, m array<int>", ([258], [1], [1]), R.tail_rules(F.col("p"), F.col("r"), F.col("m"), [])) == ["G6:prompt_suffix_ne_tail_ids"]


@pytest.mark.parametrize("stats, want", [
    ((1, 2, 2), []), (None, ["G7:missing_evidence:reconstruction_stats"]), ((1, None, 2), ["G7:missing_evidence:reconstruction_stats.completions_total"]),
    ((2, 3, 1), ["G7:chains_total_ne_1:2", "G7:completions_merged_ne_total:1!=3"]),
])
def test_chain_snapshot(spark, stats, want):
    assert findings(spark, "s struct<chains_total:int,completions_total:int,completions_merged:int>", (stats,), R.chain_rules(F.col("s"))) == want


@pytest.mark.parametrize("status, trajectory, want", [
    ("COMPLETED", ([("a",)],), []), (None, ([("a",)],), ["ADM1:status_not_completed:None"]), ("ERROR", None, ["ADM1:status_not_completed:ERROR", "ADM3:trajectory_missing"]),
    ("COMPLETED", ([],), ["ADM4:no_traces"]), ("COMPLETED", (None,), ["ADM4:no_traces"]), ("COMPLETED", ([None, ("a",), None],), ["ADM5:malformed_trace"] * 2),
])
def test_admission(spark, status, trajectory, want):
    assert findings(spark, "status string, t struct<traces:array<struct<x:string>>>", (status, trajectory), R.admission_rules(F.col("status"), F.col("t"))) == want


@pytest.mark.parametrize("reason, split, want", [
    ("stop", "train", []), ("abort", None, ["TR1:finish_reason_not_allowed:abort"]), (None, "test", ["TR1:finish_reason_not_allowed:None", "TR3:split_not_train_or_eval:test"]),
])
def test_tripwires(spark, reason, split, want):
    assert findings(spark, "f string, s string", (reason, split), R.tripwire_rules(F.col("f"), F.col("s"))) == want


@pytest.mark.parametrize("source, card, want", [
    ("free", None, []), ("skill:x", "ok", []), ("skill:x", "no", ["G1:skill_card_hash_not_approved:no"]), ("skill:x", None, ["G1:missing_evidence:skill_card_hash"]),
    ("skill: ", "ok", ["G1:missing_evidence:prompt_source"]), (None, "ok", ["G1:missing_evidence:prompt_source"]),
])
def test_prompt_sources(spark, source, card, want):
    assert findings(spark, "s string, c string", (source, card), R.source_rules(F.col("s"), F.col("c"), ["ok"])) == want


WS = "w struct<shallow:boolean,remotes:int,branch:string,pages:struct<min:int,max:int,count:int>>, t int"


@pytest.mark.parametrize("w, t, want", [
    ((True, 0, "timestep-3", (1, 3, 3)), 3, []), (None, 3, ["G5:missing_evidence:workspace"]), ((True, 0, "timestep-3", (None, 3, 3)), 3, ["G5:missing_evidence:workspace.pages"]),
    ((False, 1, "timestep-3", (1, 3, 3)), 3, ["G5:checkout_history_posture:shallow=False,remotes=1"]), ((True, 0, "timestep-3", (1, 3, 2)), 3, ["G5:checkout_pages_not_contiguous:1-3/2"]),
    ((True, 0, None, (1, 4, 4)), 3, ["G5:workspace_branch_ne_timestep:None!=timestep-3", "G5:checkout_max_page_ne_timestep:4!=3"]), ((True, 0, "x", (1, 4, 4)), None, []),
])
def test_workspace(spark, w, t, want):
    assert findings(spark, WS, (w, t), R.workspace_rules(F.col("w"), F.col("t"))) == want


MSG = "array<struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,tool_call_id:string>>"


def call(i, name):
    return (i, "function", (name, "{}"))


def test_cutoff_follows_the_calls(spark):
    messages = [
        ("assistant", None, [call("a", "x_search_case"), call("b", "x_other")], None), ("tool", '[{"page": 9}, {"page": 2}]', None, "a"), ("tool", '[{"page": 50}]', None, "b"),
        ("tool", '[{"page": 60}]', None, "zzz"), ("assistant", None, [call("a", "x_other")], None), ("tool", '[{"page": 70}]', None, "a"),  # the last call of an id names it
        ("assistant", "see", [call("c", "x_search_case")], None), ("tool", "md/page_0008.md", None, "c"), None,
    ]
    df = spark.createDataFrame([(1, 5, None, messages), (2, None, None, messages), (3, None, None, None)], f"trace_id int, timestep int, prompt_messages {MSG}, response_messages {MSG}")
    t = R.with_tool_results(df)
    got = rows(R.explode_findings(t, ["trace_id"], R.cutoff_rules(F.col("timestep"), F.col("results"))), "trace_id", "rule_ord", "finding")
    assert got == [(1, 0, "G5:search_page_gt_timestep:8>5"), (1, 1, "G5:search_page_gt_timestep:9>5"), (2, 0, "G5:missing_evidence:timestep"), (3, 0, "G5:missing_evidence:timestep")]


def test_timestep_from_a_status_result(spark):
    messages = [("assistant", None, [call("a", "x_case_status"), call("b", "x_search_case")], None), ("tool", '{"timestep": 4}', None, "a"), ("tool", '{"page": 6}', None, "b")]
    df = R.with_tool_results(spark.createDataFrame([(1, None, None, messages)], f"trace_id int, timestep int, prompt_messages {MSG}, response_messages {MSG}"))
    assert df.select(R.cutoff_rules(F.col("timestep"), F.col("results"))).first()[0] == ["G5:search_page_gt_timestep:6>4"]


def test_system_prompts(spark):
    df = spark.createDataFrame([(1, [("system", "good", None, None)]), (2, [("system", "bad", None, None)]), (3, [("user", "x", None, None)]), (4, None)], f"trace_id int, prompt_messages {MSG}").withColumn("response_messages", F.col("prompt_messages"))
    approved = R.system_prompts(df.where("trace_id = 1"), "trace_id")
    got = dict(tuple(r) for r in R.prompt_gate(df, "trace_id", approved).collect())
    assert set(got) == {2, 3, 4} and got[2].startswith("G2:system_prompt_hash_not_approved:") and got[3] == got[4] == "G2:missing_evidence:system_prompt"


def test_toolless(spark):
    armed = R.Policy(reject_toolless=True)
    df = spark.createDataFrame([([1], [("assistant", "x", None, None)])], f"tools array<int>, m {MSG}")
    assert df.select(R.toolless_rules(F.col("tools"), F.col("m"), armed)).first()[0] == [R.H41]
    assert df.select(R.toolless_rules(F.col("tools"), F.col("m"))).first()[0] == []


def test_raw_masks(spark):
    df = spark.createDataFrame([(1, "[0, 1]"), (2, '[0, true, "1", 1.0, 2, null]'), (3, "oops"), (4, None)], "k int, mask string")
    assert rows(R.raw_mask_findings(df, "k", "mask")) == [(2, "LP9:loss_mask_value_not_binary:first=1:count=5")]


def test_raw_masks_of_every_member_and_trace(spark, tmp_path):
    from tracelode.plans.trace_queries import raw_mask_gate

    member = lambda *masks: '{"trajectory": {"traces": [' + ", ".join(f'{{"loss_mask": {m}}}' for m in masks) + "]}}"
    texts = [member("[0, 1]", "[1, true]"), f'{{"results": [{member("[0]")}, 5, {member("[1]", "null", "[1.0, 0]")}]}}', f'{{"session_result": {member('["1"]')}}}', '{"trajectory": {"traces": [null, {}, 3]}}', "oops", None]
    spark.createDataFrame(list(enumerate(texts)), "body_id int, body string").write.parquet(f"{tmp_path}/wire_bodies.parquet")
    said = "LP9:loss_mask_value_not_binary:first={}:count=1"
    assert rows(raw_mask_gate(spark, str(tmp_path))) == [(0, 0, 1, said.format(1)), (1, 2, 2, said.format(0)), (2, 0, 0, said.format(0))]


def test_divergence_in_any_trace(spark, tmp_path):
    import duckdb

    from tracelode.plans import trace_queries as Q
    from tracelode.schemas import DELIVERY

    def delivery(n, session, *traces):
        return {"delivery_id": n, "session_id": session, "trajectory": None if traces == (None,) else {"traces": [t and {"response_ids": t} for t in traces]}}

    data = [delivery(0, "s", None), delivery(1, "s", [1, 2], [3, 4]), delivery(2, "s", [1, 2], [3, 5]), delivery(3, "s", [1, 2], [3, 4], [6]), delivery(4, "s", [1, 2]), delivery(5, "s", None, [3, 4]), delivery(6, "t", [1]), delivery(7, None, [1])]
    spark.createDataFrame([tuple(d.get(f.name) for f in DELIVERY.fields) for d in data], DELIVERY).write.parquet(f"{tmp_path}/pi_polar_task_status.parquet")
    want = [("s", 2, 0, None), ("s", 2, 1, 1), ("s", 3, 0, None), ("s", 3, 1, None), ("s", 3, 2, 0), ("s", 4, 0, None), ("s", 4, 1, 0), ("s", 5, 0, 0), ("s", 5, 1, None)]
    assert rows(Q.delivery_divergence_traces(spark, str(tmp_path))) == sorted(want, key=repr)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pi_polar_task_status AS SELECT * FROM read_parquet('{tmp_path}/pi_polar_task_status.parquet/*.parquet')")
    assert sorted(c.execute(Q.ORACLE["delivery_divergence_traces"]).fetchall(), key=repr) == sorted(want, key=repr)


def test_redeliveries_of_other_trajectories_and_null_tasks(spark, tmp_path):
    from tracelode.plans.trace_queries import redelivery_changes
    from tracelode.schemas import DELIVERY

    def delivery(n, task, ids, status="COMPLETED"):
        return {"delivery_id": n, "session_id": "s", "task_id": task, "status": status, "trajectory": ids and {"traces": [{"response_ids": ids}]}}

    data = [delivery(0, "t", [1, 2]), delivery(1, "t", [1, 2]), delivery(2, "t", [1, 3]), delivery(3, "t", None), delivery(4, None, [1]), delivery(5, None, [1], "FAILED"), delivery(6, "u", None), delivery(7, "u", [1])]
    spark.createDataFrame([tuple(d.get(f.name) for f in DELIVERY.fields) for d in data], DELIVERY).write.parquet(f"{tmp_path}/pi_polar_task_status.parquet")
    assert rows(redelivery_changes(spark, str(tmp_path))) == [(2, "trajectory", "changed"), (3, "trajectory", "only_a"), (5, "status", "changed"), (7, "trajectory", "only_b")]


def test_any_number_of_approved_cards(spark, tmp_path):
    from tracelode.plans.trace_queries import prompt_source_gate
    from tracelode.schemas import DELIVERY

    n = 10_500
    tasks = spark.range(n + 2).selectExpr("'t' || id AS task_id", f"CASE WHEN id < {n} THEN 'image-r5' ELSE 'image-r4' END AS sandbox_image", f"CASE WHEN id <= {n} THEN 'card ' || id END AS skill_card_text")
    tasks.write.parquet(f"{tmp_path}/tasks.parquet")
    delivery = {"delivery_id": 1, "trajectory": {"traces": [{"metadata": {"task_id": f"t{i}", "prompt_source": "skill:x"}} for i in range(n + 3)]}}
    spark.createDataFrame([tuple(delivery.get(f.name) for f in DELIVERY.fields)], DELIVERY).write.parquet(f"{tmp_path}/pi_polar_task_status.parquet")
    got = [(r.trace_no, r.finding[: len(R.G1_NOT_APPROVED)]) for r in prompt_source_gate(spark, str(tmp_path)).orderBy("trace_no").collect()]
    assert got == [(n, R.G1_NOT_APPROVED), (n + 1, R.G1_CARD[: len(R.G1_NOT_APPROVED)]), (n + 2, R.G1_CARD[: len(R.G1_NOT_APPROVED)])]


def test_envelopes(spark):
    ok = '{"session_id": "s", "trajectory": {}}'
    texts = [ok, f'{{"results": [{ok}, {ok}]}}', f'{{"results": [{ok}, 5]}}', '{"session_id": "../x", "trajectory": {}}', '{"session_id": "s"}', "oops", None]
    df = spark.createDataFrame(list(enumerate(texts)), "body_id int, body string")
    assert rows(E.screen(df), "body_id", "member_no", "reason") == sorted([(0, 0, None), (1, 0, None), (1, 1, None), (2, 0, None), (2, 1, "not_an_object"), (3, 0, "unsafe_session_id"), (4, 0, "no_trajectory"), (5, -1, "no_member"), (6, -1, "no_member")], key=repr)
    assert rows(E.accepted_members(df)) == [(0, 0, "s"), (1, 1, "s")]
    assert E.screen(df.limit(0)).count() == 0


def test_rosters_and_settings(spark):
    import hashlib

    ok = hashlib.sha256(b'[{"a":1}]').hexdigest()
    df = spark.createDataFrame([('[{"a": 1}]',), ('[{"a": 1.0}]',), ("[]",), ("{}",), (None,), ("[NaN]",)], "t string")
    got = [r[0] for r in df.select(R.roster_rules(F.col("t"), [ok])).collect()]
    assert got[0] == [] and got[1][0].startswith(R.G3_NOT_APPROVED + ":") and got[2] == got[3] == got[4] == [R.G3_MISSING] and got[5] == [R.G3_NOT_APPROVED + ":unhashable"]
    good = hashlib.sha256(b'{"k":true}').hexdigest()
    df = spark.createDataFrame([('{"k": true}',), ("{}",), ("[1]",), ('{"k": 1}',)], "t string")
    got = [r[0] for r in df.select(R.settings_rules(F.col("t"), [good])).collect()]
    assert got[0] == [] and got[1] == got[2] == [R.G7_SETTINGS] and got[3][0].startswith(R.G7_SETTINGS_NOT_APPROVED + ":")


def test_full_chain_snapshot(spark):
    schema = "s struct<chains_total:int,chains_reconstructed_truncated:int,completions_total:int,completions_merged:int,raw_completions_total:int>"
    for stats, want in (((1, 0, 2, 2, 2), []), ((1, 1, 2, 2, 3), ["G7:chains_truncated:1", "G7:raw_completions_ne_total:3!=2"]), ((1, None, 2, 2, 2), ["G7:missing_evidence:reconstruction_stats.chains_reconstructed_truncated"])):
        assert findings(spark, schema, (stats,), R.chain_rules(F.col("s"), full=True)) == want


def test_builder_findings_and_reasoning(spark):
    for f, want in ((["a", "b"], ["ADM2:builder_findings_present:2", "a", "b"]), ([], []), (None, [])):
        assert findings(spark, "f array<string>", (f,), R.builder_rules(F.col("f"))) == want
    for m, want in (("3", ["TR2:reasoning_loss_mask_masked_tokens:3"]), ("0", []), ("False", []), ("", []), (None, [])):
        assert findings(spark, "m string", (m,), R.reasoning_rules(F.col("m"))) == want

"""Queries over traces, session results and transcripts: rules, reconstruction, analytics, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.arrays import first_divergence, mask_runs, segments
from tracelode.functions.text import END, TOOL, flat_content, message_ids, stub_logprobs
from tracelode.functions.wire import canonical_hash
from tracelode.operators import analytics as A
from tracelode.operators import compare as K
from tracelode.operators import envelopes as E
from tracelode.operators import gate as G
from tracelode.operators import rules as R
from tracelode.operators import trajectory as J
from tracelode.plans.records import MEMBERS
from tracelode.runtime import shared_folder
from tracelode.schemas import BODY, DELIVERY
from tracelode.sources.tables import table
from tracelode.streaming import reconstruct as VR
from tracelode.streaming import validate as V

#: A turn opens after the assistant's mark.
TAILS = [[258]]


def _traces(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "traces")


def _deliveries(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pi_polar_task_status")


def _delivered(spark: SparkSession, root: str) -> DataFrame:
    return R.trace_rows(_deliveries(spark, root))


_KEYS = ["delivery_id", "trace_no"]


def logprob_discipline(spark: SparkSession, root: str) -> DataFrame:
    c = F.col
    return R.explode_findings(_delivered(spark, root), _KEYS, R.logprob_rules(c("response_ids"), c("loss_mask"), c("response_logprobs")))


def trace_tripwires(spark: SparkSession, root: str) -> DataFrame:
    return R.explode_findings(_traces(spark, root).select("trace_id", "finish_reason", "split").distinct(), ["trace_id"], R.tripwire_rules(F.col("finish_reason"), F.col("split")))


def page_cutoff_gate(spark: SparkSession, root: str) -> DataFrame:
    t = R.with_tool_results(_traces(spark, root).dropDuplicates(["trace_id"]))
    return R.explode_findings(t, ["trace_id"], R.cutoff_rules(F.col("timestep"), F.col("results")))


def turn_opening_tail(spark: SparkSession, root: str) -> DataFrame:
    c = F.col
    return R.explode_findings(_delivered(spark, root), _KEYS, R.tail_rules(c("prompt_ids"), c("response_ids"), c("loss_mask"), TAILS))


def chain_snapshot_gate(spark: SparkSession, root: str) -> DataFrame:
    d = _deliveries(spark, root).where("trajectory IS NOT NULL")
    return R.explode_findings(d, ["delivery_id"], R.chain_rules(F.col("trajectory.metadata.reconstruction_stats")))


def admission_gate(spark: SparkSession, root: str) -> DataFrame:
    return R.explode_findings(_deliveries(spark, root), ["delivery_id"], R.admission_rules(F.col("status"), F.col("trajectory")))


def prompt_source_gate(spark: SparkSession, root: str) -> DataFrame:
    """Traces' prompt sources; the digest of the task's card stands for the echoed hash, those of cards on r5 images are approved."""
    tasks = table(spark, root, "tasks").select("task_id", "sandbox_image", F.sha2("skill_card_text", 256).alias("card_hash"))
    approved = tasks.where("sandbox_image LIKE '%r5' AND card_hash IS NOT NULL").select("card_hash").distinct().withColumn("approved", F.lit(True))
    tasks = tasks.drop("sandbox_image").join(approved, "card_hash", "left")
    t = _delivered(spark, root).select(*_KEYS, F.col("metadata.task_id").alias("task_id"), F.col("metadata.prompt_source").alias("source"))
    t = t.join(tasks, "task_id", "left")
    return R.explode_findings(t, _KEYS, R.source_rules(F.col("source"), F.col("card_hash"), F.col("approved")))


def system_prompt_gate(spark: SparkSession, root: str) -> DataFrame:
    """Approved are the system prompts of the eval split."""
    t = _traces(spark, root).dropDuplicates(["trace_id"]).select("trace_id", "split", "prompt_messages", "response_messages")
    return R.prompt_gate(t, "trace_id", R.system_prompts(t.where("split = 'eval'"), "trace_id"))


def workspace_gate(spark: SparkSession, root: str) -> DataFrame:
    """The echo of a checkout made of each task's pages in chunks."""
    pages = table(spark, root, "chunks").groupBy("case_id").agg(F.min("page").alias("min"), F.max("page").alias("max"), F.countDistinct("page").cast("int").alias("count"))
    t = table(spark, root, "tasks").join(pages, "case_id", "left")
    echo = F.when(F.col("max").isNotNull(), F.struct((F.col("split") == "train").alias("shallow"), F.lit(0).alias("remotes"), F.concat(F.lit("timestep-"), F.col("max").cast("string")).alias("branch"), F.struct("min", "max", "count").alias("pages")))
    return R.explode_findings(t.select("task_id", "timestep", echo.alias("echo")), ["task_id"], R.workspace_rules(F.col("echo"), F.col("timestep")))


def raw_mask_gate(spark: SparkSession, root: str) -> DataFrame:
    """LP9 on the masks as they stand in wire bodies, those of every member and trace."""
    return R.raw_mask_findings(E.raw_masks(table(spark, root, "wire_bodies")), ["body_id", "member_no", "trace_no"], "mask")


def raw_mask_faults(spark: SparkSession, root: str) -> DataFrame:
    """As raw_mask_gate, with the first mask value of two bodies in three made true or a text."""
    b = table(spark, root, "wire_bodies")
    body = F.when(F.col("body_id") % 3 == 0, F.replace("body", F.lit('"loss_mask":[1'), F.lit('"loss_mask":[true'))).when(F.col("body_id") % 3 == 1, F.replace("body", F.lit('"loss_mask":[1'), F.lit('"loss_mask":["1"'))).otherwise(F.col("body"))
    return R.raw_mask_findings(E.raw_masks(b.withColumn("body", body)), ["body_id", "member_no", "trace_no"], "mask")


def _pins(spark: SparkSession, root: str) -> G.Pins:
    """Approved are the system prompts of the eval split, the cards on r5 images, and turns that open after the assistant's mark."""
    prompts = R.system_prompts(_traces(spark, root).where("split = 'eval'"), "trace_id").select("digest")
    cards = table(spark, root, "tasks").where("sandbox_image LIKE '%r5'").select(F.sha2("skill_card_text", 256).alias("card"))
    return G.Pins(system_prompts=G.pinned(prompts), cards=G.pinned(cards), tails=TAILS)


def _cards(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "tasks").select("task_id", F.sha2("skill_card_text", 256).alias("card_hash"))


def _gated(spark: SparkSession, root: str):
    """The whole gate over deliveries; the digest of a task's card stands for the hash that traces would state."""
    pins, cards = _pins(spark, root), _cards(spark, root)
    return lambda d: G.gate(d, ["delivery_id", "session_id"], pins, cards=cards)


def _shown(d: DataFrame) -> DataFrame:
    return d.withColumn("findings", F.array_join("findings", "|"))


def accept_quarantine(spark: SparkSession, root: str) -> DataFrame:
    return _shown(_gated(spark, root)(_deliveries(spark, root)))


def disposition_counts(spark: SparkSession, root: str) -> DataFrame:
    return V.counters(_gated(spark, root)(_deliveries(spark, root)))


def streaming_validate(spark: SparkSession, root: str) -> DataFrame:
    """As accept_quarantine, by a stream that takes all files there are; the result is what it wrote."""
    sink = shared_folder(spark, "stream")
    # A pattern, since a stream takes the path of a folder or a pattern, and the table may be one file.
    V.run_available(spark, f"{root}/pi_polar_task_status.parque[t]", DELIVERY, _gated(spark, root), sink)
    return _shown(V.routed(spark, sink).select("delivery_id", "session_id", "findings", "disposition"))


def _doctored_deliveries(spark: SparkSession, root: str) -> DataFrame:
    """Deliveries that pass every check, and one fault planted in each by its id, so that every rule fires alone."""
    d = _deliveries(spark, root).where("trajectory IS NOT NULL")
    fault = F.col("delivery_id") % 16
    planted = lambda k, a, b: F.when(fault == k, a).otherwise(b)
    card = F.struct(F.lit("system").alias("role"), planted(10, F.lit("Do as you like."), F.lit("Answer from the pages.")).alias("content"))

    def trace(t):
        ids = F.coalesce(t["response_ids"], F.array().cast("array<int>"))
        n = F.size(ids)
        ones = F.when(n > 0, F.array_repeat(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        mask = planted(6, F.concat(F.slice(ones, 2, n), F.array(F.lit(2))), planted(8, F.slice(ones, 2, n), ones))
        logprobs = stub_logprobs(ids)
        first = lambda v: F.concat(F.array(F.lit(v)), F.slice(logprobs, 2, n))
        logprobs = F.when(fault == 1, F.slice(logprobs, 2, n)).when(fault == 2, first(-9999.0)).when(fault == 3, first(float("inf"))).when(fault == 4, first(0.5)).when(fault == 5, F.transform(logprobs, lambda x: x * 0)).when(fault != 7, logprobs)
        system = F.struct(card["role"].alias("role"), card["content"].alias("content"), F.get(t["prompt_messages"], F.lit(0))["tool_calls"].alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"))
        asked = F.filter(F.coalesce(t["prompt_messages"], F.slice(t["response_messages"], 1, 0)), lambda m: F.coalesce(m["role"] != "system", F.lit(False)))
        head = F.coalesce(t["prompt_ids"], F.array().cast("array<int>"))
        meta = t["metadata"].withField("timestep", planted(12, F.lit(0), F.lit(9999))).withField("prompt_source", planted(11, F.lit("skill:x"), F.lit("free")))
        return (
            t.withField("prompt_ids", F.concat(head, F.array(planted(14, F.lit(END), F.lit(258))))).withField("response_ids", ids).withField("loss_mask", mask).withField("response_logprobs", logprobs)
            .withField("prompt_messages", F.concat(F.array(system.withField("tool_calls", F.lit(None).cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"))), asked))
            .withField("finish_reason", planted(9, F.lit("abort"), F.lit("stop"))).withField("metadata", meta)
        )

    traces = F.transform(F.filter("trajectory.traces", lambda t: t.isNotNull() & t["metadata"].isNotNull() & (F.coalesce(F.size(t["response_ids"]), F.lit(0)) > 3)), trace)
    stats = F.struct(F.lit(1).alias("chains_total"), F.lit(2).alias("completions_total"), planted(13, F.lit(1), F.lit(2)).alias("completions_merged"))
    done = F.col("trajectory").withField("traces", traces).withField("metadata", F.col("trajectory.metadata").withField("reconstruction_stats", stats))
    return d.where("trajectory.metadata IS NOT NULL").withColumn("trajectory", done).withColumn("status", planted(15, F.lit("FAILED"), F.lit("COMPLETED")))


def doctored_gate(spark: SparkSession, root: str) -> DataFrame:
    """The whole gate over sound deliveries with one planted fault each; deliveries without fault are accepted."""
    cards = table(spark, root, "tasks").where("sandbox_image LIKE '%r5'").select(F.sha2("skill_card_text", 256).alias("card"))
    approved = spark.range(1).select(F.sha2(F.lit("Answer from the pages."), 256).alias("d"))
    pins = G.Pins(system_prompts=G.pinned(approved), cards=G.pinned(cards), tails=TAILS)
    return _shown(G.gate(_doctored_deliveries(spark, root), ["delivery_id", "session_id"], pins, cards=_cards(spark, root)))


def _doctored_bodies(bodies: DataFrame) -> DataFrame:
    """Bodies with faults planted by id: a mask value that is no integer, findings of the builder, a split that is null."""
    body = F.col("body")
    for left, old, new in (
        (0, '"loss_mask":[1', '"loss_mask":["x"'), (1, '"metadata":{"builder":', '"metadata":{"validation":{"findings":["S1:empty_prompt_ids:c1"]},"builder":'), (2, '"prompt_source":', '"split":null,"prompt_source":'),
        (3, '"finish_reason":"stop"', '"finish_reason":"abort"'),
    ):
        body = F.when(F.col("body_id") % 4 == left, F.replace(body, F.lit(old), F.lit(new))).otherwise(body)
    return bodies.withColumn("body", body)


def raw_gate(spark: SparkSession, root: str) -> DataFrame:
    """The whole gate over raw bodies with planted faults, unfit envelopes rejected whole."""
    return _shown(G.gate_bodies(_doctored_bodies(table(spark, root, "wire_bodies")), _pins(spark, root), cards=_cards(spark, root)))


def raw_stream(spark: SparkSession, root: str) -> DataFrame:
    """As raw_gate, by a stream, and of each session only the member that came last."""
    sink, pins, cards = shared_folder(spark, "stream"), _pins(spark, root), _cards(spark, root)
    V.run_available(spark, f"{root}/wire_bodies.parque[t]", BODY, lambda b: G.gate_bodies(_doctored_bodies(b), pins, cards=cards), sink)
    return _shown(V.latest(spark, sink, "session_id", ["body_id", "member_no"]).select("body_id", "member_no", "session_id", "findings", "disposition"))


def envelope_screen(spark: SparkSession, root: str) -> DataFrame:
    return E.screen(table(spark, root, "wire_bodies"))


def envelope_members(spark: SparkSession, root: str) -> DataFrame:
    return E.accepted_members(table(spark, root, "wire_bodies"))


def argument_hashes(spark: SparkSession, root: str) -> DataFrame:
    """The canonical hash of each tool call's arguments in transcripts; null where they aren't JSON."""
    t = table(spark, root, "pi_polar_transcript").select("row_id", F.posexplode("message.content").alias("part", "p")).where("p.type = 'toolCall'")
    return t.select("row_id", "part", canonical_hash(F.col("p.arguments")).alias("sha256"))


def mask_runs_rows(spark: SparkSession, root: str) -> DataFrame:
    t = _traces(spark, root).select("trace_id", "loss_mask").distinct()
    return t.select("trace_id", F.posexplode(mask_runs(F.col("loss_mask"))).alias("run", "r")).select("trace_id", "run", "r.start", "r.end")


def loss_mask_counts(spark: SparkSession, root: str) -> DataFrame:
    return A.episodes(_traces(spark, root)).select("trace_id", "n_prompt", "n_response", "n_trained", "n_turns")


def tool_segments(spark: SparkSession, root: str) -> DataFrame:
    """The stretches of tool results within responses, by their marks: how many, and how many ids."""
    s = segments(F.col("response_ids"), TOOL, END)
    t = _traces(spark, root).select("trace_id", s.alias("s")).groupBy("trace_id").agg(F.max("s").alias("s"))
    return t.select("trace_id", F.greatest(F.size("s"), F.lit(0)).alias("n"), F.coalesce(F.aggregate("s", F.lit(0), lambda a, x: a + x["end"] - x["start"]), F.lit(0)).alias("ids"))


def _turned(spark: SparkSession, root: str) -> DataFrame:
    return _delivered(spark, root).withColumn("response_logprobs", F.coalesce("response_logprobs", stub_logprobs(F.col("response_ids"))))


def _completions(spark: SparkSession, root: str) -> DataFrame:
    return J.sampled_turns(_turned(spark, root), _KEYS)


def sampled_turns(spark: SparkSession, root: str) -> DataFrame:
    return _completions(spark, root).select(*_KEYS, "seq", F.size("prompt_ids").alias("n_prompt"), F.size("response_ids").alias("n_response"), F.size("logprobs").alias("n_logprobs"))


def _digests(m: DataFrame, *more: str) -> DataFrame:
    text = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ","), 256)
    return m.select(*_KEYS, "chain_no", F.size("response_ids").alias("n"), text("prompt_ids").alias("prompt"), text("response_ids").alias("response"), text("loss_mask").alias("mask"), "kept", "total", *more)


def prefix_merge(spark: SparkSession, root: str) -> DataFrame:
    """The completions of each delivered trace merged again: ids and masks as hashes of joined text."""
    return _digests(J.reconstruct_traces(_turned(spark, root), _KEYS))


def chain_statistics(spark: SparkSession, root: str) -> DataFrame:
    return J.statistics(J.reconstruct_traces(_turned(spark, root), _KEYS), _KEYS)


def streaming_merge(spark: SparkSession, root: str) -> DataFrame:
    """As prefix_merge, by a stream that rebuilds the sessions that each batch of deliveries touches."""
    sink = shared_folder(spark, "merge")
    turned = lambda d: J.sampled_turns(R.trace_rows(d).withColumn("response_logprobs", F.coalesce("response_logprobs", stub_logprobs(F.col("response_ids")))), _KEYS)
    VR.run_available(spark, f"{root}/pi_polar_task_status.parque[t]", DELIVERY, turned, _KEYS, sink)
    return _digests(VR.current(spark, sink, _KEYS))


#: Ids that a template puts at the end of every prompt, and that the next prompt doesn't repeat.
GLUE = [270, 271]


def glue_stitch(spark: SparkSession, root: str) -> DataFrame:
    """The completions of each delivered trace with glue planted behind every prompt, stitched and merged."""
    c = _completions(spark, root).where(F.size("prompt_ids") > 0)
    glued = c.withColumn("prompt_ids", F.concat("prompt_ids", F.array(*[F.lit(g) for g in GLUE])))
    return _digests(J.reconstruct(glued, _KEYS, glue=GLUE), "stitched")


def broken_chains(spark: SparkSession, root: str) -> DataFrame:
    """Completions with faults planted: every delivery's turns a second time behind a prompt of another agent, and,
    in every fourth delivery, no end marks."""
    c = _completions(spark, root).where(F.size("prompt_ids") > 0)
    unmarked = lambda a: F.when(F.col("delivery_id") % 4 == 1, F.transform(a, lambda x: F.when(x == END, 261).otherwise(x))).otherwise(F.col(a))
    c = c.withColumns({"prompt_ids": unmarked("prompt_ids"), "response_ids": unmarked("response_ids"), "copy": F.explode(F.array(F.lit(0), F.lit(1)))})
    c = c.withColumns({"prompt_ids": F.when(F.col("copy") == 1, F.concat(F.array(F.lit(999)), "prompt_ids")).otherwise(F.col("prompt_ids")), "seq": F.col("seq") * 2 + F.col("copy")})
    return _digests(J.reconstruct(c, _KEYS))


def session_findings(spark: SparkSession, root: str) -> DataFrame:
    return J.session_findings(_completions(spark, root), _KEYS)


def episode_rows(spark: SparkSession, root: str) -> DataFrame:
    return A.episodes(_traces(spark, root))


def distribution_summary(spark: SparkSession, root: str) -> DataFrame:
    return A.order_statistics(A.episodes(_traces(spark, root)).withColumn("split", F.coalesce("split", F.lit("none"))), "split", "n_response")


def tool_call_join(spark: SparkSession, root: str) -> DataFrame:
    return A.tool_calls(_traces(spark, root))


def tool_outcomes(spark: SparkSession, root: str) -> DataFrame:
    return A.tool_outcomes(_traces(spark, root))


def finish_histogram(spark: SparkSession, root: str) -> DataFrame:
    return A.finish_histogram(_traces(spark, root))


def length_stopped(spark: SparkSession, root: str) -> DataFrame:
    return A.length_stopped(_traces(spark, root))


def citation_rewards(spark: SparkSession, root: str) -> DataFrame:
    return A.citation_rewards(_traces(spark, root))


def group_advantages(spark: SparkSession, root: str) -> DataFrame:
    r = A.once(_traces(spark, root), "trace_id", ["task_id", "reward"])
    return A.advantages(r, "trace_id", "task_id").select("trace_id", "task_id", (F.round("grpo", 4) + 0.0).alias("grpo"), (F.round("loo", 2) + 0.0).alias("loo"))


def logprob_delta(spark: SparkSession, root: str) -> DataFrame:
    """The captured logprobs of each delivered trace against the deterministic ones."""
    t = _delivered(spark, root).where("response_logprobs IS NOT NULL").withColumn("replayed", stub_logprobs(F.col("response_ids")))
    return A.logprob_delta(t, _KEYS, "response_logprobs", "replayed", "loss_mask")


def delivery_divergence_traces(spark: SparkSession, root: str) -> DataFrame:
    """Later deliveries of a session against the earliest one, trace by trace: where the response ids first differ.

    Deliveries without a trace aren't compared. A trace that only one of the two has stands against no ids.
    """
    held = F.transform("trajectory.traces", lambda t: F.when(t.isNotNull(), F.struct(t["response_ids"].alias("ids"))))
    d = _deliveries(spark, root).where("session_id IS NOT NULL").select("session_id", "delivery_id", held.alias("held")).where(F.exists("held", lambda t: t.isNotNull()))
    first = d.groupBy("session_id").agg(F.min(F.struct("delivery_id", "held")).alias("f")).select("session_id", F.col("f.delivery_id").alias("first_id"), F.col("f.held").alias("first"))
    later = d.join(first, "session_id").where("delivery_id > first_id")
    pairs = later.withColumn("trace_no", F.explode(F.sequence(F.lit(0), F.greatest(F.size("first"), F.size("held")) - 1))).withColumns({"a": F.get("first", "trace_no"), "b": F.get("held", "trace_no")})
    ids = lambda t: F.when(F.col(t).isNull(), F.array().cast("array<int>")).otherwise(F.col(f"{t}.ids"))
    return pairs.where("a IS NOT NULL OR b IS NOT NULL").select("session_id", "delivery_id", "trace_no", first_divergence(ids("a"), ids("b")).alias("diverges_at"))


def delivery_divergence(spark: SparkSession, root: str) -> DataFrame:
    """All traces, as delivery_divergence_traces; it once compared first traces only."""
    return delivery_divergence_traces(spark, root)


def collection_comparison(spark: SparkSession, root: str) -> DataFrame:
    return A.collection(_traces(spark, root).withColumn("split", F.coalesce("split", F.lit("none"))), "split")


def marked_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Ids of tool results within responses; none of them should be trained."""
    return A.marked_tokens(_traces(spark, root), TOOL, END)


def opening_kinds(spark: SparkSession, root: str) -> DataFrame:
    return A.opening_kinds(_delivered(spark, root), _KEYS, {"assistant": [258], "end": [END]})


def redelivery_changes(spark: SparkSession, root: str) -> DataFrame:
    """By which members a later delivery of a session and task differs from its first: status, timing, node_id, and trajectory by its digest.

    Null task_ids are one task.
    """
    body = F.to_json(F.struct("status", F.col("timing.init_ms").alias("init_ms"), F.col("timing.run_ms").alias("run_ms"), "node_id", F.sha2(F.to_json("trajectory"), 256).alias("trajectory")))
    d = _deliveries(spark, root).where("session_id IS NOT NULL").select("delivery_id", "session_id", "task_id", body.alias("body"))
    first = d.groupBy("session_id", "task_id").agg(F.min(F.struct("delivery_id", "body")).alias("f")).select(F.col("session_id").alias("s"), F.col("task_id").alias("t"), "f")
    later = d.join(first, (F.col("session_id") == F.col("s")) & F.col("task_id").eqNullSafe(F.col("t"))).where("delivery_id > f.delivery_id")
    return K.member_diff(later, "delivery_id", F.col("f.body"), F.col("body"))


def token_stream(spark: SparkSession, root: str) -> DataFrame:
    """The prompt's ids made again from its messages: how many, and whether they are the trace's."""
    t = _traces(spark, root).select("trace_id", message_ids(F.col("prompt_messages")).alias("ids"), "prompt_ids")
    return t.select("trace_id", F.size("ids").alias("n"), F.coalesce(F.col("ids") == F.col("prompt_ids"), F.lit(False)).alias("same")).distinct()


def message_texts(spark: SparkSession, root: str) -> DataFrame:
    """The flattened text of every prompt message, by its length and hash."""
    m = _traces(spark, root).dropDuplicates(["trace_id"]).select("trace_id", F.posexplode("prompt_messages").alias("ord", "m"))
    t = flat_content(F.col("m.content"))
    return m.select("trace_id", "ord", F.length(t).alias("n"), F.sha2(t, 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (
    logprob_discipline, trace_tripwires, page_cutoff_gate, turn_opening_tail, chain_snapshot_gate, admission_gate, prompt_source_gate, system_prompt_gate, workspace_gate, raw_mask_gate, raw_mask_faults, accept_quarantine,
    disposition_counts, streaming_validate, doctored_gate, raw_gate, raw_stream, envelope_screen, envelope_members, argument_hashes, mask_runs_rows, loss_mask_counts, tool_segments, sampled_turns, prefix_merge, streaming_merge, chain_statistics, glue_stitch, broken_chains, session_findings,
    episode_rows, distribution_summary, tool_call_join, tool_outcomes, finish_histogram, length_stopped, citation_rewards, group_advantages, logprob_delta, delivery_divergence, delivery_divergence_traces, collection_comparison, message_texts, token_stream, marked_tokens, opening_kinds, redelivery_changes)}


_T = "tr AS (SELECT * FROM traces QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY created_at) = 1)"
_D = """dt AS (SELECT delivery_id, session_id, (k - 1)::INT AS trace_no, trajectory.traces[k] AS t FROM pi_polar_task_status, unnest(range(1, coalesce(len(trajectory.traces), 0) + 1)) AS u(k) WHERE trajectory.traces[k] IS NOT NULL),
d AS (SELECT delivery_id, session_id, trace_no, t.prompt_ids AS p, t.response_ids AS r, t.loss_mask AS m, t.response_logprobs AS lp, t.finish_reason AS fr, t.metadata AS md,
  coalesce(len(t.response_ids), 0) AS n, coalesce(len(t.loss_mask), 0) AS nm FROM dt)"""


def _if(cond: str, *text: str) -> str:
    """SQL of a finding or none."""
    return f"CASE WHEN {cond} THEN [{' || '.join(text)}] ELSE []::VARCHAR[] END"


def _off(name: str, positions: str) -> str:
    """SQL of a finding with the first position and the count; positions from 0."""
    return f"list_transform(list_filter([{positions}], lambda z: len(z) > 0), lambda z: '{name}:first=' || z[1]::VARCHAR || ':count=' || len(z)::VARCHAR)"


def _found(keys: str, lists: str, rows: str) -> str:
    return f"SELECT {keys}, (j - 1)::INT AS rule_ord, f[j] AS finding FROM (SELECT {keys}, {lists} AS f FROM {rows}), unnest(range(1, len(f) + 1)) AS u(j)"


_NUM = "coalesce(({0})::VARCHAR, 'None')"
_ON = "coalesce(m[i + 1], 0) = 1"
_FIN = "coalesce(isfinite(lp[i + 1]), false)"
_AT = "list_filter(range(0, coalesce(len(lp), 0)), lambda i: {})"
_NTRAIN = "len(list_filter(coalesce(m, []), lambda x: x = 1))"
_NZERO = "len(" + _AT.format(f"{_ON} AND {_FIN} AND lp[i + 1] = 0") + ")"
_LP_HEAD = " || ".join([
    _if("n > 0 AND nm = 0", f"'{R.LP7}'"), _if("nm > 0 AND nm <> n", f"'{R.LP8}:'", "nm::VARCHAR", "'!='", "n::VARCHAR"),
    _off(R.LP9, "list_filter(range(0, nm), lambda i: NOT coalesce(m[i + 1] IN (0, 1), false))")])
_LP_REST = " || ".join([
    _if("len(lp) <> n", f"'{R.LP2}:'", "len(lp)::VARCHAR", "'!='", "n::VARCHAR"), _off(R.LP3, _AT.format(f"{_ON} AND {_FIN} AND lp[i + 1] <= -9000")), _off(R.LP4, _AT.format(f"NOT {_FIN}")),
    _off(R.LP5, _AT.format(f"{_FIN} AND lp[i + 1] > 0")), _if(f"{_NTRAIN} > 0 AND {_NZERO} > {_NTRAIN} * 0.25", f"'{R.LP6}:'", f"{_NZERO}::VARCHAR", "'/'", f"{_NTRAIN}::VARCHAR", "'>0.25'")])
_LP = f"({_LP_HEAD}) || CASE WHEN lp IS NULL THEN {_if(f'{_NTRAIN} > 0 OR (n > 0 AND nm = 0)', f"'{R.LP1}'")} ELSE {_LP_REST} END"
_TR1 = _if("NOT coalesce(fr IN ('stop', 'tool_calls', 'stop_sequence', 'length'), false)", f"'{R.TR1}:'", _NUM.format("fr"))
_STARTS = "list_filter(range(0, nm), lambda i: coalesce(m[i + 1], 0) = 1 AND (i = 0 OR coalesce(m[i], 0) <> 1))"
_ENDS = "list_filter(range(1, nm + 1), lambda i: coalesce(m[i], 0) = 1 AND (i = nm OR coalesce(m[i + 1], 0) <> 1))"
# The last id before each run: of the response if anything lies between, for the first run else of the prompt.
_BEFORE = "CASE WHEN s[q] > CASE WHEN q = 1 THEN 0 ELSE e[q - 1] END THEN r[s[q]] WHEN q = 1 THEN p[-1] END"
_BADTURNS = f"list_filter(range(1, len(s) + 1), lambda q: coalesce({_BEFORE}, -1) <> 258)"
_TAIL = f"CASE WHEN len(s) = 0 THEN ['{R.G6_TURNS}'] ELSE " + " || ".join([_if(f"list_contains({_BADTURNS}, 1)", f"'{R.G6_PROMPT}'"), _off(R.G6_INTERSTITIAL, f"list_filter({_BADTURNS}, lambda q: q > 1)")]) + " END"
_G7 = f"""CASE WHEN st IS NULL THEN ['{R.G7_STATS}'] WHEN st.chains_total IS NULL THEN ['{R.G7_STATS}.chains_total'] WHEN st.completions_total IS NULL THEN ['{R.G7_STATS}.completions_total']
  WHEN st.completions_merged IS NULL THEN ['{R.G7_STATS}.completions_merged'] ELSE """ + " || ".join([
    _if("st.chains_total <> 1", f"'{R.G7_CHAINS}:'", "st.chains_total::VARCHAR"), _if("st.completions_merged <> st.completions_total", f"'{R.G7_MERGED}:'", "st.completions_merged::VARCHAR", "'!='", "st.completions_total::VARCHAR")]) + " END"
_ADM = _if("status IS DISTINCT FROM 'COMPLETED'", f"'{R.ADM1}:'", _NUM.format("status")) + f""" || CASE WHEN trajectory IS NULL THEN ['{R.ADM3}'] ELSE """ + _if("coalesce(len(trajectory.traces), 0) = 0", f"'{R.ADM4}'") + f""" ||
  coalesce(list_transform(list_filter(trajectory.traces, lambda x: x IS NULL), lambda x: '{R.ADM5}'), []) END"""
_DISP = f"""WITH {_D}, x AS (SELECT *, {_STARTS} AS s, {_ENDS} AS e FROM d), per AS (SELECT delivery_id, trace_no, ({_LP}) || ({_TR1}) || ({_TAIL}) AS f FROM x),
agg AS (SELECT delivery_id, flatten(list(f ORDER BY trace_no)) AS f FROM per GROUP BY 1),
z AS (SELECT delivery_id, session_id, ({_ADM}) || CASE WHEN trajectory IS NULL THEN []::VARCHAR[] ELSE ({_G7.replace('st.', 'trajectory.metadata.reconstruction_stats.').replace('st IS NULL', 'trajectory.metadata.reconstruction_stats IS NULL')}) END || coalesce(agg.f, []) AS findings
  FROM pi_polar_task_status LEFT JOIN agg USING (delivery_id)),
y AS (SELECT delivery_id, session_id, array_to_string(findings, '|') AS findings, CASE WHEN len(findings) = 0 THEN 'accepted' ELSE 'quarantined' END AS disposition FROM z) """
_FLAT = """CASE WHEN json_valid({0}) AND json_type({0}) = 'OBJECT' AND ({0} ->> '$.type') IS NOT NULL THEN coalesce({0} ->> '$.text', {0})
  WHEN json_valid({0}) AND json_type({0}) = 'ARRAY' AND len(list_filter(json_extract({0}, '$[*]'), lambda z: json_type(z) = 'OBJECT' AND (z ->> '$.type') IS NULL)) = 0
  THEN coalesce(array_to_string(list_transform(json_extract({0}, '$[*]'), lambda z: CASE json_type(z) WHEN 'OBJECT' THEN coalesce(z ->> '$.text', '') ELSE z ->> '$' END), ''), '') ELSE {0} END"""
_EPISODES = f"""WITH {_T}, e AS (SELECT *, loss_mask AS m, coalesce(len(loss_mask), 0) AS nm FROM tr),
ep AS (SELECT trace_id, session_id, task_id, split, finish_reason, reward, coalesce(len(prompt_ids), 0) AS n_prompt, coalesce(len(response_ids), 0) AS n_response, {_NTRAIN} AS n_trained, len({_STARTS}) AS n_turns,
  coalesce(list_sum(list_transform(response_messages, lambda x: coalesce(len(x.tool_calls), 0))), 0)::INT AS n_calls, coalesce(len(list_filter(response_messages, lambda x: x.role = 'tool')), 0) AS n_results,
  coalesce(len(list_filter(response_messages, lambda x: x.role = 'tool' AND starts_with(ltrim(x.content), 'Error'))), 0) AS n_errors FROM e)"""
_CALLS = f"""WITH {_T}, mm AS (SELECT trace_id, (k - 1)::INT AS message_no, response_messages[k] AS x FROM tr, unnest(range(1, coalesce(len(response_messages), 0) + 1)) AS u(k)),
cc AS (SELECT trace_id, message_no, (k - 1)::INT AS call_no, x.tool_calls[k].id AS call_id, x.tool_calls[k].function.name AS name FROM mm, unnest(range(1, coalesce(len(x.tool_calls), 0) + 1)) AS u(k)),
aa AS (SELECT trace_id, x.tool_call_id AS call_id, arg_max(x.content, message_no) AS text FROM mm WHERE x.role = 'tool' GROUP BY ALL),
cj AS (SELECT cc.trace_id, message_no, call_no, cc.call_id, name, aa.trace_id IS NOT NULL AS answered, aa.trace_id IS NOT NULL AND NOT coalesce(starts_with(ltrim(text), 'Error'), false) AS ok FROM cc LEFT JOIN aa ON aa.trace_id = cc.trace_id AND aa.call_id = cc.call_id) """
_RUNS = f"WITH {_D}, x AS (SELECT *, {_STARTS} AS s, {_ENDS} AS e FROM d)"
_SHA = "sha256(array_to_string({}, ','))"
# What the turns of a trace make when they are merged again: all up to the end of its last trained run. Two runs always have an end mark between them here, or the trace stays cut.
_LATE = """WITH msgs AS (SELECT trace_id, timestep, list_concat(coalesce(prompt_messages, []), coalesce(response_messages, [])) AS l FROM tr),
ms AS (SELECT trace_id, timestep, k AS ord, l[k] AS x FROM msgs, unnest(range(1, len(l) + 1)) AS u(k)),
calls AS (SELECT trace_id, ord, j AS cn, x.tool_calls[j].id AS id, x.tool_calls[j].function.name AS name FROM ms, unnest(range(1, coalesce(len(x.tool_calls), 0) + 1)) AS w(j)),
res AS (SELECT r.trace_id, r.timestep, r.ord, r.x.content AS text, (SELECT arg_max(c.name, c.ord * 1000 + c.cn) FROM calls c WHERE c.trace_id = r.trace_id AND c.id = r.x.tool_call_id AND c.ord <= r.ord) AS name FROM ms r WHERE r.x.role = 'tool'),
st AS (SELECT trace_id, arg_min(nullif(regexp_extract(text, '"timestep"\\s*:\\s*(\\d+)', 1), '')::INT, ord) AS t FROM res WHERE name LIKE '%case_status' AND regexp_matches(text, '"timestep"\\s*:\\s*(\\d+)') GROUP BY 1),
tt AS (SELECT tr.trace_id, coalesce(timestep, t) AS t FROM tr LEFT JOIN st USING (trace_id)),
pg AS (SELECT DISTINCT trace_id, unnest(list_concat(regexp_extract_all(text, '"page"\\s*:\\s*(\\d+)', 1), regexp_extract_all(text, 'md/page_(\\d{4})\\.md', 1)))::INT AS page FROM res WHERE name LIKE '%search_case')"""

ORACLE: dict[str, str] = {
    "logprob_discipline": f"WITH {_D} " + _found("delivery_id, trace_no", _LP, "d"),
    "trace_tripwires": _found("trace_id", _if("NOT coalesce(finish_reason IN ('stop', 'tool_calls', 'stop_sequence', 'length'), false)", f"'{R.TR1}:'", _NUM.format("finish_reason")) + " || " + _if("split NOT IN ('train', 'eval')", f"'{R.TR3}:'", "split"), "(SELECT DISTINCT trace_id, finish_reason, split FROM traces)"),
    "page_cutoff_gate": f"WITH {_T}, " + _LATE.removeprefix("WITH ") + f""" SELECT trace_id, 0::INT AS rule_ord, '{R.G5_TIMESTEP}' AS finding FROM tt WHERE t IS NULL
UNION ALL SELECT trace_id, (row_number() OVER (PARTITION BY trace_id ORDER BY page) - 1)::INT, '{R.G5_PAGE}:' || page || '>' || t FROM pg JOIN tt USING (trace_id) WHERE page > t""",
    "turn_opening_tail": _RUNS + " " + _found("delivery_id, trace_no", _TAIL, "x"),
    "chain_snapshot_gate": _found("delivery_id", _G7, "(SELECT delivery_id, trajectory.metadata.reconstruction_stats AS st FROM pi_polar_task_status WHERE trajectory IS NOT NULL)"),
    "admission_gate": _found("delivery_id", _ADM, "pi_polar_task_status"),
    "prompt_source_gate": f"""WITH {_D}, ok AS (SELECT DISTINCT sha256(skill_card_text) AS h FROM tasks WHERE sandbox_image LIKE '%r5' AND skill_card_text IS NOT NULL),
x AS (SELECT delivery_id, trace_no, md.prompt_source AS source, sha256(skill_card_text) AS h FROM d LEFT JOIN tasks ON tasks.task_id = d.md.task_id)
SELECT delivery_id, trace_no, 0::INT AS rule_ord, CASE WHEN NOT coalesce(regexp_matches(source, '^skill:.*\\S'), false) THEN '{R.G1_SOURCE}' WHEN h IS NULL THEN '{R.G1_CARD}' ELSE '{R.G1_NOT_APPROVED}:' || h END AS finding
FROM x WHERE coalesce(source, '') <> 'free' AND NOT (coalesce(regexp_matches(source, '^skill:.*\\S'), false) AND coalesce(h IN (SELECT h FROM ok), false))""",
    "system_prompt_gate": f"""WITH {_T}, mm AS (SELECT trace_id, split, prompt_messages[k] AS x FROM tr, unnest(range(1, coalesce(len(prompt_messages), 0) + 1)) AS u(k)),
s AS (SELECT trace_id, split, sha256({_FLAT.format('x.content')}) AS h FROM mm WHERE x.role = 'system')
SELECT trace_id, '{R.G2_NOT_APPROVED}:' || coalesce(h, 'unhashable') AS finding FROM s WHERE h IS NULL OR h NOT IN (SELECT h FROM s WHERE split = 'eval' AND h IS NOT NULL)
UNION ALL SELECT trace_id, '{R.G2_MISSING}' FROM tr WHERE trace_id NOT IN (SELECT trace_id FROM s)""",
    "workspace_gate": "WITH p AS (SELECT case_id, min(page) AS lo, max(page) AS hi, count(DISTINCT page) AS c FROM chunks GROUP BY 1), x AS (SELECT task_id, timestep AS t, split, lo, hi, c FROM tasks LEFT JOIN p USING (case_id)) " + _found("task_id", "CASE WHEN hi IS NULL THEN ['" + R.G5_WORKSPACE + "'] ELSE " + " || ".join([
        _if("coalesce(split, '') <> 'train'", f"'{R.G5_POSTURE}:shallow='", "CASE WHEN split IS NULL THEN 'None' ELSE 'False' END", "',remotes=0'"), _if("lo <> 1 OR c <> hi", f"'{R.G5_CONTIGUOUS}:'", "lo::VARCHAR", "'-'", "hi::VARCHAR", "'/'", "c::VARCHAR"),
        _if("t IS NOT NULL AND hi <> t", f"'{R.G5_BRANCH}:timestep-'", "hi::VARCHAR", "'!=timestep-'", "t::VARCHAR"), _if("t IS NOT NULL AND hi <> t", f"'{R.G5_MAX_PAGE}:'", "hi::VARCHAR", "'!='", "t::VARCHAR")]) + " END", "x"),
    "accept_quarantine": _DISP + "SELECT * FROM y",
    "streaming_validate": _DISP + "SELECT * FROM y",
    "disposition_counts": _DISP + "SELECT disposition, count(*) AS n FROM y GROUP BY 1",
    "mask_runs_rows": f"WITH {_T}, x AS (SELECT trace_id, loss_mask AS m, coalesce(len(loss_mask), 0) AS nm FROM tr), y AS (SELECT trace_id, {_STARTS} AS s, {_ENDS} AS e FROM x) SELECT trace_id, (q - 1)::INT AS run, s[q] AS start, e[q] AS \"end\" FROM y, unnest(range(1, len(s) + 1)) AS u(q)",
    "loss_mask_counts": _EPISODES + " SELECT trace_id, n_prompt, n_response, n_trained, n_turns FROM ep",
    "episode_rows": _EPISODES + " SELECT * FROM ep",
    "sampled_turns": _RUNS + """ SELECT delivery_id, trace_no, (q - 1)::INT AS seq, coalesce(len(p), 0) + least(s[q], n) AS n_prompt, greatest(least(e[q], n) - s[q], 0) AS n_response,
  CASE WHEN coalesce(len(lp), n) >= e[q] THEN e[q] - s[q] END AS n_logprobs FROM x, unnest(range(1, len(s) + 1)) AS u(q)""",
    "distribution_summary": _EPISODES + """, v AS (SELECT coalesce(split, 'none') AS split, list_sort(list(n_response)) AS l FROM ep GROUP BY 1)
SELECT split, len(l) AS n, l[1] AS min, l[len(l) // 4 + 1] AS p25, l[len(l) // 2 + 1] AS med, l[3 * len(l) // 4 + 1] AS p75, l[-1] AS max, round(list_avg(l), 1) AS mean FROM v""",
    "tool_call_join": _CALLS + "SELECT * FROM cj",
    "tool_outcomes": _CALLS + "SELECT name, count(*) AS calls, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE answered AND NOT ok) AS failed, count(*) FILTER (WHERE NOT answered) AS unanswered FROM cj GROUP BY 1",
    "finish_histogram": f"WITH {_T} SELECT finish_reason, count(*) AS n FROM tr GROUP BY 1",
    "length_stopped": "SELECT count(*) AS sessions, count(*) FILTER (WHERE hit) AS length_stopped FROM (SELECT session_id, bool_or(coalesce(finish_reason = 'length', false)) AS hit FROM traces WHERE session_id IS NOT NULL GROUP BY 1)",
    "citation_rewards": f"""WITH {_T}, a AS (SELECT trace_id, timestep, list_filter(response_messages, lambda x: x.role = 'assistant' AND x.content IS NOT NULL)[-1].content AS c FROM tr),
g AS (SELECT trace_id, timestep AS cutoff, coalesce(regexp_extract_all({_FLAT.format('c')}, 'page:(\\d+)', 1), [])::INT[] AS l FROM a),
w AS (SELECT trace_id, cutoff, len(l) AS n_cited, coalesce(len(list_filter(l, lambda z: z >= 1 AND z <= cutoff)), 0) AS n_valid FROM g)
SELECT *, round(CASE WHEN n_cited > 0 THEN n_valid / n_cited ELSE 0 END, 6) AS reward FROM w""",
    "group_advantages": f"""WITH {_T}, r AS (SELECT trace_id, task_id, reward AS x FROM tr WHERE reward IS NOT NULL), g AS (SELECT task_id, count(*) AS n, sum(x) AS s, sum(x * x) AS q, CASE WHEN min(x) = max(x) THEN 0 ELSE stddev_samp(x) END AS sd, min(x) AS lo, max(x) AS hi, list(x) AS l FROM r GROUP BY 1)
SELECT trace_id, r.task_id, round(CASE WHEN n = 1 THEN x ELSE (x - s / n) / (sd + 1e-6) END, 4) + 0.0 AS grpo,
  round(CASE WHEN n = 1 THEN x ELSE (x - (s - x) / (n - 1)) / (sqrt(CASE WHEN n <= 2 OR lo = hi OR (x < hi AND len(list_filter(l, lambda z: z = hi)) = n - 1) OR (x > lo AND len(list_filter(l, lambda z: z = lo)) = n - 1) THEN 0
    ELSE greatest((q - x * x - (s - x) * (s - x) / (n - 1)) / (n - 2), 0) END) + 1e-6) END, 2) + 0.0 AS loo FROM r JOIN g ON r.task_id IS NOT DISTINCT FROM g.task_id""",
    "logprob_delta": f"""WITH {_D}, z AS (SELECT delivery_id, trace_no, list_transform(list_filter(range(0, least(len(lp), n, nm)), lambda i: m[i + 1] = 1 AND lp[i + 1] IS NOT NULL), lambda i: abs(lp[i + 1] + 0.03125::DOUBLE * (i % 7 + 1))) AS v FROM d WHERE lp IS NOT NULL)
SELECT delivery_id, trace_no, len(v) AS n, round(list_avg(v), 6) AS mean, round(list_max(v), 6) AS max, len(list_filter(v, lambda x: x > 0.2)) AS over FROM z WHERE len(v) > 0""",
    "collection_comparison": _EPISODES + """ SELECT coalesce(split, 'none') AS split, count(*) AS n, round(avg(n_response), 4) AS mean_response, min(n_response) AS min_response, max(n_response) AS max_response, sum(n_trained)::BIGINT AS n_trained,
  count(*) FILTER (WHERE reward <> 0) AS rewarded, count(reward) AS graded FROM ep GROUP BY 1""",
    "message_texts": f"WITH {_T}, mm AS (SELECT trace_id, (k - 1)::INT AS ord, prompt_messages[k] AS x FROM tr, unnest(range(1, coalesce(len(prompt_messages), 0) + 1)) AS u(k)), t AS (SELECT trace_id, ord, {_FLAT.format('x.content')} AS t FROM mm) SELECT trace_id, ord, length(t) AS n, sha256(t) AS sha256 FROM t",
    "session_findings": _RUNS + f""", c AS (SELECT delivery_id, trace_no, q, (q - 1)::INT AS seq, list_concat(coalesce(p, []), r[1 : s[q]]) AS cp, r[s[q] + 1 : e[q]] AS cr, fr, len(s) AS k FROM x, unnest(range(1, len(s) + 1)) AS u(q)),
w AS (SELECT *, lag(cp) OVER (PARTITION BY delivery_id, trace_no ORDER BY q) AS bp FROM c),
f AS (SELECT delivery_id, trace_no, seq, {" || ".join([_if("coalesce(len(cp), 0) = 0", "'S1:empty_prompt_ids'"), _if("coalesce(len(cr), 0) = 0", "'S6:empty_response_ids'"), _if("q > 1 AND cp IS NOT DISTINCT FROM bp", "'S3:duplicate_consecutive_prompt'"), _if("fr = 'length' AND q < k", "'S7:mid_chain_finish_length'")])} AS l FROM w)
SELECT delivery_id, trace_no, seq, unnest(l) AS finding FROM f""",
    "delivery_divergence": f"""WITH {_D}, t AS (SELECT session_id, delivery_id, trace_no, r FROM d WHERE session_id IS NOT NULL), s AS (SELECT session_id, min(delivery_id) AS first_id FROM t GROUP BY 1),
f AS (SELECT session_id, trace_no, r FROM t JOIN s USING (session_id) WHERE delivery_id = first_id), l AS (SELECT t.* FROM t JOIN s USING (session_id) WHERE delivery_id > first_id),
k AS (SELECT session_id, delivery_id, trace_no FROM l UNION SELECT session_id, l.delivery_id, f.trace_no FROM l JOIN f USING (session_id)),
x AS (SELECT k.*, CASE WHEN f.trace_no IS NULL THEN [] ELSE f.r END AS a, CASE WHEN l.trace_no IS NULL THEN [] ELSE l.r END AS b FROM k LEFT JOIN f USING (session_id, trace_no) LEFT JOIN l USING (session_id, delivery_id, trace_no))
SELECT session_id, delivery_id, trace_no, coalesce(list_filter(range(0, least(len(a), len(b))), lambda i: a[i + 1] IS DISTINCT FROM b[i + 1])[1], CASE WHEN len(a) <> len(b) THEN least(len(a), len(b)) END)::INT AS diverges_at FROM x""",
    "envelope_screen": MEMBERS + f""" SELECT body_id, member_no, sid AS session_id, reason IS NULL AS fit, reason FROM (SELECT body_id, member_no, CASE WHEN json_type(m, '$.session_id') = 'VARCHAR' THEN m ->> '$.session_id' END AS sid,
  CASE WHEN json_type(m) <> 'OBJECT' THEN 'not_an_object' WHEN NOT coalesce(json_type(m, '$.session_id') = 'VARCHAR' AND regexp_full_match(m ->> '$.session_id', '[A-Za-z0-9][A-Za-z0-9._-]*'), false) THEN 'unsafe_session_id'
    WHEN json_type(m, '$.trajectory') IS DISTINCT FROM 'OBJECT' THEN 'no_trajectory' END AS reason FROM members)
UNION ALL SELECT body_id, -1, NULL, false, 'no_member' FROM wire_bodies WHERE body_id NOT IN (SELECT body_id FROM members)""",
}
ORACLE["token_stream"] = f"""WITH {_T}, mm AS (SELECT trace_id, k, prompt_messages[k] AS x FROM tr, unnest(range(1, coalesce(len(prompt_messages), 0) + 1)) AS u(k)), tx AS (SELECT trace_id, k, x.role AS role, coalesce({_FLAT.format('x.content')}, '') || coalesce(array_to_string(list_transform(x.tool_calls, lambda c: coalesce(c.function.arguments, '')), ''), '') AS t FROM mm WHERE x IS NOT NULL),
b AS (SELECT trace_id, k, [CASE role WHEN 'system' THEN 256 WHEN 'user' THEN 257 WHEN 'assistant' THEN 258 WHEN 'tool' THEN 259 END] || list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::INT) || [260] AS ids FROM tx),
j AS (SELECT trace_id, flatten(list(ids ORDER BY k)) AS ids FROM b GROUP BY 1)
SELECT tr.trace_id, (len(coalesce(ids, [])) + 1)::INT AS n, coalesce(coalesce(ids, []) || [258] = prompt_ids, false) AS same FROM tr LEFT JOIN j USING (trace_id)"""
_CHANGE = "CASE WHEN {0} IS NOT DISTINCT FROM f.{0} THEN NULL WHEN {0} IS NULL THEN 'only_a' WHEN f.{0} IS NULL THEN 'only_b' ELSE 'changed' END"
ORACLE["redelivery_changes"] = """WITH d AS (SELECT delivery_id, session_id, task_id, status, timing.init_ms AS init_ms, timing.run_ms AS run_ms, node_id, trajectory FROM pi_polar_task_status WHERE session_id IS NOT NULL),
f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY session_id, task_id ORDER BY delivery_id) = 1), j AS (""" + " UNION ALL ".join(
    f"SELECT d.delivery_id, '{c}' AS member, {_CHANGE.format(c).replace(f'WHEN {c} IS', f'WHEN d.{c} IS')} AS change FROM d JOIN f ON f.session_id = d.session_id AND f.task_id IS NOT DISTINCT FROM d.task_id WHERE d.delivery_id > f.delivery_id" for c in ("status", "init_ms", "run_ms", "node_id", "trajectory")) + ") SELECT * FROM j WHERE change IS NOT NULL"
_LAST = "CASE WHEN s[q] > 0 THEN r[s[q]] ELSE p[-1] END"
ORACLE["opening_kinds"] = _RUNS + f""" SELECT delivery_id, trace_no, CASE {_LAST} WHEN 258 THEN 'assistant' WHEN 260 THEN 'end' ELSE 'other' END AS kind, count(*) AS n FROM x, unnest(range(1, len(s) + 1)) AS u(q) GROUP BY ALL"""
ORACLE["envelope_members"] = f"WITH s AS ({ORACLE['envelope_screen']}) SELECT body_id, max(member_no) AS member_no, session_id FROM s WHERE body_id NOT IN (SELECT body_id FROM s WHERE NOT fit) GROUP BY body_id, session_id"
# A trace's turns merged again: what stands between two runs, from the first end mark after the earlier prompt on; a prompt without ids is extended by none.
_TURNS = _RUNS + """, z AS (SELECT delivery_id, trace_no, p, r, s, e, len(s) AS k, coalesce(len(p), 0) + s[1] = 0 AS bare FROM x WHERE len(s) > 0),
c AS (SELECT *, 0 AS chain_no, 1 AS a, CASE WHEN bare THEN 1 ELSE k END AS b FROM z UNION ALL SELECT *, 1, 2, k FROM z WHERE bare AND k > 1)"""
_TURNED = """, t AS (SELECT *, list_transform(range(a, b), lambda q: r[s[q] + 1 : s[q + 1]]) AS tails FROM c),
m AS (SELECT *, list_transform(tails, lambda l: coalesce(list_position(l, 260), 0)) AS mk FROM t),
w AS (SELECT *, coalesce(list_position(mk, 0), 0) AS cut FROM m),
g AS (SELECT *, CASE WHEN cut = 0 THEN b - a + 1 ELSE cut END AS kept FROM w),
f AS (SELECT *, [[]::INT[]] || list_transform(range(1, kept), lambda i: CASE WHEN r[e[a + i - 1]] = 260 THEN tails[i][mk[i] + 1 :] ELSE tails[i][mk[i] :] END || {0}) AS betw,
  list_transform(range(a, a + kept), lambda q: r[s[q] + 1 : e[q]]) AS said FROM g),
h AS (SELECT *, flatten(list_transform(range(1, kept + 1), lambda i: betw[i] || said[i])) AS ids, flatten(list_transform(range(1, kept + 1), lambda i: list_transform(betw[i], lambda y: 0) || list_transform(said[i], lambda y: 1))) AS ms FROM f)"""
_SUM = "sha256(array_to_string({}, ','))"
ORACLE["prefix_merge"] = _TURNS + _TURNED.format("[]::INT[]") + f""" SELECT delivery_id, trace_no, chain_no, len(ids) AS n, {_SUM.format('coalesce(p, []) || r[1 : s[a]]')} AS prompt, {_SUM.format('ids')} AS response, {_SUM.format('ms')} AS mask, kept, b - a + 1 AS total FROM h"""
ORACLE["chain_statistics"] = _TURNS + _TURNED.format("[]::INT[]") + """ SELECT delivery_id, trace_no, count(*) AS chains_total, count(*) FILTER (WHERE kept = b - a + 1) AS chains_full, count(*) FILTER (WHERE kept < b - a + 1) AS chains_truncated,
  sum(b - a + 1)::BIGINT AS completions_total, sum(kept)::BIGINT AS completions_merged FROM h GROUP BY 1, 2"""
# The turns of a trace from the first with a prompt on are one chain; stitched, glue stands behind what lies between two runs.
_PROMPTED = _RUNS + """, z AS (SELECT delivery_id, trace_no, p, r, s, e, len(s) AS k, coalesce(len(p), 0) + s[1] = 0 AS bare FROM x WHERE len(s) > 0),
c AS (SELECT *, 0 AS chain_no, CASE WHEN bare THEN 2 ELSE 1 END AS a, k AS b FROM z WHERE NOT bare OR k > 1)"""
ORACLE["glue_stitch"] = _PROMPTED + _TURNED.format("[270, 271]") + f""" SELECT delivery_id, trace_no, chain_no, len(ids) AS n, {_SUM.format('coalesce(p, []) || r[1 : s[a]] || [270, 271]')} AS prompt, {_SUM.format('ids')} AS response, {_SUM.format('ms')} AS mask, kept,
  b - a + 1 AS total, b - a AS stitched FROM h"""
ORACLE["broken_chains"] = _PROMPTED.replace("p, r, s, e, len(s)", "CASE WHEN delivery_id % 4 = 1 THEN list_transform(p, lambda y: CASE WHEN y = 260 THEN 261 ELSE y END) ELSE p END AS p, CASE WHEN delivery_id % 4 = 1 THEN list_transform(r, lambda y: CASE WHEN y = 260 THEN 261 ELSE y END) ELSE r END AS r, s, e, len(s)") + _TURNED.format("[]::INT[]") + f"""
SELECT delivery_id, trace_no, o.n::INT AS chain_no, len(ids) AS n, {_SUM.format('CASE WHEN o.n = 1 THEN [999] ELSE []::INT[] END || coalesce(p, []) || r[1 : s[a]]')} AS prompt, {_SUM.format('ids')} AS response, {_SUM.format('ms')} AS mask, kept, b - a + 1 AS total FROM h, (VALUES (0), (1)) AS o(n)"""

# The whole gate: dt has one row for each trace object (delivery_id, session_id, trace_no, t), src the records themselves, extra what raw bodies state.
_GATE = """x AS (SELECT *, """ + _STARTS + """ AS s, """ + _ENDS + """ AS e FROM d),
tr AS (SELECT delivery_id * 100000 + trace_no AS trace_id, t.metadata.timestep AS timestep, t.prompt_messages AS prompt_messages, t.response_messages AS response_messages FROM dt),
""" + _LATE.removeprefix("WITH ") + f""",
late AS (SELECT trace_id, ['{R.G5_TIMESTEP}'] AS f FROM tt WHERE t IS NULL UNION ALL SELECT trace_id, list('{R.G5_PAGE}:' || page || '>' || t ORDER BY page) FROM pg JOIN tt USING (trace_id) WHERE page > t GROUP BY 1),
said AS (SELECT trace_id, k AS ord, prompt_messages[k] AS x FROM tr, unnest(range(1, coalesce(len(prompt_messages), 0) + 1)) AS u(k)),
sys AS (SELECT trace_id, ord, sha256({_FLAT.format('x.content')}) AS h FROM said WHERE x.role = 'system'),
okp AS (SELECT DISTINCT sha256({_FLAT.format('m.content')}) AS h FROM (SELECT unnest(prompt_messages) AS m FROM traces WHERE split = 'eval') WHERE m.role = 'system'),
g2 AS (SELECT trace_id, coalesce(list('{R.G2_NOT_APPROVED}:' || coalesce(h, 'unhashable') ORDER BY ord) FILTER (WHERE h IS NULL OR h NOT IN (SELECT h FROM okp WHERE h IS NOT NULL)), []) AS f FROM sys GROUP BY 1),
okc AS (SELECT DISTINCT sha256(skill_card_text) AS h FROM tasks WHERE sandbox_image LIKE '%r5' AND skill_card_text IS NOT NULL),
src1 AS (SELECT delivery_id, trace_no, md.prompt_source AS source, sha256(skill_card_text) AS h FROM d LEFT JOIN tasks ON tasks.task_id = d.md.task_id),
g1 AS (SELECT delivery_id, trace_no, CASE WHEN coalesce(source, '') = 'free' THEN [] WHEN NOT coalesce(regexp_matches(source, '^skill:.*\\S'), false) THEN ['{R.G1_SOURCE}'] WHEN h IS NULL THEN ['{R.G1_CARD}']
  WHEN h IN (SELECT h FROM okc) THEN [] ELSE ['{R.G1_NOT_APPROVED}:' || h] END AS f FROM src1),
per AS (SELECT x.delivery_id, x.trace_no, ({_LP}) || ({_TR1}) || @raw@ || coalesce(late.f, []) || coalesce(g2.f, ['{R.G2_MISSING}']) || g1.f || ({_TAIL}) AS f
  FROM x JOIN g1 ON g1.delivery_id = x.delivery_id AND g1.trace_no = x.trace_no LEFT JOIN late ON late.trace_id = x.delivery_id * 100000 + x.trace_no LEFT JOIN g2 ON g2.trace_id = x.delivery_id * 100000 + x.trace_no @join@),
mine AS (SELECT delivery_id, trace_no, f FROM per UNION ALL SELECT delivery_id, k - 1, ['{R.ADM5}'] FROM src, unnest(range(1, coalesce(len(trajectory.traces), 0) + 1)) AS u(k) WHERE trajectory.traces[k] IS NULL),
agg AS (SELECT delivery_id, flatten(list(f ORDER BY trace_no)) AS f FROM mine GROUP BY 1),
z AS (SELECT delivery_id, session_id, {_if("status IS DISTINCT FROM 'COMPLETED'", f"'{R.ADM1}:'", _NUM.format("status"))} || CASE WHEN trajectory IS NULL THEN ['{R.ADM3}'] ELSE @builder@ || {_if("coalesce(len(trajectory.traces), 0) = 0", f"'{R.ADM4}'")} ||
  ({_G7.replace('st.', 'trajectory.metadata.reconstruction_stats.').replace('st IS NULL', 'trajectory.metadata.reconstruction_stats IS NULL')}) END || coalesce(agg.f, []) AS findings FROM src LEFT JOIN agg USING (delivery_id)),
y AS (SELECT delivery_id, session_id, array_to_string(findings, '|') AS findings, CASE WHEN len(findings) = 0 THEN 'accepted' ELSE 'quarantined' END AS disposition FROM z) """
_WHOLE = f"WITH {_D}, src AS (SELECT * FROM pi_polar_task_status), " + _GATE.replace("@raw@", "[]").replace("@join@", "").replace("@builder@", "[]")
# The gate's operator runs every check of the specification since it was widened, and so does its SQL.
ORACLE["accept_quarantine"] = ORACLE["streaming_validate"] = _WHOLE + "SELECT * FROM y"
ORACLE["disposition_counts"] = _WHOLE + "SELECT disposition, count(*) AS n FROM y GROUP BY 1"
# Raw bodies, doctored alike: a body with an unfit member is refused whole; of a session's members in a body the last counts.
_BODIES = """WITH wire_bodies AS (SELECT body_id, received_at, CASE body_id % 4 WHEN 0 THEN replace(body, '"loss_mask":[1', '"loss_mask":["x"')
  WHEN 1 THEN replace(body, '"metadata":{"builder":', '"metadata":{"validation":{"findings":["S1:empty_prompt_ids:c1"]},"builder":')
  WHEN 2 THEN replace(body, '"prompt_source":', '"split":null,"prompt_source":') WHEN 3 THEN replace(body, '"finish_reason":"stop"', '"finish_reason":"abort"') ELSE body END AS body FROM wire_bodies),
""" + MEMBERS.strip().removeprefix("WITH ") + ", screened AS (" + ORACLE["envelope_screen"].removeprefix(MEMBERS).strip() + """),
refused AS (SELECT body_id, arg_min(reason, member_no) AS reason FROM screened WHERE NOT fit GROUP BY 1),
kept AS (SELECT body_id, max(member_no) AS member_no, session_id FROM screened WHERE body_id NOT IN (SELECT body_id FROM refused) GROUP BY body_id, session_id),
src AS (SELECT body_id * 1000 + member_no AS delivery_id, body_id, member_no, kept.session_id, CASE WHEN json_type(m, '$.status') = 'VARCHAR' THEN m ->> '$.status' END AS status,
  from_json(m -> '$.trajectory', '{"metadata":{"reconstruction_stats":{"chains_total":"INTEGER","completions_total":"INTEGER","completions_merged":"INTEGER"}},"traces":[{"prompt_ids":["INTEGER"],"response_ids":["INTEGER"],"loss_mask":["INTEGER"],
    "prompt_messages":[{"role":"VARCHAR","content":"VARCHAR","tool_calls":[{"id":"VARCHAR","type":"VARCHAR","function":{"name":"VARCHAR","arguments":"VARCHAR"}}],"tool_call_id":"VARCHAR"}],
    "response_messages":[{"role":"VARCHAR","content":"VARCHAR","tool_calls":[{"id":"VARCHAR","type":"VARCHAR","function":{"name":"VARCHAR","arguments":"VARCHAR"}}],"tool_call_id":"VARCHAR"}],
    "finish_reason":"VARCHAR","response_logprobs":["DOUBLE"],"metadata":{"task_id":"VARCHAR","timestep":"INTEGER","prompt_source":"VARCHAR"}}]}') AS trajectory,
  json_extract_string(m, '$.trajectory.metadata.validation.findings[*]') AS builder, json_extract(m, '$.trajectory.traces[*]') AS raw FROM kept JOIN members USING (body_id, member_no)),
dt AS (SELECT delivery_id, session_id, (k - 1)::INT AS trace_no, trajectory.traces[k] AS t, CASE json_type(raw[k], '$.metadata.split') WHEN 'NULL' THEN 'None' ELSE raw[k] ->> '$.metadata.split' END AS split
  FROM src, unnest(range(1, coalesce(len(trajectory.traces), 0) + 1)) AS u(k) WHERE trajectory.traces[k] IS NOT NULL),
d AS (SELECT delivery_id, session_id, trace_no, split, t.prompt_ids AS p, t.response_ids AS r, t.loss_mask AS m, t.response_logprobs AS lp, t.finish_reason AS fr, t.metadata AS md, coalesce(len(t.response_ids), 0) AS n, coalesce(len(t.loss_mask), 0) AS nm FROM dt), """
_BODY_GATE = _BODIES + _GATE.replace("@raw@", _if("split NOT IN ('train', 'eval')", f"'{R.TR3}:'", "split")).replace("@join@", "").replace("@builder@", f"CASE WHEN len(builder) > 0 THEN ['{R.ADM2}:' || len(builder)] || builder ELSE [] END")
_JUDGED = "SELECT src.body_id, src.member_no, y.session_id, findings, disposition FROM y JOIN src USING (delivery_id) UNION ALL SELECT body_id, -1, NULL, reason, 'rejected' FROM refused"
ORACLE["raw_gate"] = _BODY_GATE + _JUDGED
ORACLE["raw_stream"] = _BODY_GATE + f", judged AS ({_JUDGED}) SELECT * FROM judged QUALIFY session_id IS NULL OR row_number() OVER (PARTITION BY session_id ORDER BY body_id DESC, member_no DESC) = 1"
# Sound deliveries with one fault each, as planted: q is the fault, tx a trace's members made sound.
_SOUND = """WITH base AS (SELECT delivery_id, session_id, delivery_id % 16 AS q, list_filter(trajectory.traces, lambda t: t IS NOT NULL AND t.metadata IS NOT NULL AND coalesce(len(t.response_ids), 0) > 3) AS ts
  FROM pi_polar_task_status WHERE trajectory IS NOT NULL AND trajectory.metadata IS NOT NULL),
opened AS (SELECT delivery_id, session_id, q, (k - 1)::INT AS trace_no, ts[k] AS o, len(ts[k].response_ids) AS n FROM base, unnest(range(1, coalesce(len(ts), 0) + 1)) AS u(k)),
lps AS (SELECT *, list_transform(range(0, n), lambda i: -0.03125::DOUBLE * (i % 7 + 1)) AS lp0, list_transform(range(0, n), lambda i: 1) AS m0 FROM opened),
cured AS (SELECT *, coalesce(o.prompt_ids, []) || [CASE WHEN q = 14 THEN 260 ELSE 258 END] AS p2, CASE q WHEN 6 THEN m0[2:] || [2] WHEN 8 THEN m0[2:] ELSE m0 END AS m2,
  CASE q WHEN 1 THEN lp0[2:] WHEN 2 THEN [-9999.0::DOUBLE] || lp0[2:] WHEN 3 THEN ['inf'::DOUBLE] || lp0[2:] WHEN 4 THEN [0.5::DOUBLE] || lp0[2:] WHEN 5 THEN list_transform(lp0, lambda y: 0.0::DOUBLE) WHEN 7 THEN NULL ELSE lp0 END AS lp2,
  [{'role': 'system', 'content': CASE WHEN q = 10 THEN 'Do as you like.' ELSE 'Answer from the pages.' END, 'tool_calls': NULL, 'tool_call_id': NULL}] || list_filter(coalesce(o.prompt_messages, []), lambda x: coalesce(x.role <> 'system', false)) AS pm2,
  CASE WHEN q = 12 THEN 0 ELSE 9999 END AS t2, CASE WHEN q = 11 THEN 'skill:x' ELSE 'free' END AS s2, CASE WHEN q = 9 THEN 'abort' ELSE 'stop' END AS f2 FROM lps),
dt AS (SELECT delivery_id, session_id, trace_no, {'prompt_ids': p2, 'response_ids': o.response_ids, 'loss_mask': m2, 'response_logprobs': lp2, 'finish_reason': f2, 'prompt_messages': pm2, 'response_messages': o.response_messages,
  'metadata': {'task_id': o.metadata.task_id, 'timestep': t2, 'prompt_source': s2}} AS t FROM cured),
d AS (SELECT delivery_id, session_id, trace_no, t.prompt_ids AS p, t.response_ids AS r, t.loss_mask AS m, t.response_logprobs AS lp, t.finish_reason AS fr, t.metadata AS md, coalesce(len(t.response_ids), 0) AS n, coalesce(len(t.loss_mask), 0) AS nm FROM dt),
src AS (SELECT delivery_id, session_id, CASE WHEN q = 15 THEN 'FAILED' ELSE 'COMPLETED' END AS status, {'traces': ts, 'metadata': {'reconstruction_stats': {'chains_total': 1, 'completions_total': 2, 'completions_merged': CASE WHEN q = 13 THEN 1 ELSE 2 END}}} AS trajectory FROM base), """
_OKP = _GATE[_GATE.index("okp AS ("):_GATE.index("g2 AS (")]
ORACLE["doctored_gate"] = _SOUND + _GATE.replace("@raw@", "[]").replace("@join@", "").replace("@builder@", "[]").replace(_OKP, "okp AS (SELECT sha256('Answer from the pages.') AS h),\n") + "SELECT * FROM y"
_MASKS = """mk AS (SELECT body_id, member_no, trace_no, json_extract(t, '$.loss_mask[*]') AS v FROM (SELECT body_id, member_no, (k - 1)::INT AS trace_no, ts[k] AS t FROM (SELECT body_id, member_no, json_extract(m, '$.trajectory.traces[*]') AS ts FROM members),
  unnest(range(1, len(ts) + 1)) AS u(k)) WHERE json_type(t, '$.loss_mask') = 'ARRAY'),
bad AS (SELECT *, list_filter(range(0, len(v)), lambda i: NOT (json_type(v[i + 1]) IN ('UBIGINT', 'BIGINT') AND (v[i + 1] ->> '$') IN ('0', '1'))) AS b FROM mk)
SELECT body_id, member_no, trace_no, '""" + R.LP9 + """:first=' || b[1] || ':count=' || len(b) AS finding FROM bad WHERE len(b) > 0"""
ORACLE["raw_mask_gate"] = MEMBERS + ", " + _MASKS
ORACLE["raw_mask_faults"] = """WITH wire_bodies AS (SELECT body_id, received_at, CASE body_id % 3 WHEN 0 THEN replace(body, '"loss_mask":[1', '"loss_mask":[true') WHEN 1 THEN replace(body, '"loss_mask":[1', '"loss_mask":["1"') ELSE body END AS body FROM wire_bodies),
""" + MEMBERS.strip().removeprefix("WITH ") + ", " + _MASKS
# The canonical form of an object of plain members: its members by name, without spaces or escapes of letters.
ORACLE["argument_hashes"] = """WITH l AS (SELECT row_id, message.content AS c FROM pi_polar_transcript WHERE message IS NOT NULL), p AS (SELECT row_id, (k - 1)::INT AS part, c[k].arguments AS a FROM l, unnest(range(1, coalesce(len(c), 0) + 1)) AS u(k) WHERE c[k].type = 'toolCall'),
j AS (SELECT row_id, part, a, CASE WHEN json_valid(a) THEN a::JSON END AS j FROM p)
SELECT row_id, part, CASE WHEN j IS NULL THEN NULL WHEN json_type(j) <> 'OBJECT' THEN sha256(j::VARCHAR) ELSE sha256('{' || array_to_string(list_transform(list_sort(json_keys(j)), lambda k: to_json(k)::VARCHAR || ':' || json_extract(j, '$."' || k || '"')::VARCHAR), ',') || '}') END AS sha256 FROM j"""
ORACLE["delivery_divergence_traces"] = ORACLE["delivery_divergence"]
ORACLE["streaming_merge"] = ORACLE["prefix_merge"]

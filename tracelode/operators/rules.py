"""Validation rules over traces and session results.

A rule is an expression that gives its findings as array<string>, empty if it holds; rules are joined
by ``concat`` in their order, so all of them are one projection without a shuffle. ``explode_findings`` makes rows
of them. Arrays may be null anywhere. Rules that tell 1 from true or "1" read the raw JSON (``raw_mask_findings``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.arrays import ends_with, finding, indices, let, mask_runs, offenders
from tracelode.functions.text import flat_content, page_refs, timestep_of
from tracelode.functions.wire import canonical_hash, element_kinds, member_names

# Finding identifiers, byte-stable (fixed values).
ADM1 = "ADM1:status_not_completed"
ADM2 = "ADM2:builder_findings_present"
ADM3 = "ADM3:trajectory_missing"
ADM4 = "ADM4:no_traces"
ADM5 = "ADM5:malformed_trace"
G1_SOURCE = "G1:missing_evidence:prompt_source"
G1_CARD = "G1:missing_evidence:skill_card_hash"
G1_NOT_APPROVED = "G1:skill_card_hash_not_approved"
G2_MISSING = "G2:missing_evidence:system_prompt"
G2_NOT_APPROVED = "G2:system_prompt_hash_not_approved"
G3_MISSING = "G3:missing_evidence:tools"
G3_NOT_APPROVED = "G3:tool_roster_hash_not_approved"
G5_CONTIGUOUS = "G5:checkout_pages_not_contiguous"
G5_MAX_PAGE = "G5:checkout_max_page_ne_timestep"
G5_POSTURE = "G5:checkout_history_posture"
G5_TIMESTEP = "G5:missing_evidence:timestep"
G5_WORKSPACE = "G5:missing_evidence:workspace"
G5_PAGE = "G5:search_page_gt_timestep"
G5_BRANCH = "G5:workspace_branch_ne_timestep"
G6_INTERSTITIAL = "G6:interstitial_ne_tail_ids"
G6_TURNS = "G6:missing_evidence:turns"
G6_PROMPT = "G6:prompt_suffix_ne_tail_ids"
G7_CHAINS = "G7:chains_total_ne_1"
G7_TRUNCATED = "G7:chains_truncated"
G7_MERGED = "G7:completions_merged_ne_total"
G7_RAW = "G7:raw_completions_ne_total"
G7_SETTINGS = "G7:missing_evidence:settings"
G7_SETTINGS_NOT_APPROVED = "G7:settings_hash_not_approved"
G7_STATS = "G7:missing_evidence:reconstruction_stats"
H41 = "H41:roster_offered_zero_tool_calls"
LP1 = "LP1:response_logprobs_absent"
LP2 = "LP2:response_logprobs_length_ne_response_ids"
LP3 = "LP3:sentinel_logprob_at_mask1"
LP4 = "LP4:nonfinite_logprob"
LP5 = "LP5:positive_logprob"
LP6 = "LP6:zero_logprob_rate_at_mask1"
LP7 = "LP7:empty_loss_mask"
LP8 = "LP8:loss_mask_length_ne_response_ids"
LP9 = "LP9:loss_mask_value_not_binary"
TR1 = "TR1:finish_reason_not_allowed"
TR2 = "TR2:reasoning_loss_mask_masked_tokens"
TR3 = "TR3:split_not_train_or_eval"
FINISH_REASONS = ["stop", "tool_calls", "stop_sequence", "length"]
SPLITS = ["train", "eval"]


@dataclass(frozen=True)
class Policy:
    """The rules' thresholds, passed explicitly."""

    sentinel: float = -9000.0
    zero_rate: float = 0.25
    reject_toolless: bool = False
    #: The tool whose results are under the cutoff, and the one that states the timestep: name suffixes.
    search_tool: str = "search_case"
    status_tool: str = "case_status"


def _empty() -> Column:
    return F.array().cast("array<string>")


def _len(c: Column) -> Column:
    return F.greatest(F.size(c), F.lit(0))


def _seq(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def logprob_rules(ids: Column, mask: Column, logprobs: Column, policy: Policy = Policy()) -> Column:
    """LP7, LP8, LP9 (values), then LP1 alone, or LP2 to LP6.

    Positions past the end of the mask aren't trainable; a null or non-finite logprob is LP4's only.
    """
    n, m = _len(ids), _len(mask)
    trained = lambda i: F.coalesce(F.get(mask, i) == 1, F.lit(False))
    value = lambda i: F.get(logprobs, i)
    finite = lambda i: value(i).isNotNull() & ~F.isnan(value(i)) & (F.abs(value(i)) != float("inf"))
    where = lambda f: F.filter(indices(logprobs), f)
    trainable = F.size(F.filter(_seq(mask, "int"), lambda x: F.coalesce(x == 1, F.lit(False))))
    zeros = F.size(where(lambda i: trained(i) & finite(i) & (value(i) == 0)))
    head = F.concat(
        finding((n > 0) & (m == 0), LP7),
        finding((m > 0) & (m != n), f"{LP8}:", m, "!=", n),
        offenders(LP9, F.filter(indices(mask), lambda i: ~F.coalesce(F.get(mask, i).isin(0, 1), F.lit(False)))),
    )
    rest = F.concat(
        finding(_len(logprobs) != n, f"{LP2}:", _len(logprobs), "!=", n),
        offenders(LP3, where(lambda i: trained(i) & finite(i) & (value(i) <= policy.sentinel))),
        offenders(LP4, where(lambda i: ~finite(i))),
        offenders(LP5, where(lambda i: finite(i) & (value(i) > 0))),
        finding((trainable > 0) & (zeros > trainable * policy.zero_rate), f"{LP6}:", zeros, "/", trainable, f">{policy.zero_rate}"),
    )
    absent = finding((trainable > 0) | ((n > 0) & (m == 0)), LP1)
    return F.concat(head, F.when(logprobs.isNull(), absent).otherwise(rest))


def tripwire_rules(finish_reason: Column, split: Column | None = None) -> Column:
    """TR1 for a finish reason not allowed (null too), TR3 for a split that is given and not allowed."""
    out = finding(~F.coalesce(finish_reason.isin(*FINISH_REASONS), F.lit(False)), f"{TR1}:", finish_reason)
    return out if split is None else F.concat(out, finding(split.isNotNull() & ~split.isin(*SPLITS), f"{TR3}:", split))


def tool_results(messages: Column) -> Column:
    """The tool results in order of the messages: array of (ord, name, text).

    A result's name is that of the last call with its id made in an earlier message or its own; null if there is none.
    """
    none = F.array().cast("array<struct<ord:int,id:string,name:string>>")
    call = lambda i: F.transform(F.coalesce(F.get(messages, i)["tool_calls"], F.array().cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>")), lambda c: F.struct(i.alias("ord"), c["id"].alias("id"), c["function"]["name"].alias("name")))
    calls = F.coalesce(F.flatten(F.transform(indices(messages), call)), none)
    results = F.filter(indices(messages), lambda i: F.coalesce(F.get(messages, i)["role"] == "tool", F.lit(False)))
    named = lambda i: F.try_element_at(F.filter(calls, lambda c: (c["ord"] <= i) & (c["id"] == F.get(messages, i)["tool_call_id"])), F.lit(-1))
    return F.transform(results, lambda i: F.struct(i.alias("ord"), F.when(F.exists(calls, lambda c: (c["ord"] <= i) & (c["id"] == F.get(messages, i)["tool_call_id"])), named(i)["name"]).alias("name"), F.get(messages, i)["content"].alias("text")))


def with_tool_results(traces: DataFrame, column: str = "results") -> DataFrame:
    """``traces`` with the tool results of prompt and response messages, as ``tool_results`` has them."""
    all_ = F.concat(F.coalesce("prompt_messages", F.slice("response_messages", 1, 0)), F.coalesce("response_messages", F.slice("prompt_messages", 1, 0)))
    return traces.withColumn(column, F.coalesce(tool_results(all_), F.array().cast("array<struct<ord:int,name:string,text:string>>")))


def timestep(stated: Column, results: Column, policy: Policy = Policy()) -> Column:
    """The stated timestep, or the first that a status result names."""
    status = F.filter(F.transform(F.filter(results, lambda r: F.coalesce(r["name"].endswith(policy.status_tool), F.lit(False))), lambda r: timestep_of(r["text"])), lambda t: t.isNotNull())
    return F.coalesce(stated, F.get(status, F.lit(0)))


def cutoff_rules(stated: Column, results: Column, policy: Policy = Policy()) -> Column:
    """G5: one finding for each page past the timestep that a search result names, ascending."""
    t = timestep(stated, results, policy)
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(results, lambda r: F.coalesce(r["name"].endswith(policy.search_tool), F.lit(False))), lambda r: page_refs(r["text"])))))
    late = F.transform(F.filter(pages, lambda p: p > t), lambda p: F.concat(F.lit(f"{G5_PAGE}:"), p.cast("string"), F.lit(">"), t.cast("string")))
    return F.when(t.isNull(), F.array(F.lit(G5_TIMESTEP))).otherwise(late)


def workspace_rules(workspace: Column, t: Column) -> Column:
    """G5's checkout census over a struct (shallow, remotes, branch, pages(min, max, count)); null is missing."""
    low, high, count = workspace["pages"]["min"], workspace["pages"]["max"], workspace["pages"]["count"]
    told = low.isNotNull() & high.isNotNull() & count.isNotNull()
    posture = finding(~(F.coalesce(workspace["shallow"], F.lit(False)) & F.coalesce(workspace["remotes"] == 0, F.lit(False))), f"{G5_POSTURE}:shallow=", F.initcap(workspace["shallow"].cast("string")), ",remotes=", workspace["remotes"])
    pages = F.concat(
        finding((low != 1) | (count != high), f"{G5_CONTIGUOUS}:", low, "-", high, "/", count),
        finding(t.isNotNull() & ~workspace["branch"].eqNullSafe(F.concat(F.lit("timestep-"), t.cast("string"))), f"{G5_BRANCH}:", workspace["branch"], "!=timestep-", t),
        finding(t.isNotNull() & (high != t), f"{G5_MAX_PAGE}:", high, "!=", t),
    )
    return F.when(workspace.isNull(), F.array(F.lit(G5_WORKSPACE))).otherwise(F.concat(posture, F.when(told, pages).otherwise(F.array(F.lit(f"{G5_WORKSPACE}.pages")))))


def tail_rules(prompt: Column, response: Column, mask: Column, tails: list[list[int]]) -> Column:
    """G6: the ids before each trained run must end with an approved tail."""
    approved = [F.array(*[F.lit(x) for x in t]) for t in tails if t]
    ids, head = _seq(response, "int"), _seq(prompt, "int")
    passes = lambda a: F.exists(F.array(*approved), lambda t: ends_with(a, t)) if approved else F.lit(False)
    cut = lambda lo, hi: F.slice(ids, lo + 1, F.greatest(hi - lo, F.lit(0)))

    def judge(runs: Column) -> Column:
        first = lambda k: F.concat(head, cut(F.lit(0), F.get(runs, k)["start"]))
        later = lambda k: cut(F.coalesce(F.get(runs, k - 1)["end"], F.lit(0)), F.get(runs, k)["start"])
        bad = F.transform(F.filter(indices(runs), lambda k: ~passes(F.when(k == 0, first(k)).otherwise(later(k)))), lambda k: k + 1)
        told = let(bad, lambda b: F.concat(finding(F.array_contains(b, 1), G6_PROMPT), offenders(G6_INTERSTITIAL, F.filter(b, lambda k: k > 1))))
        return F.when(F.size(runs) <= 0, F.array(F.lit(G6_TURNS))).otherwise(told)

    return let(mask_runs(mask), judge)


def chain_rules(stats: Column, full: bool = False) -> Column:
    """G7 over the statistics of a reconstruction; the first missing one is told alone.

    ``stats`` has chains_total, completions_total and completions_merged, and if ``full`` also
    chains_reconstructed_truncated and raw_completions_total.
    """
    keys = ["chains_total", *["chains_reconstructed_truncated"] * full, "completions_total", "completions_merged", *["raw_completions_total"] * full]
    missing = F.coalesce(*[F.when(stats[k].isNull(), F.lit(f"{G7_STATS}.{k}")) for k in keys])
    total = stats["completions_total"]
    rest = F.concat(
        finding(stats["chains_total"] != 1, f"{G7_CHAINS}:", stats["chains_total"]),
        *([finding(stats["chains_reconstructed_truncated"] != 0, f"{G7_TRUNCATED}:", stats["chains_reconstructed_truncated"])] if full else []),
        finding(stats["completions_merged"] != total, f"{G7_MERGED}:", stats["completions_merged"], "!=", total),
        *([finding(stats["raw_completions_total"] != total, f"{G7_RAW}:", stats["raw_completions_total"], "!=", total)] if full else []),
    )
    return F.when(stats.isNull(), F.array(F.lit(G7_STATS))).when(missing.isNotNull(), F.array(missing)).otherwise(rest)


def _hash_rules(given: Column, digest: Column, approved: list[str], missing: str, not_approved: str) -> Column:
    known = F.coalesce(digest.isin(*approved), F.lit(False)) if approved else F.lit(False)
    return F.when(~F.coalesce(given, F.lit(False)), F.array(F.lit(missing))).otherwise(finding(~known, f"{not_approved}:", F.coalesce(digest, F.lit("unhashable"))))


def roster_rules(tools: Column, approved: list[str]) -> Column:
    """G3 over the JSON text of the offered tools: a list that isn't empty, of an approved canonical hash."""
    return _hash_rules(F.size(element_kinds(tools)) > 0, canonical_hash(tools), approved, G3_MISSING, G3_NOT_APPROVED)


def settings_rules(settings: Column, approved: list[str]) -> Column:
    """G7's settings over the JSON text of the echo: an object that isn't empty, of an approved canonical hash."""
    return _hash_rules(F.size(member_names(settings)) > 0, canonical_hash(settings), approved, G7_SETTINGS, G7_SETTINGS_NOT_APPROVED)


def builder_rules(findings: Column) -> Column:
    """ADM2: how many findings the builder had, then each as it is; none for null or empty."""
    return F.when(_len(findings) > 0, F.concat(F.array(F.concat(F.lit(f"{ADM2}:"), F.size(findings).cast("string"))), findings)).otherwise(_empty())


def reasoning_rules(masked: Column) -> Column:
    """TR2 over the text of a count of masked reasoning ids: null, 0, false and the empty text pass."""
    return finding(~F.coalesce(F.lower(masked), F.lit("0")).isin("", "0", "false"), f"{TR2}:", masked)


def admission_rules(status: Column, trajectory: Column) -> Column:
    """ADM1, then ADM3 alone, or ADM4 and one ADM5 for each element of traces that is null."""
    traces = trajectory["traces"]
    none = _len(traces) == 0
    malformed = F.transform(F.filter(F.coalesce(traces, F.slice(traces, 1, 0)), lambda t: t.isNull()), lambda _: F.lit(ADM5))
    return F.concat(finding(~status.eqNullSafe(F.lit("COMPLETED")), f"{ADM1}:", status), F.when(trajectory.isNull(), F.array(F.lit(ADM3))).otherwise(F.concat(finding(none, ADM4), F.coalesce(malformed, _empty()))))


def source_rules(source: Column, card_hash: Column, approved: list[str] | Column) -> Column:
    """G1: free prompts pass; a skill's card hash must be given and approved: one of a list, or as a column says."""
    known = F.coalesce(approved, F.lit(False)) if isinstance(approved, Column) else card_hash.isin(*approved) if approved else F.lit(False)
    skill = F.coalesce(source.rlike(r"^skill:.*[^\s\p{Z}]"), F.lit(False))
    carded = F.coalesce(card_hash, F.lit("")) != ""
    return F.when(F.coalesce(source == "free", F.lit(False)), _empty()).when(~skill, F.array(F.lit(G1_SOURCE))).when(~carded, F.array(F.lit(G1_CARD))).otherwise(finding(~known, f"{G1_NOT_APPROVED}:", F.substring(card_hash, 1, 64)))


def system_prompts(traces: DataFrame, key: str) -> DataFrame:
    """The system messages of each trace's prompt: key, ord, digest."""
    m = traces.select(key, F.posexplode("prompt_messages").alias("ord", "m")).where("m.role = 'system'")
    return m.select(key, "ord", F.sha2(flat_content(F.col("m.content")), 256).alias("digest"))


def prompt_gate(traces: DataFrame, key: str, approved: DataFrame) -> DataFrame:
    """G2: key and finding of traces without system message, or with one whose digest isn't in ``approved`` (digest)."""
    said = system_prompts(traces, key)
    bad = said.join(approved.select("digest").distinct(), "digest", "left_anti").select(key, F.concat(F.lit(f"{G2_NOT_APPROVED}:"), F.coalesce("digest", F.lit("unhashable"))).alias("finding"))
    has = F.exists(F.coalesce("prompt_messages", F.slice("response_messages", 1, 0)), lambda m: F.coalesce(m["role"] == "system", F.lit(False)))
    none = traces.where(~F.coalesce(has, F.lit(False))).select(key, F.lit(G2_MISSING).alias("finding"))
    return bad.unionByName(none)


def toolless_rules(offered: Column, messages: Column, policy: Policy = Policy()) -> Column:
    """H41, if the policy asks for it: tools were offered and no message calls one."""
    if not policy.reject_toolless:
        return _empty()
    called = F.exists(messages, lambda m: F.coalesce(F.size(m["tool_calls"]) > 0, F.lit(False)))
    return finding(F.coalesce(F.size(offered) > 0, F.lit(False)) & ~F.coalesce(called, F.lit(False)), H41)


def raw_mask_findings(rows: DataFrame, key: str | list[str], mask_json: str) -> DataFrame:
    """LP9 on raw JSON masks: an element must be the integer 0 or 1; true, "1" and 1.0 aren't."""
    keys = [key] if isinstance(key, str) else key
    kinds, values = element_kinds(F.col(mask_json)), F.from_json(mask_json, "array<string>")
    rows = rows.select(*keys, kinds.alias("kinds"), values.alias("values"))
    bad = F.filter(indices(F.col("kinds")), lambda i: (F.get("kinds", i) != "int") | ~F.coalesce(F.get("values", i).isin("0", "1"), F.lit(False)))
    return rows.select(*keys, F.explode(offenders(LP9, bad)).alias("finding"))


def explode_findings(rows: DataFrame, keys: list[str], found: Column) -> DataFrame:
    """The findings as rows: keys, rule_ord (place among the trace's findings), finding."""
    return rows.select(*keys, F.posexplode(found).alias("rule_ord", "finding"))


def trace_rows(deliveries: DataFrame) -> DataFrame:
    """One row for each trace of a delivery, arrays kept: delivery_id, trace_no, status and the trace's members."""
    return deliveries.select("delivery_id", "session_id", F.posexplode("trajectory.traces").alias("trace_no", "t")).where("t IS NOT NULL").select("delivery_id", "session_id", "trace_no", "t.*")


def dispositions(deliveries: DataFrame, tails: list[list[int]], policy: Policy = Policy()) -> DataFrame:
    """Each delivery's findings in order and where it goes: delivery_id, session_id, findings, disposition."""
    per_trace = lambda t: F.concat(
        logprob_rules(t["response_ids"], t["loss_mask"], t["response_logprobs"], policy), tripwire_rules(t["finish_reason"]),
        tail_rules(t["prompt_ids"], t["response_ids"], t["loss_mask"], tails),
    )
    traces = F.filter(F.coalesce("trajectory.traces", F.slice("trajectory.traces", 1, 0)), lambda t: t.isNotNull())
    found = F.concat(
        admission_rules(F.col("status"), F.col("trajectory")), F.when(F.col("trajectory").isNotNull(), chain_rules(F.col("trajectory.metadata.reconstruction_stats"))).otherwise(_empty()),
        F.coalesce(F.flatten(F.transform(traces, per_trace)), _empty()),
    )
    return deliveries.select("delivery_id", "session_id", found.alias("findings")).withColumn("disposition", F.when(F.size("findings") == 0, "accepted").otherwise("quarantined"))

"""Numbers over traces: episodes, distributions, tool outcomes, rewards, advantages, logprob differences.

Aggregates are partial everywhere; no group is collected, so a task with a third of all traces is summed like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.arrays import ends_with, indices, let, mask_runs, segments
from tracelode.functions.text import citations, flat_content

EPSILON = 1e-6


def once(traces: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each distinct trace by its key; rows repeated unchanged count once."""
    return traces.groupBy(key).agg(F.min(F.struct(*columns)).alias("t")).select(key, "t.*")


def trained(mask: Column) -> Column:
    """How many positions of a mask are trained."""
    return F.size(F.filter(F.coalesce(mask, F.array().cast("array<int>")), lambda x: F.coalesce(x == 1, F.lit(False))))


def episodes(traces: DataFrame) -> DataFrame:
    """One row a trace: lengths, trained ids, turns, calls, results, errors, finish reason."""
    calls = F.aggregate(F.coalesce("response_messages", F.slice("prompt_messages", 1, 0)), F.lit(0), lambda s, m: s + F.greatest(F.coalesce(F.size(m["tool_calls"]), F.lit(0)), F.lit(0)))
    results = F.filter(F.coalesce("response_messages", F.slice("prompt_messages", 1, 0)), lambda m: F.coalesce(m["role"] == "tool", F.lit(False)))
    errors = F.size(F.filter(results, lambda m: F.coalesce(F.ltrim(m["content"]).startswith("Error"), F.lit(False))))
    n = lambda c: F.greatest(F.size(c), F.lit(0))
    rows = traces.select(
        "trace_id", "session_id", "task_id", "split", "finish_reason", "reward", n("prompt_ids").alias("n_prompt"), n("response_ids").alias("n_response"), trained(F.col("loss_mask")).alias("n_trained"),
        F.size(mask_runs(F.col("loss_mask"))).alias("n_turns"), calls.alias("n_calls"), F.size(results).alias("n_results"), errors.alias("n_errors"),
    )
    return rows.groupBy("trace_id").agg(*[F.min(c).alias(c) for c in rows.columns if c != "trace_id"])


def order_statistics(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, min, p25, med, p75, max, mean (one decimal) of the non-null values.

    The quartiles are the elements at n div 4, n div 2 and 3n div 4 of the sorted values. Values are
    counted first, so that only distinct ones of a group are sorted and summed up.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    whole = Window.partitionBy(group)
    upto = counted.withColumn("upto", F.sum("c").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.sum("c").over(whole))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col(value)))
    return upto.groupBy(group).agg(
        F.max("n").alias("n"), F.min(value).alias("min"), at(F.floor(F.col("n") / 4)).alias("p25"), at(F.floor(F.col("n") / 2)).alias("med"), at(F.floor(F.col("n") * 3 / 4)).alias("p75"),
        F.max(value).alias("max"), F.round(F.sum(F.col(value) * F.col("c")) / F.max("n"), 1).alias("mean"),
    )


def tool_calls(traces: DataFrame) -> DataFrame:
    """The calls of the responses with the result that answers each: trace_id, message_no, call_no, call_id, name, answered, ok.

    The result is the last one with the call's id; ok if its text doesn't begin with Error.
    """
    m = traces.select("trace_id", F.posexplode("response_messages").alias("message_no", "m"))
    calls = m.select("trace_id", "message_no", F.posexplode("m.tool_calls").alias("call_no", "c")).select("trace_id", "message_no", "call_no", F.col("c.id").alias("call_id"), F.col("c.function.name").alias("name")).distinct()
    answers = m.where("m.role = 'tool'").groupBy("trace_id", F.col("m.tool_call_id").alias("call_id")).agg(F.max_by(F.col("m.content"), F.col("message_no")).alias("text"))
    joined = calls.join(answers.withColumn("answered", F.lit(True)), ["trace_id", "call_id"], "left")
    ok = F.col("answered") & ~F.coalesce(F.ltrim(F.col("text")).startswith("Error"), F.lit(False))
    return joined.select("trace_id", "message_no", "call_no", "call_id", "name", F.coalesce("answered", F.lit(False)).alias("answered"), F.coalesce(ok, F.lit(False)).alias("ok"))


def tool_outcomes(traces: DataFrame) -> DataFrame:
    """By tool: calls, ok, failed, unanswered."""
    c = tool_calls(traces)
    return c.groupBy("name").agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.count_if(F.col("answered") & ~F.col("ok")).alias("failed"), F.count_if(~F.col("answered")).alias("unanswered"))


def finish_histogram(traces: DataFrame) -> DataFrame:
    """Distinct traces by finish reason."""
    return once(traces, "trace_id", ["finish_reason"]).groupBy("finish_reason").agg(F.count("*").alias("n"))


def length_stopped(traces: DataFrame) -> DataFrame:
    """Sessions, and those with any trace stopped by length."""
    per = traces.where("session_id IS NOT NULL").groupBy("session_id").agg(F.max(F.coalesce(F.col("finish_reason") == "length", F.lit(False))).alias("hit"))
    return per.agg(F.count("*").alias("sessions"), F.count_if("hit").alias("length_stopped"))


def citation_rewards(traces: DataFrame) -> DataFrame:
    """trace_id, cutoff, n_cited, n_valid, reward: the share of the last answer's citations that lie in 1 .. the timestep; 0 without any."""
    answers = F.filter("response_messages", lambda m: F.coalesce(m["role"] == "assistant", F.lit(False)))
    pages = F.coalesce(citations(flat_content(F.try_element_at(F.filter(answers, lambda m: m["content"].isNotNull()), F.lit(-1))["content"])), F.array().cast("array<int>"))
    rows = traces.select("trace_id", F.col("timestep").alias("cutoff"), F.when(F.size(answers) > 0, pages).otherwise(F.array().cast("array<int>")).alias("pages"))
    rows = rows.select("trace_id", "cutoff", F.greatest(F.size("pages"), F.lit(0)).alias("n_cited"), F.greatest(F.size(F.filter("pages", lambda p: F.coalesce((p >= 1) & (p <= F.col("cutoff")), F.lit(False)))), F.lit(0)).alias("n_valid"))
    return once(rows, "trace_id", ["cutoff", "n_cited", "n_valid"]).withColumn("reward", F.round(F.when(F.col("n_cited") > 0, F.col("n_valid") / F.col("n_cited")).otherwise(0.0), 6))


def advantages(rewards: DataFrame, key: str, group: str, reward: str = "reward") -> DataFrame:
    """key, group, grpo, loo: each reward against its group.

    grpo: less the mean, over the sample deviation plus EPSILON; loo: less the others' mean, over
    their deviation plus EPSILON. A reward alone in its group is its own advantage; two have no
    deviation of others, which counts as 0. Groups are summed and joined back, not windowed.
    """
    r = rewards.where(F.col(reward).isNotNull()).select(key, group, F.col(reward).cast("double").alias("r"))
    counted = r.groupBy(F.col(group).alias("__g"), "r").agg(F.count("*").alias("c"))
    sums = counted.groupBy("__g").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("r")).alias("s"), F.sum(F.col("c") * F.col("r") * F.col("r")).alias("q"),
        F.min("r").alias("lo"), F.max("r").alias("hi"), F.min_by("c", "r").alias("n_lo"), F.max_by("c", "r").alias("n_hi"),
    )
    j = r.join(sums, F.col(group).eqNullSafe(F.col("__g")))
    n, s, q, x, lo, hi = (F.col(c) for c in ("n", "s", "q", "r", "lo", "hi"))
    # Equal rewards deviate by nothing, not by what rounding leaves of the difference of sums.
    others_equal = (lo == hi) | ((F.col("n_hi") == n - 1) & (x < hi)) | ((F.col("n_lo") == n - 1) & (x > lo))
    sd = F.when(lo == hi, 0.0).otherwise(F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))))
    grpo = F.when(n == 1, x).otherwise((x - s / n) / (sd + EPSILON))
    mean = (s - x) / (n - 1)
    var = F.when((n <= 2) | others_equal, 0.0).otherwise(F.greatest(((q - x * x) - (n - 1) * mean * mean) / (n - 2), F.lit(0.0)))
    loo = F.when(n == 1, x).otherwise((x - mean) / (F.sqrt(var) + EPSILON))
    return j.select(key, group, grpo.alias("grpo"), loo.alias("loo"))


def logprob_delta(rows: DataFrame, keys: list[str], a: str, b: str, mask: str, tolerance: float = 0.2) -> DataFrame:
    """keys, n, mean, max, over: absolute differences at trained positions that both arrays have."""
    at = F.filter(indices(F.col(mask)), lambda i: F.coalesce(F.get(mask, i) == 1, F.lit(False)) & F.get(a, i).isNotNull() & F.get(b, i).isNotNull())
    rows = rows.select(*keys, F.transform(at, lambda i: F.abs(F.get(a, i) - F.get(b, i))).alias("d"))
    n = F.size("d")
    return rows.where(n > 0).select(
        *keys, n.alias("n"), F.round(F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / n, 6).alias("mean"), F.round(F.array_max("d"), 6).alias("max"),
        F.size(F.filter("d", lambda x: x > tolerance)).alias("over"),
    )


def collection(traces: DataFrame, by: str) -> DataFrame:
    """By group: traces, responses' mean, least and greatest length, trained ids, rewards not 0."""
    e = episodes(traces)
    return e.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg("n_response"), 4).alias("mean_response"), F.min("n_response").alias("min_response"), F.max("n_response").alias("max_response"),
        F.sum("n_trained").alias("n_trained"), F.count_if(F.col("reward") != 0).alias("rewarded"), F.count("reward").alias("graded"),
    )


def marked_tokens(traces: DataFrame, opens: int, closes: int) -> DataFrame:
    """Of each distinct trace the ids in stretches between two marks: trace_id, blocks, inside, trained_inside, share of the trained ids."""
    on = lambda i: F.coalesce(F.get("loss_mask", i) == 1, F.lit(False))
    s = segments(F.col("response_ids"), opens, closes)
    inside = F.aggregate(s, F.lit(0), lambda n, x: n + x["end"] - x["start"])
    within = F.aggregate(s, F.lit(0), lambda n, x: n + F.size(F.filter(F.sequence(x["start"], x["end"] - 1), on)))
    rows = traces.select("trace_id", F.greatest(F.size(s), F.lit(0)).alias("blocks"), F.coalesce(inside, F.lit(0)).alias("inside"), F.coalesce(within, F.lit(0)).alias("trained_inside"), trained(F.col("loss_mask")).alias("n"))
    one = once(rows, "trace_id", ["blocks", "inside", "trained_inside", "n"])
    return one.withColumn("share", F.round(F.when(F.col("n") > 0, F.col("trained_inside") / F.col("n")).otherwise(0.0), 6)).drop("n")


def opening_kinds(rows: DataFrame, keys: list[str], kinds: dict[str, list[int]]) -> DataFrame:
    """keys, kind, n: the turns of each row by the first of ``kinds`` (name to ids) that the ids before them end with, else other."""
    most = max(map(len, kinds.values()))
    none = F.array().cast("array<int>")
    prompt, response = F.coalesce("prompt_ids", none), F.coalesce("response_ids", none)

    def before(r):
        """No more of what stands before a run than the longest of ``kinds`` needs."""
        short = F.greatest(F.lit(most) - r["start"], F.lit(0))
        lead = F.slice(prompt, F.greatest(F.size(prompt) - short + 1, F.lit(1)), short)
        return F.concat(lead, F.slice(response, F.greatest(r["start"] - most + 1, F.lit(1)), F.least(r["start"], F.lit(most))))

    name = lambda a: F.coalesce(*[F.when(ends_with(a, F.array(*[F.lit(x) for x in t])), F.lit(k)) for k, t in kinds.items()], F.lit("other"))
    told = F.transform(mask_runs(F.col("loss_mask")), lambda r: let(before(r), name))
    return rows.select(*keys, F.explode(told).alias("kind")).groupBy(*keys, "kind").agg(F.count("*").alias("n"))

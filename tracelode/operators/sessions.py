"""Sessions as wholes: completion filter, hoisted metadata, summaries, request differences, golden comparison, leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.arrays import first_divergence, indices, let, mask_runs
from tracelode.functions.kernels import segments

# --- completions --------------------------------------------------------------------------------


def completion_filter(log: DataFrame, keys: list[str], messages: Column, response: Column) -> DataFrame:
    """Completions with why they are dropped: ``log``'s columns, kept, reason.

    An agent's completion has two messages or more, a system one among them, and an answer; the first of these that lacks is the reason.
    """
    system = F.exists(messages, lambda m: F.coalesce(m["role"] == "system", F.lit(False)))
    reason = F.when(F.coalesce(F.size(messages), F.lit(0)) < 2, "single_message").when(~F.coalesce(system, F.lit(False)), "no_system").when(F.coalesce(F.size(response), F.lit(0)) <= 0, "no_response")
    return log.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def excluded_findings(filtered: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """A12 for each session with dropped completions: keys, finding, the completions' names in their order."""
    gone = filtered.where("NOT kept").groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(order, F.col(name).cast("string").alias("name")))).alias("x"))
    return gone.select(*keys, F.concat(F.lit("A12:completion_filter_excluded_nonempty:"), F.array_join(F.transform("x", lambda e: e["name"]), ",")).alias("finding"))


def hoisted(traces: DataFrame, keys: list[str]) -> DataFrame:
    """The first completion's metadata of each trace, and those of all: keys, session_id, completion_id, completion_ids, n_completions."""
    ids = F.coalesce(F.array_join(F.transform("metadata.completion_metadata", lambda c: c["completion_id"]), ","), F.lit(""))
    first = F.get("metadata.completion_metadata", F.lit(0))
    return traces.select(*keys, first["session_id"].alias("session_id"), first["completion_id"].alias("completion_id"), ids.alias("completion_ids"), F.greatest(F.size("metadata.completion_metadata"), F.lit(0)).alias("n_completions"))


# --- summaries ----------------------------------------------------------------------------------


def episode_summary(deliveries: DataFrame, traces: DataFrame) -> DataFrame:
    """One row: deliveries, completed ones, those whose chains aren't one, traces, tasks, tasks with a success (a reward above 0)."""
    d = deliveries.agg(
        F.count("*").alias("deliveries"), F.count_if(F.col("status") == "COMPLETED").alias("completed"),
        F.count_if(F.col("trajectory.metadata.reconstruction_stats.chains_total") != 1).alias("chains_ne_1"),
    )
    per = traces.groupBy("task_id").agg(F.max(F.coalesce(F.col("reward") > 0, F.lit(False))).alias("hit"), F.count_distinct("trace_id").alias("n"))
    t = per.agg(F.sum("n").alias("traces"), F.count("*").alias("tasks"), F.count_if("hit").alias("tasks_with_success"))
    return d.join(F.broadcast(t))  # one row each


def session_tools(calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """Of each session a map from tool to its ok and failed calls: session_id, tools. ``calls`` as ``tool_calls`` has them; ``sessions``: trace_id, session_id."""
    per = calls.join(sessions, "trace_id").where("name IS NOT NULL").groupBy("session_id", "name").agg(F.count_if("ok").alias("ok"), F.count_if(F.col("answered") & ~F.col("ok")).alias("err"))
    pairs = F.array_sort(F.collect_list(F.struct("name", F.struct("ok", "err").alias("n"))))
    return per.groupBy("session_id").agg(F.map_from_entries(pairs).alias("tools"))


def collection_statistics(rows: DataFrame, by: str) -> DataFrame:
    """By group: traces, least, median (element n div 2), mean and greatest response length, trained ids, rate of zero logprobs at trained positions.

    Lengths are counted first, so that a group's values are sorted as distinct ones only.
    """
    from pyspark.sql import Window

    mask, lp = F.coalesce("loss_mask", F.array().cast("array<int>")), F.col("response_logprobs")
    on = lambda i: F.coalesce(F.get(mask, i) == 1, F.lit(False))
    r = rows.select(
        by, F.greatest(F.size("response_ids"), F.lit(0)).alias("len"), F.size(F.filter(mask, lambda x: F.coalesce(x == 1, F.lit(False)))).alias("trained"),
        F.size(F.filter(indices(lp), on)).alias("told"), F.size(F.filter(indices(lp), lambda i: on(i) & (F.get(lp, i) == 0))).alias("zeros"),
    )
    counted = r.groupBy(by, "len").agg(F.count("*").alias("c"), *[F.sum(x).alias(x) for x in ("trained", "told", "zeros")])
    whole = Window.partitionBy(by)
    upto = counted.withColumn("upto", F.sum("c").over(whole.orderBy("len").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.sum("c").over(whole))
    out = upto.groupBy(by).agg(
        F.max("n").alias("n"), F.min("len").alias("min"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("len"))).alias("median"), F.round(F.sum(F.col("len") * F.col("c")) / F.max("n"), 3).alias("mean"),
        F.max("len").alias("max"), F.sum("trained").alias("trained"), F.sum("told").alias("told"), F.sum("zeros").alias("zeros"),
    )
    return out.withColumn("zero_rate", F.round(F.when(F.col("told") > 0, F.col("zeros") / F.col("told")).otherwise(0.0), 6)).drop("told", "zeros")


def importance(rows: DataFrame, by: str, old: str, new: str, mask: str) -> DataFrame:
    """By group over the trained positions that both arrays have: n, effective sample size over n, KL (mean of old less new), chi squared (mean of squared ratios less 1)."""
    at = F.filter(indices(F.col(mask)), lambda i: F.coalesce(F.get(mask, i) == 1, F.lit(False)) & F.get(old, i).isNotNull() & F.get(new, i).isNotNull())
    d = rows.select(by, F.explode(F.transform(at, lambda i: F.get(new, i) - F.get(old, i))).alias("d")).withColumn("r", F.exp("d"))
    s = d.groupBy(by).agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.sum(F.col("r") * F.col("r")).alias("q"), F.sum("d").alias("d"))
    return s.select(by, "n", F.round(F.col("r") * F.col("r") / F.col("q") / F.col("n"), 6).alias("ess"), F.round(-F.col("d") / F.col("n"), 6).alias("kl"), F.round(F.col("q") / F.col("n") - 1, 6).alias("chi2"))


def mode_counts(traces: DataFrame, key: str, opens: int, closes: int, tails: list[int]) -> DataFrame:
    """Of each distinct trace: stretches between two marks, their ids that are trained and not, turns, turns that open after one of ``tails``."""
    s = segments(F.col("response_ids"), opens, closes)
    on = lambda i: F.coalesce(F.get("loss_mask", i) == 1, F.lit(False))
    rows = traces.withColumn("s", s).withColumn("runs", mask_runs(F.col("loss_mask")))
    inside = F.coalesce(F.aggregate("s", F.lit(0), lambda n, x: n + x["end"] - x["start"]), F.lit(0))
    within = F.coalesce(F.aggregate("s", F.lit(0), lambda n, x: n + F.size(F.filter(F.sequence(x["start"], x["end"] - 1), on))), F.lit(0))
    last = lambda r: F.when(r["start"] > 0, F.get("response_ids", r["start"] - 1)).otherwise(F.try_element_at("prompt_ids", F.lit(-1)))
    tailed = F.size(F.filter("runs", lambda r: F.coalesce(last(r).isin(*tails), F.lit(False))))
    out = rows.select(key, F.greatest(F.size("s"), F.lit(0)).alias("spans"), within.alias("at_mask1"), (inside - within).alias("at_mask0"), F.size("runs").alias("turns"), tailed.alias("tails"))
    return out.groupBy(key).agg(*[F.min(c).alias(c) for c in out.columns if c != key])


# --- comparison ---------------------------------------------------------------------------------


def golden_comparison(pairs: DataFrame, keys: list[str], tolerance: float = 0.2) -> DataFrame:
    """Each pair of a golden trace (struct ``g``) and another (``o``), step by step: keys, step, detail.

    The steps are the prompt, the mask, each trained run's ids, and the logprobs; the first that fails ends the comparison
    and is named with where it fails (an index, or the run's number from 1); a pair without fault has step ``same``.
    """
    g, o = F.col("g"), F.col("o")
    runs = mask_runs(g["loss_mask"])
    cut = lambda t, r: F.slice(t["response_ids"], r["start"] + 1, r["end"] - r["start"])
    bad = let(runs, lambda r: F.get(F.filter(indices(r), lambda k: ~cut(g, F.get(r, k)).eqNullSafe(cut(o, F.get(r, k)))), F.lit(0)))
    far = F.get(F.filter(indices(g["response_logprobs"]), lambda i: F.abs(F.get(g["response_logprobs"], i) - F.get(o["response_logprobs"], i)) > tolerance), F.lit(0))
    none = F.array().cast("array<int>")
    prompt = first_divergence(F.coalesce(g["prompt_ids"], none), F.coalesce(o["prompt_ids"], none))
    mask = first_divergence(F.coalesce(g["loss_mask"], none), F.coalesce(o["loss_mask"], none))
    step = F.when(prompt.isNotNull(), F.struct(F.lit("prompt").alias("step"), prompt.alias("detail"))).when(mask.isNotNull(), F.struct(F.lit("mask").alias("step"), mask.alias("detail")))
    step = step.when(bad.isNotNull(), F.struct(F.lit("run").alias("step"), (bad + 1).alias("detail"))).when(far.isNotNull(), F.struct(F.lit("logprob").alias("step"), far.alias("detail")))
    return pairs.select(*keys, F.coalesce(step, F.struct(F.lit("same").alias("step"), F.lit(None).cast("int").alias("detail"))).alias("s")).select(*keys, "s.*")


def request_diff(rows: DataFrame, key: str, forms: dict[str, Column]) -> DataFrame:
    """How the JSON objects of several forms of a request differ: key, member, forms (those that have it), equal (where they do, in all alike).

    Only members that not all forms have, or that differ, are rows; values are compared as texts.
    """
    names = list(forms)
    maps = rows.select(key, *[F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")).alias(n) for n, c in forms.items()])
    members = F.array_distinct(F.flatten(F.array(*[F.map_keys(n) for n in names])))
    m = maps.select(key, *names, F.explode(members).alias("member"))
    have = F.array_join(F.filter(F.array(*[F.when(F.array_contains(F.map_keys(n), F.col("member")), F.lit(n)) for n in names]), lambda x: x.isNotNull()), ",")
    values = F.array_distinct(F.array(*[F.col(n)[F.col("member")] for n in names]))
    equal = F.size(F.filter(values, lambda v: v.isNotNull())) <= 1
    return m.select(key, "member", have.alias("forms"), equal.alias("equal")).where((F.col("forms") != ",".join(names)) | ~F.col("equal"))


def leaks(rows: DataFrame, key: str, text: str, own: str, known: DataFrame, pattern: str) -> DataFrame:
    """Names that a row's text holds although they aren't its own: key, leaked. ``known``: one column of names, all of which match ``pattern``.

    Candidates are cut out by the pattern and joined by equality, so that no text meets every name.
    """
    name = known.columns[0]
    found = rows.where(F.col(text).isNotNull()).select(key, F.col(own).alias("__own"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))).alias("leaked"))
    return found.where(~F.col("leaked").eqNullSafe(F.col("__own"))).join(known.select(F.col(name).alias("leaked")).distinct(), "leaked", "left_semi").select(key, "leaked")


# --- projections --------------------------------------------------------------------------------


def log_fields(lines: DataFrame, keys: list[str], line: str, fields: list[str]) -> DataFrame:
    """The configured members of JSON log lines, in their configured order, as texts; lines that are no object are left out."""
    whole = lines.where(F.col(line).rlike(r"^\s*\{.*\}\s*\z"))
    return whole.select(*keys, F.from_json(line, "map<string,string>").alias("m")).where("m IS NOT NULL").select(*keys, *[F.col("m")[f].alias(f) for f in fields])


def document(rows: DataFrame, key: str, template: dict) -> DataFrame:
    """Each row as a nested JSON document: key, request. In ``template`` columns stand for themselves, other values are constants, empty structures are left out."""

    def build(value) -> Column:
        if isinstance(value, Column):
            return value
        if isinstance(value, dict):
            return F.struct(*[build(v).alias(k) for k, v in value.items() if isinstance(v, Column) or v != {}])
        if isinstance(value, (list, tuple)):
            return F.array(*[build(v) for v in value])
        return F.lit(value)

    return rows.select(key, F.to_json(build(template)).alias("request"))


# --- refs ---------------------------------------------------------------------------------------


def refs(lines: DataFrame, line: str, pattern: str) -> DataFrame:
    """Listed refs, one ``<id> <ref>`` a line: ref, id, t (the number that ``pattern`` captures, null for other refs). Other lines are left out."""
    whole = r"^([0-9a-f]{40})\s+(\S+)\s*$"
    found = lines.where(F.col(line).rlike(whole)).select(F.regexp_extract(line, whole, 2).alias("ref"), F.regexp_extract(line, whole, 1).alias("id"))
    return found.select("ref", "id", F.regexp_extract("ref", pattern, 1).try_cast("int").alias("t"))

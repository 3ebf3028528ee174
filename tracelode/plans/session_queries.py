"""Queries over sessions as wholes, and over inputs with planted faults, each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.text import END, TOOL, stub_logprobs
from tracelode.operators import analytics as A
from tracelode.operators import compare as K
from tracelode.operators import corpus as C
from tracelode.operators import rules as R
from tracelode.operators import sessions as S
from tracelode.operators import trajectory as J
from tracelode.plans import trace_queries as T
from tracelode.plans.corpus_queries import _ROWS
from tracelode.sources.tables import table

_KEYS = ["delivery_id", "trace_no"]


def _once(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "traces").dropDuplicates(["trace_id"])


def completion_filter(spark: SparkSession, root: str) -> DataFrame:
    t = _once(spark, root).where("session_id IS NOT NULL")
    return S.completion_filter(t, ["session_id"], F.col("prompt_messages"), F.col("response_ids")).select("session_id", "trace_id", "kept", "reason")


def excluded_completions(spark: SparkSession, root: str) -> DataFrame:
    return S.excluded_findings(completion_filter(spark, root), ["session_id"], "trace_id", "trace_id")


def log_findings(spark: SparkSession, root: str) -> DataFrame:
    """Session findings over a log made of traces: every seventh has two choices, the split stands for the roster, the finish reason for the policy; no end mark is configured."""
    t = completion_filter(spark, root).join(_once(spark, root).select("trace_id", "split", "finish_reason"), "trace_id")
    log = t.select("session_id", F.col("trace_id").alias("seq"), F.col("trace_id").cast("string").alias("completion_id"), F.when(F.col("trace_id") % 7 == 0, 2).otherwise(1).alias("n_choices"), F.col("kept").alias("agent_shaped"), F.col("split").alias("roster"), F.col("finish_reason").alias("policy"))
    return J.log_findings(log, ["session_id"], None)


def session_faults(spark: SparkSession, root: str) -> DataFrame:
    """Session findings over completions with faults planted: the first turn of each trace comes twice, the first time without an answer."""
    c = T._completions(spark, root)
    first = c.where("seq = 0").withColumn("seq", F.lit(-1)).withColumn("response_ids", F.array().cast("array<int>"))
    return J.session_findings(c.unionByName(first), _KEYS)


def metadata_hoist(spark: SparkSession, root: str) -> DataFrame:
    return S.hoisted(T._delivered(spark, root).drop("session_id"), _KEYS)


def episode_summary(spark: SparkSession, root: str) -> DataFrame:
    return S.episode_summary(table(spark, root, "pi_polar_task_status"), table(spark, root, "traces"))


def session_tools(spark: SparkSession, root: str) -> DataFrame:
    """By session and tool, opened from the map."""
    m = S.session_tools(A.tool_calls(table(spark, root, "traces")), _once(spark, root).where("session_id IS NOT NULL").select("trace_id", "session_id"))
    return m.select("session_id", F.explode("tools").alias("name", "n")).select("session_id", "name", "n.ok", "n.err")


def collection_statistics(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "pi_polar_task_status").select("delivery_id", "session_id", F.coalesce("status", F.lit("none")).alias("outcome"), "trajectory")
    t = d.select("outcome", F.explode("trajectory.traces").alias("t")).where("t IS NOT NULL").select("outcome", "t.*")
    return S.collection_statistics(t, "outcome")


def importance_statistics(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "pi_polar_task_status").select(F.coalesce("status", F.lit("none")).alias("outcome"), F.explode("trajectory.traces").alias("t")).where("t.response_logprobs IS NOT NULL").select("outcome", "t.*")
    return S.importance(d.withColumn("replayed", stub_logprobs(F.col("response_ids"))), "outcome", "response_logprobs", "replayed", "loss_mask")


def mode_verification(spark: SparkSession, root: str) -> DataFrame:
    return S.mode_counts(table(spark, root, "traces"), "trace_id", TOOL, END, [258])


def golden_comparison(spark: SparkSession, root: str) -> DataFrame:
    """Every delivered trace against itself with a fault planted by its id: a prompt id, the last mask, the last trained id, a logprob, or none."""
    t = T._turned(spark, root).where("size(prompt_ids) > 2 AND size(response_ids) > 0 AND size(loss_mask) = size(response_ids) AND element_at(loss_mask, -1) = 1 AND size(response_logprobs) = size(response_ids)")
    t = t.select(*_KEYS, F.struct("prompt_ids", "response_ids", "loss_mask", "response_logprobs").alias("g"))
    g, k = F.col("g"), F.col("delivery_id") % 5
    head = lambda a: F.slice(a, F.lit(1), F.size(a) - 1)
    o = F.struct(
        F.when(k == 0, F.concat(F.slice(g["prompt_ids"], 1, 2), F.array(F.lit(-1)), F.slice(g["prompt_ids"], F.lit(4), F.size(g["prompt_ids"])))).otherwise(g["prompt_ids"]).alias("prompt_ids"),
        F.when(k == 2, F.concat(head(g["response_ids"]), F.array(F.lit(-1)))).otherwise(g["response_ids"]).alias("response_ids"),
        F.when(k == 1, F.concat(head(g["loss_mask"]), F.array(F.lit(0)))).otherwise(g["loss_mask"]).alias("loss_mask"),
        F.when(k == 3, F.concat(F.array(F.lit(-50.0)), F.slice(g["response_logprobs"], F.lit(2), F.size(g["response_logprobs"])))).otherwise(g["response_logprobs"]).alias("response_logprobs"),
    )
    return S.golden_comparison(t.withColumn("o", o), _KEYS)


def request_forms(spark: SparkSession, root: str) -> DataFrame:
    """Three forms of each task's request: as written, with its image in place of its split and every even timestep raised, and without its prompt on the wire."""
    t = table(spark, root, "tasks")
    step = F.when(F.col("timestep") % 2 == 0, F.col("timestep") + 1).otherwise(F.col("timestep"))
    js = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]))
    c = F.col
    return S.request_diff(t, "task_id", {
        "original": js(case_id=c("case_id"), timestep=c("timestep"), prompt_id=c("prompt_id"), split=c("split")), "transformed": js(case_id=c("case_id"), timestep=step, prompt_id=c("prompt_id"), image=c("sandbox_image")),
        "wire": js(case_id=c("case_id"), timestep=step, image=c("sandbox_image")),
    })


def case_id_leaks(spark: SparkSession, root: str) -> DataFrame:
    """Cases of the task table that documents of other cases name."""
    return S.leaks(table(spark, root, "documents"), "doc_id", "text", "case_id", table(spark, root, "tasks").select("case_id"), r"case_[0-9]{6}")


def log_fields(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "documents").where("kind = 'log' AND text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return S.log_fields(lines, ["doc_id", "line_no"], "line", ["tool", "k", "event"]).where("event = 'tool_call'")


def request_documents(spark: SparkSession, root: str) -> DataFrame:
    """The whole request document of each task, shown by members of each of its sections."""
    c = F.col
    template = {
        "task_id": c("task_id"), "instruction": F.coalesce("prompt_text", "skill_card_text"), "num_samples": 1, "timeout_seconds": 900.0,
        "metadata": {"case_id": c("case_id"), "timestep": c("timestep"), "prompt_source": c("prompt_source")}, "runtime": {"image": c("sandbox_image"), "network": "bridge"},
        "agent": {"name": "agent", "settings": {"case_id": c("case_id"), "timestep": c("timestep"), "tools": ["read", "search"], "limits": {"context": 32768, "tokens": 8192}}},
        "builder": {"strategy": "prefix_merging", "config": {"end": END, "glue": [270, 271]}}, "callback": F.concat(F.lit("http://receiver/callbacks/"), c("task_id")),
    }
    r = S.document(table(spark, root, "tasks"), "task_id", template)
    paths = {"instruction": "$.instruction", "timestep": "$.agent.settings.timestep", "tools": "$.agent.settings.tools", "tokens": "$.agent.settings.limits.tokens", "glue": "$.builder.config.glue", "callback": "$.callback", "source": "$.metadata.prompt_source", "timeout": "$.timeout_seconds"}
    return r.select("task_id", *[F.get_json_object("request", p).alias(n) for n, p in paths.items()])


def git_refs(spark: SparkSession, root: str) -> DataFrame:
    """Refs listed for each case's timesteps, some lines of them broken: what is read of them."""
    t = table(spark, root, "tasks").select("case_id", "timestep").distinct()
    ref = F.concat(F.lit("refs/heads/"), F.when(F.col("timestep") % 5 == 0, F.lit("draft-")).otherwise(F.lit("timestep-")), F.col("timestep").cast("string"))
    line = F.concat(F.when(F.col("timestep") % 7 == 0, F.lit("?")).otherwise(F.sha1(F.concat("case_id", F.lit("/"), F.col("timestep").cast("string")))), F.lit("\t"), ref)
    return S.refs(t.select(line.alias("line")), "line", r"^refs/heads/timestep-([0-9]+)$")


def census_pages(spark: SparkSession, root: str) -> DataFrame:
    """Each case's pages, all of them, as the documents have them against those of the chunks."""
    pages = lambda name: table(spark, root, name).where("case_id IS NOT NULL AND page IS NOT NULL").select("case_id", "page").distinct().groupBy("case_id").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    return K.census_diff(pages("documents"), pages("chunks"), "case_id", ["pages"])


def _faulty_tasks(spark: SparkSession, root: str) -> DataFrame:
    """The task table with a fault in some timesteps: no text, another source, a skill without card, another split, no timestep."""
    t, at = table(spark, root, "tasks"), F.col("timestep") % 6
    return t.select(
        "case_id", F.when(at == 5, F.lit(0)).otherwise(F.col("timestep")).alias("timestep"), "prompt_id", F.when(at == 4, "test").otherwise(F.col("split")).alias("split"),
        F.when(at == 2, "other").when(at == 3, "skill:new").otherwise(F.col("prompt_source")).alias("prompt_source"), F.when(at == 1, F.lit(None)).otherwise(F.col("prompt_text")).alias("prompt_text"), "skill_card_text",
    )


def task_row_faults(spark: SparkSession, root: str) -> DataFrame:
    return C.row_findings(_faulty_tasks(spark, root))


def split_overlap_faults(spark: SparkSession, root: str) -> DataFrame:
    """Cases in both splits, once every third timestep has gone over to eval."""
    t = table(spark, root, "tasks").withColumn("split", F.when(F.col("timestep") % 3 == 0, "eval").otherwise(F.col("split")))
    return C.cases_in_both(t)


def unknown_cases(spark: SparkSession, root: str) -> DataFrame:
    """Cases of chunks that the train split's tasks lack."""
    return C.outside(table(spark, root, "chunks"), table(spark, root, "tasks").where("split = 'train'"), "case_id")


QUERIES = {f.__name__: f for f in (
    completion_filter, excluded_completions, log_findings, session_faults, metadata_hoist, episode_summary, session_tools, collection_statistics, importance_statistics, mode_verification, golden_comparison,
    request_forms, case_id_leaks, log_fields, request_documents, git_refs, census_pages, task_row_faults, split_overlap_faults, unknown_cases)}

_FILTER = """f AS (SELECT session_id, trace_id, split, finish_reason, CASE WHEN coalesce(len(prompt_messages), 0) < 2 THEN 'single_message' WHEN len(list_filter(prompt_messages, lambda x: x.role = 'system')) = 0 THEN 'no_system'
  WHEN coalesce(len(response_ids), 0) = 0 THEN 'no_response' END AS reason FROM tr WHERE session_id IS NOT NULL)"""
# Stretches between marks: each opening mark that follows none that is still open, to the next closing mark.
_SPANS = f"""ev AS (SELECT trace_id, response_ids AS r, loss_mask AS m, coalesce(len(response_ids), 0) AS n, list_filter(range(1, coalesce(len(response_ids), 0) + 1), lambda i: response_ids[i] IN ({TOOL}, {END})) AS e, prompt_ids AS p, coalesce(len(loss_mask), 0) AS nm FROM tr),
st AS (SELECT *, list_filter(range(1, len(e) + 1), lambda k: r[e[k]] = {TOOL} AND (k = 1 OR r[e[k - 1]] = {END})) AS ks FROM ev),
sp AS (SELECT *, list_transform(ks, lambda k: [e[k], coalesce(list_filter(range(k + 1, len(e) + 1), lambda j: r[e[j]] = {END}).list_transform(lambda j: e[j])[1], n)]) AS spans FROM st),
inn AS (SELECT *, coalesce(list_sum(list_transform(spans, lambda s: s[2] - s[1] + 1)), 0)::INT AS inside, coalesce(list_sum(list_transform(spans, lambda s: len(list_filter(range(s[1], s[2] + 1), lambda i: m[i] = 1)))), 0)::INT AS within FROM sp)"""
T.ORACLE["tool_segments"] = f"WITH {T._T}, {_SPANS} SELECT trace_id, len(spans) AS n, inside AS ids FROM inn"
T.ORACLE["marked_tokens"] = f"WITH {T._T}, {_SPANS} SELECT trace_id, len(spans) AS blocks, inside, within AS trained_inside, round(CASE WHEN {T._NTRAIN} > 0 THEN within / {T._NTRAIN} ELSE 0 END, 6) AS share FROM inn"
# Arguments are JSON objects of plain texts and numbers, so that their canonical form is their members by name.
_STATS = f"""g AS (SELECT outcome, len(t.response_ids) AS len, {T._NTRAIN.replace('coalesce(m, [])', 'coalesce(t.loss_mask, [])')} AS trained,
  len(list_filter(range(1, coalesce(len(t.response_logprobs), 0) + 1), lambda i: t.loss_mask[i] = 1)) AS told, len(list_filter(range(1, coalesce(len(t.response_logprobs), 0) + 1), lambda i: t.loss_mask[i] = 1 AND t.response_logprobs[i] = 0)) AS zeros FROM o)"""
_OUT = "o AS (SELECT coalesce(status, 'none') AS outcome, unnest(trajectory.traces) AS t FROM pi_polar_task_status)"

ORACLE = {
    "completion_filter": f"WITH {T._T}, {_FILTER} SELECT session_id, trace_id, reason IS NULL AS kept, reason FROM f",
    "excluded_completions": f"WITH {T._T}, {_FILTER} SELECT session_id, 'A12:completion_filter_excluded_nonempty:' || string_agg(trace_id::VARCHAR, ',' ORDER BY trace_id) AS finding FROM f WHERE reason IS NOT NULL GROUP BY 1",
    "log_findings": f"""WITH {T._T}, {_FILTER}, w AS (SELECT session_id, count(DISTINCT coalesce(split, 'None')) AS rosters, list_sort(list(DISTINCT coalesce(finish_reason, 'None'))) AS ps FROM f GROUP BY 1)
SELECT session_id, 'S8:choices_len_ne_1:' || trace_id || ':2' AS finding FROM f WHERE trace_id % 7 = 0 UNION ALL SELECT session_id, 'A12:non_agent_shape:' || trace_id FROM f WHERE reason IS NOT NULL
UNION ALL SELECT session_id, 'A15:end_of_turn_token_id_not_configured' FROM w UNION ALL SELECT session_id, 'R11:roster_changed_across_completions' FROM w WHERE rosters > 1
UNION ALL SELECT session_id, 'S9:policy_version_mixed:' || array_to_string(ps, ',') FROM w WHERE len(ps) > 1""",
    "session_faults": T.ORACLE["session_findings"].replace("w AS (SELECT *, lag(cp)", "c2 AS (SELECT * FROM c UNION ALL SELECT delivery_id, trace_no, 0, -1, cp, []::INT[], fr, k FROM c WHERE q = 1), w AS (SELECT *, lag(cp)").replace("AS bp FROM c)", "AS bp FROM c2)").replace("q > 1 AND cp", "q > 0 AND cp"),
    "metadata_hoist": f"WITH {T._D} SELECT delivery_id, trace_no, md.completion_metadata[1].session_id AS session_id, md.completion_metadata[1].completion_id AS completion_id, coalesce(array_to_string(list_transform(md.completion_metadata, lambda c: c.completion_id), ','), '') AS completion_ids, coalesce(len(md.completion_metadata), 0) AS n_completions FROM d",
    "episode_summary": """SELECT (SELECT count(*) FROM pi_polar_task_status) AS deliveries, (SELECT count(*) FROM pi_polar_task_status WHERE status = 'COMPLETED') AS completed,
  (SELECT count(*) FROM pi_polar_task_status WHERE trajectory.metadata.reconstruction_stats.chains_total <> 1) AS chains_ne_1, sum(n)::BIGINT AS traces, count(*) AS tasks, count(*) FILTER (WHERE hit) AS tasks_with_success
FROM (SELECT task_id, bool_or(coalesce(reward > 0, false)) AS hit, count(DISTINCT trace_id) AS n FROM traces GROUP BY 1)""",
    "session_tools": T._CALLS + "SELECT tr.session_id, name, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE answered AND NOT ok) AS err FROM cj JOIN tr USING (trace_id) WHERE tr.session_id IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2",
    "collection_statistics": f"WITH {_OUT}, {_STATS.replace('FROM o)', 'FROM o WHERE t IS NOT NULL)').replace('len(t.response_ids) AS len', 'coalesce(len(t.response_ids), 0) AS len')}, l AS (SELECT outcome, list_sort(list(len)) AS v, sum(trained)::BIGINT AS trained, sum(told) AS told, sum(zeros) AS zeros FROM g GROUP BY 1) "
    "SELECT outcome, len(v) AS n, v[1] AS min, v[len(v) // 2 + 1] AS median, round(list_avg(v), 3) AS mean, v[-1] AS max, trained, round(CASE WHEN told > 0 THEN zeros / told ELSE 0 END, 6) AS zero_rate FROM l",
    "importance_statistics": f"""WITH {_OUT}, v AS (SELECT outcome, unnest(list_transform(list_filter(range(1, least(len(t.response_logprobs), coalesce(len(t.loss_mask), 0), coalesce(len(t.response_ids), 0)) + 1), lambda i: t.loss_mask[i] = 1 AND t.response_logprobs[i] IS NOT NULL),
  lambda i: -0.03125::DOUBLE * ((i - 1) % 7 + 1) - t.response_logprobs[i])) AS d FROM o WHERE t.response_logprobs IS NOT NULL)
SELECT outcome, count(*) AS n, round(sum(exp(d)) ** 2 / sum(exp(d) ** 2) / count(*), 6) AS ess, round(-sum(d) / count(*), 6) AS kl, round(sum(exp(d) ** 2) / count(*) - 1, 6) AS chi2 FROM v GROUP BY 1""",
    "mode_verification": f"WITH {T._T}, {_SPANS}, q AS (SELECT *, {T._STARTS} AS s FROM inn) SELECT trace_id, len(spans) AS spans, within AS at_mask1, inside - within AS at_mask0, len(s) AS turns, len(list_filter(s, lambda b: CASE WHEN b > 0 THEN r[b] ELSE p[-1] END = 258)) AS tails FROM q",
    "golden_comparison": f"""WITH {T._D}, k AS (SELECT delivery_id, trace_no, delivery_id % 5 AS q, len(m) AS n, m, len({T._STARTS}) AS runs FROM d WHERE len(p) > 2 AND len(r) > 0 AND len(m) = len(r) AND m[-1] = 1 AND (lp IS NULL OR len(lp) = len(r)))
SELECT delivery_id, trace_no, CASE q WHEN 0 THEN 'prompt' WHEN 1 THEN 'mask' WHEN 2 THEN 'run' WHEN 3 THEN 'logprob' ELSE 'same' END AS step, CASE q WHEN 0 THEN 2 WHEN 1 THEN n - 1 WHEN 2 THEN runs WHEN 3 THEN 0 END::INT AS detail FROM k""",
    "request_forms": """SELECT task_id, 'prompt_id' AS member, 'original,transformed' AS forms, true AS equal FROM tasks UNION ALL SELECT task_id, 'split', 'original', true FROM tasks WHERE split IS NOT NULL
UNION ALL SELECT task_id, 'image', 'transformed,wire', true FROM tasks UNION ALL SELECT task_id, 'timestep', 'original,transformed,wire', false FROM tasks WHERE timestep % 2 = 0""",
    "case_id_leaks": "WITH x AS (SELECT DISTINCT doc_id, case_id, unnest(regexp_extract_all(text, 'case_[0-9]{6}')) AS leaked FROM documents) SELECT doc_id, leaked FROM x WHERE leaked IS DISTINCT FROM case_id AND leaked IN (SELECT case_id FROM tasks)",
    "log_fields": r"""WITH l AS (SELECT doc_id, string_split(text, E'\n') AS ls FROM documents WHERE kind = 'log' AND text IS NOT NULL), x AS (SELECT doc_id, (k - 1)::INT AS line_no, ls[k] AS line FROM l, unnest(range(1, len(ls) + 1)) AS u(k)),
j AS (SELECT doc_id, line_no, line::JSON AS j FROM x WHERE json_valid(line)) SELECT doc_id, line_no, j ->> '$.tool' AS tool, j ->> '$.k' AS k, j ->> '$.event' AS event FROM j WHERE j ->> '$.event' = 'tool_call'""",
    "request_documents": """SELECT task_id, coalesce(prompt_text, skill_card_text) AS instruction, timestep::VARCHAR AS timestep, '["read","search"]' AS tools, '8192' AS tokens, '[270,271]' AS glue, 'http://receiver/callbacks/' || task_id AS callback, prompt_source AS source, '900.0' AS timeout FROM tasks""",
    "git_refs": """SELECT DISTINCT 'refs/heads/' || CASE WHEN timestep % 5 = 0 THEN 'draft-' ELSE 'timestep-' END || timestep AS ref, sha1(case_id || '/' || timestep) AS id, CASE WHEN timestep % 5 <> 0 THEN timestep::INT END AS t FROM (SELECT DISTINCT case_id, timestep FROM tasks) WHERE timestep % 7 <> 0""",
    "census_pages": """WITH d AS (SELECT case_id, list_sort(list(DISTINCT page)) AS p FROM documents WHERE case_id IS NOT NULL AND page IS NOT NULL GROUP BY 1), c AS (SELECT case_id, list_sort(list(DISTINCT page)) AS p FROM chunks WHERE case_id IS NOT NULL AND page IS NOT NULL GROUP BY 1)
SELECT case_id, 'not_wanted' AS finding FROM d ANTI JOIN c USING (case_id) UNION ALL SELECT case_id, 'not_served' FROM c ANTI JOIN d USING (case_id) UNION ALL SELECT d.case_id, 'differs:pages' FROM d JOIN c USING (case_id) WHERE d.p <> c.p""",
    "task_row_faults": """WITH doctored AS (SELECT case_id, CASE WHEN timestep % 6 = 5 THEN 0 ELSE timestep END AS timestep, prompt_id, CASE WHEN timestep % 6 = 4 THEN 'test' ELSE split END AS split,
  CASE timestep % 6 WHEN 2 THEN 'other' WHEN 3 THEN 'skill:new' ELSE prompt_source END AS prompt_source, CASE WHEN timestep % 6 = 1 THEN NULL ELSE prompt_text END AS prompt_text, skill_card_text FROM tasks) """ + _ROWS,
    "split_overlap_faults": "SELECT case_id FROM (SELECT case_id, CASE WHEN timestep % 3 = 0 THEN 'eval' ELSE split END AS split FROM tasks) WHERE split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "unknown_cases": "SELECT DISTINCT case_id FROM chunks WHERE case_id NOT IN (SELECT case_id FROM tasks WHERE split = 'train') OR case_id IS NULL",
}

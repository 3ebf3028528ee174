"""Queries over the task table and the case documents, each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import text as TX
from tracelode.functions.kernels import byte_ids
from tracelode.operators import compare as K
from tracelode.operators import corpus as C
from tracelode.sources.tables import table


def _tasks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "tasks")


def _doctored(spark: SparkSession, root: str) -> DataFrame:
    """The task table with defects: timestep 5 moved on, cost-split skills gone, one image renamed, the free prompts of eval doubled."""
    t = _tasks(spark, root).where("prompt_id <> 'skill:cost-split'")
    t = t.withColumn("timestep", F.when(F.col("timestep") == 5, F.col("timestep") + 1000).otherwise(F.col("timestep")))
    t = t.withColumn("sandbox_image", F.regexp_replace("sandbox_image", "r5$", "r6"))
    return t.unionByName(t.where("split = 'eval' AND prompt_source = 'free'"))


def task_table(spark: SparkSession, root: str) -> DataFrame:
    """The table rebuilt from its parts: cases, prompts, skill cards."""
    t = _tasks(spark, root)
    cases = t.groupBy("case_id").agg(F.min("split").alias("split"))
    name = F.regexp_extract("prompt_source", "^skill:(.*)$", 1)
    prompts = t.select("case_id", "timestep", "prompt_id", F.nullif(name, F.lit("")).alias("name"), F.col("prompt_text").alias("text"))
    cards = t.where("skill_card_text IS NOT NULL").groupBy(name.alias("name")).agg(F.min("skill_card_text").alias("card"))
    return C.task_table(cases, prompts, cards, "sandbox:base")


def task_rows(spark: SparkSession, root: str) -> DataFrame:
    return C.row_findings(_doctored(spark, root))


def task_table_diff(spark: SparkSession, root: str) -> DataFrame:
    return C.diff(_tasks(spark, root), _doctored(spark, root).distinct())


def task_verify(spark: SparkSession, root: str) -> DataFrame:
    return C.verify(_tasks(spark, root), _doctored(spark, root))


def task_duplicates(spark: SparkSession, root: str) -> DataFrame:
    return C.duplicates(_doctored(spark, root))


def task_row_at(spark: SparkSession, root: str) -> DataFrame:
    return C.row_at(_tasks(spark, root), 7)


def task_requests(spark: SparkSession, root: str) -> DataFrame:
    r = C.request(_tasks(spark, root), {"kind": "task", "version": 1})
    j = F.col("request")
    return r.select("task_id", *[F.get_json_object(j, p).alias(n) for n, p in (("case_id", "$.metadata.case_id"), ("image", "$.runtime.image"), ("prompt", "$.prompt.text"), ("kind", "$.kind"))])


def split_counts(spark: SparkSession, root: str) -> DataFrame:
    return C.split_counts(_tasks(spark, root))


def split_overlap(spark: SparkSession, root: str) -> DataFrame:
    """Cases whose traces are in more than one split."""
    return C.cases_in_both(table(spark, root, "traces"))


def cases_without_tasks(spark: SparkSession, root: str) -> DataFrame:
    return C.outside(table(spark, root, "chunks"), _tasks(spark, root), "case_id")


def page_census(spark: SparkSession, root: str) -> DataFrame:
    return C.page_census(table(spark, root, "chunks"))


def prefix_census(spark: SparkSession, root: str) -> DataFrame:
    """Whether chunks hold every page up to each task's timestep."""
    return K.prefix_census(table(spark, root, "chunks"), _tasks(spark, root))


def census_diff(spark: SparkSession, root: str) -> DataFrame:
    """Each case's pages as the documents have them against those of the chunks."""
    count = lambda name: table(spark, root, name).where("case_id IS NOT NULL AND page IS NOT NULL").groupBy("case_id").agg(F.countDistinct("page").alias("n_pages"), F.max("page").alias("max_page"))
    return K.census_diff(count("documents"), count("chunks"), "case_id", ["n_pages", "max_page"])


def task_bag_diff(spark: SparkSession, root: str) -> DataFrame:
    return K.bag_diff(_tasks(spark, root).select("case_id", "timestep", "prompt_id"), _doctored(spark, root).select("case_id", "timestep", "prompt_id"))


def prefix_divergence(spark: SparkSession, root: str) -> DataFrame:
    """Documents of one case and page, the versions in order of doc_id, as timesteps."""
    d = table(spark, root, "documents").where("case_id IS NOT NULL AND page IS NOT NULL AND text IS NOT NULL")
    t = (F.floor(F.col("doc_id") / 250) + 1).cast("bigint").alias("t")
    versions = d.groupBy("case_id", t, "page").agg(F.min(F.struct("doc_id", F.sha2("text", 256).alias("sha"))).alias("v")).select("case_id", "t", "page", "v.sha")
    return C.prefix_divergence(versions)


def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents")
    return d.select("doc_id", TX.sha256_text(F.col("text")).alias("sha256"), TX.git_blob_id(F.encode("text", "utf-8")).alias("blob_id"))


def identifiers(spark: SparkSession, root: str) -> DataFrame:
    t = _tasks(spark, root)
    return t.select("task_id", C.identifier(F.col("case_id"), "case").alias("case_ok"), C.identifier(F.col("prompt_id"), "prompt").alias("prompt_ok"), C.identifier(F.concat(F.lit("timestep-"), F.col("timestep").cast("string")), "timestep").alias("timestep_ok"), TX.env_name(F.col("case_id")).alias("env"))


def url_credentials(spark: SparkSession, root: str) -> DataFrame:
    t = _tasks(spark, root)
    url = F.concat(F.lit("https://user:p@ss@"), F.col("case_id"), F.lit(".example/v1/"), F.col("prompt_id"))
    return t.select("task_id", TX.strip_userinfo(url).alias("url"), TX.strip_userinfo(F.col("sandbox_image")).alias("image"))


def chunk_pages(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").where("text IS NOT NULL")
    w = d.select("doc_id", F.explode(TX.windows(F.col("text"))).alias("w"))
    return w.select("doc_id", F.col("w.chunk_idx").alias("chunk_idx"), F.col("w.n_words").alias("n_words"), F.sha2("w.text", 256).alias("sha256"))


def page_facts(spark: SparkSession, root: str) -> DataFrame:
    """The facts stated in documents."""
    d = table(spark, root, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.posexplode(TX.facts(F.col("text"))).alias("ord", "f")).select("doc_id", "ord", "f.*")


def split_mismatch(spark: SparkSession, root: str) -> DataFrame:
    """Cases of the traces whose split isn't that of the task table."""
    lock = _tasks(spark, root).groupBy("case_id").agg(F.min("split").alias("split"))
    return C.split_mismatch(table(spark, root, "traces"), lock)


def byte_stream(spark: SparkSession, root: str) -> DataFrame:
    ids = byte_ids(F.col("text"))
    return table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", ids.alias("ids")).select("doc_id", F.size("ids").cast("bigint").alias("n"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


QUERIES = {f.__name__: f for f in (
    task_table, task_rows, task_table_diff, task_verify, task_duplicates, task_row_at, task_requests, split_counts, split_overlap, cases_without_tasks, page_census, prefix_census, census_diff, task_bag_diff, prefix_divergence, content_hashes,
    identifiers, url_credentials, chunk_pages, page_facts, split_mismatch, byte_stream)}

_DOCTORED = """
WITH kept AS (SELECT * REPLACE (CASE WHEN timestep = 5 THEN timestep + 1000 ELSE timestep END AS timestep, regexp_replace(sandbox_image, 'r5$', 'r6') AS sandbox_image) FROM tasks WHERE prompt_id <> 'skill:cost-split'),
doctored AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE split = 'eval' AND prompt_source = 'free')"""
_DIFF = _DOCTORED + """,
d AS (SELECT DISTINCT * FROM doctored),
pair AS (SELECT coalesce(w.case_id, h.case_id) AS case_id, coalesce(w.timestep, h.timestep) AS timestep, coalesce(w.prompt_id, h.prompt_id) AS prompt_id, w AS w, h AS h, w.task_id AS wt, h.task_id AS ht
  FROM tasks w FULL OUTER JOIN d h ON w.case_id = h.case_id AND w.timestep = h.timestep AND w.prompt_id = h.prompt_id),
found AS (SELECT case_id, timestep, prompt_id, 'missing' AS finding FROM pair WHERE ht IS NULL UNION ALL SELECT case_id, timestep, prompt_id, 'extra' FROM pair WHERE wt IS NULL""" + "".join(
    f" UNION ALL SELECT case_id, timestep, prompt_id, 'differs:{c}' FROM pair WHERE ht IS NOT NULL AND wt IS NOT NULL AND w.{c} IS DISTINCT FROM h.{c}" for c in C.COMPARED) + ")"
_ROWS = """SELECT case_id, timestep, prompt_id, 'exactly_one_text' AS finding FROM doctored WHERE (prompt_text IS NULL) = (skill_card_text IS NULL)
UNION ALL SELECT case_id, timestep, prompt_id, 'skill_without_card' FROM doctored WHERE prompt_source LIKE 'skill:%' AND skill_card_text IS NULL
UNION ALL SELECT case_id, timestep, prompt_id, 'prompt_source:' || coalesce(prompt_source, 'None') FROM doctored WHERE coalesce(prompt_source, '') NOT LIKE 'skill:%' AND coalesce(prompt_source, '') <> 'free'
UNION ALL SELECT case_id, timestep, prompt_id, 'split:' || coalesce(split, 'None') FROM doctored WHERE split IS NULL OR split NOT IN ('train', 'eval')
UNION ALL SELECT case_id, timestep, prompt_id, 'timestep:' || coalesce(timestep::VARCHAR, 'None') FROM doctored WHERE timestep IS NULL OR timestep < 1"""
_WORDS = r"regexp_extract_all(text, '[ \t\r\n]*[^ \t\r\n]+')"

ORACLE = {
    "task_table": """SELECT case_id, timestep, prompt_id, min(split) OVER (PARTITION BY case_id) AS split, prompt_source, prompt_text,
  CASE WHEN prompt_text IS NULL THEN min(skill_card_text) OVER (PARTITION BY prompt_source) END AS skill_card_text, 'sandbox:base' AS sandbox_image FROM tasks""",
    "task_rows": _DOCTORED + " " + _ROWS,
    "task_table_diff": _DIFF + " SELECT case_id, timestep, prompt_id, finding FROM found",
    "task_verify": _DIFF + f""", n AS (SELECT regexp_extract(finding, '^[a-z]+') AS "check", count(*) AS n FROM found GROUP BY 1 UNION ALL SELECT 'duplicate', count(*) FROM (SELECT 1 FROM doctored GROUP BY case_id, timestep, prompt_id HAVING count(*) > 1)
UNION ALL SELECT 'row', count(*) FROM ({_ROWS}))
SELECT "check", coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) = 0 AS passed FROM (SELECT unnest(['missing', 'extra', 'differs', 'duplicate', 'row']) AS "check") LEFT JOIN n USING ("check")""",
    "task_duplicates": _DOCTORED + " SELECT case_id, timestep, prompt_id, count(*) AS n FROM doctored GROUP BY ALL HAVING count(*) > 1",
    "task_row_at": "SELECT * FROM tasks ORDER BY case_id, timestep, prompt_id LIMIT 1 OFFSET 7",
    "task_requests": "SELECT task_id, case_id, sandbox_image AS image, coalesce(prompt_text, skill_card_text) AS prompt, 'task' AS kind FROM tasks",
    "split_counts": "SELECT count(*) AS n_rows, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'eval') AS eval FROM tasks",
    "split_overlap": "SELECT case_id FROM traces WHERE split IS NOT NULL GROUP BY case_id HAVING count(DISTINCT split) > 1",
    "cases_without_tasks": "SELECT DISTINCT case_id FROM chunks WHERE case_id IS NOT NULL EXCEPT SELECT case_id FROM tasks",
    "page_census": """SELECT case_id, count(DISTINCT page) AS n_pages, max(page) AS max_page,
  array_to_string(list_filter(range(1, max(page)::BIGINT + 1), lambda p: NOT list_contains(list(DISTINCT page), p)), ',') AS missing, count(DISTINCT page) FILTER (WHERE page >= 1) = greatest(max(page), 0) AS contiguous
FROM chunks WHERE case_id IS NOT NULL AND page IS NOT NULL GROUP BY case_id""",
    "prefix_census": """WITH t AS (SELECT DISTINCT case_id, timestep FROM tasks), p AS (SELECT DISTINCT case_id, page FROM chunks)
SELECT t.case_id, timestep, count(page) AS n_pages, count(page) = timestep AS complete FROM t LEFT JOIN p ON p.case_id = t.case_id AND page BETWEEN 1 AND timestep GROUP BY t.case_id, timestep""",
    "census_diff": """WITH d AS (SELECT case_id, count(DISTINCT page) AS n, max(page) AS m FROM documents WHERE case_id IS NOT NULL AND page IS NOT NULL GROUP BY 1), c AS (SELECT case_id, count(DISTINCT page) AS n, max(page) AS m FROM chunks WHERE case_id IS NOT NULL AND page IS NOT NULL GROUP BY 1)
SELECT case_id, 'not_wanted' AS finding FROM d ANTI JOIN c USING (case_id) UNION ALL SELECT case_id, 'not_served' FROM c ANTI JOIN d USING (case_id)
UNION ALL SELECT d.case_id, 'differs:n_pages' FROM d JOIN c USING (case_id) WHERE d.n <> c.n UNION ALL SELECT d.case_id, 'differs:max_page' FROM d JOIN c USING (case_id) WHERE d.m <> c.m""",
    "task_bag_diff": _DOCTORED + """ SELECT 'a' AS side, * FROM (SELECT case_id, timestep, prompt_id FROM tasks EXCEPT ALL SELECT case_id, timestep, prompt_id FROM doctored)
UNION ALL SELECT 'b', * FROM (SELECT case_id, timestep, prompt_id FROM doctored EXCEPT ALL SELECT case_id, timestep, prompt_id FROM tasks)""",
    "prefix_divergence": """WITH v AS (SELECT case_id, doc_id // 250 + 1 AS t, page, sha256(arg_min(text, doc_id)) AS sha FROM documents WHERE case_id IS NOT NULL AND page IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
s AS (SELECT case_id, t, lead(t) OVER (PARTITION BY case_id ORDER BY t) AS next_t FROM (SELECT DISTINCT case_id, t FROM v))
SELECT a.case_id, a.t, s.next_t, a.page FROM v a JOIN s USING (case_id, t) JOIN v b ON b.case_id = a.case_id AND b.t = s.next_t AND b.page = a.page WHERE a.sha <> b.sha""",
    "content_hashes": "SELECT doc_id, sha256(text) AS sha256, CASE WHEN text IS NOT NULL THEN sha1(encode('blob ' || octet_length(encode(text))::VARCHAR) || '\\x00'::BLOB || encode(text)) END AS blob_id FROM documents",
    "identifiers": r"""SELECT task_id, regexp_full_match(case_id, '[a-z0-9][a-z0-9_-]*') AS case_ok, regexp_full_match(prompt_id, '[a-z0-9][a-z0-9:_-]*') AS prompt_ok, regexp_full_match('timestep-' || timestep, 'timestep-[1-9][0-9]*') AS timestep_ok,
  replace(upper(case_id), '-', '_') AS env FROM tasks""",
    "url_credentials": "SELECT task_id, 'https://' || case_id || '.example/v1/' || prompt_id AS url, sandbox_image AS image FROM tasks",
    "chunk_pages": rf"""WITH w AS (SELECT doc_id, text, {_WORDS} AS words FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, words, unnest(range(0, CASE WHEN len(words) <= 220 THEN 1 ELSE 1 + ((len(words) - 220 + 179) // 180) END)) AS i FROM w WHERE len(words) > 0)
SELECT doc_id, i AS chunk_idx, len(words[i * 180 + 1 : i * 180 + 220]) AS n_words, sha256(ltrim(array_to_string(words[i * 180 + 1 : i * 180 + 220], ''), E' \t\r\n')) AS sha256 FROM k
UNION ALL SELECT doc_id, 0, 0, sha256(text) FROM w WHERE len(words) = 0""",
    "page_facts": r"""WITH l AS (SELECT doc_id, list_filter(string_split(replace(replace(text, E'\r\n', E'\n'), E'\r', E'\n'), E'\n'), lambda x: regexp_matches(x, '^FACT-.+-[0-9]{4}-[0-9]+: [^\n]*$')) AS f FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (k - 1)::INT AS ord, regexp_extract(f[k], '^FACT-(.+)-([0-9]{4})-([0-9]+): (.*)$', 1) AS case_id, regexp_extract(f[k], '^FACT-(.+)-([0-9]{4})-([0-9]+): (.*)$', 2)::INT AS page,
  regexp_extract(f[k], '^FACT-(.+)-([0-9]{4})-([0-9]+): (.*)$', 3)::INT AS k, regexp_extract(f[k], '^FACT-(.+)-([0-9]{4})-([0-9]+): (.*)$', 4) AS fact FROM l, unnest(range(1, len(f) + 1)) AS u(k)""",
    "split_mismatch": """WITH l AS (SELECT case_id, min(split) AS s FROM tasks GROUP BY 1) SELECT DISTINCT t.case_id, CASE WHEN l.case_id IS NULL THEN 'not_locked' ELSE 'split:' || coalesce(split, 'None') || '!=' || coalesce(s, 'None') END AS finding
FROM traces t LEFT JOIN l ON l.case_id = t.case_id WHERE l.case_id IS NULL OR split IS DISTINCT FROM s""",
    "byte_stream": "SELECT doc_id, octet_length(encode(text)) AS n, coalesce(list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT)), 0)::BIGINT AS total FROM documents WHERE text IS NOT NULL",
}

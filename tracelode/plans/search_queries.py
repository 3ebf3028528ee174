"""Retrieval queries. Vectors stand for chunks: the label is the case, ten vectors are a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators import retrieval as R
from tracelode.sources.tables import table


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select("vec_id", F.col("label").alias("case"), (F.col("vec_id") / 10).cast("int").alias("page"), "embedding")


def _query_vector(spark: SparkSession, root: str) -> list[float]:
    """The vector of row 0, or of the lowest row."""
    return table(spark, root, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def _queries(spark: SparkSession, root: str) -> DataFrame:
    """Every row whose id is divisible by 20, against its own case up to its own page."""
    c = _chunks(spark, root)
    return c.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "case", F.col("page").alias("cutoff"), "embedding")


def search_case_topk(spark: SparkSession, root: str) -> DataFrame:
    """One query, case 2, pages up to 30."""
    return R.search_case(_chunks(spark, root), _query_vector(spark, root), 2, 30).select("page", "file", F.round("score", 6).alias("score"), "rank")


def search_case_multi(spark: SparkSession, root: str) -> DataFrame:
    rows = _chunks(spark, root).select("case", F.col("page").alias("unit"), "embedding")
    return R.search_many(rows, _queries(spark, root)).select("query_id", F.col("unit").alias("page"), F.round("score", 6).alias("score"), "rank")


def search_unscoped(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.search_all(rows, _query_vector(spark, root)).select("id", F.round("score", 6).alias("score"), "rank")


def search_unscoped_multi(spark: SparkSession, root: str) -> DataFrame:
    rows = _chunks(spark, root).select("case", F.col("vec_id").alias("unit"), "embedding")
    return R.search_many(rows, _queries(spark, root), scoped=False).select("query_id", F.col("unit").alias("id"), F.round("score", 6).alias("score"), "rank")


def search_index_multi(spark: SparkSession, root: str) -> DataFrame:
    """As search_unscoped_multi, by inverted lists; no SQL, as what the lists leave unread is lost (recall is tested)."""
    rows = _chunks(spark, root).select(F.col("vec_id").alias("unit"), "embedding")
    return R.search_index(rows, _queries(spark, root)).select("query_id", F.col("unit").alias("id"), F.round("score", 6).alias("score"), "rank")


def hits_with_pages(spark: SparkSession, root: str) -> DataFrame:
    """The hits of every query with the fields of their rows: the row's case and page, after the ranking."""
    rows = _chunks(spark, root).select("case", F.col("vec_id").alias("unit"), "embedding")
    hits = R.search_many(rows, _queries(spark, root).withColumn("cutoff", F.lit(2**62)), k=30).select("query_id", F.col("unit").alias("vec_id"), "rank")
    return R.attach(hits, _chunks(spark, root), ["vec_id"], ["case", "page"])


def prefilter_vs_postfilter(spark: SparkSession, root: str) -> DataFrame:
    """Hits of each query when the cutoff comes before the ranking, and when it comes after."""
    rows, q = _chunks(spark, root).select("case", F.col("page").alias("unit"), "embedding"), _queries(spark, root)
    before = R.search_many(rows, q).groupBy("query_id").agg(F.count("*").alias("prefiltered"))
    after = R.search_many(rows, q.withColumn("cutoff", F.lit(2**30))).join(q.select("query_id", "cutoff"), "query_id").where("unit <= cutoff").groupBy("query_id").agg(F.count("*").alias("postfiltered"))
    return before.join(after, "query_id", "left").select("query_id", "prefiltered", F.coalesce("postfiltered", F.lit(0)).cast("bigint").alias("postfiltered"))


def case_status(spark: SparkSession, root: str) -> DataFrame:
    return R.case_status(table(spark, root, "chunks"), 12)


def _decisions(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("court"))


def decision_stats(spark: SparkSession, root: str) -> DataFrame:
    return R.decision_stats(_decisions(spark, root))


def decision_stats_filtered(spark: SparkSession, root: str) -> DataFrame:
    return R.decision_stats(_decisions(spark, root), from_year=1996, to_year=1999, court="2-HIGH")


def decision_counters(spark: SparkSession, root: str) -> DataFrame:
    """The k-th order of its year and priority, as the running counter of a docket; numbered by day, month and key within bounded groups."""
    from pyspark.sql import Window

    o = table(spark, root, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("court"), F.to_date("o_orderdate").alias("day"))
    per_day = o.groupBy("year", "court", "day").agg(F.count("*").alias("c"))
    base = per_day.withColumn("base", F.sum("c").over(Window.partitionBy("year", "court").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c"))
    k = o.withColumn("k", F.row_number().over(Window.partitionBy("year", "court", "day").orderBy("o_orderkey")))
    return k.join(base.drop("c"), ["year", "court", "day"]).select("o_orderkey", "year", "court", (F.col("base") + F.col("k")).alias("k"))


def scope_errors(spark: SparkSession, root: str) -> DataFrame:
    """Tasks whose timestep isn't a page of their case in chunks."""
    cases = table(spark, root, "chunks").groupBy("case_id").agg(F.max("page").alias("n_pages"))
    return R.scope_errors(table(spark, root, "tasks").select("task_id", "case_id", F.col("timestep").alias("cutoff")), cases)


def health_census(spark: SparkSession, root: str) -> DataFrame:
    """Pages and chunks of each case, and its timesteps in the task table."""
    c = table(spark, root, "chunks").groupBy("case_id").agg(F.countDistinct("page").alias("pages"), F.countDistinct("page", "chunk_idx").alias("chunks"))
    t = table(spark, root, "tasks").groupBy("case_id").agg(F.countDistinct("timestep").alias("timesteps"))
    return c.join(t, "case_id", "full_outer").select("case_id", *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in ("pages", "chunks", "timesteps")])


def tool_log(spark: SparkSession, root: str) -> DataFrame:
    """The tool-call lines in log documents, read as JSON: calls, mean latency and known case by tool."""
    lines = table(spark, root, "documents").where("kind = 'log' AND text IS NOT NULL").select(F.explode(F.split("text", "\n")).alias("line"))
    j = F.from_json("line", "event string, case_id string, tool string, k int, latency_ms double, broken string", {"columnNameOfCorruptRecord": "broken"})
    whole = lines.where(F.regexp_replace("line", r"^\s+|\s+\z", "").rlike(r"^\{.*\}\z"))  # what follows an object makes the line none
    rows = whole.select(j.alias("j")).select("j.*").where("broken IS NULL AND event = 'tool_call' AND tool IS NOT NULL")
    return rows.groupBy("tool").agg(F.count("*").alias("calls"), F.count("case_id").alias("cased"), F.sum("k").alias("k"), F.round(F.sum("latency_ms"), 2).alias("latency_ms"))


QUERIES = {f.__name__: f for f in (
    search_case_topk, search_case_multi, search_unscoped, search_unscoped_multi, search_index_multi, hits_with_pages, prefilter_vs_postfilter, case_status, decision_stats, decision_stats_filtered, decision_counters, scope_errors, health_census, tool_log)}

_CHUNKS = "WITH c AS (SELECT vec_id, label AS \"case\", (vec_id // 10)::INT AS page, embedding::DOUBLE[] AS e FROM embeddings), "
_Q = "q AS (SELECT vec_id AS query_id, \"case\", page AS cutoff, e FROM c WHERE vec_id % 20 = 0)"
_COS = "list_dot_product(c.e, q.e) / (sqrt(list_dot_product(c.e, c.e)) * sqrt(list_dot_product(q.e, q.e)))"
_PAGES = f"p AS (SELECT q.query_id, c.page, max({_COS}) AS score, any_value(q.cutoff) AS cutoff FROM q JOIN c ON c.\"case\" = q.\"case\" AND c.page <= q.cutoff GROUP BY ALL)"

ORACLE = {
    "search_case_topk": _CHUNKS + f"""q AS (SELECT e FROM c ORDER BY vec_id LIMIT 1), p AS (SELECT c.page, max({_COS}) AS score FROM c, q WHERE c."case" = 2 AND c.page <= 30 GROUP BY 1),
r AS (SELECT page, score, row_number() OVER (ORDER BY score DESC, page) AS rank FROM p) SELECT page, printf('md/page_%04d.md', page) AS file, round(score, 6) AS score, rank FROM r WHERE rank <= 5 AND score > 0""",
    "search_case_multi": _CHUNKS + _Q + ", " + _PAGES + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS rank FROM p WHERE score > 0)
SELECT query_id, page, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
    "search_unscoped": _CHUNKS + f"""q AS (SELECT e FROM c ORDER BY vec_id LIMIT 1), r AS (SELECT vec_id AS id, {_COS} AS score, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS rank FROM c, q)
SELECT id, round(score, 6) AS score, rank FROM r WHERE rank <= 5 AND score > 0""",
    "search_unscoped_multi": _CHUNKS + _Q + f""", r AS (SELECT q.query_id, c.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY {_COS} DESC, c.vec_id) AS rank FROM q, c)
SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5 AND score > 0""",
    "hits_with_pages": _CHUNKS + _Q + f""", r AS (SELECT q.query_id, c.vec_id, c."case", c.page, {_COS} AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY {_COS} DESC, c.vec_id) AS rank FROM q JOIN c ON c."case" = q."case")
SELECT query_id, vec_id, rank, "case", page FROM r WHERE rank <= 20 AND score > 0""",
    "prefilter_vs_postfilter": _CHUNKS + _Q + ", " + _PAGES + f""", pre AS (SELECT query_id, least(count(*), 5) AS prefiltered FROM p WHERE score > 0 GROUP BY 1),
a AS (SELECT q.query_id, c.page, max({_COS}) AS score, any_value(q.cutoff) AS cutoff FROM q JOIN c ON c."case" = q."case" GROUP BY ALL),
post AS (SELECT query_id, count(*) AS postfiltered FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS rank FROM a WHERE score > 0) WHERE rank <= 5 AND page <= cutoff GROUP BY 1)
SELECT query_id, prefiltered, coalesce(postfiltered, 0) AS postfiltered FROM pre LEFT JOIN post USING (query_id)""",
    "case_status": "SELECT case_id, count(DISTINCT page) AS n_pages, max(page) AS max_page FROM chunks WHERE page <= 12 GROUP BY 1",
    "decision_stats": """SELECT CASE g WHEN 3 THEN 'total' WHEN 1 THEN 'year' ELSE 'court' END AS dim, CASE g WHEN 1 THEN y::VARCHAR WHEN 2 THEN court END AS key, n FROM (
  SELECT y, court, count(*) AS n, grouping(y, court) AS g FROM (SELECT year(o_orderdate) AS y, o_orderpriority AS court FROM orders) GROUP BY GROUPING SETS ((), (y), (court)))""",
    "decision_stats_filtered": """SELECT CASE g WHEN 3 THEN 'total' WHEN 1 THEN 'year' ELSE 'court' END AS dim, CASE g WHEN 1 THEN y::VARCHAR WHEN 2 THEN court END AS key, n FROM (
  SELECT y, court, count(*) AS n, grouping(y, court) AS g FROM (SELECT year(o_orderdate) AS y, o_orderpriority AS court FROM orders) WHERE y BETWEEN 1996 AND 1999 AND court = '2-HIGH' GROUP BY GROUPING SETS ((), (y), (court)))""",
    "decision_counters": "SELECT o_orderkey, year(o_orderdate) AS year, o_orderpriority AS court, row_number() OVER (PARTITION BY year(o_orderdate), o_orderpriority ORDER BY o_orderdate::DATE, o_orderkey) AS k FROM orders",
    "scope_errors": """SELECT task_id, t.case_id, timestep AS cutoff, CASE WHEN c.case_id IS NULL THEN 'unknown_case' ELSE 'cutoff_out_of_range' END AS error FROM tasks t
LEFT JOIN (SELECT case_id, max(page) AS n FROM chunks GROUP BY 1) c ON c.case_id = t.case_id WHERE c.case_id IS NULL OR NOT coalesce(timestep BETWEEN 1 AND n, false)""",
    "health_census": """SELECT coalesce(c.case_id, t.case_id) AS case_id, coalesce(pages, 0) AS pages, coalesce(chunks, 0) AS chunks, coalesce(timesteps, 0) AS timesteps FROM
(SELECT case_id, count(DISTINCT page) AS pages, count(DISTINCT (page, chunk_idx)) AS chunks FROM chunks GROUP BY 1) c FULL JOIN (SELECT case_id, count(DISTINCT timestep) AS timesteps FROM tasks GROUP BY 1) t ON c.case_id = t.case_id""",
    "tool_log": r"""WITH l AS (SELECT unnest(string_split(text, E'\n')) AS line FROM documents WHERE kind = 'log' AND text IS NOT NULL), j AS (SELECT CASE WHEN json_valid(line) THEN line::JSON END AS j FROM l)
SELECT j ->> '$.tool' AS tool, count(*) AS calls, count(j ->> '$.case_id') AS cased, sum((j ->> '$.k')::INT)::BIGINT AS k, round(sum((j ->> '$.latency_ms')::DOUBLE), 2) AS latency_ms
FROM j WHERE j ->> '$.event' = 'tool_call' AND j ->> '$.tool' IS NOT NULL GROUP BY 1""",
}

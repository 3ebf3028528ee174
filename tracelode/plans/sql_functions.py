"""The four retrieval tools as SQL table functions over named views, for use from plain SQL.

    register(spark, chunks="chunks", pages="pages", decisions="decisions")
    spark.sql("SELECT * FROM search_case(array(0.1D, ...), 2, 30, 5)")

``chunks``: case, page, embedding; ``pages``: case, page; ``decisions``: id, year, court, embedding. The functions
are SQL themselves, so Catalyst plans what they say: the cutoff reaches the scan, the aggregates are partial.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from tracelode.operators.retrieval import DEFAULT_K, MAX_K

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*\Z")
_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"


def register(spark: SparkSession, chunks: str = "chunks", pages: str = "pages", decisions: str = "decisions", case_type: str = "INT") -> None:
    """Create (or replace) cosine, search_case, search_decisions, case_status and decision_stats for the session.

    The views must be there. k is brought into 1 .. MAX_K; a null filter of decision_stats is none.
    """
    for name in (chunks, pages, decisions):
        if not _NAME.match(name):
            raise ValueError(f"not a view's name: {name!r}")
    k = f"greatest(1, least({MAX_K}, k))"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
RETURN try_divide({_DOT.format('a', 'b')}, sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')}))""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION search_case(query ARRAY<DOUBLE>, wanted {case_type}, cutoff INT, k INT DEFAULT {DEFAULT_K}) RETURNS TABLE (page INT, file STRING, score DOUBLE, rank INT)
RETURN SELECT page, printf('md/page_%04d.md', page), score, rank FROM (
  SELECT page, score, row_number() OVER (ORDER BY score DESC, page) AS rank FROM (SELECT page, max(s) AS score FROM (SELECT page, cosine(embedding, search_case.query) AS s FROM {chunks} WHERE case = search_case.wanted AND page <= search_case.cutoff) GROUP BY page))
WHERE rank <= {k.replace('k)', 'search_case.k)')} AND score > 0""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION search_decisions(query ARRAY<DOUBLE>, k INT DEFAULT {DEFAULT_K}) RETURNS TABLE (id BIGINT, score DOUBLE, rank INT)
RETURN SELECT id, score, rank FROM (
  SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, score FROM (SELECT id, cosine(embedding, search_decisions.query) AS score FROM {decisions}) ORDER BY score DESC, id LIMIT {MAX_K}))
WHERE rank <= {k.replace('k)', 'search_decisions.k)')} AND score > 0""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION case_status(wanted {case_type}, cutoff INT) RETURNS TABLE (n_pages BIGINT, max_page INT)
RETURN SELECT count(DISTINCT page), max(page) FROM {pages} WHERE case = case_status.wanted AND page <= case_status.cutoff HAVING count(*) > 0""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION decision_stats(from_year INT DEFAULT NULL, to_year INT DEFAULT NULL, wanted STRING DEFAULT NULL) RETURNS TABLE (dim STRING, key STRING, n BIGINT)
RETURN SELECT CASE g WHEN 3 THEN 'total' WHEN 1 THEN 'year' ELSE 'court' END, CASE g WHEN 1 THEN CAST(year AS STRING) WHEN 2 THEN court END, n FROM (
  SELECT year, court, count(*) AS n, grouping_id() AS g FROM (SELECT year, court FROM {decisions} WHERE (decision_stats.from_year IS NULL OR year >= decision_stats.from_year)
    AND (decision_stats.to_year IS NULL OR year <= decision_stats.to_year) AND (decision_stats.wanted IS NULL OR court = decision_stats.wanted)) GROUP BY GROUPING SETS ((), (year), (court)))""")

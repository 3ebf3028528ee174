"""Retrieval, corpus, analytics and streaming over small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tracelode.operators import analytics as A
from tracelode.operators import corpus as C
from tracelode.operators import retrieval as R
from tracelode.sources.tables import SchemaMismatch, strict_parquet
from tracelode.streaming import validate as V


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(5)
    data = [(i, i % 3, i // 4, [float(x) for x in rnd.normal(size=8)]) for i in range(120)]
    return spark.createDataFrame(data, "vec_id bigint, case int, page int, embedding array<float>"), data


def brute(data, q, case, cutoff, k):
    best = {}
    for _, c, page, e in data:
        if (case is None or c == case) and page <= cutoff:
            s = float(np.dot(e, q) / np.linalg.norm(e) / np.linalg.norm(q))
            best[page] = max(best.get(page, -2), s)
    order = sorted(best.items(), key=lambda x: (-x[1], x[0]))
    return [(p, round(s, 4)) for p, s in order if s > 0][:k]


def test_one_query(vectors):
    df, data = vectors
    got = [(r["page"], round(r["score"], 4)) for r in R.search_case(df, data[5][3], 1, 20, 7).orderBy("rank").collect()]
    assert got == brute(data, data[5][3], 1, 20, 7)
    assert R.search_case(df, data[5][3], 99, 20).count() == 0
    assert R.clamp_k(0) == 1 and R.clamp_k(999) == 20
    plan = R.search_case(df, data[5][3], 1, 20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_many_queries_in_blocks(vectors):
    df, data = vectors
    queries = df.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "case", F.col("page").alias("cutoff"), "embedding")
    found = R.search_many(df.select("case", F.col("page").alias("unit"), "embedding"), queries, k=4, block=7).collect()
    for i, case, page, e in data:
        if i % 5 == 0:
            got = sorted(((r["rank"], r["unit"], round(r["score"], 4)) for r in found if r["query_id"] == i))
            assert [(u, s) for _, u, s in got] == brute(data, e, case, page, 4)
    assert R.search_many(df.select("case", F.col("page").alias("unit"), "embedding"), queries.limit(0)).count() == 0


def test_index(spark, vectors, tmp_path):
    df, _ = vectors
    path = str(tmp_path / "index")
    with pytest.raises(Exception):
        R.index(df, path, {"v": 1}, "never")
    assert R.index(df, path, {"v": 1}).count() == 120
    assert R.index(df, path, {"v": 1}, "never").count() == 120
    with pytest.raises(R.StaleIndex):
        R.index(df, path, {"v": 2}, "never")
    assert R.fingerprint(df, {"v": 1}) == R.fingerprint(df.repartition(5), {"v": 1}) != R.fingerprint(df.limit(100), {"v": 1})


def test_stats(spark):
    df = spark.createDataFrame([(2000, "a"), (2000, "b"), (2001, "a"), (None, "a")], "year int, court string")
    assert rows(R.decision_stats(df, to_year=2000)) == [("court", "a", 1), ("court", "b", 1), ("total", None, 2), ("year", "2000", 2)]


def test_tree(spark, tmp_path):
    for f, text in (("train/cases/c1/timestep-1/pages/page_0001.md", "one"), ("train/cases/c1/timestep-2/pages/page_0001.md", "two"), ("train/cases/c1/timestep-2/pages/page_0003.md", "x"), ("train/cases/c1/timestep-1/prompts.yaml", "prompts: []"), ("train/cases/c1/timestep-1/odd.txt", "odd")):
        p = tmp_path / f
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    files = C.tree_files(spark, str(tmp_path))
    assert rows(C.unexpected_files(files), "place") == [("train/c1/1/odd.txt",)]
    pages = files.where("page IS NOT NULL")
    assert rows(C.page_census(pages)) == [("c1", 2, 3, "2", False)]
    assert rows(C.prefix_divergence(pages.select("case_id", F.col("timestep").alias("t"), "page", F.col("sha256").alias("sha")))) == [("c1", 1, 2, 1)]


def test_divergence_doesnt_reach_over_a_gap(spark):
    v = spark.createDataFrame([("c", 1, 1, "a"), ("c", 2, 2, "x"), ("c", 3, 1, "b")], "case_id string, t int, page int, sha string")
    assert C.prefix_divergence(v).count() == 0


def test_task_table(spark, tmp_path):
    cases = spark.createDataFrame([("c1", "train")], "case_id string, split string")
    prompts = spark.createDataFrame([("c1", 2, "free:q", None, "why?"), ("c1", 1, "skill:s", "s", None), ("c1", 1, "skill:u", "u", None), ("c9", 1, "free:q", None, "x")], "case_id string, timestep int, prompt_id string, name string, text string")
    cards = spark.createDataFrame([("s", "card")], "name string, card string")
    t = C.task_table(cases, prompts, cards, "img")
    assert [tuple(r) for r in t.collect()] == [("c1", 1, "skill:s", "train", "skill:s", None, "card", "img"), ("c1", 2, "free:q", "train", "free", "why?", None, "img")]
    assert rows(C.unresolved(cases, prompts, cards), "place", "detail") == [("c1/skill:u", "unknown skill"), ("c9/free:q", "unknown case")]
    assert C.row_findings(t).count() == 0 and C.diff(t, t).count() == 0
    bad = t.withColumn("sandbox_image", F.lit(None).cast("string")).where("timestep = 1").unionByName(t.where("timestep = 1"))
    got = {r["check"]: r["n"] for r in C.verify(t, bad).collect()}
    assert got == {"missing": 1, "extra": 0, "differs": 1, "duplicate": 1, "row": 0}
    lock = C.write_task_table(t, str(tmp_path / "t"))
    assert lock["rows"] == 2 and lock["train"] == 2 and lock["digest"] == C.write_task_table(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "u"))["digest"]
    assert C.lock_text({"b": 1, "a": 2}) == '{\n  "a": 2,\n  "b": 1\n}\n'
    assert C.row_at(t, 1).first()["timestep"] == 2
    for at in (-1, 2):
        with pytest.raises(IndexError):
            C.row_at(t, at)
    strict_parquet(spark, str(tmp_path / "t"), t.schema)
    with pytest.raises(SchemaMismatch):
        strict_parquet(spark, str(tmp_path / "t"), t.withColumn("timestep", F.col("timestep").cast("double")).schema)


def test_identifiers(spark):
    df = spark.createDataFrame([("case_1",), ("case_1\n",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(C.identifier(F.col("x"), "case")).collect()] == [True, False, False, False]


def test_order_statistics(spark):
    rnd = random.Random(3)
    for n in (1, 4, 7, 50):
        values = [rnd.randrange(20) for _ in range(n)]
        s = sorted(values)
        got = tuple(A.order_statistics(spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v int"), "g", "v").first())
        assert got == ("g", n, s[0], s[n // 4], s[n // 2], s[3 * n // 4], s[-1], round(sum(s) / n + 1e-9, 1))


def test_published_advantages(spark):
    one = spark.createDataFrame([(i, "g", 1.0 if i == 0 else 0.0) for i in range(110)], "k int, g string, reward double")
    got = [r["grpo"] for r in A.advantages(one, "k", "g").collect()]
    assert math.isclose(max(got), 10.3926334, abs_tol=1e-4) and math.isclose(min(got), -0.0953453, abs_tol=1e-6)
    few = spark.createDataFrame([(i, "g", 1.0 if i == 0 else 0.0) for i in range(27)], "k int, g string, reward double")
    assert math.isclose(sum(r["loo"] for r in A.advantages(few, "k", "g").collect()) / 27, 37036.84818542442, rel_tol=1e-6)
    alone = A.advantages(spark.createDataFrame([(1, "g", 0.25), (2, None, 0.5)], "k int, g string, reward double"), "k", "g")
    assert {(r["k"], r["grpo"], r["loo"]) for r in alone.collect()} == {(1, 0.25, 0.25), (2, 0.5, 0.5)}


def test_stream_is_as_batch(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rule = lambda df: df.withColumn("disposition", F.when(F.col("v") > 1, "accepted").otherwise("quarantined"))
    df = spark.createDataFrame([(i,) for i in range(4)], "v int")
    df.repartition(2).write.parquet(src)
    V.run_available(spark, src, df.schema, rule, sink, files_per_batch=1)
    assert rows(V.routed(spark, sink), "v", "disposition") == rows(rule(df), "v", "disposition")
    spark.createDataFrame([(9,)], "v int").write.mode("append").parquet(src)
    V.run_available(spark, src, df.schema, rule, sink)  # only what is new
    assert rows(V.counters(V.routed(spark, sink))) == [("accepted", 3), ("quarantined", 2)]


def test_index_recall(spark):
    """Inverted lists against brute force: at least nine of ten hits, and all with every list probed."""
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(40, 16))
    e = (centres[rnd.integers(0, 40, 4000)] + 0.6 * rnd.normal(size=(4000, 16))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)] + [(9999, None)], "unit bigint, embedding array<float>")
    queries = rows.where("unit % 20 = 0").select(F.col("unit").alias("query_id"), "embedding")
    exact = {(r[0], r[1]) for r in R.search_many(rows.withColumn("case", F.lit(1)), queries.select("query_id", F.lit(1).alias("case"), F.lit(2**40).alias("cutoff"), "embedding"), scoped=False).select("query_id", "unit").collect()}
    near = {(r[0], r[1]) for r in R.search_index(rows, queries).select("query_id", "unit").collect()}
    whole = {(r[0], r[1]) for r in R.search_index(rows, queries, lists=8, probes=8).select("query_id", "unit").collect()}
    assert len(exact) == 1000 and len(near & exact) >= 0.9 * len(exact) and whole == exact


def test_fingerprints_count_equal_rows(spark):
    rows = lambda *r: spark.createDataFrame(r, "case int, page int, chunk_idx int, text string, embedding array<float>")
    a, b = (1, 1, 0, "a", [1.0]), (1, 1, 1, "b", [1.0])
    marks = {R.fingerprint(rows(*r), {}) for r in ([a], [a, a, a], [a, b], [a, a, b, b], [b], [(1, 1, 0, "c", [1.0])])}
    assert len(marks) == 6 and R.fingerprint(rows(a, b), {}) == R.fingerprint(rows(b, a), {})


def test_index_recall_on_the_tables(spark, data):
    """The vectors of the tables lie in no clusters, so that many lists are read; nine of ten hits are found all the same."""
    from tracelode.plans import search_queries as Q

    root = data.replace("sf0.001", "sf0.01")
    exact, near = ({tuple(r) for r in q(spark, root).select("query_id", "id").collect()} for q in (Q.search_unscoped_multi, Q.search_index_multi))
    assert len(near & exact) >= 0.9 * len(exact) > 0

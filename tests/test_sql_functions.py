import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tracelode.operators import retrieval as R
from tracelode.plans.sql_functions import register


def test_as_the_operators(spark):
    rnd = np.random.default_rng(8)
    data = [(i, i % 3, i // 4, 2000 + i % 5, "ab"[i % 2], [float(x) for x in rnd.normal(size=6)]) for i in range(90)]
    df = spark.createDataFrame(data, "id bigint, case int, page int, year int, court string, embedding array<float>")
    df.createOrReplaceTempView("v_chunks")
    register(spark, "v_chunks", "v_chunks", "v_chunks")
    q = data[7][5]
    vector = "array(" + ", ".join(f"{x!r}D" for x in q) + ")"
    near = lambda d: [(r[0], *[round(x, 6) if isinstance(x, float) else x for x in r[1:]]) for r in rows(d)]
    for k in (1, 5, 0, 999):
        assert near(spark.sql(f"SELECT page, file, score, rank FROM search_case({vector}, 1, 15, {k})")) == near(R.search_case(df, q, 1, 15, k))
        assert near(spark.sql(f"SELECT id, score, rank FROM search_decisions({vector}, {k})")) == near(R.search_all(df, q, k))
    assert spark.sql(f"SELECT * FROM search_case({vector}, 77, 15)").count() == 0
    assert rows(spark.sql("SELECT * FROM case_status(1, 15)")) == [tuple(df.where("case = 1 AND page <= 15").agg(F.countDistinct("page"), F.max("page")).first())]
    assert spark.sql("SELECT * FROM case_status(1, -1)").count() == 0
    assert rows(spark.sql("SELECT * FROM decision_stats()")) == rows(R.decision_stats(df))
    assert rows(spark.sql("SELECT * FROM decision_stats(2001, 2003, 'a')")) == rows(R.decision_stats(df, 2001, 2003, "a"))
    with pytest.raises(ValueError):
        register(spark, "x; DROP TABLE y")

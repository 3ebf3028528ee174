import random

from conftest import rows
from tracelode.operators.dedup import admit, first_deliveries, redundant_deliveries

KEYS = ["session_id", "task_id"]
SCHEMA = "delivery_id bigint, session_id string, task_id string, at int, __rank int, __known0 string"


def test_rules(spark):
    data = [
        (1, "a", "t", 5, 0, "x"), (2, "a", "t", 3, 0, "x"), (3, "a", "t", 3, 0, "x"),  # earliest, then lowest id
        (4, "a", "u", None, 0, "x"), (5, "a", "u", 9, 0, "x"),  # a null arrival ranks last
        (6, None, "t", 1, 0, "x"), (7, None, "t", 1, 0, "x"),  # null identifies nothing
        (8, "b", None, 1, 0, "x"), (9, "b", None, 2, 0, "x"),  # a null task is a value
        (10, "c", "t", 1, 0, "x"), (10, "c", "t", 1, 0, "x"),  # whole copies
    ]
    df = spark.createDataFrame(data, SCHEMA)
    kept = first_deliveries(df, KEYS, "at", "delivery_id")
    assert kept.columns == df.columns
    assert [r[0] for r in rows(kept, "delivery_id")] == sorted([2, 5, 6, 7, 8, 10], key=lambda x: repr((x,)))
    assert sorted(r[0] for r in redundant_deliveries(df, KEYS, "at", "delivery_id").collect()) == [1, 3, 4, 9, 10]
    assert first_deliveries(df.limit(0), KEYS, "at", "delivery_id").count() == redundant_deliveries(df.limit(0), KEYS, "at", "delivery_id").count() == 0


def test_new_batches(spark):
    old = spark.createDataFrame([(1, "a", "t", 1, 0, "x"), (2, "b", None, 1, 0, "x"), (3, None, "t", 1, 0, "x")], SCHEMA)
    new = spark.createDataFrame([(4, "a", "t", 0, 0, "x"), (5, "b", None, 0, 0, "x"), (6, None, "t", 2, 0, "x"), (7, "c", "t", 2, 0, "x"), (8, "c", "t", 1, 0, "x")], SCHEMA)
    assert sorted(r[0] for r in admit(new, old, KEYS, "at", "delivery_id").select("delivery_id").collect()) == [6, 8]
    assert admit(new, old.limit(0), KEYS, "at", "delivery_id").count() == 4


def test_hot_key_against_brute_force(spark):
    rnd = random.Random(1)
    data = [(i, "hot" if rnd.random() < 0.4 else f"s{rnd.randrange(40)}", rnd.choice(["t", "u", None]), rnd.randrange(20), 0, "x") for i in range(3000)]
    first = {}
    for d in data:
        k = d[1:3]
        first[k] = min(first.get(k, (99, 9**9)), (d[3], d[0]))
    want = sorted(d[0] for d in data if first[d[1:3]][1] != d[0])
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    assert sorted(r[0] for r in redundant_deliveries(df, KEYS, "at", "delivery_id").collect()) == want
    plan = first_deliveries(df, KEYS, "at", "delivery_id")._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2  # before and after the shuffle

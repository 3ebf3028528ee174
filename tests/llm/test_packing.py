import random
from collections import Counter

import numpy as np
import pytest

from conftest import rows
from tracelode.llm.packing import Plan, fill, oversize, pack, training_rows

SCHEMA = "trace_id bigint, prompt_ids array<int>, response_ids array<int>, loss_mask array<int>, row int, salt string"


def best_fit(lengths, capacity):
    """Best fit, longest first, one by one."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        gaps.remove(g := min(fits)) if fits else None
        gaps.append((g if fits else capacity) - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_sound_and_tight(seed):
    rnd = random.Random(seed)
    kind = [lambda: rnd.randint(1, 100), lambda: rnd.randint(1, 9), lambda: rnd.choice([34, 33, 50, 51]), lambda: rnd.randint(30, 60), lambda: 34 if rnd.random() < 0.4 else rnd.randint(1, 100), lambda: 100][seed]
    lengths = [kind() for _ in range(1500)]
    plan, used = Plan(dict(Counter(lengths)), 100), {}
    for n, c in Counter(lengths).items():
        row, offset = plan.find(np.full(c, n), np.arange(c))
        for r, o in zip(row.tolist(), offset.tolist()):
            used.setdefault(r, []).append((o, n))
    assert sorted(used) == list(range(plan.rows))
    for stretches in used.values():
        at = 0
        for o, n in sorted(stretches):
            assert o == at  # no gap, no overlap
            at += n
        assert at <= 100
    assert plan.rows == best_fit(lengths, 100)


def test_empty_plan():
    assert Plan({}, 10).rows == 0


def traces(spark):
    data = [
        (1, [1] * 6, [2] * 3, [1, 1, 0], 0, "x"), (1, [1] * 6, [2] * 3, [1, 1, 0], 0, "x"),  # repeated
        (2, [3] * 14, [4] * 11, [1] * 10, 0, "x"),  # longer than a row; the mask is one short
        (3, None, None, None, 0, "x"), (4, [], [5], None, 0, "x"), (5, [6] * 10, None, [1], 0, "x"), (6, None, [7] * 20, [1] * 20, 0, "x"), (None, [8], None, None, 0, "x"),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_layout(spark):
    df = traces(spark)
    got = pack(df, 10).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["trace_id"], []).append((r["part"], r["begin"], r["length"]))
    assert {k: sorted(v) for k, v in parts.items()} == {
        1: [(0, 0, 9)], 2: [(0, 0, 10), (1, 10, 10), (2, 20, 5)], 3: [(0, 0, 0)], 4: [(0, 0, 1)], 5: [(0, 0, 10)], 6: [(0, 0, 10), (1, 10, 10)], None: [(0, 0, 1)]}
    spans = {}
    for r in got:
        if r["length"]:
            spans.setdefault(r["row"], []).append((r["offset"], r["offset"] + r["length"]))
        else:
            assert r["row"] is None and r["offset"] is None
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:])) and s[-1][1] <= 10
    assert sorted(spans) == list(range(len(spans)))
    assert sorted(r[0] for r in oversize(df, 10).collect()) == [2, 6]
    assert fill(pack(df, 10), 10).first()["ids"] == 9 + 25 + 1 + 10 + 20 + 1


def test_rows_hold_every_id_once(spark):
    got = training_rows(traces(spark), 10).collect()
    ids = Counter(x for r in got for x in r["ids"])
    assert ids == {1: 6, 2: 3, 3: 14, 4: 11, 5: 1, 6: 10, 7: 20, 8: 1}
    assert all(len(r["ids"]) == len(r["loss_mask"]) == r["n_used"] <= 10 for r in got)
    assert sum(m for r in got for x, m in zip(r["ids"], r["loss_mask"]) if x == 4) == 10  # the missing one counts as 0
    assert sum(m for r in got for x, m in zip(r["ids"], r["loss_mask"]) if x in (1, 3, 5, 6, 8)) == 0


def test_empty(spark):
    none = traces(spark).limit(0)
    assert pack(none).count() == oversize(none).count() == training_rows(none).count() == 0
    assert fill(pack(none)).first()["rows"] == 0
    with pytest.raises(ValueError):
        pack(none, 0)


def test_hot_length_against_brute_force(spark):
    rnd = random.Random(2)
    data = [(i, [1] * (37 if rnd.random() < 0.4 else rnd.randint(0, 130)), [], None, 0, "x") for i in range(2500)]
    got = pack(spark.createDataFrame(data, SCHEMA).repartition(5), 100)
    lengths = [r["length"] for r in got.collect() if r["length"]]
    used = rows(got.where("length > 0").groupBy("row").sum("length"))
    assert sum(u for _, u in used) == sum(len(d[1]) for d in data) and all(u <= 100 for _, u in used)
    assert len(used) == best_fit(lengths, 100)


def test_the_longest_copy_counts(spark):
    data = [(1, [1] * 3, [2] * 2, [1, 1], 0, "x"), (1, [9] * 4, [8] * 9, [1] * 9, 0, "x"), (2, [5] * 4, None, None, 0, "x")]
    got = training_rows(spark.createDataFrame(data, SCHEMA), 10).collect()
    assert Counter(x for r in got for x in r["ids"]) == {9: 4, 8: 9, 5: 4}
    assert sum(x for r in got for x in r["loss_mask"]) == 9


def test_null_ids_and_odd_masks(spark):
    got = training_rows(spark.createDataFrame([(1, [None, 2**31 - 1], [-5], [7], 0, "x")], SCHEMA), 10).first()
    assert got["ids"] == [0, 2**31 - 1, -5] and got["loss_mask"] == [0, 0, 7] and got["trace_ids"] == [1]


def test_hot_length_in_parts(spark):
    """A length that most items share is ranked in parts; the places are as good, none is taken twice."""
    df = spark.createDataFrame([(i, [0] * (10 if i % 4 else i % 23), None, None) for i in range(900)], "trace_id bigint, prompt_ids array<int>, response_ids array<int>, loss_mask array<int>")
    whole, parts = (pack(df, 32, per).where("length > 0").collect() for per in (100_000, 50))
    for places in (whole, parts):
        taken = sorted((r["row"], r["offset"], r["length"]) for r in places)
        assert all(b[0] > a[0] or b[1] >= a[1] + a[2] for a, b in zip(taken, taken[1:])) and max(o + n for _, o, n in taken) <= 32
    assert sorted((r["row"], r["offset"], r["length"]) for r in whole) == sorted((r["row"], r["offset"], r["length"]) for r in parts)


def test_null_ids_are_told_apart(spark):
    df = spark.createDataFrame([(None, [1, 2], [3], [1]), (None, [4], None, None), (None, [4], None, None), (7, [9], None, None)], "trace_id bigint, prompt_ids array<int>, response_ids array<int>, loss_mask array<int>")
    assert sorted(r["length"] for r in pack(df, 8).collect()) == [1, 1, 3]
    made = training_rows(df, 8).collect()
    assert sorted(x for r in made for x in r["ids"]) == [1, 2, 3, 4, 9] and sum(sum(r["loss_mask"]) for r in made) == 1

import math
import random

from conftest import rows
from tracelode.llm.mixing import mixture, schedule, shares, sized

DOCS = "doc_id bigint, source string, text string, slot string, h int, bucket int"
TARGETS = "source string, target_weight double, max_repeats int, quota string"


def test_schedule_is_never_a_block_off():
    rnd = random.Random(9)
    for _ in range(20):
        raw = [rnd.random() ** 3 + 1e-3 for _ in range(rnd.randint(1, 12))]
        weights = {f"s{i}": w / sum(raw) for i, w in enumerate(raw)}
        slots = schedule(weights, 500)
        taken = sorted(x for s in slots.values() for x in s)
        assert taken == list(range(500))
        for s, w in weights.items():
            at = set(slots[s])
            n = 0
            for t in range(500):
                n += t in at
                assert abs(n - w * (t + 1)) < 1 + 1e-6


def test_mixture(spark):
    rnd = random.Random(1)
    docs = [(i, s, " word" * rnd.randint(1, 9), "x", 0, 0) for i, s in enumerate(["big"] * 600 + ["mid"] * 200 + ["small"] * 12 + ["unwanted"] * 50)]
    docs += [(900, "big", None, "x", 0, 0), (901, "small", "", "x", 0, 0), (902, None, " word", "x", 0, 0), (None, "big", " word", "x", 0, 0), (0, "big", docs[0][2], "x", 0, 0)]
    targets = [("big", 0.6, 1, "x"), ("mid", 0.3, 2, "x"), ("small", 0.1, 4, "x"), ("absent", 0.2, 3, "x"), ("zero", 0.0, 3, "x"), (None, 0.1, 1, "x"), ("off", None, None, "x")]
    df, want = spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)
    got = mixture(df, want, slots=64).collect()
    uses = {}
    for r in got:
        uses.setdefault((r["source"], r["doc_id"]), []).append(r["repeat_no"])
    assert {s for s, _ in uses} == {"big", "mid", "small"}
    assert all(sorted(v) == list(range(len(v))) and len(v) <= {"big": 1, "mid": 2, "small": 4}[s] for (s, _), v in uses.items())
    assert max(len(v) for (s, _), v in uses.items() if s == "small") - min(len(v) for (s, _), v in uses.items() if s == "small") <= 1
    assert not any(d in (900, 901, 902) for _, d in uses)
    tokens = {s: sum(r["n_tokens"] for r in got if r["source"] == s) for s in ("big", "mid", "small")}
    for s, w in (("big", 0.6), ("mid", 0.3), ("small", 0.1)):
        assert abs(tokens[s] / sum(tokens.values()) - w) < 9 / sum(tokens.values())
    caps = {"big": 1, "mid": 2, "small": 4}
    total = {s: sum(r["n_tokens"] for r in sized(df, want).collect() if r["source"] == s) for s in caps}
    assert math.isclose(sum(tokens.values()), min(total[s] * caps[s] / w for s, w in (("big", 0.6), ("mid", 0.3), ("small", 0.1))), rel_tol=0.02)
    # The order interleaves: after each slot every source is within a block and a document of its share.
    block = sum(tokens.values()) / 64
    for t in range(0, 64, 7):
        for s, w in (("big", 0.6), ("mid", 0.3), ("small", 0.1)):
            assert abs(sum(r["n_tokens"] for r in got if r["slot"] <= t and r["source"] == s) - w * (t + 1) * block) <= block + 9
    report = {r["source"]: r for r in shares(df, want, slots=64).collect()}
    assert set(report) == {"big", "mid", "small", "absent", "zero", "off"} and report["absent"]["actual_share"] == 0 and report["small"]["most_repeats"] == max(len(v) for (s, _), v in uses.items() if s == "small")


def test_empty(spark):
    d, t = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1, "x")], TARGETS)
    assert mixture(d, t).count() == mixture(spark.createDataFrame([(1, "a", " x", "x", 0, 0)], DOCS), t.limit(0)).count() == 0
    assert rows(shares(d, t), "source", "uses", "actual_share") == [("a", 0, 0.0)]

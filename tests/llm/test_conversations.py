import random

import numpy as np
import pytest

from conftest import rows
from tracelode.llm import conversations as C

PART = "struct<type:string,text:string,id:string,name:string,arguments:string>"
SCHEMA = f"row_id bigint, id string, type string, timestamp timestamp, received_at timestamp, message struct<role:string,content:array<{PART}>,tool_call_id:string,tool_name:string,is_error:boolean,stop_reason:string,timestamp:bigint>, pos string, turn string, node string"


class Log:
    def __init__(self):
        self.lines = []

    def say(self, cid, at, role, text=None, calls=(), answers=None, kind="message_end", parts=...):
        content = [("text", text, None, None, None)] * (text is not None) + [("toolCall", None, c, "f", "{}") for c in calls] if parts is ... else parts
        self.lines.append((len(self.lines), cid, kind, None, None, (role, content, answers, None, None, None, at), "x", "x", "x"))
        return self

    def frame(self, spark):
        return spark.createDataFrame(self.lines, SCHEMA)


def test_reasons(spark):
    log = Log()
    log.say("good", 2, "model ", "hi").say("good", 1, "HUMAN", "q").say("good", 1, "user", "q").say("good", 0, "System", "s")
    log.say("tools", 1, "user", "q").say("tools", 2, "assistant", None, ["a"]).say("tools", 3, "toolResult", "r", answers="a").say("tools", 4, "assistant", "done")
    log.say("silent", 1, "user", "q").say("silent", 2, "assistant", "​ ﻿ ").say("silent", 3, "user", "q").say("silent", 4, "assistant", "a")
    log.say("last", 1, "user", "q").say("last", 2, "assistant", "a").say("last", 3, "user", "more")
    log.say("orphan", 1, "user", "q").say("orphan", 2, "tool", "r", answers="a").say("orphan", 3, "assistant", "x", ["a"])
    log.say("same", 1, "user", "q").say("same", 2, "tool", "r", ["a"], answers="a").say("same", 3, "assistant", "x")
    log.say("first", 1, "system", "s").say("first", 2, "assistant", "x").say("first", 3, "user", "q").say("first", 4, "assistant", "y")
    log.say("norole", 1, "user", "q").say("norole", 2, " ", "x").say("noinstant", 1, "user", "q").say("noinstant", None, "assistant", "a")
    log.say("blank", 1, "user", " ").say("blank", None, None, None).say("system", 1, "system", "s").say("none", 1, "user", "q", kind="message_start")
    log.say(None, 1, "user", "q").say("nulls", 1, "user", "q").say("nulls", 2, "assistant", parts=[None, ("text", None, None, None, None), (None, "x", None, None, None)])
    log.lines.append((99, "null message", "message_end", None, None, None, "x", "x", "x"))
    want = {"silent": "no_reply", "last": "no_reply", "orphan": "broken", "same": "broken", "first": "broken", "norole": "broken", "noinstant": "broken", "blank": "empty", "system": "empty", "none": "empty", "nulls": "no_reply", "null message": "empty"}
    assert dict(rows(C.dropped(log.frame(spark)))) == want
    kept = rows(C.conversations(log.frame(spark)), "id", "pos", "role", "text")
    assert kept == [("good", 0, "system", "s"), ("good", 1, "user", "q"), ("good", 2, "assistant", "hi"), ("tools", 0, "user", "q"), ("tools", 1, "assistant", ""), ("tools", 2, "tool", "r"), ("tools", 3, "assistant", "done")]
    empty = log.frame(spark).limit(0)
    assert C.dropped(empty).count() == C.conversations(empty).count() == 0


def brute(lines):
    out, by = {}, {}
    for r, cid, kind, _, _, m, *_ in lines:
        if cid is not None:
            by.setdefault(cid, {})
            if kind == "message_end":
                by[cid].setdefault((m[6], m[0], str(m[1])), (r, m))
    for cid, seen in by.items():
        ms = sorted((m[6], r, m) for r, m in seen.values())
        text = lambda m: any(p[0] == "text" and p[1].strip() for p in m[1])
        if not any(text(m) and m[0] != "system" for _, _, m in ms):
            out[cid] = "empty"
            continue
        calls, broken, waiting, silent = set(), False, False, False
        others = [m for _, _, m in ms if m[0] != "system"]
        broken = others[0][0] != "user"
        for _, _, m in ms:
            if m[0] == "toolResult":
                broken |= m[2] not in calls
            calls |= {p[2] for p in m[1] if p[0] == "toolCall"}
            if m[0] == "user":
                silent |= waiting
                waiting = True
            elif m[0] == "assistant" and text(m):
                waiting = False
        if broken:
            out[cid] = "broken"
        elif silent or waiting:
            out[cid] = "no_reply"
    return out


def test_hot_conversation_against_brute_force(spark):
    """One id holds a third of the lines, and spans several tasks."""
    rnd, log = random.Random(11), Log()
    for at in range(2400):
        cid = "hot" if rnd.random() < 0.35 else f"c{rnd.randrange(300)}"
        if cid == "hot":
            log.say(cid, at, "user" if len([1 for x in log.lines if x[1] == "hot"]) % 2 == 0 else "assistant", "t")
            continue
        role = rnd.choice(["user", "assistant", "assistant", "toolResult", "system"])
        log.say(cid, at, role, rnd.choice(["t", " ", None]), [f"a{rnd.randrange(3)}"] if role == "assistant" and rnd.random() < 0.6 else (), f"a{rnd.randrange(3)}" if role == "toolResult" else None)
        if rnd.random() < 0.1:
            log.lines.append((len(log.lines), *log.lines[-1][1:]))
    df = log.frame(spark).repartition(6)
    assert dict(rows(C.dropped(df))) == brute(log.lines)
    placed = C.place(C.messages(df)).where("id = 'hot'").orderBy("instant").select("pos", "turn").collect()
    assert [r["pos"] for r in placed] == list(range(len(placed))) and [r["turn"] for r in placed] == [i // 2 + 1 for i in range(len(placed))]


def test_parent_pointers(spark):
    rnd = random.Random(5)
    parents = {0: None, 1: 0, 2: 1, 3: 1, 10: 99, 11: 10, 12: 11, 20: 22, 21: 20, 22: 21, 23: 22, 30: 30}
    chain = list(range(100, 400))
    parents |= {chain[0]: None} | {b: a for a, b in zip(chain, chain[1:])}
    data = [(n, p, "x") for n, p in parents.items()] + [(None, 1, "x"), (1, 0, "x")]
    rnd.shuffle(data)
    got = {r["node"]: (r["root"], r["depth"], r["status"]) for r in C.resolve_parents(spark.createDataFrame(data, "node int, up int, root string"), "node", "up").collect()}
    for n in parents:
        seen, at = [n], n
        while parents.get(at) is not None and at in parents and parents[at] not in seen:
            at = parents[at]
            seen.append(at)
        if at in parents and parents[at] is not None:
            assert got[n] == (None, None, "cycle"), n
        elif at in parents:
            assert got[n] == (at, len(seen) - 1, "ok"), n
        else:
            assert got[n] == (seen[-2], len(seen) - 2, "orphan"), n
    assert len(got) == len(parents)
    assert C.resolve_parents(spark.createDataFrame([], "node int, up int"), "node", "up").count() == 0


@pytest.mark.parametrize("parts", [1, 8])
def test_rows_come_by_jumping(spark, data, monkeypatch, parts):
    """Places and broken results are what ``jump`` makes of the pointers, at any number of tasks."""
    lines = spark.read.parquet(f"{data}/pi_polar_transcript.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        kept, gone = rows(C.conversations(lines)), rows(C.dropped(lines))
        assert kept and gone
        seen, whole = [], C.jump
        monkeypatch.setattr(C, "jump", lambda e, most: seen.append(set(e.columns)) or whole(e, most))
        assert rows(C.dropped(lines)) == gone and len(seen) == 2
        monkeypatch.setattr(C, "jump", lambda e, most: e)
        assert rows(C.dropped(lines)) != gone
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_leap():
    parent = np.array([0, 0, 1, 2, 4, 4, 3])
    one = np.array([0, 1, 1, 1, 0, 1, 1])
    root, hops = C.leap(parent, one)
    assert root.tolist() == [0, 0, 0, 0, 4, 4, 0] and hops.tolist() == [0, 1, 2, 3, 0, 1, 4]


def test_answers(spark):
    """A result before its call, of its own message, and of a call nobody made."""
    log = Log()
    log.say("c", 1, "user", "q").say("c", 2, "tool", "r", answers="late").say("c", 3, "tool", "r", ["own"], answers="own").say("c", 4, "assistant", "x", ["late", "a"])
    log.say("c", 5, "tool", "r", answers="a").say("c", 6, "tool", "r", answers="none").say("c", 7, "tool", "r").say("d", 1, "tool", "r", answers="a")
    got = C.answers(C.place(C.messages(log.frame(spark)))).select("row", "status").collect()
    assert sorted(map(tuple, got)) == [(1, "cycle"), (2, "cycle"), (4, "ok"), (5, "orphan"), (6, "orphan"), (7, "orphan")]

import random

import pytest

from conftest import rows
from tracelode.llm.split import cut, oversized, split_chunks, split_rows

SCHEMA = "case_id string, page int, file string, chunk_idx int, text string, ingested_at int, piece_no int, k int"


def check(text, limit, overlap):
    pieces = cut(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[0][2] == 0 and pieces[-1][1] == len(text)
    assert "".join(text[b + o : e] for b, e, o in pieces) == text
    assert all(e - b <= limit and (o <= overlap) for b, e, o in pieces)
    for (b0, e0, _), (b, _, o) in zip(pieces, pieces[1:]):
        assert b + o == e0 and b >= b0  # it begins with the last o characters of the one before
    return pieces


def test_random_texts():
    rnd = random.Random(7)
    for _ in range(400):
        text = "".join(rnd.choice(["word ", "a", ".", ". ", "\n", "\n\n", "。", "é", "é", "👩‍⚖️", "\r\n", "; ", ", "]) for _ in range(rnd.randrange(300)))
        limit = rnd.randrange(5, 80)
        check(text, limit, rnd.randrange(0, limit))


@pytest.mark.parametrize("text", ["x" * 30_000, "漢字" * 1000, " " * 5000, "\n" * 3000, "ab " * 4000, "", "a" * 1000, "a" * 1001])
def test_extremes(text):
    pieces = check(text, 1000, 100)
    assert (len(pieces) == 1) == (len(text) <= 1000)


def test_natural_boundaries_come_first():
    para = "Sentence one is here. Sentence two is there." * 10
    text = "\n\n".join([para] * 6)
    for b, e, o in check(text, 1000, 100)[1:]:
        assert text[b + o - 2 : b + o] == "\n\n"  # every cut is between paragraphs
    lines = "\n".join(f"SN-{i} | holder | {i * 7}" for i in range(200))
    assert all(lines[b + o - 1] == "\n" for b, e, o in check(lines, 1000, 100)[1:])
    words = "word " * 600
    assert all(words[b + o - 1] == " " for b, e, o in check(words, 1000, 100)[1:])


def test_no_cut_within_a_shown_character():
    text = "é" * 2000
    assert all(text[b + o] != "́" for b, e, o in check(text, 1000, 100)[1:])


def test_chunks(spark):
    long = "one two three. " * 100
    data = [
        ("c", 1, "f", 0, long, 2, 0, 0), ("c", 1, "f", 0, long, 1, 0, 0),  # delivered twice
        ("c", 1, "f", 1, "short", 1, 0, 0), ("c", 1, None, 2, None, 1, 0, 0), ("c", 1, "f", 3, "", None, 0, 0), (None, None, None, None, long, None, 0, 0), ("c", 2, "f", 0, " ", 1, 0, 0),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(oversized(df)) == sorted([("c", 1, 0), (None, None, None)], key=repr)
    got = split_chunks(df)
    page = [(r["chunk_idx"], r["piece_no"], r["piece_idx"], r["text"]) for r in got.where("case_id = 'c' AND page = 1").orderBy("piece_idx").collect()]
    n = len(cut(long))
    assert [p[:3] for p in page] == [(0, i, i) for i in range(n)] + [(1, 0, n), (2, 0, n + 1), (3, 0, n + 2)]
    assert page[n][3] == "short" and page[n + 1][3] is None and page[n + 2][3] == ""
    assert got.where("case_id IS NULL").count() == n
    assert split_rows(df.limit(0)).count() == split_chunks(df.limit(0)).count() == oversized(df.limit(0)).count() == 0

import random

import pytest

from conftest import rows
from tracelode.llm.tokens import MergeReplay, default_vocabulary, encode, load_ranks

SCHEMA = "doc_id bigint, text string, ids string"
TEXTS = ["", " ", "\n\n a", "hello world", "it's you'll", "SN-4811925 (page:40)", "<|endoftext|> </s>", "é é ß 契約書 👩🏽‍⚖️", "a" * 5000, "ab" * 4000, " \t\r\n x", " ​﻿", None, "x\x00y"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_as_the_library(spark, library):
    rnd = random.Random(3)
    odd = ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x80, 0x250), rnd.randrange(0x2000, 0x2070), 32, 10, 0x4E00 + rnd.randrange(90), 0x1F600 + rnd.randrange(40)])) for _ in range(rnd.randrange(80))) for _ in range(400)]
    texts = TEXTS + odd
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[3], "x")], SCHEMA).repartition(3)
    got = sorted((r["doc_id"], r["ids"]) for r in encode(df, "doc_id", "text").collect())
    assert got == sorted([(i, library(t)) for i, t in enumerate(texts)] + [(0, library(texts[3]))])
    sizes = dict(tuple(r) for r in encode(df.where("doc_id > 0"), "doc_id", "text", sizes_only=True).collect())
    assert sizes == {i: len(library(t)) for i, t in enumerate(texts) if i}


def test_documents(spark, data, library):
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: library(r["text"]) for r in d.collect()}
    assert {r["doc_id"]: r["ids"] for r in encode(d, "doc_id", "text").collect()} == want


def test_ids_spell_the_text(spark):
    """An exact round trip through the vocabulary."""
    token = {v: k for k, v in load_ranks(default_vocabulary()).items()}
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], SCHEMA)
    for r in encode(df, "doc_id", "text").collect():
        assert b"".join(token[i] for i in r["ids"]).decode() == (TEXTS[r["doc_id"]] or "")


def test_overlapping_merges():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaa": 257, b"aaaa": 258, b"ab": 259}
    ids, sizes = MergeReplay(ranks).encode([b"aaaaa", b"", b"aab", b"b"])
    assert sizes.tolist() == [2, 0, 2, 1] and ids.tolist() == [256, 257, 256, 98, 98]


def test_empty(spark):
    assert rows(encode(spark.createDataFrame([], SCHEMA), "doc_id", "text")) == []

import heldout_pairs
import pytest

from conftest import rows
from tracelode.llm import pairs as P

Q = "Which party bore the storage cost after May 2014, and on which page is that recorded?"
A = "The surveyor put the loss at 4059 crowns (page:12). Nobody could say when the crates had last been counted."
DE = "Der Gutachter bezifferte den Verlust auf 73639 Kronen, abzüglich der Rückzahlung, und die Akte blieb offen."

CASES = [
    (Q, A, []), (Q, None, ["empty"]), (Q, " ​﻿ \n", ["empty"]), (None, A, []),
    (Q, "I can't help with that request.", ["refusal"]), (Q, "I'm sorry, but I must decline. Is there anything else you would like to know?", ["refusal"]),
    (Q, "Dabei kann ich leider nicht helfen. Bitte wenden Sie sich an eine Fachperson.", ["refusal", "language"]), (Q, "Je ne peux pas répondre à cette demande.", ["refusal", "language"]),
    (Q, "Lo siento, pero no puedo ayudar con esa petición.", ["refusal", "language"]),
    (Q, "Sorry for the length; the record is scattered. " + A, []), (Q, 'The letter reads "I cannot help with that request", and the file goes on from there.', []), (Q, "The witness declined to answer in court, but the ledger does. " + A, []),
    (Q, Q, ["copy"]), (Q, "You asked: " + Q.upper(), ["copy"]), (Q, "> " + Q + "\n\n" + A, []), (Q, "**" + Q.replace("storage ", "") + "**", ["copy"]), (Q, "Q: " + Q.replace("party", "patry"), ["copy"]), (Q, Q[:-1].replace(",", ""), ["copy", "truncated"]),
    (Q, A + " The remaining entries are listed under page:", ["truncated"]), (Q, A + " An auditor sampled 36 vouchers and", ["truncated"]), (Q, A + '\n```json\n{"a": [1, 2', ["truncated"]), (Q, A + "\n\n1. The harbour log shows a delay.\n2. The cham", ["truncated"]),
    (Q, A + " The letter says „es war so.", ["truncated"]), (Q, "SN-7516190 (page:8)", []), (Q, "299", []), (Q, "Markaar Holding eG", []), (Q, A + "\n\n| serial | crowns |\n|-|-|\n| SN-1 | 3 |", []), (Q, A + "\n\n| serial | crowns |\n|-|-|\n| SN-1", ["truncated"]),
    (Q, DE, ["language"]), (Q + " Please answer in German.", DE, []), (Q + " Please answer in German.", A, []), (Q, A + " The note says „" + DE + "“.", []), (Q, "Договор был подписан в мае, и страница указана в деле.", ["language"]),
]


@pytest.mark.parametrize("question, answer, want", CASES)
def test_rules(question, answer, want):
    assert P.find_defects(question, answer) == want


def test_copy_with_many_words_misspelt():
    q = "Which surveyor counted the broken crates twice before the harbour office closed the ledger and returned every voucher?"
    assert P.copies(q, "Which surveyro conuted the borken crtaes twcie befroe the harbuor offcie closed the legder and retunred evrey voucehr?")
    assert not P.copies(q, "Which surveyor told the broker that crews twist beneath the arbour while officers chose the lodge and retired in winter?")


def test_near_words_are_all_compared():
    # Whichever word is indexed first, 'ear' is no twin of 'hear', being short; 'year' is.
    groups = [("hear", "ear", "year"), ("boat", "oat", "goat"), ("mice", "ice", "dice"), ("bold", "old", "cold"), ("wink", "ink", "link"), ("land", "and", "sand"), ("ball", "all", "tall"), ("farm", "arm", "warm")]
    w, x, y = (" ".join(g[i] for g in groups) for i in range(3))
    assert P.copies(f"{x}. {y}?", w)
    # An answer's word may stand for each word that it is near.
    assert P.copies("kept kent sept?", "kepts kent sept")
    words = [c * 20 + "qrstuvwxyz" * 3 for c in "abcd"]
    assert P.copies(" ".join(words), " ".join(w[:30] + w[31:] for w in words)) and P.copies(" ".join(words), " ".join(w[:30] + "a" + w[31:] for w in words))
    assert P.copies(" ".join(w[:40] for w in words), " ".join(w[:39] for w in words)) and P.copies(" ".join(w[:39] for w in words), " ".join(w[:40] for w in words))
    assert not P.copies(" ".join(words), " ".join(w[:30] + w[32:] for w in words))


def test_plain_text():
    for content, want in (("x", "x"), ('{"type": "text", "text": "a"}', "a"), ('["a", {"type": "text", "text": "b"}]', "ab"), ('{"type": "text"}', ""), ("[1]", "[1]"), ("{oops", "{oops"), (None, None), ('[{"page": 1}]', '[{"page": 1}]')):
        assert P.plain_text(content) == want


def test_long_texts_end_soon():
    import time

    began = time.time()
    for t in ("a" * 300_000, "word " * 60_000, '"' * 50_000, "(" * 50_000, "x. " * 50_000):
        P.find_defects(Q, t)
        P.find_defects(t, A)
    import random

    rnd = random.Random(1)
    known = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9))) for _ in range(5000)]
    q, a = (" ".join(rnd.choice(known) if rnd.random() < 0.8 else "".join(rnd.choice("klmnop") for _ in range(6)) for _ in range(20_000)) for _ in range(2))
    P.find_defects(q, a)
    assert time.time() - began < 30


MSG = "array<struct<role:string,content:string>>"


def test_operator(spark):
    u, a = ("user", Q), ("assistant", A)
    data = [
        (1, [u], [a], "x"), (1, [u], [a], "x"), (2, [u], [], "x"), (3, [u], None, "x"), (4, None, [a], "x"), (5, [("user", "old"), (" Human ", Q)], [("assistant", "old"), ("MODEL", "I can't help with that request."), ("tool", "r")], "x"),
        (6, [u], [None, (None, A)], "x"), (7, [u], [("assistant", '{"type": "text", "text": ""}')], "x"), (8, [u], [("assistant", A), ("assistant", None)], "x"), (9, [u], [("assistant", Q[:-1])], "x"),
    ]
    df = spark.createDataFrame(data, f"trace_id bigint, prompt_messages {MSG}, response_messages {MSG}, defects string")
    assert rows(P.first_defects(df)) == [(2, "empty"), (3, "empty"), (5, "refusal"), (6, "empty"), (7, "empty"), (8, "empty"), (9, "copy")]
    assert rows(P.defects(df).where("trace_id = 9")) == [(9, 0, "copy"), (9, 1, "truncated")]
    assert P.first_defects(df.limit(0)).count() == 0


def test_pairs_from_elsewhere():
    """Pairs that the tables don't hold: verdicts right, and how many of the flagged ones are."""
    for pairs in (heldout_pairs.FIRST, heldout_pairs.SECOND):
        got = [(next(iter(P.find_defects(q, a, f)), None), want) for q, a, f, want in pairs]
        right = [g for g, want in got if want and g == want]
        assert len(right) >= 0.9 * sum(want is not None for _, want in got) and len(right) >= 0.9 * sum(g is not None for g, _ in got)


def test_finish_reason_alone_tells_nothing():
    assert P.find_defects("Who?", "Anna Miller", "length") == P.find_defects("Who?", "It was Anna Miller.", "length") == []
    assert P.find_defects("Who?", "It was Anna, because of the", "stop") == ["truncated"]
    assert P.find_defects("Who?", "The clerk filed", "length") == ["truncated"] and P.find_defects("Who?", "The clerk filed", "stop") == []

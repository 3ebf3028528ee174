import hashlib
import json

from pyspark.sql import functions as F

from tracelode.functions import arrays as A
from tracelode.functions import text as X
from tracelode.functions import wire as W


def one(spark, expr, **cols):
    schema = {"ids": "array<int>", "b": "array<int>", "m": "array<int>", "t": "string", "content": "binary"}
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {schema[k]}" for k in cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()[0]


def test_prefix_and_suffix(spark):
    for a, b, pre, suf in (([1, 2, 3], [1, 2], True, False), ([1, 2, 3], [2, 3], False, True), ([1], [0, 1], False, False), ([1], [], True, True), ([], [], True, True)):
        assert one(spark, A.starts_with(F.col("ids"), F.col("b")), ids=a, b=b) is pre
        assert one(spark, A.ends_with(F.col("ids"), F.col("b")), ids=a, b=b) is suf


def test_mask_runs(spark):
    for mask, want in (([1, 1, 0, 1], [(0, 2), (3, 4)]), ([0, 0], []), ([], []), (None, []), ([2, 1, None, 1], [(1, 2), (3, 4)])):
        assert [tuple(r) for r in one(spark, A.mask_runs(F.col("m")), m=mask)] == want


def test_segments(spark):
    for ids, want in (([9, 1, 5, 2, 1, 7], [(1, 4), (4, 6)]), ([1, 1, 2, 2], [(0, 3)]), ([], []), ([2, 3], [])):
        assert [tuple(r) for r in one(spark, A.segments(F.col("ids"), 1, 2), ids=ids)] == want


def test_divergence(spark):
    for a, b, want in (([1, 2], [1, 2], None), ([1, 2], [1, 3], 1), ([1], [1, 2], 1), ([], [], None), ([], [1], 0)):
        assert one(spark, A.first_divergence(F.col("ids"), F.col("b")), ids=a, b=b) == want


def test_page_references(spark):
    t = '[{"page": 12, "x": 1}, {"page":3}] see md/page_0007.md and page:5, page:99999999999'
    assert one(spark, X.page_refs(F.col("t")), t=t) == [3, 7, 12]
    assert one(spark, X.citations(F.col("t")), t="page:5 (page:12) page: 3") == [5, 12]
    assert one(spark, X.timestep_of(F.col("t")), t='{"timestep" : 8, "timestep": 9}') == 8
    assert one(spark, X.timestep_of(F.col("t")), t="none") is None


def test_addresses_and_names(spark):
    for url, want in (("https://u:p@h/x@y", "https://h/x@y"), ("https://a@b@h/x", "https://h/x"), ("h/x@y", "h/x@y"), ("https://h", "https://h")):
        assert one(spark, X.strip_userinfo(F.col("t")), t=url) == want
    assert X.template_pattern("timestep-{T}.v1") == r"^timestep\-(\d+)\.v1$"
    assert one(spark, X.page_file(F.lit(7))) == "md/page_0007.md"


def test_blob_id(spark):
    for data in (b"", b"hello\n", b"\x00\xff"):
        want = hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()
        assert one(spark, X.git_blob_id(F.col("content")), content=bytearray(data)) == want


def test_byte_ids(spark):
    for t in ("", "aß😀", "x" * 5000):
        assert one(spark, X.byte_ids(F.col("t")), t=t) == list(t.encode())


def test_windows_cover_verbatim(spark):
    text = "  " + "\n".join(f"w{i} " for i in range(57))
    got = one(spark, X.windows(F.col("t"), 20, 5), t=text)
    spans, want, at = [], [], 0
    for w in text.split():
        at = text.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    a = 0
    while True:
        part = spans[a : a + 20]
        want.append((len(part), text[part[0][0] : part[-1][1]]))
        if a + 20 >= len(spans):
            break
        a += 15
    assert [(r["n_words"], r["text"]) for r in got] == want
    assert [tuple(r) for r in one(spark, X.windows(F.col("t")), t=" \n")] == [(0, 0, " \n")]


def test_flat_content(spark):
    for content, want in (("plain", "plain"), ('{"type": "text", "text": "a"}', "a"), ('["a", {"type": "text", "text": "b\\"c"}]', 'ab"c'), ('[{"page": 1}]', '[{"page": 1}]'), ("[oops", "[oops"), (None, None), ('{"x": 1}', '{"x": 1}')):
        assert one(spark, X.flat_content(F.col("t")), t=content) == want


def test_raw_json_keeps_kinds(spark):
    df = spark.createDataFrame([('[1, true, "1", 1.0, null, NaN, [], {}]',), ("nope",), (None,), ("[]",), ('["\\ud800"]',), ('{"b": 1.0, "a": [1, 1e3], "a": 2}',)], "t string")
    kinds = [r[0] for r in df.select(W.element_kinds("t")).collect()]
    assert kinds == [["int", "bool", "string", "float", "null", "nonfinite", "list", "object"], None, None, [], ["string"], None]
    hashes = [r[0] for r in df.select(W.canonical_hash("t")).collect()]
    assert hashes[0] is None and hashes[1] is None and hashes[2] is None and hashes[4] is None
    assert hashes[5] == hashlib.sha256(json.dumps({"a": 2, "b": 1.0}, separators=(",", ":")).encode()).hexdigest()
    names = [r[0] for r in df.select(W.member_names("t")).collect()]
    assert names[5] == ["a", "b"] and names[0] is None
    assert W.flatten(["a", {"text": "b"}, {"text": 3}, 4]) == "ab" and W.flatten({"text": "x"}) == "x" and W.flatten(5) == ""

"""Trees, YAML text, arrays, strategies, streams in several batches."""

import numpy as np
import pytest

from conftest import rows
from tracelode.operators import corpus as C
from tracelode.operators import trajectory as J
from tracelode.plans.registry import strategy
from tracelode.schemas import ddl
from tracelode.sources import files as S
from tracelode.sources import yaml_text as Y
from tracelode.streaming import reconstruct as VR


@pytest.mark.parametrize("text, want", [
    ("", None), ("a: 1\nb: off\nc: 'x: y'\n", {"a": 1, "b": False, "c": "x: y"}), ("- 1\n- two # no\n- \"t\\n\"\n- ~\n", [1, "two", "t\n", None]),
    ("prompts:\n  - id: p1\n    text: |\n      one\n      two\n  - id: p2\n    skill: date-line\nempty: []\n", {"prompts": [{"id": "p1", "text": "one\ntwo\n"}, {"id": "p2", "skill": "date-line"}], "empty": []}),
    ("a:\n- x\n- y\nb:\n  c: 1.5\n", {"a": ["x", "y"], "b": {"c": 1.5}}), ("t: >-\n  a\n  b\n\n  c\n", {"t": "a b\n\nc"}), ("k: [1, b, off]", {"k": [1, "b", False]}), ("url: http://x/#a\n", {"url": "http://x/#a"}), ("plain words", "plain words"),
])
def test_yaml_text(text, want):
    assert Y.load(text) == want


@pytest.mark.parametrize("text", ["a: 1\na: 2", "a: &x 1", "a: {b: 1}", "a: 1\n   b: 2", "\ta: 1", "a: 'x", "- 1\nb: 2"])
def test_yaml_text_refuses(text):
    with pytest.raises(ValueError):
        Y.load(text)


def test_tree(spark, tmp_path):
    at = tmp_path / "train" / "cases" / "c1" / "timestep-1"
    (at / "pages").mkdir(parents=True)
    (at / "pages" / "page_0001.md").write_text("x")
    (at / "pages" / "page_0002.md").write_text("")
    (at / "prompts.yaml").write_text("a: 1")
    (tmp_path / "train" / "cases" / "c2" / "timestep-2" / "pages").mkdir(parents=True)
    (tmp_path / "other").mkdir()
    (at / "pages" / "note.txt").write_text("x")
    got = {(r["place"], r["detail"]) for r in C.tree_findings(C.entries(spark, str(tmp_path))).collect()}
    c2 = "train/cases/c2/timestep-2"
    assert got == {("other", "unexpected entry"), ("other", "empty folder"), ("train/cases/c1/timestep-1/pages/note.txt", "unexpected entry"), ("train/cases/c1/timestep-1/pages/page_0002.md", "empty file"), (f"{c2}/pages", "empty folder"), (f"{c2}", "no prompts.yaml")}


def test_branches(spark):
    files = spark.createDataFrame([("c", 1, "pages/page_0001.md", 1, "h1"), ("c", 1, "AGENTS.md", None, "a"), ("c", 2, "pages/page_0001.md", 1, "h1"), ("c", 2, "junk", None, "j")], "case_id string, timestep int, name string, page int, sha256 string")
    assert rows(C.fixed_files(files, {"AGENTS.md": "b"})) == [("c", 1, "AGENTS.md", "differs"), ("c", 2, "AGENTS.md", "missing"), ("c", 2, "junk", "extra")]
    census = rows(C.branch_census(files), "case_id", "timestep", "n_files", "n_pages")
    assert census == [("c", 1, 2, 1), ("c", 2, 2, 1)]


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "a.npz", i=np.arange(3, dtype="<i4"), f=np.array([0.5], "<f8"), two=np.zeros((2, 2)), empty=np.zeros(0, "<f4"))
    (tmp_path / "b.npz").write_bytes(b"no archive")
    assert rows(S.npz_arrays(spark, str(tmp_path)), "name", "dtype", "n", "values") == [("empty", "<f4", 0, []), ("f", "<f8", 1, [0.5]), ("i", "<i4", 3, [0.0, 1.0, 2.0])]


def test_strategies():
    assert strategy("tracelode.operators.trajectory:stitch", glue=[2])([[1, 2], [1, 3, 2]]) == ([[1, 2], [1, 2, 3, 2]], 1)
    for bad in ("x", "tracelode.nothing:x", "tracelode.operators.trajectory:nothing", "tracelode.operators.trajectory:_NATURAL"):
        with pytest.raises(ValueError):
            strategy(bad)


def test_sessions_over_batches(spark, tmp_path):
    """A session whose completions come in two batches is built from both; one that isn't touched stays."""
    schema = ddl("s string, seq int, prompt_ids array<int>, response_ids array<int>, logprobs array<double>, finish_reason string")
    first = [("a", 0, [257, 260, 258], [65, 260], None, "tool_calls"), ("b", 0, [1], [9, 260], None, "stop")]
    second = [("a", 1, [257, 260, 258, 65, 260, 259, 260, 258], [66, 260], None, "stop")]
    for i, part in enumerate((first, second)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        VR.run_available(spark, str(tmp_path / "in"), schema, lambda d: d, ["s"], str(tmp_path / "out"))
    got = {r["s"]: (r["response_ids"], r["kept"], r["total"]) for r in VR.current(spark, str(tmp_path / "out"), ["s"]).collect()}
    assert got == {"a": ([65, 260, 259, 260, 258, 66, 260], 2, 2), "b": ([9, 260], 1, 1)}
    whole = {r["s"]: (r["response_ids"], r["kept"], r["total"]) for r in J.reconstruct(spark.createDataFrame(first + second, schema), ["s"]).collect()}
    assert got == whole

"""Readers of the loose files around a corpus: session results, logs, timings, prompts, manifests.

Content faults become findings, never errors; a missing path is an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.sources import yaml_text

#: The members that every manifest has, and their kinds; a caller may ask for more.
MANIFEST = {"name": str, "owner": str, "git": dict, "sandbox_image": str}
GIT = {"name", "email", "date"}
TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*\Z")


def parse(text: str) -> object:
    """A YAML document, by the installed parser or, where there is none, by ``yaml_text``; ValueError if it is none."""
    try:
        import yaml
    except ImportError:
        try:
            return json.loads(text)
        except ValueError:
            return yaml_text.load(text)
    try:
        return yaml.safe_load(text)
    except (yaml.YAMLError, RecursionError) as e:
        raise ValueError(str(e)) from e


def session_files(spark: SparkSession, path: str) -> DataFrame:
    """Session-result files, one body a file: body_id (of the path), path, body; wrapped and enveloped ones are opened by ``flatten_bodies``."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    return texts.select(F.xxhash64("path").alias("body_id"), "path", "body")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSONL log by a given schema; a line that isn't one object of it is left out."""
    kept = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").option("mode", "PERMISSIVE").json(path)
    return kept.where("_broken IS NULL").drop("_broken")


def timings(spark: SparkSession, path: str) -> DataFrame:
    """Collection timings: attempt, exit, seconds."""
    return spark.read.schema("attempt int, exit int, seconds double").option("header", True).csv(path)


def prompt_rows(files: DataFrame, skills: list[str]) -> DataFrame:
    """The prompts of a tree (``corpus.tree_files``): case_id, timestep, prompt_id, name, text, finding.

    An absent or empty file is no prompts. A file is a mapping whose only member is the list ``prompts``; an entry has exactly id, source
    and name if its source is skill, or id, source and text if it is free. The id is the source and, after a
    colon, the skill's name or a token, once in a timestep; texts aren't empty, skills are known. A fault is a row with its
    finding and no prompt.
    """
    known = set(skills)

    def fault(e: object) -> str | None:
        if not isinstance(e, dict) or e.get("source") not in ("skill", "free"):
            return "source"
        kind = e["source"]
        if set(e) != {"id", "source", "name" if kind == "skill" else "text"}:
            return "members"
        if kind == "skill":
            if not isinstance(e["name"], str) or not TOKEN.match(e["name"]) or e["id"] != f"skill:{e['name']}":
                return "id"
            return None if e["name"] in known else "unknown_skill"
        if not isinstance(e["text"], str) or not e["text"]:
            return "empty_text"
        return None if isinstance(e["id"], str) and e["id"].startswith("free:") and TOKEN.match(e["id"][5:]) else "id"

    def entries(text: str | None) -> Iterator[tuple]:
        if text is None:
            yield None, None, None, "not_utf8"
            return
        try:
            value = parse(text) if text.strip() else None
        except ValueError:
            yield None, None, None, "not_a_document"
            return
        if value is None:
            return
        if not isinstance(value, dict) or set(value) != {"prompts"} or not isinstance(value["prompts"], list):
            yield None, None, None, "not_a_list_of_prompts"
            return
        seen: set[str] = set()
        for i, e in enumerate(value["prompts"]):
            what = fault(e) or ("duplicate_id" if e["id"] in seen else None)
            if what:
                yield None, None, None, f"{what}:{i}"
            else:
                seen.add(e["id"])
                yield e["id"], e.get("name"), e.get("text"), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(c, t, *e) for c, t, text in zip(*(b.column(i).to_pylist() for i in range(3))) for e in entries(text)]
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["case_id", "timestep", "prompt_id", "name", "text", "finding"])

    texts = files.where("name = 'prompts.yaml'").select("case_id", "timestep", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return texts.mapInArrow(run, "case_id string, timestep int, prompt_id string, name string, text string, finding string")


def manifest(raw: bytes, owners: list[str], more: dict[str, type] | None = None) -> tuple[dict | None, list[tuple[str, str]]]:
    """A corpus manifest and its findings (place, detail); None if there are any. One small file, read by the driver.

    It must have the members of MANIFEST and of ``more``, of their kinds and not empty, and no others; ``owner`` is
    one of ``owners``, ``git`` has exactly the strings of GIT.
    """
    try:
        value = parse(raw.decode())
    except UnicodeDecodeError:
        return None, [("manifest", "not UTF-8")]
    except ValueError:
        return None, [("manifest", "can't be parsed")]
    if not isinstance(value, dict):
        return None, [("manifest", "not a mapping")]
    want = MANIFEST | (more or {})
    found = [(k, "unknown member") for k in sorted(map(str, set(value) - set(want)))]
    found += [(k, "missing") for k in want if k not in value]
    found += [(k, f"must be a {kind.__name__} that isn't empty") for k, kind in want.items() if k in value and not (isinstance(value[k], kind) and value[k])]
    if isinstance(value.get("owner"), str) and value["owner"] and value["owner"] not in owners:
        found.append(("owner", f"must be one of {', '.join(owners)}"))
    git = value.get("git")
    if isinstance(git, dict) and git and not (set(git) == GIT and all(isinstance(x, str) for x in git.values())):
        found.append(("git", f"must have the strings {', '.join(sorted(GIT))}"))
    return (None if found else value), found


def findings_frame(spark: SparkSession, found: list[tuple[str, str]], scope: str = "manifest") -> DataFrame:
    """Findings of the driver as rows: scope, place, detail."""
    return spark.createDataFrame([(scope, *f) for f in found], "scope string, place string, detail string")


def npz_arrays(spark: SparkSession, path: str) -> DataFrame:
    """The arrays in .npz files, one a row: path, name, dtype, n, values (as doubles); arrays of other than one dimension or of objects are left out, as are files that are none."""
    import io
    import zipfile

    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for where, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as held:
                        rows += [(where, n, a.dtype.str, len(a), a.astype(np.float64).tolist()) for n in held.files if (a := held[n]).ndim == 1 and a.dtype.kind in "iuf"]
                except (ValueError, OSError, zipfile.BadZipFile, AttributeError):
                    continue
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64())))], names=["path", "name", "dtype", "n", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, name string, dtype string, n bigint, values array<double>")

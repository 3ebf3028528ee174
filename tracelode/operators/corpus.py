"""Corpus to task table: tree scan, census, version consistency, the table itself and its verification.

Findings are rows (scope, place, detail): no finding, no row. Joins that compare take nulls as values.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.functions.arrays import finding

#: The task table's key and the columns that verification compares.
KEY = ["case_id", "timestep", "prompt_id"]
COMPARED = ["split", "prompt_source", "prompt_text", "skill_card_text", "sandbox_image"]
SPLITS = ("train", "eval")


# --- sources ------------------------------------------------------------------------------------


def tree_files(spark: SparkSession, root: str) -> DataFrame:
    """The files below a corpus root: split, case_id, timestep, name, page, sha256, content.

    Expected are ``<split>/cases/<case>/timestep-<T>/pages/page_NNNN.md`` and ``.../prompts.yaml``;
    page is null for other files, and split, case and timestep for files elsewhere. Files of no bytes and
    empty folders are no rows, as Spark's scans skip them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_extract(F.col("path"), r"([^/]+/cases/[^/]+/timestep-[0-9]+/.+)$", 1)
    part = lambda k: F.nullif(F.regexp_extract(path, r"^([^/]+)/cases/([^/]+)/timestep-([0-9]+)/(.+)$", k), F.lit(""))
    name = F.coalesce(part(4), F.col("path"))
    page = F.regexp_extract(name, r"^pages/page_([0-9]{4})\.md$", 1).try_cast("int")
    return files.select(part(1).alias("split"), part(2).alias("case_id"), part(3).try_cast("int").alias("timestep"), name.alias("name"), page.alias("page"), F.sha2("content", 256).alias("sha256"), "content")


def unexpected_files(files: DataFrame) -> DataFrame:
    """Files that are neither a page nor the prompts of a timestep, or lie in no known split."""
    bad = F.col("case_id").isNull() | (F.col("page").isNull() & (F.col("name") != "prompts.yaml")) | ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))
    return files.where(bad).select(F.lit("tree").alias("scope"), F.concat_ws("/", "split", "case_id", F.col("timestep").cast("string"), "name").alias("place"), F.lit("unexpected file").alias("detail"))


def entries(spark: SparkSession, root: str, depth: int = 7) -> DataFrame:
    """Everything below a corpus root down to ``depth`` levels, folders and empty files too: place (from the root), level, is_dir, bytes.

    The complement of ``tree_files``, which can't see what has no bytes: a listing by the driver, one call a level.
    """
    import re

    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    start = files.makeQualified(base).toString().rstrip("/") + "/"
    rows = []
    for level in range(1, depth + 1):
        found = files.globStatus(jvm.org.apache.hadoop.fs.Path(base, "/".join("*" * level)))
        text = jvm.org.apache.commons.lang3.ArrayUtils.toString(found)
        now = re.findall(r"path=(.*?); isDirectory=(true|false); (?:length=(\d+);)?", text)
        if not now:
            break
        rows += [(p.removeprefix(start), level, d == "true", int(n or 0)) for p, d, n in now]
    return spark.createDataFrame(rows, "place string, level int, is_dir boolean, bytes bigint")


#: What may stand at each level of a corpus: a pattern of the place, and whether it is a folder.
_LAYOUT = {1: (r"(?:train|eval)", True), 2: (r"[^/]+/cases", True), 3: (r"[^/]+/cases/[a-z0-9][a-z0-9_-]*", True), 4: (r".+/timestep-[1-9][0-9]*", True), 5: (r".+/(?:pages|prompts\.yaml)", None), 6: (r".+/pages/page_[0-9]{4}\.md", False)}


def tree_findings(found: DataFrame) -> DataFrame:
    """``entries`` against the layout: scope, place, detail for unexpected entries, empty folders and empty files, and timesteps that lack pages or prompts."""
    want = F.lit(False)
    for level, (pattern, folder) in _LAYOUT.items():
        fits = F.col("place").rlike(f"^{pattern}\\z")
        kind = F.col("is_dir") == F.lit(folder) if folder is not None else F.col("is_dir") == F.col("place").endswith("/pages")
        want = want | ((F.col("level") == level) & fits & kind)
    told = lambda df, place, detail: df.select(F.lit("tree").alias("scope"), F.col(place).alias("place"), F.lit(detail).alias("detail"))
    above = found.select(F.regexp_extract("place", r"^(.*)/[^/]+$", 1).alias("place")).distinct()
    bare = found.where("is_dir").join(above, "place", "left_anti")
    steps = found.where(F.col("is_dir") & (F.col("level") == 4)).select("place")
    lacks = lambda name: told(steps.join(found.where(F.col("level") == 5).select(F.regexp_extract("place", rf"^(.*)/{name}$", 1).alias("place")), "place", "left_anti"), "place", f"no {name}")
    parts = [told(found.where(~want), "place", "unexpected entry"), told(bare, "place", "empty folder"), told(found.where("NOT is_dir AND bytes = 0"), "place", "empty file"), lacks("pages"), lacks("prompts.yaml")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def branch_census(files: DataFrame) -> DataFrame:
    """Of each branch its files and one hash over their names and contents: case_id, timestep, n_files, n_pages, digest."""
    each = F.concat_ws(" ", "name", "sha256")
    return files.where("case_id IS NOT NULL").groupBy("case_id", "timestep").agg(F.count("*").alias("n_files"), F.count("page").alias("n_pages"), F.sha2(F.array_join(F.array_sort(F.collect_list(each)), "\n"), 256).alias("digest"))


def fixed_files(clone: DataFrame, names: dict[str, str]) -> DataFrame:
    """Files that every branch must hold with one content (``names``: name to sha256), and files that are neither these nor pages: case_id, timestep, name, finding."""
    branches = clone.select("case_id", "timestep").distinct()
    want = branches.select("*", F.explode(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])).alias("name", "want"))
    other = clone.where(F.col("page").isNull()).select("case_id", "timestep", "name", "sha256")
    both = want.join(other, ["case_id", "timestep", "name"], "full_outer")
    found = F.when(F.col("want").isNull(), "extra").when(F.col("sha256").isNull(), "missing").when(F.col("want") != F.col("sha256"), "differs")
    return both.select("case_id", "timestep", "name", found.alias("finding")).where("finding IS NOT NULL")


# --- rules --------------------------------------------------------------------------------------


def page_census(pages: DataFrame) -> DataFrame:
    """Of each case its pages against 1 .. the highest: case_id, n_pages, max_page, missing, contiguous.

    Distinct pages are counted in two steps, so that a hot case is summed from parts; only a case's
    distinct page numbers come together.
    """
    distinct = pages.where("case_id IS NOT NULL AND page IS NOT NULL").select("case_id", "page").distinct()
    seen = distinct.groupBy("case_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    top = F.array_max("pages")
    missing = F.array_except(F.when(top >= 1, F.sequence(F.lit(1), top)).otherwise(F.array().cast("array<int>")), "pages")
    return seen.select("case_id", F.size("pages").alias("n_pages"), top.alias("max_page"), F.array_join(missing.cast("array<string>"), ",").alias("missing"), (F.size(missing) == 0).alias("contiguous"))


def prefix_divergence(versions: DataFrame) -> DataFrame:
    """Pages whose content differs between a timestep and the next recorded one of their case.

    ``versions``: case_id, t, page, sha. Only adjacent timesteps are compared, and a page that one of
    them lacks is skipped; a window over a page's own versions would reach across the gap.
    """
    steps = versions.select("case_id", "t").distinct()
    nexts = steps.withColumn("next_t", F.lead("t").over(Window.partitionBy("case_id").orderBy("t"))).where("next_t IS NOT NULL")
    a = versions.join(nexts, ["case_id", "t"])
    b = versions.select("case_id", F.col("t").alias("next_t"), "page", F.col("sha").alias("next_sha"))
    return a.join(b, ["case_id", "next_t", "page"]).where(F.col("sha") != F.col("next_sha")).select("case_id", "t", "next_t", "page")


def duplicates(rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def split_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])


def cases_in_both(rows: DataFrame) -> DataFrame:
    """Cases that are in more than one split."""
    return rows.where("split IS NOT NULL").groupBy("case_id").agg(F.countDistinct("split").alias("n")).where("n > 1").select("case_id")


def outside(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The distinct values of ``key`` in ``rows`` that ``known`` lacks."""
    return rows.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


# --- the task table -----------------------------------------------------------------------------


def task_table(cases: DataFrame, prompts: DataFrame, cards: DataFrame, image: str) -> DataFrame:
    """case x timestep x prompt, sorted: the eight columns of the task table.

    ``cases``: case_id, split; ``prompts``: case_id, timestep, prompt_id, name, text, where a null text
    means the skill ``name``; ``cards``: name, card. A prompt without case or card gives no row; see
    ``unresolved``.
    """
    skill = F.col("text").isNull()
    rows = prompts.join(cases, "case_id").join(cards.select("name", "card"), "name", "left").where(~skill | F.col("card").isNotNull())
    return rows.select(
        "case_id", F.col("timestep").cast("bigint"), "prompt_id", "split", F.when(skill, F.concat(F.lit("skill:"), "name")).otherwise("free").alias("prompt_source"),
        F.col("text").alias("prompt_text"), F.when(skill, F.col("card")).alias("skill_card_text"), F.lit(image).alias("sandbox_image"),
    ).orderBy(*KEY)


def unresolved(cases: DataFrame, prompts: DataFrame, cards: DataFrame) -> DataFrame:
    """Prompts of unknown cases, and skill prompts without a card, as findings."""
    lost = prompts.join(cases, "case_id", "left_anti").select(F.lit("prompt").alias("scope"), F.concat_ws("/", "case_id", "prompt_id").alias("place"), F.lit("unknown case").alias("detail"))
    bare = prompts.where("text IS NULL").join(cards, "name", "left_anti").select(F.lit("prompt").alias("scope"), F.concat_ws("/", "case_id", "prompt_id").alias("place"), F.lit("unknown skill").alias("detail"))
    return lost.unionByName(bare)


def row_findings(rows: DataFrame) -> DataFrame:
    """Task rows against their own rules: key and finding."""
    skill = F.coalesce(F.col("prompt_source").startswith("skill:"), F.lit(False))
    has = lambda c: F.col(c).isNotNull()
    found = F.concat(
        finding(has("prompt_text") == has("skill_card_text"), "exactly_one_text"),
        finding(skill & ~has("skill_card_text"), "skill_without_card"),
        finding(~skill & (F.coalesce(F.col("prompt_source"), F.lit("")) != "free"), "prompt_source:", F.col("prompt_source")),
        finding(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), "split:", F.col("split")),
        finding(F.coalesce(F.col("timestep") < 1, F.lit(True)), "timestep:", F.col("timestep")),
    )
    return rows.select(*KEY, F.explode(found).alias("finding"))


def diff(want: DataFrame, have: DataFrame, key: list[str] = KEY, compared: list[str] = COMPARED) -> DataFrame:
    """Missing and extra keys, and columns that differ: key columns and finding.

    Both sides are aligned by a full outer join on the whole key; duplicates are ``duplicates``' matter.
    """
    left = want.select(*key, F.struct(*compared).alias("a"))
    right = have.select(*key, F.struct(*compared).alias("b"))
    both = left.join(right, key, "full_outer")
    differs = F.concat(*[finding(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), f"differs:{c}") for c in compared])
    found = F.when(F.col("b").isNull(), F.array(F.lit("missing"))).when(F.col("a").isNull(), F.array(F.lit("extra"))).otherwise(differs)
    return both.select(*key, F.explode(found).alias("finding"))


def verify(want: DataFrame, have: DataFrame) -> DataFrame:
    """The whole verification: each check with its number of findings and whether it passed."""
    d = diff(want, have.select(*KEY, *COMPARED).distinct()).groupBy(F.regexp_extract("finding", "^[a-z]+", 0).alias("check")).agg(F.count("*").alias("n"))
    dup = duplicates(have).agg(F.lit("duplicate").alias("check"), F.count("*").alias("n")).select("check", "n")
    bad = row_findings(have).agg(F.lit("row").alias("check"), F.count("*").alias("n")).select("check", "n")
    names = want.sparkSession.createDataFrame([(c,) for c in ("missing", "extra", "differs", "duplicate", "row")], "check string")
    counted = names.join(d.unionByName(dup).unionByName(bad), "check", "left")
    return counted.select("check", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), (F.coalesce("n", F.lit(0)) == 0).alias("passed"))


def row_at(rows: DataFrame, position: int, key: list[str] = KEY) -> DataFrame:
    """The row at a position (from 0) of the sorted table; raises if there is none."""
    found = rows.orderBy(*key).offset(position).limit(1) if position >= 0 else rows.limit(0)
    if found.isEmpty():
        raise IndexError(f"no row {position}")
    return found


def write_task_table(rows: DataFrame, path: str) -> dict:
    """The sorted table as Parquet (its parts in order), and its lock: rows by split and a digest of the rows that no writer version changes."""
    rows.orderBy(*KEY).write.mode("overwrite").parquet(path)
    cols = [*KEY, *COMPARED]
    hashes = F.xxhash64(F.to_json(F.struct(*cols))).cast("decimal(38,0)")  # summed, so that equal rows don't cancel
    digest = rows.agg(F.count("*").alias("rows"), F.sum(hashes).alias("x"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS]).first()
    return {"rows": digest["rows"], "digest": f"{int(digest['x'] or 0) % 2**64:016x}"} | {s: digest[s] for s in SPLITS}


def lock_text(lock: dict) -> str:
    """A lock as it is stored: sorted members, two spaces, a new line at the end."""
    return json.dumps(lock, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def request(rows: DataFrame, base: dict) -> DataFrame:
    """Each task as a nested request document: task_id, request (JSON)."""
    body = F.struct(
        F.struct("case_id", "timestep", "split", "prompt_id", "prompt_source").alias("metadata"), F.struct(F.col("sandbox_image").alias("image")).alias("runtime"),
        F.struct(F.coalesce("prompt_text", "skill_card_text").alias("text")).alias("prompt"), *[F.lit(v).alias(k) for k, v in sorted(base.items())],
    )
    return rows.select("task_id", F.to_json(body).alias("request"))


def identifier(text: Column, kind: str) -> Column:
    """Whether a name has the grammar of its kind; a trailing new line is no match."""
    pattern = {"case": r"^[a-z0-9][a-z0-9_-]*\z", "session": r"^[A-Za-z0-9][A-Za-z0-9._-]*\z", "prompt": r"^[a-z0-9][a-z0-9:_-]*\z", "page_file": r"^page_[0-9]{4}\.md\z", "timestep": r"^timestep-[1-9][0-9]*\z"}[kind]
    return F.coalesce(text.rlike(pattern), F.lit(False))


def only(rows: DataFrame, cases: list[str]) -> DataFrame:
    """The rows of the named cases; a name that isn't there is an error."""
    unknown = set(cases) - {r[0] for r in rows.where(F.col("case_id").isin(cases)).select("case_id").distinct().collect()}  # at most the names given
    if unknown:
        raise ValueError(f"unknown cases: {', '.join(sorted(unknown))}")
    return rows.where(F.col("case_id").isin(cases))


def split_mismatch(rows: DataFrame, lock: DataFrame) -> DataFrame:
    """Cases whose split isn't the lock's (case_id, split), or that the lock lacks: case_id, finding."""
    found = rows.select("case_id", "split").distinct().join(lock.select("case_id", F.col("split").alias("locked"), F.lit(True).alias("known")), "case_id", "left")
    return found.where(F.col("known").isNull() | ~F.col("split").eqNullSafe(F.col("locked"))).select("case_id", F.when(F.col("known").isNull(), "not_locked").otherwise(F.concat(F.lit("split:"), F.coalesce("split", F.lit("None")), F.lit("!="), F.coalesce("locked", F.lit("None")))).alias("finding"))


def page_diff(source: DataFrame, clone: DataFrame) -> DataFrame:
    """Pages of a source against those of its clone by case, branch and page: key and missing, extra or differs."""
    key = ["case_id", "branch", "page"]
    both = source.select(*key, F.col("sha256").alias("a")).join(clone.select(*key, F.col("sha256").alias("b")), key, "full_outer")
    return both.select(*key, F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "differs").alias("finding")).where("finding IS NOT NULL")


def agent_shaped(messages: Column, tools: Column, members: Column) -> Column:
    """Whether a request is an agent's: two messages or more, a system one among them, tools, and a member named stream, whatever its value."""
    has = F.exists(messages, lambda m: F.coalesce(m["role"] == "system", F.lit(False)))
    return F.coalesce((F.size(messages) >= 2) & has & (F.size(tools) > 0) & F.array_contains(members, "stream"), F.lit(False))

"""Retrieval under a page cutoff: chunks are filtered before they are ranked, pages take their best chunk.

A hit's score is 1 less the cosine distance; order is by falling score, then page (or id); only positive
scores are hits. k is brought into 1 .. MAX_K. No candidates give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.arrays import cosine
from tracelode.functions.text import page_file

DEFAULT_K, MAX_K = 5, 20
#: Rows of one block of chunks, and queries of one block: what meets in one matrix product.
ROWS, BLOCK = 1024, 512


def clamp_k(k: int, most: int = MAX_K) -> int:
    return max(1, min(most, k))


def _vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def search_case(chunks: DataFrame, query: list[float], case: object, cutoff: int, k: int = DEFAULT_K) -> DataFrame:
    """The best pages of one case up to ``cutoff``: page, file, score, rank.

    The filter reaches the scan; the aggregation is partial; the k rows come by a top-k, not a sort.
    """
    seen = chunks.where((F.col("case") == case) & (F.col("page") <= cutoff))
    pages = seen.select("page", cosine(F.col("embedding"), _vector(query)).alias("score")).groupBy("page").agg(F.max("score").alias("score"))
    best = pages.orderBy(F.col("score").desc(), F.col("page")).limit(clamp_k(k)).where(F.col("score") > 0)
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("page")))  # over k rows
    return best.select("page", page_file(F.col("page")).alias("file"), "score", rank.alias("rank"))


def search_all(rows: DataFrame, query: list[float], k: int = DEFAULT_K) -> DataFrame:
    """The best rows of a whole corpus: id, score, rank."""
    scored = rows.select("id", cosine(F.col("embedding"), _vector(query)).alias("score"))
    best = scored.orderBy(F.col("score").desc(), F.col("id")).limit(clamp_k(k)).where(F.col("score") > 0)
    return best.select("id", "score", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("id"))).alias("rank"))


def _blocks(rows: DataFrame, by: str, per: int, value: str) -> DataFrame:
    """``rows`` in blocks of about ``per`` of one case: case, block, ``value`` (array of struct of the other columns).

    Blocks are cut by a hash of ``by``, so that rows of one value meet, and a case of any size is spread over as many blocks as it needs.
    """
    sizes = rows.groupBy(F.col("case").alias("of")).agg(F.ceil(F.count("*") / per).cast("int").alias("n"))
    cut = rows.join(sizes, F.col("case") == F.col("of")).withColumn("block", F.pmod(F.xxhash64(by), F.col("n")).cast("int"))
    inner = [c for c in rows.columns if c != "case"]
    return cut.groupBy("case", "block").agg(F.collect_list(F.struct(*inner)).alias(value), F.first("n").alias("n"))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    e = flat.reshape(len(lists), -1)
    return e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)


def _pair_scores(k: int, scoped: bool):
    """Top units of each query in each pair of blocks: columns chunks, queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found, values = [], [], []
            for i in range(b.num_rows):
                chunks, queries = b.column(0)[i].values, b.column(1)[i].values
                units, pos = np.unique(chunks.field("unit").to_numpy(zero_copy_only=False), return_inverse=True)
                names, cutoffs = queries.field("query_id").to_numpy(zero_copy_only=False), queries.field("cutoff").to_numpy(zero_copy_only=False)
                scores = np.full((len(units), len(names)), -np.inf)
                np.maximum.at(scores, pos, _matrix(chunks.field("embedding")) @ _matrix(queries.field("embedding")).T)
                if scoped:
                    scores[units[:, None] > cutoffs[None, :]] = -np.inf
                # Units are ascending and the sort is stable: equal scores keep the order of the units.
                best = np.argsort(-scores, axis=0, kind="stable")[:k]
                top = np.take_along_axis(scores, best, axis=0)
                at, q = np.nonzero(top > 0)
                ids.append(names[q])
                found.append(units[best[at, q]])
                values.append(top[at, q])
            flat = [np.concatenate([np.zeros(0), *x]) for x in (ids, found, values)]
            yield pa.RecordBatch.from_arrays([pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int64)), pa.array(flat[2])], names=["query_id", "unit", "score"])

    return run


def search_many(rows: DataFrame, queries: DataFrame, k: int = DEFAULT_K, scoped: bool = True, block: int = BLOCK) -> DataFrame:
    """The best units of each query: query_id, unit, score, rank.

    ``rows``: case, unit (page or id), embedding; ``queries``: query_id, case, cutoff, embedding.
    Both sides stay distributed: they are cut into blocks within their case, a block of queries goes to every
    block of its case, and where two blocks meet, one matrix product gives each query its k best units of
    that block. Nothing but these is shuffled further; no pairs are emitted. A hot case is as many blocks as it
    needs. A unit among the k best is among the k best of the block that holds it, so the result is
    exact. Unscoped, all rows are one case; ``search_index`` is the way that doesn't read them all.
    """
    k = clamp_k(k)
    r = rows.where("embedding IS NOT NULL").select("case" if scoped else F.lit(0).alias("case"), F.col("unit").cast("bigint"), "embedding")
    q = queries.where("embedding IS NOT NULL").select("case" if scoped else F.lit(0).alias("case"), F.col("query_id").cast("bigint"), F.col("cutoff").cast("bigint"), "embedding")
    chunks = _blocks(r, "unit", ROWS, "chunks")
    parts = chunks.groupBy(F.col("case").alias("of")).agg(F.max("n").alias("parts"))
    asked = _blocks(q, "query_id", block, "queries").drop("block", "n").join(parts, F.col("case") == F.col("of"))
    spread = asked.select(F.col("case").alias("qcase"), "queries", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("qblock"))
    pairs = chunks.join(spread, (F.col("case") == F.col("qcase")) & (F.col("block") == F.col("qblock"))).select("chunks", "queries")
    found = pairs.mapInArrow(_pair_scores(k, scoped), "query_id bigint, unit bigint, score double")
    best = found.groupBy("query_id", "unit").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("unit"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: An index is fitted on so many rows at most; every row is put into a list.
SAMPLE = 20_000


def fit_lists(rows: DataFrame, lists: int, sample: int = SAMPLE, rounds: int = 12, seed: int = 7, k: int = DEFAULT_K, recall: float = 0.95) -> tuple[np.ndarray, int]:
    """Centroids of ``lists`` lists by spherical k-means over at most ``sample`` rows, those of the lowest hashes, and how many
    lists a query has to read so that ``recall`` of the k best rows of the sample are in them (measured on 500 of its rows as queries)."""
    picked = rows.where("embedding IS NOT NULL").select("embedding", F.xxhash64("unit", F.lit(seed)).alias("h")).orderBy("h").limit(sample).toArrow()
    if not picked.num_rows:
        return np.zeros((0, 0)), 1
    e = _matrix(picked.column("embedding").combine_chunks())
    c = e[np.random.default_rng(seed).choice(len(e), min(lists, len(e)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(e @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, e)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    near, asked = np.argmax(e @ c.T, axis=1), e[:500]
    best = np.argsort(-(asked @ e.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ c.T), axis=1, kind="stable"), axis=1)  # of each list in a query's order
    needed = np.sort(np.take_along_axis(place, near[best], axis=1), axis=None)
    return c, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def in_lists(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """``rows`` (a key and an embedding) with the ``probes`` nearest lists of each: list, then the columns as they are."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not len(centroids):
                continue
            near = np.argsort(-(_matrix(b.column(b.schema.get_field_index("embedding"))) @ centroids.T), axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), *(c.take(at) for c in b.columns)], names=["list", *b.schema.names])

    known = rows.where("embedding IS NOT NULL")
    return known.mapInArrow(run, T.StructType([T.StructField("list", T.IntegerType()), *known.schema.fields]))


def search_index(rows: DataFrame, queries: DataFrame, k: int = DEFAULT_K, lists: int = 64, probes: int | None = None, sample: int = SAMPLE, recall: float = 0.95) -> DataFrame:
    """As ``search_many`` unscoped, by inverted lists: a query reads its nearest ``probes`` of ``lists`` lists only.

    The lists are fitted on a bounded sample and hold every row. Unless it is given, ``probes`` is what the sample needs for
    ``recall``: few for vectors that lie in clusters, many for vectors that don't. What is found is scored exactly.
    """
    centroids, enough = fit_lists(rows, lists, sample, k=k, recall=recall)
    r = in_lists(rows.select(F.col("unit").cast("bigint").alias("unit"), "embedding"), centroids, 1).select(F.col("list").alias("case"), "unit", "embedding")
    q = in_lists(queries.select("query_id", "embedding"), centroids, probes or enough).select("query_id", F.col("list").alias("case"), F.lit(2**62).alias("cutoff"), "embedding")
    return search_many(r, q, k)


def attach(hits: DataFrame, rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Hits with further columns of their rows; after the ranking, so that only those of k rows a query are fetched."""
    return hits.join(rows.select(*keys, *columns), keys, "left")


def attach_pages(hits: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Hits with the text of their pages."""
    return attach(hits, pages, keys, ["text"])


def embed(rows: DataFrame, key: str, text: str, encode: Callable[[list[str]], np.ndarray], batch: int = 32) -> DataFrame:
    """``key`` and a unit vector of ``text`` for each row, by any encoder of a list of texts; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            parts = [np.asarray(encode(texts[i : i + batch]), np.float64) for i in range(0, len(texts), batch)]
            if not parts:
                continue
            v = np.concatenate(parts)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=[key, "embedding"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(text).cast("string").alias("t")).mapInArrow(run, f"`{key}` {kind}, embedding array<float>")


def case_status(pages: DataFrame, cutoff: int) -> DataFrame:
    """Of each case its visible pages: case_id, n_pages, max_page."""
    return pages.where(F.col("page") <= cutoff).groupBy("case_id").agg(F.countDistinct("page").alias("n_pages"), F.max("page").alias("max_page"))


def decision_stats(rows: DataFrame, from_year: int | None = None, to_year: int | None = None, court: str | None = None) -> DataFrame:
    """Total, by year and by court of the filtered corpus, in one pass: dim, key, n."""
    if from_year is not None:
        rows = rows.where(F.col("year") >= from_year)
    if to_year is not None:
        rows = rows.where(F.col("year") <= to_year)
    if court is not None:
        rows = rows.where(F.col("court") == court)
    sets = rows.groupingSets([[], ["year"], ["court"]], "year", "court").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    dim = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "year").otherwise("court")
    key = F.when(F.col("g") == 1, F.col("year").cast("string")).when(F.col("g") == 2, F.col("court"))
    return sets.select(dim.alias("dim"), key.alias("key"), "n")


def scope_errors(requests: DataFrame, cases: DataFrame) -> DataFrame:
    """Requests for a case that is unknown or a cutoff that isn't one of its pages: all columns and error."""
    joined = requests.join(cases.select(F.col("case_id").alias("known"), "n_pages"), F.col("case_id") == F.col("known"), "left")
    error = F.when(F.col("known").isNull(), "unknown_case").when(~F.coalesce(F.col("cutoff").between(1, F.col("n_pages")), F.lit(False)), "cutoff_out_of_range")
    return joined.withColumn("error", error).where("error IS NOT NULL").drop("known", "n_pages")


# --- the stored index ---------------------------------------------------------------------------


def fingerprint(chunks: DataFrame, settings: dict) -> str:
    """A hash of an index's settings and of all its rows with all their columns; one row reaches the driver.

    Rows are summed by their hashes beside their number, so that equal rows don't cancel and their order doesn't count.
    """
    import hashlib

    cols = sorted(chunks.columns)
    whole = chunks.agg(F.count("*").alias("n"), *[F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")).cast("string").alias(f"s{seed}") for seed in (1, 2)]).first()
    return hashlib.sha256(json.dumps({"settings": settings, "columns": cols, "rows": list(whole)}, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def save_index(chunks: DataFrame, path: str, settings: dict) -> str:
    """The chunks as Parquet by case, with their count and fingerprint beside them."""
    mark = fingerprint(chunks, settings)
    chunks.write.mode("overwrite").partitionBy("case").parquet(f"{path}/chunks")
    spark = chunks.sparkSession
    spark.createDataFrame([(mark, spark.read.parquet(f"{path}/chunks").count())], "fingerprint string, rows bigint").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return mark


class StaleIndex(RuntimeError):
    """A stored index is missing, corrupt or of other data."""


def load_index(spark, path: str, expected: str | None = None) -> DataFrame:
    """The stored chunks; refused if there are none, or if their count or, when given, the fingerprint differs."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in ("meta", "chunks"):
        if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{part}/_SUCCESS")):
            raise StaleIndex(f"no whole {part} are stored")
    meta = spark.read.json(f"{path}/meta").first()
    chunks = spark.read.parquet(f"{path}/chunks")
    if meta is None or chunks.count() != meta["rows"]:
        raise StaleIndex("the stored chunks are incomplete")
    if expected is not None and meta["fingerprint"] != expected:
        raise StaleIndex("the stored index is of other data or settings")
    return chunks


def index(chunks: DataFrame, path: str, settings: dict, policy: str = "if-stale") -> DataFrame:
    """The index by policy: ``always`` rebuilds, ``never`` takes what is stored or fails, ``if-stale`` rebuilds unless the fingerprint holds."""
    spark = chunks.sparkSession
    if policy not in ("if-stale", "always", "never"):
        raise ValueError(f"unknown policy {policy!r}")
    if policy != "always":
        try:
            return load_index(spark, path, fingerprint(chunks, settings))
        except StaleIndex:  # any other failure is no reason to build anew
            if policy == "never":
                raise
    save_index(chunks, path, settings)
    return load_index(spark, path)

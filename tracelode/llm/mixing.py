"""Sources mixed to target weights by Pfair scheduling.

The mixture is as large as the scarcest source allows at its weight: the least of (tokens times
max_repeats) over weight. It is a sequence of ``slots`` blocks of equal size. The k-th block of a
source of weight w is released at slot ``floor(k / w)`` and due by ``ceil((k + 1) / w)``; in each
slot the released block with the earliest deadline goes first, which keeps every source less than one block
from its share at every slot. A source's documents follow in order of a hash, pass after pass; a
document goes to the block in which its middle falls, and is used if that is within the quota.

A block holds at least ``DOCS`` documents of mean size, so that a document is small against it: there are at most ``SLOTS``
blocks, fewer for a small mixture (unless their number is given). ``shares`` gives each source's greatest deviation from its share in the order of
the mixture. The sums that place documents in their source are taken per source and hash bucket, with a bucket for
every ``PART`` documents, so that a source that holds a third of all rows is summed in many tasks; one row a
source reaches the driver.

Defined results: sources without weight, or missing on either side, give no documents (their
actual share is 0; weights are taken relative to the sources present); a null max_repeats is 1, one
below 1 excludes the source; documents without tokens are not used; a doc_id given twice
counts once; a null source or doc_id is left out; empty tables give an empty mixture; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm.tokens import encode
from tracelode.runtime import checkpointed

SLOTS = 4096
#: Mean documents in a block at least; documents in a bucket.
DOCS, PART = 8, 100_000
#: The targets are a reference table that the driver holds.
MAX_SOURCES = 10_000


def schedule(weights: dict[str, float], slots: int) -> dict[str, list[int]]:
    """The slot of each source's blocks in turn, by earliest deadline among the released."""
    out: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, s) for s, w in sorted(weights.items()) if w > 0]  # by release
    due: list[tuple[int, int, str]] = []  # by deadline
    heapq.heapify(waiting)
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            k = len(out[s])
            heapq.heappush(due, (math.ceil((k + 1) / weights[s] - 1e-9), k, s))
        if not due:
            continue
        _, k, s = heapq.heappop(due)
        out[s].append(slot)
        heapq.heappush(waiting, (math.floor((k + 1) / weights[s] + 1e-9), s))
    return out


def sized(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source and n_tokens of the documents of weighted sources; each doc_id once."""
    wanted = F.broadcast(targets.where("target_weight > 0 AND source IS NOT NULL").select("source").distinct())
    rows = documents.where("doc_id IS NOT NULL").join(wanted, "source", "left_semi").select(F.struct("doc_id", "source").alias("k"), "text")
    counted = encode(rows, "k", "text", vocabulary, sizes_only=True)
    return counted.groupBy("k.doc_id").agg(F.min(F.struct("k.source", "n_tokens")).alias("d")).select("doc_id", "d.*").where("n_tokens > 0")


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.groupBy("source").agg(F.max("target_weight").alias("w"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("r")).where("source IS NOT NULL").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the targets")
    return {r["source"]: (r["w"] if r["w"] and r["w"] > 0 else 0.0, max(0, r["r"])) for r in rows}


def _planned(documents: DataFrame, targets: DataFrame, vocabulary: str | None, slots: int | None) -> tuple[DataFrame, float]:
    """The uses of documents, as ``mixture`` gives them, and the tokens of a block."""
    spark = documents.sparkSession
    want = _targets(targets)
    docs = checkpointed(sized(documents, targets, vocabulary).withColumn("h", F.xxhash64("doc_id")))
    sums = docs.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("c")).collect()  # one row a source
    total = {r["source"]: r["n"] for r in sums}
    buckets = max(1, -(-max((r["c"] for r in sums), default=0) // PART))
    docs = docs.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 40), F.lit(buckets)).cast("int"))
    usable = {s: w for s, (w, reps) in want.items() if w > 0 and reps > 0 and total.get(s)}
    weight = {s: w / sum(usable.values()) for s, w in usable.items()}
    size = min((total[s] * want[s][1] / w for s, w in weight.items()), default=0.0)
    mean = sum(total.values()) / max(1, sum(r["c"] for r in sums))
    slots = slots or max(1, min(SLOTS, int(size / (DOCS * mean)) if mean else 1))
    block = size / slots or 1.0
    plan = schedule(weight, slots)
    rows = [(s, size * w, total[s], min(want[s][1], max(1, math.ceil(size * w / total[s] - 1e-9))), plan[s] or [slots - 1]) for s, w in weight.items()]
    quota = spark.createDataFrame(rows, "source string, quota double, total bigint, passes int, slots array<int>")
    parts = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = parts.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    run = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = docs.withColumn("upto", F.sum("n_tokens").over(run)).join(base, ["source", "bucket"]).join(F.broadcast(quota.drop("slots")), "source")
    uses = placed.select("source", "doc_id", "n_tokens", "quota", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("repeat_no"), (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("at"), "total")
    uses = uses.withColumn("begin", F.col("at") + F.col("repeat_no") * F.col("total")).withColumn("mid", F.col("begin") + F.col("n_tokens") / 2).where("mid < quota + 1e-6")
    slot = F.element_at("slots", F.least(F.floor(F.col("mid") / block).cast("int") + 1, F.size("slots")))
    return uses.join(F.broadcast(quota.select("source", "slots")), "source").select("source", "doc_id", "repeat_no", "n_tokens", slot.alias("slot"), "begin"), block


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None, slots: int | None = None) -> DataFrame:
    """The uses of documents: source, doc_id, repeat_no (from 0), n_tokens, slot, begin.

    In order of (slot, source, begin) they are the interleaved mixture; ``begin`` is the use's first token
    among its source's.
    """
    return _planned(documents, targets, vocabulary, slots)[0]


def deviations(uses: DataFrame) -> DataFrame:
    """How far each source of a mixture is at most, before or after a slot of its own, from its share of what was emitted so far: source, tokens.

    Uses are summed by slot first: at most slots x sources rows are ordered.
    """
    whole = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = uses.groupBy("slot", "source").agg(F.sum("n_tokens").alias("n"))
    slots = per.groupBy("slot").agg(F.sum("n").alias("all")).withColumn("upto", F.sum("all").over(whole))
    rows = per.join(slots, "slot").withColumn("own", F.sum("n").over(mine)).withColumn("share", F.sum("n").over(Window.partitionBy("source")) / F.lit(1.0))
    total = per.agg(F.sum("n").alias("total"))
    w = F.col("share") / F.col("total")
    after, before = F.abs(F.col("own") - w * F.col("upto")), F.abs(F.col("own") - F.col("n") - w * (F.col("upto") - F.col("all")))
    return rows.join(F.broadcast(total)).groupBy("source").agg(F.max(F.greatest(after, before)).alias("tokens"))


def shares(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None, slots: int | None = None) -> DataFrame:
    """Each target source with what the mixture gives it: uses, documents, most repeats, tokens, its longest document, actual share, and its greatest
    deviation from its share in the order of the mixture, in blocks (``block_tokens``)."""
    uses, block = _planned(documents, targets, vocabulary, slots)
    uses = checkpointed(uses)
    got = uses.groupBy("source", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("longest"))
    got = got.groupBy("source").agg(F.max("longest").cast("bigint").alias("longest"), F.sum("k").alias("uses"), F.count("*").alias("docs"), F.max("k").alias("most_repeats"), F.sum("n").alias("tokens"))
    got = checkpointed(got.join(deviations(uses).withColumnRenamed("tokens", "off"), "source"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    want = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    zero = F.lit(0).cast("bigint")
    return want.join(got, "source", "left").join(F.broadcast(whole)).select(
        "source", "target_weight", "max_repeats", *[F.coalesce(c, zero).alias(c) for c in ("uses", "docs", "most_repeats", "tokens", "longest")],
        F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"), F.lit(float(block)).alias("block_tokens"), F.round(F.coalesce(F.col("off"), F.lit(0.0)) / block, 4).alias("greatest_deviation"),
    )

"""Traces laid into training rows of fixed capacity by bulk-synchronous best fit.

Items and gaps of equal length are interchangeable, so the rounds work on runs: the number of items
of each length and the row intervals of each gap, both sorted. The runs come from one distributed count and
are at most ``capacity`` numbers, whatever the size of the table; they are all that reaches the driver. A round places all items of one length: a sweep over the gaps that follow the length, the smallest
first, gives each gap as many items as it holds, conflicts for a gap being resolved by the items' rank; items
without a gap open rows; then the gaps are updated, and the next shorter length follows. That is best
fit, longest first, exactly. The items themselves are ranked within their length in parts of about ``PART`` items,
the parts' bases being summed where they lie, and find their place by binary search in the plan.

Defined results: an item longer than the capacity is cut into full rows and a rest, every other
item stays whole; a null array has no ids; a trace without ids has length 0 and neither row nor
offset; rows repeated under one trace_id count once (the longest); rows of null
trace_id are told apart by their ids and mask; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.runtime import checkpointed

CAPACITY = 4096
#: Items of one length that are ranked in one task; a length has as many parts as its count asks for.
PART = 100_000
#: Above this, the plan would no longer be small; lengths would have to be grouped.
MAX_CAPACITY = 1 << 17


class Plan:
    """Where the items of each length go, as runs: the items of ``length`` from ``rank`` on lie ``each`` to a row,
    from ``row`` on, the first at ``offset``."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.rows, self.rounds = capacity, 0, 0
        self._gaps: dict[int, list[tuple[int, int]]] = {}  # gap to its row intervals (first, many)
        self._sizes: list[int] = []  # the gaps there are, ascending
        self._runs: list[tuple[int, int, int, int, int]] = []
        for length in sorted((n for n, c in counts.items() if c), reverse=True):
            self._round(length, counts[length])
        runs = np.array(sorted(self._runs), np.int64).reshape(-1, 5)
        self.length, self.rank, self.row, self.offset, self.each = runs.T
        self.key = self.length << 40 | self.rank

    def _free(self, gap: int, row: int, many: int) -> None:
        if gap and many:
            if gap not in self._gaps:
                self._gaps[gap] = []
                bisect.insort(self._sizes, gap)
            self._gaps[gap].append((row, many))

    def _round(self, length: int, left: int) -> None:
        """All items of a length at once: by rank into the gaps that follow it, the smallest first, the rest into new rows."""
        self.rounds += 1
        rank, freed = 0, []
        at = bisect.bisect_left(self._sizes, length)
        while left:
            if at < len(self._sizes):
                gap = self._sizes[at]
                row, many = self._gaps[gap].pop()
                if not self._gaps[gap]:
                    del self._gaps[gap]
                    self._sizes.pop(at)
            else:
                gap, row = self.capacity, self.rows
                many = -(-left // (self.capacity // length))
                self.rows += many
            each = gap // length
            took = min(left, many * each)
            self._runs.append((length, rank, row, self.capacity - gap, each))
            full, part = divmod(took, each)
            freed.append((gap - each * length, row, full))
            if part:
                freed.append((gap - part * length, row + full, 1))
            used = full + bool(part)
            freed.append((gap, row + used, many - used))
            rank, left = rank + took, left - took
        for f in freed:
            self._free(*f)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and offset of the items."""
        at = np.searchsorted(self.key, length.astype(np.int64) << 40 | rank, side="right") - 1
        nth = rank - self.rank[at]
        return self.row[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def _size(c: str):
    return F.greatest(F.size(c), F.lit(0))


def _mark(c: str = "trace_id"):
    """What tells rows of null trace_id apart; 0 for all others."""
    return F.when(F.col(c).isNull(), F.xxhash64("prompt_ids", "response_ids", "loss_mask")).otherwise(F.lit(0).cast("bigint"))


def items(traces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The whole traces, or their parts of at most ``capacity`` ids: trace_id, mark (0, for null ids a hash), part, begin, length."""
    columns = {c for c in traces.columns}
    mark = _mark() if "loss_mask" in columns else F.lit(0).cast("bigint")
    sizes = traces.select("trace_id", mark.alias("mark"), (_size("prompt_ids") + _size("response_ids")).alias("n")).groupBy("trace_id", "mark").agg(F.max("n").alias("n"))
    part = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int"))).alias("part")
    return sizes.select("trace_id", "mark", "n", part).select(
        "trace_id", "mark", "part", (F.col("part") * capacity).alias("begin"), F.least(F.col("n") - F.col("part") * capacity, F.lit(capacity)).cast("int").alias("length"),
    )


def _ranked(parts: DataFrame, counts: dict[int, int], per: int) -> DataFrame:
    """``parts`` with ``k``, each item's rank among those of its length, from 0."""
    hot = {n: -(-c // per) for n, c in counts.items() if c > per}
    salts = F.coalesce(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv])[F.col("length")], F.lit(1)) if hot else F.lit(1)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("trace_id", "mark", "part"), salts).cast("int"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("trace_id", "mark", "part")).cast("bigint") - 1
    ranked = salted.withColumn("k", within)
    if not hot:
        return ranked.drop("salt")
    sizes = salted.where(F.col("length").isin(*hot)).groupBy("length", "salt").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    return ranked.join(bases, ["length", "salt"], "left").withColumn("k", F.col("k") + F.coalesce("base", F.lit(0))).drop("salt", "base")


def _pack(traces: DataFrame, capacity: int, per: int) -> DataFrame:
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be in 1 .. {MAX_CAPACITY}")
    parts = checkpointed(items(traces, capacity))
    counted = parts.where("length > 0").groupBy("length").count().toArrow().to_pydict()  # at most capacity rows
    counts = dict(zip(counted["length"], counted["count"]))
    shared = parts.sparkSession.sparkContext.broadcast(Plan(counts, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            length, k = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "k"))
            empty = length == 0
            if len(p.key):
                row, offset = p.find(np.where(empty, p.length[0], length), np.where(empty, 0, k))
            else:
                row, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("trace_id", "mark", "part", "begin", "length")] + [pa.array(row, pa.int64(), mask=empty), pa.array(offset.astype(np.int32), pa.int32(), mask=empty)],
                names=["trace_id", "mark", "part", "begin", "length", "row", "offset"],
            )

    return _ranked(parts, counts, per).mapInArrow(run, "trace_id bigint, mark bigint, part int, begin int, length int, row bigint, offset int")


def pack(traces: DataFrame, capacity: int = CAPACITY, per: int = PART) -> DataFrame:
    """The place of every trace: trace_id, part, begin (in the trace's ids), length, row, offset."""
    return _pack(traces, capacity, per).drop("mark")


def oversize(traces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The traces that don't fit a row whole, from their places."""
    return pack(traces, capacity).where("part = 1").select("trace_id")


def fill(layout: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """How full the rows are: rows, ids, the least number of rows that could hold them, mean fill."""
    used = layout.where("length > 0").groupBy("row").agg(F.sum("length").alias("used"))
    return used.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("used"), F.lit(0)).alias("ids"), F.ceil(F.coalesce(F.sum("used"), F.lit(0)) / capacity).alias("least_rows"),
        F.max("used").cast("bigint").alias("fullest"), F.round(F.avg("used") / capacity, 6).alias("mean_fill"),
    )


def _press(ids: np.ndarray, mask: np.ndarray) -> bytes:
    """Ids and mask as bytes, by byte planes: most planes are zeros, and what is left is as compressible as text."""
    return zlib.compress(np.concatenate([ids, mask]).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpress(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()
    return both[: len(both) // 2], both[len(both) // 2 :]


def _numbers(values: pa.Array) -> np.ndarray:
    return pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.int32)


def _stretches(traces: DataFrame, capacity: int) -> DataFrame:
    """The parts of every trace with their ids and mask pressed: trace_id, mark, part, n (ids of the whole trace), data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, parts, sizes, data = [], [], [], []
            for i in range(b.num_rows):
                prompt, response, mask = (_numbers(b.column(c)[i].values) if b.column(c)[i].is_valid else np.zeros(0, np.int32) for c in (2, 3, 4))
                ids, marks = np.concatenate([prompt, response]), np.zeros(len(prompt) + len(response), np.int32)
                k = min(len(response), len(mask))
                marks[len(prompt) : len(prompt) + k] = mask[:k]
                for part, at in enumerate(range(0, len(ids), capacity)):
                    keys.append(i)
                    parts.append(part)
                    sizes.append(len(ids))
                    data.append(_press(ids[at : at + capacity], marks[at : at + capacity]))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(keys, pa.int64())) for c in (0, 1)), pa.array(parts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], names=["t", "m", "p", "n", "data"])

    rows = traces.select(F.col("trace_id").cast("bigint").alias("t"), _mark().alias("m"), *[F.col(c).cast("array<int>") for c in ("prompt_ids", "response_ids", "loss_mask")])
    return rows.mapInArrow(run, "t bigint, m bigint, p int, n int, data binary")


def training_rows(traces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows themselves: row, n_used, ids, loss_mask, trace_ids (one for each stretch, in order).

    A prompt's mask is 0; a response's is its loss_mask, 0 where that is null or too short; a null id is 0.
    The ids are pressed where they are read, go through the two shuffles pressed, and are laid out where their row is made.
    """
    layout = _pack(traces, capacity, PART).where("length > 0").select("trace_id", "mark", "part", "row", "offset")
    placed = _stretches(traces, capacity).join(layout, F.col("t").eqNullSafe(F.col("trace_id")) & (F.col("m") == F.col("mark")) & (F.col("p") == F.col("part")))
    # Of copies of a trace the longest comes first in its place; the others are passed over.
    rows = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("offset", (-F.col("n")).alias("shorter"), "trace_id", "data"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, masks, used, names = [], [], [], []
            for stretches in b.column(1).to_pylist():
                mine, at = [], -1
                for x in stretches:
                    if x["offset"] != at:
                        at = x["offset"]
                        mine.append(x)
                opened = [_unpress(x["data"]) for x in mine]
                ids.append(np.concatenate([o[0] for o in opened]))
                masks.append(np.concatenate([o[1] for o in opened]))
                used.append(len(ids[-1]))
                names.append([x["trace_id"] for x in mine])
            ends = pa.array(np.concatenate([[0], np.cumsum(used)]).astype(np.int32))
            flat = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(used, pa.int32()), pa.ListArray.from_arrays(ends, flat(ids)), pa.ListArray.from_arrays(ends, flat(masks)), pa.array(names, pa.list_(pa.int64()))],
                names=["row", "n_used", "ids", "loss_mask", "trace_ids"],
            )

    return rows.mapInArrow(run, "row bigint, n_used int, ids array<int>, loss_mask array<int>, trace_ids array<bigint>")

"""Functions over whole Arrow buffers: bytes as ids, stretches between marks. One call handles a batch of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf


def _lists(offsets: np.ndarray, flat: pa.Array, missing: np.ndarray | None = None) -> pa.ListArray:
    mask = None if missing is None else np.append(missing, False)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=mask), flat)


def byte_ids(text: Column) -> Column:
    """The UTF-8 bytes of a text as ids, null for null: the text's own buffer, widened."""

    @arrow_udf("array<int>")
    def widen(v: pa.Array) -> pa.Array:
        v = v.cast(pa.large_binary())
        ends = np.frombuffer(v.buffers()[1], np.int64)[v.offset : v.offset + len(v) + 1] if len(v) else np.zeros(1, np.int64)
        data = v.buffers()[2]
        flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        return _lists(ends - ends[0], pa.array(flat.astype(np.int32)), v.is_null().to_numpy(zero_copy_only=False))

    return widen(text)


def segments(ids: Column, opens: int, closes: int) -> Column:
    """The stretches from an ``opens`` id to the next ``closes`` id, marks included: array of (start, end), end exclusive.

    A stretch that isn't closed runs to the end; an open mark within a stretch is part of it. Null ids have none.
    Only the marks are walked through.
    """

    @arrow_udf("array<struct<start:int,end:int>>")
    def find(v: pa.Array) -> pa.Array:
        first = np.concatenate([[0], np.cumsum(v.value_lengths().fill_null(0).to_numpy())])
        x = v.flatten().fill_null(min(opens, closes) - 1).to_numpy(zero_copy_only=False)
        marks = np.flatnonzero((x == opens) | (x == closes))
        row = np.searchsorted(first, marks, side="right") - 1
        count, starts, ends = np.zeros(len(v), np.int64), [], []
        at, of = -1, -1
        for i, r, opening in zip(marks.tolist(), row.tolist(), (x[marks] == opens).tolist()):
            if r != of:
                if at >= 0:
                    ends.append(int(first[of + 1] - first[of]))
                at, of = -1, r
            if at < 0 and opening:
                at = i
                starts.append(i - int(first[r]))
                count[r] += 1
            elif at >= 0 and x[i] == closes:
                ends.append(i + 1 - int(first[r]))
                at = -1
        if at >= 0:
            ends.append(int(first[of + 1] - first[of]))
        flat = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["start", "end"])
        return _lists(np.concatenate([[0], np.cumsum(count)]), flat)

    return find(ids)

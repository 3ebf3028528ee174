"""Wire bodies screened as wholes: one malformed member rejects its body; of a session's members in a body the last counts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators.nested import members_of

_SAFE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*\Z")


def members_with_reasons(body: str | None) -> list[tuple[object, str | None, str | None]]:
    """Each member of a body with its session_id and the reason why it is unfit, None if it is fit."""
    out = []
    for m in members_of(body):
        sid = m.get("session_id") if isinstance(m, dict) else None
        if not isinstance(m, dict):
            reason = "not_an_object"
        elif not (isinstance(sid, str) and _SAFE.match(sid)):
            reason = "unsafe_session_id"
        else:
            reason = None if isinstance(m.get("trajectory"), dict) else "no_trajectory"
        out.append((m, sid if isinstance(sid, str) else None, reason))
    return out


def screen(bodies: DataFrame) -> DataFrame:
    """Each member of each body: body_id, member_no, session_id, fit, reason.

    A member is fit if it is an object with a safe session_id and an object as trajectory. A body
    that is null or isn't one whole JSON object, or lists no member, is one unfit row with member_no -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                judged = members_with_reasons(text)
                rows += [(key, i, sid, reason) for i, (_, sid, reason) in enumerate(judged)] or [(key, -1, None, "no_member")]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["body_id", "member_no", "session_id", "reason"])

    rows = bodies.select(F.col("body_id").cast("bigint"), "body").mapInArrow(run, "body_id bigint, member_no int, session_id string, reason string")
    return rows.select("body_id", "member_no", "session_id", F.col("reason").isNull().alias("fit"), "reason")


def accepted_members(bodies: DataFrame) -> DataFrame:
    """The members of bodies without unfit ones, the last of each session in its body: body_id, member_no, session_id."""
    rows = screen(bodies)
    whole = Window.partitionBy("body_id")
    last = Window.partitionBy("body_id", "session_id").orderBy(F.col("member_no").desc())
    return rows.withColumn("ok", F.min("fit").over(whole)).where("ok").withColumn("k", F.row_number().over(last)).where("k = 1").select("body_id", "member_no", "session_id")


def raw_masks(bodies: DataFrame) -> DataFrame:
    """The loss masks in bodies, of every member and trace, as JSON text: body_id, member_no, trace_no, mask.

    A mask is whatever stands there but null; a text that isn't one whole JSON object has none (``screen`` tells them).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, m in enumerate(members_of(text)):
                    trajectory = m.get("trajectory") if isinstance(m, dict) else None
                    traces = trajectory.get("traces") if isinstance(trajectory, dict) else None
                    for k, t in enumerate(traces if isinstance(traces, list) else ()):
                        mask = t.get("loss_mask") if isinstance(t, dict) else None
                        if mask is not None:
                            rows.append((key, i, k, json.dumps(mask)))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["body_id", "member_no", "trace_no", "mask"])

    return bodies.select(F.col("body_id").cast("bigint"), "body").mapInArrow(run, "body_id bigint, member_no int, trace_no int, mask string")

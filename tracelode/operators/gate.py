"""The whole gate of a session result: admission, chain, then every rule of every trace in a fixed order.

Order: admission (status, builder findings, trajectory, traces), the chain's statistics, and for each trace
logprobs, finish reason, split, reasoning mask, page cutoff, checkout, tools, system prompts, skill card, settings, turn
openings, unused tools. A null among the traces has ADM5 in its place. What a record must state beyond the typed
tables (``EVIDENCE``) is judged only where it is asked for.

Findings are made where a trace lies; only they, and the keys by which a card is looked up, are shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tracelode.functions.arrays import finding
from tracelode.functions.text import flat_content
from tracelode.operators import rules as R
from tracelode.operators.envelopes import members_with_reasons
from tracelode.operators.nested import _fit
from tracelode.schemas import SESSION_RESULT, ddl

#: What raw bodies may state of a trace beyond the typed tables; each is judged only if it is required.
EVIDENCE = ("split", "masked", "workspace", "tools", "settings")
#: Approved values are a policy's, not data: a list beyond this is refused.
MAX_PINS = 10_000
_STATED = ddl("struct<split:string,masked:string,workspace:string,tools:string,settings:string,card:string>")
_WORKSPACE = "struct<shallow:boolean,remotes:int,branch:string,pages:struct<min:int,max:int,count:int>>"


@dataclass(frozen=True)
class Pins:
    """The approved values."""

    system_prompts: list[str] = field(default_factory=list)
    cards: list[str] = field(default_factory=list)
    tails: list[list[int]] = field(default_factory=list)
    rosters: list[str] = field(default_factory=list)
    settings: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        for name, values in vars(self).items():
            if len(values) > MAX_PINS:
                raise ValueError(f"more than {MAX_PINS} approved {name}")


def pinned(digests: DataFrame) -> list[str]:
    """The distinct values of a one-column frame of approved values; raises above ``MAX_PINS``."""
    rows = digests.where(F.col(digests.columns[0]).isNotNull()).distinct().limit(MAX_PINS + 1).collect()
    if len(rows) > MAX_PINS:
        raise ValueError(f"more than {MAX_PINS} approved values")
    return sorted(r[0] for r in rows)


def system_prompt_rules(messages: Column, approved: list[str]) -> Column:
    """G2: a finding for each system message whose digest isn't approved, in order; one if there is no such message."""
    said = F.filter(messages, lambda m: F.coalesce(m["role"] == "system", F.lit(False)))
    digests = F.transform(said, lambda m: F.coalesce(F.sha2(flat_content(m["content"]), 256), F.lit("unhashable")))
    known = F.array(*[F.lit(a) for a in approved]).cast("array<string>")
    bad = F.transform(F.filter(digests, lambda d: ~F.array_contains(known, d)), lambda d: F.concat(F.lit(f"{R.G2_NOT_APPROVED}:"), d))
    return F.when(F.coalesce(F.size(said), F.lit(0)) > 0, bad).otherwise(F.array(F.lit(R.G2_MISSING)))


def _admission(status: Column, trajectory: Column, builder: Column) -> Column:
    """ADM1, then ADM3 alone, or ADM2 with what the builder found, ADM4, and the chain's statistics."""
    within = F.concat(
        R.builder_rules(builder), finding(F.coalesce(F.size(trajectory["traces"]), F.lit(0)) <= 0, R.ADM4),
        R.chain_rules(trajectory["metadata"]["reconstruction_stats"]),
    )
    return F.concat(finding(~status.eqNullSafe(F.lit("COMPLETED")), f"{R.ADM1}:", status), F.when(trajectory.isNull(), F.array(F.lit(R.ADM3))).otherwise(within))


def gate(rows: DataFrame, keys: list[str], pins: Pins, policy: R.Policy = R.Policy(), required: tuple[str, ...] = (), cards: DataFrame | None = None) -> DataFrame:
    """Each record's findings in order and where it goes: ``keys``, findings, disposition.

    ``rows``: keys, status, trajectory, and, from raw bodies, builder (array<string>) and stated (one ``_STATED`` a trace).
    ``cards`` (task_id, card_hash) stands for the card's hash where traces don't state it.
    """
    none = F.array().cast("array<string>")
    builder = F.col("builder") if "builder" in rows.columns else F.lit(None).cast("array<string>")
    stated = F.col("stated") if "stated" in rows.columns else F.lit(None).cast(T.ArrayType(_STATED))
    heads = rows.select(*keys, F.lit(-1).alias("trace_no"), _admission(F.col("status"), F.col("trajectory"), builder).alias("f"))
    t = rows.select(*keys, stated.alias("stated"), F.posexplode("trajectory.traces").alias("trace_no", "t"))
    t = t.select(*keys, "trace_no", "t", F.get("stated", F.col("trace_no")).alias("e"))
    real = R.with_tool_results(t.where("t IS NOT NULL").select(*keys, "trace_no", "t", "e", "t.prompt_messages", "t.response_messages"))
    c, on = F.col, lambda name, rule: rule if name in required else none
    space = F.from_json("e.workspace", _WORKSPACE)
    when = R.timestep(c("t.metadata.timestep"), c("results"), policy)
    before = F.concat(
        R.logprob_rules(c("t.response_ids"), c("t.loss_mask"), c("t.response_logprobs"), policy), R.tripwire_rules(c("t.finish_reason")),
        on("split", finding(c("e.split").isNotNull() & ~c("e.split").isin(*R.SPLITS), f"{R.TR3}:", c("e.split"))), on("masked", R.reasoning_rules(c("e.masked"))),
        R.cutoff_rules(c("t.metadata.timestep"), c("results"), policy), on("workspace", R.workspace_rules(space, when)), on("tools", R.roster_rules(c("e.tools"), pins.rosters)),
        system_prompt_rules(c("prompt_messages"), pins.system_prompts),
    )
    called = F.concat(F.coalesce("prompt_messages", F.slice("response_messages", 1, 0)), F.coalesce("response_messages", F.slice("prompt_messages", 1, 0)))
    offered = F.from_json("e.tools", "array<string>")
    after = F.concat(on("settings", R.settings_rules(c("e.settings"), pins.settings)), R.tail_rules(c("t.prompt_ids"), c("t.response_ids"), c("t.loss_mask"), pins.tails), R.toolless_rules(offered, called, policy))
    judged = real.select(*keys, "trace_no", before.alias("before"), c("t.metadata.prompt_source").alias("source"), c("t.metadata.task_id").alias("task_id"), c("e.card").alias("card"), after.alias("after"))
    if cards is not None:
        judged = judged.join(cards.select(c("task_id").alias("carded"), "card_hash"), c("task_id") == c("carded"), "left").withColumn("card", F.coalesce("card", "card_hash"))
    found = judged.select(*keys, "trace_no", F.concat("before", R.source_rules(c("source"), c("card"), pins.cards), "after").alias("f"))
    lost = t.where("t IS NULL").select(*keys, "trace_no", F.array(F.lit(R.ADM5)).alias("f"))
    # A record's findings come together: those of its own traces.
    whole = heads.unionByName(found).unionByName(lost).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("trace_no", "f"))).alias("all"))
    return whole.select(*keys, F.flatten(F.transform("all", lambda x: x["f"])).alias("findings")).withColumn("disposition", F.when(F.size("findings") == 0, "accepted").otherwise("quarantined"))


# --- raw bodies ---------------------------------------------------------------------------------


def _say(value) -> str | None:
    return json.dumps(value) if value is not None else None


def _state(trace) -> dict:
    """What a raw trace states beyond the typed tables, as texts; a split that is there but null reads None."""
    meta = trace.get("metadata") if isinstance(trace, dict) and isinstance(trace.get("metadata"), dict) else {}
    masked = (meta.get("reasoning_loss_mask") or {}).get("masked_tokens") if isinstance(meta.get("reasoning_loss_mask"), dict) else None
    split, card = meta.get("split"), meta.get("skill_card_hash")
    return {
        "split": str(split) if "split" in meta else None, "masked": None if masked in (None, 0, False, "0", "") else str(masked), "workspace": _say(meta.get("workspace")),
        "tools": _say(trace.get("tools")) if isinstance(trace, dict) else None, "settings": _say(meta.get("settings")), "card": card if isinstance(card, str) else None,
    }


_RECORD = ddl("body_id bigint, member_no int, session_id string, reason string, status string")
_TRAJECTORY = SESSION_RESULT["trajectory"].dataType


def members(bodies: DataFrame) -> DataFrame:
    """The members of raw bodies, whole or not at all: body_id, member_no, session_id, reason, status, trajectory, builder, stated.

    A body with an unfit member, or with none, is one row with member_no -1 and the reason; of a
    session's members in a body only the last is there. Values of another kind than the tables' are null; an
    element of a mask that isn't the integer 0 or 1 is null, too, so that true, "1" and 1.0 are LP9's.
    """
    out = T.StructType([*_RECORD.fields, T.StructField("trajectory", _TRAJECTORY), T.StructField("builder", T.ArrayType(T.StringType())), T.StructField("stated", T.ArrayType(_STATED))])
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 64):
                part, rows = b.slice(start, 64), []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    judged = members_with_reasons(text)
                    bad = next((reason for _, _, reason in judged if reason), None)
                    if bad or not judged:
                        rows.append({"body_id": key, "member_no": -1, "reason": bad or "no_member"})
                        continue
                    last = {sid: (i, m) for i, (m, sid, _) in enumerate(judged)}
                    for sid, (i, m) in last.items():
                        trajectory = m["trajectory"]
                        meta = trajectory.get("metadata") if isinstance(trajectory.get("metadata"), dict) else {}
                        said = meta.get("validation") if isinstance(meta.get("validation"), dict) else {}
                        builder = said.get("findings") or []
                        traces = trajectory.get("traces") if isinstance(trajectory.get("traces"), list) else []
                        rows.append({
                            "body_id": key, "member_no": i, "session_id": sid, "status": _fit(m.get("status"), T.StringType()), "trajectory": _fit(trajectory, _TRAJECTORY),
                            "builder": [str(x) for x in (builder if isinstance(builder, list) else [builder])], "stated": [_state(t) for t in traces],
                        })
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return bodies.select(F.col("body_id").cast("bigint"), F.col("body").cast("string")).mapInArrow(run, out)


def gate_bodies(bodies: DataFrame, pins: Pins, policy: R.Policy = R.Policy(), required: tuple[str, ...] = ("split", "masked"), cards: DataFrame | None = None) -> DataFrame:
    """The gate over raw bodies: body_id, member_no, session_id, findings, disposition; a body that isn't taken is one
    row, rejected, with its reason as the finding."""
    rows = members(bodies)
    keys = ["body_id", "member_no", "session_id"]
    judged = gate(rows.where("reason IS NULL"), keys, pins, policy, required, cards)
    refused = rows.where("reason IS NOT NULL").select(*keys, F.array("reason").alias("findings"), F.lit("rejected").alias("disposition"))
    return judged.unionByName(refused)

"""Conversations rebuilt from message rows: parent pointers, pointer jumping, ordered paths.

Two kinds of pointers are resolved by ``jump``, which doubles their reach in every round of joins:

* A message's parent is the message before it in its conversation. A range sort by (conversation,
  instant, row) sets the pointers; those within a task are followed where they lie, by doubling over the
  Arrow batch (``leap``), which leaves two nodes a task, and ``jump`` follows these from task to task. Every
  message then knows its depth below its conversation's root, which is its place, and the user messages
  on its path, which is its turn. A conversation that holds a third of all lines is spread over the
  tasks like any other.
* A tool result points to the message that made its call. A pointer to nothing makes it an orphan; one
  that doesn't lead back in order closes a cycle with the chain of previous messages. Either breaks the conversation.

``resolve_parents`` does the same for rows that carry parent pointers of their own. Only keys are
carried; texts are read at the end, for the messages of kept conversations.

Defined results: see the functions; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.runtime import checkpointed
from tracelode.schemas import ddl

#: Spellings of a role, compared without case and outer spaces (fixed values).
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "model": "assistant", "toolresult": "tool", "tool": "tool", "system": "system"}

_VISIBLE = r"[^\s\p{Z}\u0085\u200B\uFEFF\u001C-\u001F]"


def visible(text: Column) -> Column:
    """Whether a text has a character that is neither white space nor zero-width."""
    return F.coalesce(text.rlike(_VISIBLE), F.lit(False))


def role_of(raw: Column) -> Column:
    """The role behind a spelling; null for a null or blank one, an unknown one itself in lower case."""
    plain = F.lower(F.regexp_replace(raw, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.when(plain != "", F.coalesce(known[plain], plain))


def _ended(lines: DataFrame) -> DataFrame:
    """The lines that are messages."""
    return lines.where("type = 'message_end' AND id IS NOT NULL")


def messages(lines: DataFrame) -> DataFrame:
    """The distinct messages of ``lines``: id, instant (epoch milliseconds), role, seen (has visible
    text), calls, answers, row (the first line's row_id).

    Only message_end lines with an id are messages; lines with equal id, instant, role and content are one.
    """
    m, parts = F.col("message"), F.col("message.content")
    instant, role = F.coalesce(F.unix_millis("timestamp"), m["timestamp"]), role_of(m["role"])
    calls = F.transform(F.filter(parts, lambda p: p["type"] == "toolCall"), lambda p: p["id"])
    same = F.unhex(F.md5(F.to_json(F.struct("id", instant.alias("instant"), role.alias("role"), parts.alias("content")))))
    first = F.struct(
        "id", instant.alias("instant"), role.alias("role"), F.col("row_id").alias("row"),
        F.exists(F.coalesce(parts, F.array()), lambda p: F.coalesce(p["type"] == "text", F.lit(False)) & visible(p["text"])).alias("seen"),
        F.filter(F.coalesce(calls, F.array().cast("array<string>")), lambda c: c.isNotNull()).alias("calls"), m["tool_call_id"].alias("answers"),
    )
    return _ended(lines).select(same.alias("same"), first.alias("first")).groupBy("same").agg(F.min_by("first", "first.row").alias("first")).select("first.*")


# --- pointers -----------------------------------------------------------------------------------


def jump(edges: DataFrame, most: int) -> DataFrame:
    """``edges`` (node, ptr, hops, users, root, orphan) with each pointer followed to its root, by doubling.

    ``hops`` and ``users`` are summed along the path; further columns stay. Settled pointers aren't joined
    again. After enough rounds for ``most`` nodes in a row, a pointer still set lies on a cycle or
    leads to one; a pointer to a missing node ends there.
    """
    kept = [c for c in edges.columns if c not in ("ptr", "hops", "users", "root", "orphan")]
    reach, zero = 1, F.lit(0)
    while reach <= 2 * most and not edges.where("ptr IS NOT NULL").isEmpty():
        at = edges.select(*[F.col(c).alias(f"{c}2") for c in ("node", "ptr", "hops", "users", "root", "orphan")])
        lost = F.col("node2").isNull()
        followed = edges.where("ptr IS NOT NULL").join(at, F.col("ptr") == F.col("node2"), "left").select(
            *kept, F.col("ptr2").alias("ptr"), (F.col("hops") + F.coalesce("hops2", zero)).alias("hops"), (F.col("users") + F.coalesce("users2", zero)).alias("users"),
            F.when(lost, F.col("root")).otherwise(F.col("root2")).alias("root"), (F.col("orphan") | lost | F.coalesce("orphan2", F.lit(False))).alias("orphan"),
        )
        edges = checkpointed(edges.where("ptr IS NULL").select(*followed.columns).unionByName(followed))
        reach *= 2
    return edges


def resolve_parents(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """Root, depth and status of every node: ``node``, root, depth, status.

    ``ok``: the parents lead to a row without parent, the root. ``orphan``: they lead to a node
    that is no row; root is the last row before it. ``cycle``: they lead round; root and depth
    are null. Rows with a null node are left out; of repeated nodes the least parent counts.
    """
    one = rows.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("ptr"))
    edges = checkpointed(one.select("node", "ptr", F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("bigint").alias("hops"), F.lit(0).cast("bigint").alias("users"), F.col("node").alias("root"), F.lit(False).alias("orphan")))
    done = jump(edges, max(1, edges.count()))
    cyclic = F.col("ptr").isNotNull()
    return done.select(
        F.col("node").alias(node), F.when(~cyclic, F.col("root")).alias("root"),
        F.when(~cyclic, F.col("hops") - F.when(F.col("orphan"), 1).otherwise(0)).alias("depth"),
        F.when(cyclic, "cycle").when(F.col("orphan"), "orphan").otherwise("ok").alias("status"),
    )


def leap(parent: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Roots, and the sums of each weight along the path, of nodes that point to a place in the same array; roots
    point to themselves and weigh nothing."""
    while True:
        beyond = parent[parent]
        if np.array_equal(beyond, parent):
            return parent, *weights
        weights = tuple(w + w[parent] for w in weights)
        parent = beyond


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sorted messages with head (the first message of their conversation in the task), and the hops and users from there.

    The last message of a batch is carried on as place 0 of the next one.
    """
    last = None  # (id, head, hops, users)
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        ids, node = b.column("id"), b.column("node").to_numpy()
        user = pc.fill_null(pc.equal(b.column("role"), "user"), False).to_numpy(zero_copy_only=False).astype(np.int64)
        opens = np.ones(n, bool)
        opens[1:] = pc.not_equal(ids.slice(1), ids.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        opens[0] = last is None or last[0] != ids[0].as_py()
        place = np.arange(1, n + 1)
        parent = np.concatenate([[0], np.where(opens, place, place - 1)])
        goes = np.concatenate([[0], np.where(opens, 0, 1)])
        root, hops, users = leap(parent, goes, goes * np.concatenate([[0], user]))
        head = np.concatenate([[last[1] if last else 0], node])[root]
        at_root = np.concatenate([[last[3] if last else 0], user])[root]
        hops, users, head = (hops + np.where(root == 0, last[2] if last else 0, 0))[1:], (users + at_root)[1:], head[1:]
        last = (ids[n - 1].as_py(), int(head[-1]), int(hops[-1]), int(users[-1]))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head), pa.array(hops), pa.array(users)], names=[*b.schema.names, "head", "hops", "users"])


def place(msgs: DataFrame) -> DataFrame:
    """``msgs`` with ``pos`` (depth below the conversation's root, from 0) and ``turn`` (user messages on the path, itself counted).

    Messages without instant have no place: pos and turn are null.
    """
    order = [F.col("id"), F.col("instant").asc_nulls_last(), F.col("row")]  # so that messages without instant, at the end, count for no other
    nodes = msgs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id())
    linked = checkpointed(nodes.mapInArrow(_link, T.StructType([*nodes.schema.fields, *ddl("head bigint, hops bigint, users bigint").fields])))
    # Two nodes a task: its first message, which points into the task before if its conversation goes on there, and the head of its last.
    tasks = checkpointed(linked.groupBy(F.shiftright("node", 33).alias("task")).agg(F.min(F.struct("node", "id")).alias("first"), F.max(F.struct("node", "id", "head", "hops", "users")).alias("last")))
    before = tasks.select("task", "first", "last", F.lag("last").over(Window.orderBy("task")).alias("before"))  # one row a task
    goes = F.coalesce(F.col("before.id") == F.col("first.id"), F.lit(False))
    zero = F.lit(0).cast("bigint")
    firsts = before.select(
        F.col("first.node").alias("node"), F.when(goes, F.col("before.head")).alias("ptr"), F.when(goes, F.col("before.hops") + 1).otherwise(zero).alias("hops"),
        F.when(goes, F.col("before.users")).otherwise(zero).alias("users"),
    )
    heads = tasks.where("last.head <> first.node").select(F.col("last.head").alias("node"), F.lit(None).cast("bigint").alias("ptr"), zero.alias("hops"), zero.alias("users"))
    edges = checkpointed(firsts.unionByName(heads).select("*", F.col("node").alias("root"), F.lit(False).alias("orphan")))
    done = jump(edges, 2 * tasks.count()).where("hops > 0").select("node", F.col("hops").alias("more_hops"), F.col("users").alias("more_users"))
    timed = lambda c, more: F.when(F.col("instant").isNotNull(), F.col(c) + F.coalesce(more, F.lit(0)))
    rows = linked.drop("node").join(F.broadcast(done), F.col("head") == F.col("node"), "left")  # at most one row a task is broadcast
    return rows.select(*msgs.columns, timed("hops", "more_hops").alias("pos"), timed("users", "more_users").alias("turn"))


def answers(placed: DataFrame) -> DataFrame:
    """What each tool result's pointer to its call leads to: id, row, status.

    ``ok``: to an earlier message; ``orphan``: to nothing; ``cycle``: to itself or to a later message, whose own path leads back.
    """
    call = lambda c: F.concat(F.length("id").cast("string"), F.lit(":"), "id", c)
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")
    made = placed.where("pos IS NOT NULL").select("id", "pos", F.explode("calls").alias("call")).groupBy(call(F.col("call")).alias("node")).agg(F.min("pos").alias("hops"))
    used = placed.where("role = 'tool' AND pos IS NOT NULL").select(F.concat(F.lit("r"), F.col("row").cast("string")).alias("node"), "id", "row", "pos", "answers")
    # A result that names no call points to a node of its own that isn't there, so that no key is hot.
    used = used.select("node", F.coalesce(call(F.col("answers")), F.concat(F.lit("n"), "node")).alias("ptr"), (-F.col("pos")).alias("hops"), "id", "row")
    edges = used.unionByName(made.select("node", none.alias("ptr"), "hops", none.alias("id"), F.lit(None).cast("bigint").alias("row")))
    done = jump(checkpointed(edges.select("*", zero.alias("users"), F.lit(0).alias("root"), F.lit(False).alias("orphan"))), 1)
    return done.where("row IS NOT NULL").select("id", "row", F.when(F.col("orphan"), "orphan").when(F.col("hops") >= 0, "cycle").otherwise("ok").alias("status"))


# --- verdicts -----------------------------------------------------------------------------------


def verdicts(lines: DataFrame, placed: DataFrame) -> DataFrame:
    """Each conversation's id with the first reason to drop it, null if there is none.

    ``empty``: no message other than system ones has visible text. ``broken``: a message has no role
    or no instant, the first message that isn't a system one isn't a user's, or a tool result
    is an orphan or closes a cycle (``answers``). ``no_reply``: a user message has no assistant
    message with visible text before the next user message or the end.
    """
    no, none = F.lit(False), F.lit(None).cast("bigint")
    other = F.coalesce(F.col("role") != "system", F.lit(True))
    # The first message that isn't a system one: twice its place, and one more if it isn't a user's.
    first = F.when(other & F.col("pos").isNotNull(), F.col("pos") * 2 + F.when(F.col("role") == "user", 0).otherwise(1))
    turns = placed.groupBy("id", "turn").agg(
        F.max(other & F.col("seen")).alias("filled"), F.max(F.col("role").isNull() | F.col("instant").isNull()).alias("broken"), F.min(first).alias("first"),
        F.max(F.coalesce(F.col("role") == "assistant", no) & F.col("seen")).alias("reply"),
    ).select("id", "filled", "broken", "first", F.coalesce((F.col("turn") > 0) & ~F.col("reply"), no).alias("silent"))
    unmade = answers(placed).where("status <> 'ok'").select("id", no.alias("filled"), F.lit(True).alias("broken"), none.alias("first"), no.alias("silent"))
    known = lines.where("id IS NOT NULL").select("id", no.alias("filled"), no.alias("broken"), none.alias("first"), no.alias("silent"))
    flags = turns.unionByName(unmade).unionByName(known).groupBy("id").agg(*[F.max(c).alias(c) for c in ("filled", "broken", "silent")], F.min("first").alias("first"))
    broken = F.col("broken") | F.coalesce(F.col("first") % 2 == 1, no)
    return flags.select("id", F.when(~F.coalesce("filled", no), "empty").when(broken, "broken").when(F.col("silent"), "no_reply").alias("reason"))


def dropped(lines: DataFrame) -> DataFrame:
    """The conversations to drop: id, reason."""
    return verdicts(lines, place(messages(lines))).where("reason IS NOT NULL")


def conversations(lines: DataFrame) -> DataFrame:
    """The messages of the kept conversations: id, pos, role, instant, text; a conversation is the
    path of an id's rows in order of pos. Its text is that of its text parts joined, null without content."""
    placed = place(messages(lines))
    kept = verdicts(lines, placed).where("reason IS NULL").select("id")
    rows = placed.join(kept, "id", "left_semi").select("id", "pos", "role", "instant", "row")
    parts = F.filter("message.content", lambda p: p["type"] == "text")
    texts = _ended(lines).select(F.col("row_id").alias("row"), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("text"))
    # A row_id names one line; a line that is there twice counts once. Both sides meet by row, so this shuffles nothing more.
    return rows.join(texts, "row").dropDuplicates(["row"]).select("id", "pos", "role", F.timestamp_millis("instant").alias("timestamp"), "text")

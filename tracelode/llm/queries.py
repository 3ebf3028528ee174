"""Queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import conversations, mixing, packing, pairs, residue, split, tokens
from tracelode.sources.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return split.oversized(table(spark, root, "chunks"))


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    return split.split_chunks(table(spark, root, "chunks"))


def p2_whole(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of each chunk put together again: the longest piece, and the hash of the text without the overlaps."""
    keys = ["case_id", "page", "chunk_idx"]
    p = p2_pieces(spark, root).where("text IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("piece_idx", "text", "overlap"))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: F.substr(x["text"], x["overlap"] + 1)), "")
    return p.select(*keys, (F.array_max(F.transform("s", lambda x: F.length(x["text"]))) <= 1000).alias("fits"), F.length(body).alias("n"), F.sha2(body, 256).alias("sha256"))


def p3_whole(spark: SparkSession, root: str) -> DataFrame:
    """Each trace as the training rows hold it: its ids one part after the other, hashed, and how many are trained."""
    layout = packing.pack(table(spark, root, "traces")).where("length > 0")
    layout = layout.join(layout.groupBy("trace_id").agg(F.count("*").alias("parts")), "trace_id")
    r = p3_rows(spark, root).select("row", "ids", "loss_mask")
    cut = lambda c: F.slice(c, F.col("offset") + 1, F.col("length"))
    digest = lambda ids: F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
    # A trace of one part is hashed where its row is; only ids of several parts come together.
    part = F.struct("part", F.when(F.col("parts") > 1, cut("ids")).alias("ids"), F.when(F.col("parts") == 1, digest(cut("ids"))).alias("h"))
    held = layout.join(r, "row").select("trace_id", "length", F.aggregate(cut("loss_mask"), F.lit(0), lambda a, x: a + x).alias("m"), part.alias("x"))
    whole = held.groupBy("trace_id").agg(F.array_sort(F.collect_list("x")).alias("x"), F.sum("length").alias("n"), F.sum("m").alias("trained"))
    hashed = F.coalesce(F.get("x", F.lit(0))["h"], digest(F.flatten(F.transform("x", lambda x: x["ids"]))))
    return whole.select("trace_id", F.size("x").alias("parts"), F.col("n").cast("int").alias("n"), hashed.alias("sha256"), F.col("trained").cast("int").alias("trained"))


def p3_bounds(spark: SparkSession, root: str) -> DataFrame:
    """The ids that the rows hold, whether any row holds too many, and whether at most one row in a hundred is more than the least number."""
    f = p3_fill(spark, root)
    return f.select("ids", F.col("least_rows").cast("bigint").alias("least_rows"), (F.col("fullest") <= 4096).alias("fits"), (F.col("rows") <= F.ceil(F.col("least_rows") * 1.01) + 1).alias("tight"))


def p8_bounds(spark: SparkSession, root: str) -> DataFrame:
    """Of each target source with documents whether its share and its repeats are as asked, and whether it strays too far in the order of the mixture.

    Documents are used whole, so a source has its quota but for half a document, and the whole has the quotas' sum but for half a document of
    each source; in the order of the mixture two blocks and a document more are allowed.
    """
    s = p8_shares(spark, root).where("tokens > 0")
    wanted = F.broadcast(s.agg(F.sum("target_weight").alias("w"), F.sum("tokens").alias("whole"), F.sum("longest").alias("all"), F.max("longest").alias("most")))
    part = F.col("target_weight") / F.col("w")
    near = F.abs(F.col("tokens") - part * F.col("whole")) <= F.col("longest") / 2 + part * F.col("all") / 2 + 1
    kept = F.col("greatest_deviation") * F.col("block_tokens") <= 2 * F.col("block_tokens") + F.col("most")
    return s.join(wanted).select("source", near.alias("share_ok"), (F.col("most_repeats") <= F.coalesce("max_repeats", F.lit(1))).alias("repeats_ok"), kept.alias("order_ok"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return packing.oversize(table(spark, root, "traces"))


def p3_layout(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "traces"))


def p3_rows(spark: SparkSession, root: str) -> DataFrame:
    return packing.training_rows(table(spark, root, "traces"))


def p3_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.fill(packing.pack(table(spark, root, "traces")))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return conversations.dropped(table(spark, root, "pi_polar_transcript"))


def p4_messages(spark: SparkSession, root: str) -> DataFrame:
    rows = conversations.conversations(table(spark, root, "pi_polar_transcript"))
    return rows.select("id", "pos", "role", F.unix_millis("timestamp").alias("timestamp_ms"), "text")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return pairs.first_defects(table(spark, root, "traces"))


def p5_defects(spark: SparkSession, root: str) -> DataFrame:
    return pairs.defects(table(spark, root, "traces"))


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.encode(table(spark, root, "documents"), "doc_id", "text")


def p8_mixture(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mixture(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.shares(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.residue(table(spark, root, "documents"))


def p9_clean(spark: SparkSession, root: str) -> DataFrame:
    return residue.clean(table(spark, root, "documents")).select("doc_id", "source", "text")


def p9_evidence(spark: SparkSession, root: str) -> DataFrame:
    return residue.residual_evidence(table(spark, root, "documents"))


def p9_boilerplate(spark: SparkSession, root: str) -> DataFrame:
    return residue.boilerplate(table(spark, root, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p2_whole, p3_found, p3_layout, p3_rows, p3_fill, p3_whole, p3_bounds, p4_found, p4_messages, p5_found, p5_defects, p7_ids, p8_mixture, p8_shares, p8_bounds, p9_found, p9_clean, p9_evidence, p9_boilerplate)}

# The messages of a conversation, as p4 defines them.
_MESSAGES = r"""
WITH lines AS (
  SELECT id, row_id, coalesce(epoch_ms(timestamp), message.timestamp) AS instant,
    nullif(lower(regexp_replace(message.role, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '') AS raw, message.content AS content, message.tool_call_id AS answers
  FROM pi_polar_transcript WHERE type = 'message_end' AND id IS NOT NULL),
named AS (SELECT * EXCLUDE raw, CASE raw WHEN 'human' THEN 'user' WHEN 'model' THEN 'assistant' WHEN 'toolresult' THEN 'tool' ELSE raw END AS role FROM lines),
once AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY id, instant, role, content ORDER BY row_id) AS k FROM named) WHERE k = 1),
m AS MATERIALIZED (
  SELECT id, instant, role, answers, row_id,
    coalesce(len(list_filter(content, lambda p: p.type = 'text' AND regexp_matches(coalesce(p.text, ''), '[^\s\p{Z}\x{85}\x{200B}\x{FEFF}\x{1C}-\x{1F}\x{0B}]'))), 0) > 0 AS seen,
    list_transform(list_filter(content, lambda p: p.type = 'toolCall'), lambda p: p.id) AS calls,
    coalesce(list_aggregate(list_transform(list_filter(content, lambda p: p.type = 'text'), lambda p: coalesce(p.text, '')), 'string_agg', ''), '') AS text,
    content IS NULL AS bare,
    row_number() OVER w - 1 AS pos, count(*) FILTER (WHERE role = 'user') OVER (w ROWS UNBOUNDED PRECEDING) AS turn
  FROM once WINDOW w AS (PARTITION BY id, instant IS NULL ORDER BY instant, row_id)),
whole AS (
  SELECT id, bool_or(seen AND role IS DISTINCT FROM 'system') AS filled, bool_or(role IS NULL OR instant IS NULL) AS gap,
    arg_min(role, pos) FILTER (WHERE role IS DISTINCT FROM 'system' AND instant IS NOT NULL) AS first FROM m GROUP BY id),
unmade AS (
  SELECT DISTINCT r.id FROM m r WHERE r.role = 'tool' AND r.instant IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM (SELECT id, pos, unnest(calls) AS call FROM m WHERE instant IS NOT NULL) c WHERE c.id = r.id AND c.call = r.answers AND c.pos < r.pos)),
silent AS (SELECT DISTINCT id FROM (SELECT id, turn, bool_or(role = 'assistant' AND seen) AS reply FROM m WHERE turn > 0 AND instant IS NOT NULL GROUP BY id, turn) WHERE NOT coalesce(reply, false)),
verdict AS (
  SELECT i.id, CASE WHEN NOT coalesce(filled, false) THEN 'empty' WHEN gap OR first <> 'user' OR i.id IN (SELECT id FROM unmade) THEN 'broken' WHEN i.id IN (SELECT id FROM silent) THEN 'no_reply' END AS reason
  FROM (SELECT DISTINCT id FROM pi_polar_transcript WHERE id IS NOT NULL) i LEFT JOIN whole USING (id))
"""

ORACLE = {
    "p2_found": "SELECT DISTINCT case_id, page, chunk_idx FROM chunks WHERE length(text) > 1000",
    "p3_found": "SELECT DISTINCT trace_id FROM traces WHERE coalesce(len(prompt_ids), 0) + coalesce(len(response_ids), 0) > 4096",
    "p4_found": _MESSAGES + "SELECT id, reason FROM verdict WHERE reason IS NOT NULL",
    "p4_messages": _MESSAGES + "SELECT m.id, pos, role, instant AS timestamp_ms, CASE WHEN bare THEN NULL ELSE text END AS text FROM m JOIN verdict USING (id) WHERE reason IS NULL",
    "p2_whole": "SELECT DISTINCT case_id, page, chunk_idx, true AS fits, length(text) AS n, sha256(text) AS sha256 FROM chunks WHERE text IS NOT NULL",
    "p3_whole": """WITH t AS (SELECT DISTINCT trace_id, coalesce(prompt_ids, []) || coalesce(response_ids, []) AS ids, coalesce(loss_mask, [])[1 : coalesce(len(response_ids), 0)] AS m FROM traces)
SELECT trace_id, ceil(len(ids) / 4096)::INT AS parts, len(ids) AS n, sha256(array_to_string(ids, ',')) AS sha256, coalesce(list_sum(m), 0)::INT AS trained FROM t WHERE len(ids) > 0""",
    "p3_bounds": "SELECT sum(n)::BIGINT AS ids, ceil(sum(n) / 4096)::BIGINT AS least_rows, true AS fits, true AS tight FROM (SELECT DISTINCT trace_id, coalesce(len(prompt_ids), 0) + coalesce(len(response_ids), 0) AS n FROM traces)",
    "p8_bounds": "SELECT source, true AS share_ok, true AS repeats_ok, true AS order_ok FROM mix_targets WHERE target_weight > 0 AND coalesce(max_repeats, 1) > 0 AND source IN (SELECT source FROM documents WHERE text <> '')",
}

"""Chunks longer than a limit, cut into overlapping pieces at natural boundaries.

Recursive bisection: a stretch longer than ``limit - overlap`` is cut at the strongest boundary of
its middle half, the one nearest to the midpoint among equals; both halves are cut on until they
fit. Only where the middle half has no boundary at all is the rest of the stretch searched, and
only where that has none either is the cut made at the midpoint, moved off combining sequences.
Then each piece but the first gets the end of the piece before it, at most ``overlap`` characters
and from a boundary on if there is one, as its beginning.

All lengths are Unicode code points. Defined results: a text up to the limit is one piece,
unchanged; a null or empty text is one piece with that text; of rows with one key the earliest
arrival counts, on ties the least text; null key columns are values like others; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1000, 100

#: Boundaries by falling strength; a piece may begin at the end of a match.
BOUNDARIES = [
    re.compile(r"(?:\r?\n|\r)[^\S\r\n]*(?:(?:\r?\n|\r)\s*)+"),  # blank line
    re.compile("\r?\n|[\r\x0b\x0c\x85\u2028\u2029]"),  # line end
    re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？]+[”’」』）]*\s*|[.!?…](?=[\"“„«](?:\w))"),  # sentence end
    re.compile(r"[;:]\s+|[；：]\s*"),
    re.compile(r",\s+|[，、]\s*|\s[|–—]\s"),
    re.compile(r"\s+"),
]
_JOINER = "\u200d"
_GLUE = {_JOINER, "\u200c", "\ufe0e", "\ufe0f"}


def _joined(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part what is shown as one character."""
    a, b = text[at - 1], text[at]
    return (
        unicodedata.combining(b) != 0 or unicodedata.category(b) in ("Mn", "Me", "Mc") or b in _GLUE or a == _JOINER
        or (a == "\r" and b == "\n") or 0x1F3FB <= ord(b) <= 0x1F3FF or (0x1F1E6 <= ord(a) <= 0x1F1FF and 0x1F1E6 <= ord(b) <= 0x1F1FF)
    )


class _Cuts:
    """Where a text may be cut, by strength."""

    def __init__(self, text: str):
        self.text = text
        self.at = [[m.end() for m in p.finditer(text) if 0 < m.end() < len(text)] for p in BOUNDARIES]

    def between(self, lo: int, hi: int, aim: int) -> int | None:
        """The strongest cut in ``lo .. hi``, of equals the nearest to ``aim``, the earlier on ties."""
        for cuts in self.at:
            i, j = bisect.bisect_left(cuts, lo), bisect.bisect_right(cuts, hi)
            if i < j:
                k = bisect.bisect_left(cuts, aim, i, j)
                near = cuts[max(i, k - 1) : min(j, k + 1)]
                return min(near, key=lambda c: (abs(c - aim), c))
        return None

    def plain(self, start: int, end: int) -> int:
        """A cut near the middle of a stretch without boundaries, off combining sequences if possible."""
        mid = (start + end) // 2
        for d in range(0, min(64, (end - start) // 4)):
            for c in (mid - d, mid + d):
                if start < c < end and not _joined(self.text, c):
                    return c
        return mid


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """The pieces of ``text`` in reading order as (begin, end, overlap): each is ``text[begin:end]``,
    of which the first ``overlap`` characters are the last of the piece before."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    if len(text) <= limit:
        return [(0, len(text), 0)]
    cuts, room, leaves, todo = _Cuts(text), limit - overlap, [], [(0, len(text))]
    while todo:
        start, end = todo.pop()
        if end - start <= room:
            leaves.append((start, end))
            continue
        quarter, mid = (end - start) // 4, (start + end) // 2
        c = cuts.between(max(start + 1, start + quarter), end - max(1, quarter), mid) or cuts.between(start + 1, end - 1, mid) or cuts.plain(start, end)
        todo += [(c, end), (start, c)]
    pieces = [(leaves[0][0], leaves[0][1], 0)]
    for start, end in leaves[1:]:
        begin = pieces[-1][0]
        low = max(start - overlap, begin)
        back = low if low == begin else cuts.between(low, start - 1, low) if overlap else start
        if back is None:
            back = low
            while back < start and _joined(text, back):
                back += 1
        pieces.append((back, end, start - back))
    return pieces


_SCHEMA = "case_id string, page int, file string, chunk_idx int, piece_no int, n_pieces int, begin int, overlap int, text string"


def split_rows(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every row of ``df`` (case_id, page, file, chunk_idx, text); no shuffle."""
    names = ["case_id", "page", "file", "chunk_idx"]
    ints = ["piece_no", "n_pieces", "begin", "overlap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parent, texts, numbers = [], [], {n: [] for n in ints}
            for i, text in enumerate(b.column(4).to_pylist()):
                pieces = cut(text, limit, overlap) if text is not None else [(0, 0, 0)]
                for k, (begin, end, over) in enumerate(pieces):
                    parent.append(i)
                    texts.append(None if text is None else text[begin:end])
                    for n, v in zip(ints, (k, len(pieces), begin, over)):
                        numbers[n].append(v)
            at = pa.array(parent, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(i).take(at) for i in range(4)] + [pa.array(numbers[n], pa.int32()) for n in ints] + [pa.array(texts, pa.string())],
                names=[*names, *ints, "text"],
            )

    rows = df.select(F.col("case_id").cast("string"), F.col("page").cast("int"), F.col("file").cast("string"), F.col("chunk_idx").cast("int"), F.col("text").cast("string"))
    return rows.mapInArrow(run, _SCHEMA)


def oversized(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The keys of the distinct chunks that had to be cut; only keys are shuffled."""
    return split_rows(df, limit, overlap).where("piece_no = 1").select("case_id", "page", "chunk_idx").distinct()


def split_chunks(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of each distinct chunk, numbered onward: ``piece_idx`` starts at the chunk's
    ``chunk_idx`` plus the pieces that earlier chunks of its case and page have gained."""
    first = Window.partitionBy("case_id", "page", "chunk_idx").orderBy(F.col("ingested_at").asc_nulls_last(), F.col("text").asc_nulls_last(), F.col("file").asc_nulls_last())
    kept = df.select("case_id", "page", "file", "chunk_idx", "text", "ingested_at").withColumn("k", F.row_number().over(first)).where("k = 1")
    pieces = split_rows(kept, limit, overlap)
    before = Window.partitionBy("case_id", "page").orderBy("chunk_idx", "piece_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gained = F.sum((F.col("piece_no") > 0).cast("int")).over(before)
    return pieces.withColumn("piece_idx", (F.col("chunk_idx") + gained).cast("int"))

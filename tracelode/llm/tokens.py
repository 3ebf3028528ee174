"""Documents as ids of a byte-level BPE vocabulary, by corpus-level merge replay.

The texts of a block are split by the vocabulary's pattern; each distinct word of the block is
written once as byte symbols, all words one after the other. An inverted index from pair to
positions then lets every merge be applied in rank order to all words at once: a merge touches only
its positions and enters the pairs with their two neighbours into the index. What a word becomes depends on
nothing outside it, so blocks are replayed where they lie and nothing is shuffled; a task replays a word once,
whatever the number of its blocks; ids per word are spread to its occurrences by one ``take``.

Defined results: a null and an empty text have an empty list; strings that look like special tokens
are ordinary text; texts of any length are encoded whole; repeated rows are encoded each; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public pattern by which this family of vocabularies splits text (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 2_000_000
#: Words whose ids a task remembers from block to block; beyond, it forgets them and goes on.
MAX_WORDS = 500_000


def default_vocabulary() -> str:
    """The installed file of byte_bpe_50k."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """The merges of a vocabulary, applied to many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self._words: dict[str, np.ndarray] = {}  # the ids of words replayed before
        self._merge: dict[int, int] = {}  # pair to the rank of its merge, -1 if it has none

    def merge(self, a: int, b: int) -> int:
        key = a << 32 | b
        r = self._merge.get(key)
        if r is None:
            r = self._merge[key] = self.ranks.get(self.token[a] + self.token[b], -1)
            if len(self._merge) > 2_000_000:
                self._merge.clear()
        return r

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``; words that a block before held aren't replayed again."""
        new = [w for w in words if w not in self._words]
        if new:
            ids, sizes = self.encode([w.encode() for w in new])
            ends = np.cumsum(sizes).tolist()
            self._words.update(zip(new, (ids[a:b] for a, b in zip([0, *ends], ends))))
        out = [self._words[w] for w in words]
        if len(self._words) > MAX_WORDS:
            self._words.clear()
        return np.concatenate([np.zeros(0, np.int64), *out]), np.fromiter(map(len, out), np.int64, len(out))

    def encode(self, words: list[bytes]) -> tuple[list[int], np.ndarray]:
        """The ids of all words one after the other, and how many each word has."""
        byte, merge = self.byte, self.merge
        sym: list[int] = []
        for w in words:
            sym.extend([byte[c] for c in w])
            sym.append(-1)
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for i in range(n - 1):
            a, b = sym[i], sym[i + 1]
            if a >= 0 and b >= 0 and (r := merge(a, b)) >= 0:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
        ready = list(index)
        heapq.heapify(ready)
        while ready:
            r = heapq.heappop(ready)
            for i in sorted(index.pop(r)):
                a = sym[i]
                if a < 0:
                    continue
                j = nxt[i]
                b = sym[j]
                if b < 0 or merge(a, b) != r:
                    continue
                k = nxt[j]
                sym[i], sym[j] = r, -2
                nxt[i] = k
                if k < n:
                    prv[k] = i
                    if sym[k] >= 0 and (q := merge(r, sym[k])) >= 0:
                        if q in index:
                            index[q].append(i)
                        else:
                            index[q] = [i]
                            heapq.heappush(ready, q)
                h = prv[i]
                if h >= 0 and sym[h] >= 0 and (q := merge(sym[h], r)) >= 0:
                    if q in index:
                        index[q].append(h)
                    else:
                        index[q] = [h]
                        heapq.heappush(ready, q)
        flat = np.array(sym, np.int64)
        flat = flat[flat != -2]
        ends = np.flatnonzero(flat == -1)
        return flat[flat >= 0], np.diff(np.concatenate([[-1], ends])) - 1


def _blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    block, size = [], 0
    for t in texts:
        n = len(t) if t else 0
        if block and size + n > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(t)
        size += n
    if block:
        yield block


def encode_block(replay: MergeReplay, split, texts: list[str | None]) -> pa.ListArray:
    """The ids of each text of a block."""
    found = [split(t) if t else () for t in texts]
    words = pa.array(list(chain.from_iterable(found)), pa.large_string()).dictionary_encode()
    ids, sizes = replay.lookup(words.dictionary.to_pylist())
    per_word = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), pa.array(ids.astype(np.int32)))
    codes = words.indices
    flat = pc.list_flatten(per_word.take(codes))
    many = sizes[codes.to_numpy()] if len(codes) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)]
    return pa.ListArray.from_arrays(ends.astype(np.int32), flat)


def encode(df: DataFrame, key: str, text: str, vocabulary: str | None = None, sizes_only: bool = False) -> DataFrame:
    """``key`` and the ids of ``text`` (or, with ``sizes_only``, n_tokens) for each row of ``df``.

    The vocabulary is read by the driver and broadcast: its size is that of its file, which is fixed.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary or default_vocabulary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, split = MergeReplay(shared.value), regex.compile(PATTERN).findall
        for b in batches:
            at = 0
            for block in _blocks(b.column(1).to_pylist()):
                ids = encode_block(replay, split, block)
                keys = b.column(0).slice(at, len(block))
                at += len(block)
                yield pa.RecordBatch.from_arrays([keys, pc.list_value_length(ids) if sizes_only else ids], names=[key, "n_tokens" if sizes_only else "ids"])

    rows = df.select(F.col(key), F.col(text).cast("string").alias("__text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens int" if sizes_only else "ids array<int>"))

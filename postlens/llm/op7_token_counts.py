"""Token counts without token ids: byte-pair merging on a heap and a linked list.

A piece is a row of symbols in a doubly linked list; a heap holds the adjacent pairs by
(merge rank, place).  The lowest pair is popped, its two symbols become one, and the two
new neighbour pairs are pushed; stale entries are skipped.  The count is the number of
symbols at first less the merges made; no id is ever made.

Nulls and empty texts count 0 tokens; repeated rows each give a row; other columns are
not read.  A null id is returned as null.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import BoundedCache, map_arrow, table
from postlens.llm.registry import register
from postlens.llm.word_bpe import WORD_BPE, WordBpe

#: Most words (and pieces) whose counts a task remembers.
CACHE_WORDS = 600_000


class MergeCounter:
    """Counts the symbols that are left of a piece after all merges."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        code: dict[str, int] = {}
        self.code = code
        of = lambda s: code.setdefault(s, len(code))
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge.setdefault(of(a) << 32 | of(b), (rank, of(a + b)))
        self.code = dict(code)

    def count(self, piece: str) -> int:
        n = len(piece)
        if n < 2:
            return n
        code, merge = self.code, self.merge
        sym = [code.get(c, -1) for c in piece]
        sym[-1] = code.get(piece[-1] + self.suffix, -1)
        heap = []
        for i in range(n - 1):
            a, b = sym[i], sym[i + 1]
            if a >= 0 and b >= 0 and (m := merge.get(a << 32 | b)):
                heap.append((m[0], i, a, b, m[1]))
        if not heap:
            return n
        heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            _, i, a, b, new = heappop(heap)
            if sym[i] != a or (j := after[i]) >= n or sym[j] != b:
                continue                                   # one of the two was merged meanwhile
            sym[i], sym[j] = new, -2
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if sym[k] >= 0 and (m := merge.get(new << 32 | sym[k])):
                    heappush(heap, (m[0], i, new, sym[k], m[1]))
            h = before[i]
            if h >= 0 and sym[h] >= 0 and (m := merge.get(sym[h] << 32 | new)):
                heappush(heap, (m[0], h, sym[h], new, m[1]))
        return left


class _Counts(BoundedCache):
    def __init__(self, bpe: WordBpe):
        super().__init__(CACHE_WORDS)
        self.bpe, self.merges, self.piece = bpe, MergeCounter(bpe.spec), BoundedCache(CACHE_WORDS)

    def __missing__(self, word: str) -> int:
        n = 0
        for p in self.bpe.pieces(word):
            if isinstance(p, int):
                n += 1
                continue
            c = self.piece.get(p)
            if c is None:
                c = self.merges.count(p)
                if len(p) <= 64:
                    self.piece.put(p, c)
            n += c
        return self.put(word, n) if len(word) <= 64 else n


_READY: dict[str, _Counts] = {}


def _counter(file: str) -> _Counts:
    if file not in _READY:
        _READY[file] = _Counts(WordBpe(file))
    return _READY[file]


def count_tokens(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str = WORD_BPE) -> DataFrame:
    """(id, n_bytes, n_tokens) per row of ``df``, without begin or end tokens."""
    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        counts = _counter(tokenizer)
        get, words = counts.__getitem__, counts.bpe.words
        texts = b.column(1)
        n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
        n = np.fromiter((sum(map(get, words(x.as_py()))) for x in texts), np.int64, len(texts))
        return pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array(n)],
                                          ["id", "n_bytes", "n_tokens"])
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(src, fn, "id long, n_bytes long, n_tokens long", keep_caches=True)


@register("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, tokens by the 49k word BPE, and whether they exceed 2048."""
    out = count_tokens(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens",
                      (F.col("n_tokens") > 2048).alias("over_limit"))

"""Best-fit packing of token pieces into sequences, by hierarchical residual rounds.

Every text becomes token ids by the tokenizers library plus one end id; only texts longer
than a sequence are cut.  Pieces (not texts) are then packed.  In round 0 the pieces are
dealt by a hash of their id into groups of about ``GROUP`` pieces; each group packs
best-fit, longest first, and its nearly full bins are final.  The underfull bins go on as
items, still holding their pieces, to the next round, where they are packed best-fit again.
To give that round something to fill gaps with, a group holds back its shortest pieces
(``HOLD`` of its tokens): they go up unpacked.

What goes up is bounded by what can still be filled.  No two items above half a sequence
share one, so the open items up to half of it, say f of them, are in f bins at most.  A
histogram of the sizes of open items (``LENGTH`` rows at most, aggregated on Spark) tells f:
of the larger items only about the f with the largest gaps go up, and none whose gap is
below the least open item; the rest is final.  This costs no bin: any f bins that take
fillers can be exchanged for the f with the largest gaps.

Every round is dealt anew by a hash of the bin, over as many groups as its pieces need, so
each group of each round has about ``GROUP`` pieces, whatever the table holds.  The last
round is the one that fits a group, or the first whose pieces aren't at most half of the
round's before: it holds nothing back and all of its bins are final.

Groups are hash dealt and sorted, so a task that is run again gives the same bins.  Null
and empty texts are one piece of length 1 (the end id).  Repeated rows are packed each;
they get the same piece numbers.  Rows without an id are packed with id null.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import HELD, BoundedCache, pack_ids, stage, table
from postlens.llm.registry import register
from postlens.llm.word_bpe import WORD_BPE, WordBpe

LENGTH = 4096          #: tokens of a sequence
END_ID = 1             #: appended to every document
GROUP = 60_000         #: pieces that one task packs, about
FULL = 4090            #: a bin with so many tokens is final in any round
HOLD = 0.01            #: share of a group's tokens that goes up unpacked, shortest pieces first
CACHE_WORDS = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Ids(BoundedCache):
    """Word -> its token ids as little-endian unsigned 32-bit integers."""

    def __init__(self, file: str):
        super().__init__(CACHE_WORDS)
        self.bpe = WordBpe(file)
        self.model = self.bpe.library.model

    def __missing__(self, word: str) -> bytes:
        ids: list[int] = []
        for p in self.bpe.pieces(word):
            if isinstance(p, int):
                ids.append(p)
            else:
                ids += [t.id for t in self.model.tokenize(p)]
        out = pack_ids(ids)
        return self.put(word, out) if len(word) <= 64 else out


_READY: dict[str, _Ids] = {}
HELD.append(_READY)


def _ids(file: str) -> _Ids:
    if file not in _READY:
        _READY[file] = _Ids(file)
    return _READY[file]


def token_pieces(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str = WORD_BPE, length: int = LENGTH, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``length`` tokens; with_ids: also its ids as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _ids(tokenizer)
        get, words = cache.__getitem__, cache.bpe.words
        tail = pack_ids([end_id])
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                blob = b"".join(map(get, words(text.as_py()))) + tail
                for n, at in enumerate(range(0, len(blob), 4 * length)):
                    part = blob[at:at + 4 * length]
                    row = (key, n, at // 4, len(part) // 4, zlib.crc32(part), part)
                    for c, v in zip(cols, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, tokens of each bin): items in the given order, each into the
    fullest bin that still takes it.  The open gaps are bits of one integer."""
    bins_at: list[list[int]] = [[] for _ in range(length + 1)]   # gap -> bins
    gaps = 0
    where = np.empty(len(sizes), np.int64)
    used: list[int] = []
    for i, s in enumerate(sizes.tolist()):
        fit = gaps >> s
        if fit:
            gap = s + (fit & -fit).bit_length() - 1
            k = bins_at[gap].pop()
            if not bins_at[gap]:
                gaps ^= 1 << gap
            used[k] += s
        else:
            k, gap = len(used), length
            used.append(s)
        where[i] = k
        if gap > s:
            if not bins_at[gap - s]:
                gaps |= 1 << (gap - s)
            bins_at[gap - s].append(k)
    return where, np.array(used, np.int64)


_ROW = "g long, doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, used long, final boolean"


def _round(df: DataFrame, n_round: int, length: int, last: bool) -> DataFrame:
    """Packs each group g of items (a bin of an earlier round, or a piece) anew."""
    def fn(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bin", "ascending"), ("offset", "ascending"), ("doc_id", "ascending"),
                       ("piece", "ascending"), ("ids_crc32", "ascending"), ("length", "ascending")])
        size = t["length"].to_numpy()
        label, offset = t["bin"].to_numpy(), t["offset"].to_numpy()
        if n_round == 0:
            item = np.arange(len(size))
        else:                                     # pieces of one bin stay together
            item = np.cumsum(np.concatenate([[0], (np.diff(label) != 0).astype(np.int64)]))
        n = int(item[-1]) + 1
        total = np.bincount(item, weights=size, minlength=n).astype(np.int64)
        order = np.argsort(-total, kind="stable")
        held = np.zeros(n, bool)
        if not last:
            up = np.cumsum(total[order[::-1]]) <= HOLD * total.sum()
            held[order[::-1][up]] = True
            order = order[~held[order]]
        where, used = best_fit(total[order], length)
        group = np.empty(n, np.int64)
        group[order] = where
        group[held] = len(used) + np.arange(int(held.sum()))
        used = np.concatenate([used, total[held]])
        # place of each item in its new bin: after those put there before it
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(len(order))
        rank[held] = 0
        by = np.lexsort((rank, group))
        run = np.cumsum(total[by]) - total[by]
        new = np.concatenate([[True], np.diff(group[by]) != 0])
        shift = np.empty(n, np.int64)
        shift[by] = run - np.maximum.accumulate(np.where(new, run, 0))
        final = np.full(len(used), last) | (used >= FULL * length // LENGTH)
        g = int(t["g"][0].as_py())
        name = (g << 36) | (n_round << 28) | group
        return pa.table({
            "g": t["g"], **{c: t[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
            "bin": pa.array(name[item]), "offset": pa.array(offset + shift[item]),
            "used": pa.array(used[group[item]]), "final": pa.array(final[group[item]])})
    return df.groupBy("g").applyInArrow(fn, _ROW)


def _open(out: DataFrame, length: int) -> Column:
    """Whether a row's bin goes up from the round ``out``: it is not nearly full, and there
    are enough open items that could fill its gap."""
    # a row per bin and at most ``length`` rows in all
    sizes = sorted((r["used"], r["n"]) for r in out.where("not final and offset = 0").groupBy("used")
                   .agg(F.count("*").alias("n")).collect())
    half = length // 2
    small = sum(n for s, n in sizes if s <= half)
    most, share = half, 0.0                  # larger items up to this size go up, of the size itself a share
    need = small + 4 * math.sqrt(small)      # as the share is drawn by a hash
    for s, n in sizes:
        if s > half and need > 0 and s <= length - sizes[0][0]:
            most, share = s, min(1.0, need / n)
            need -= n
    drawn = F.pmod(F.xxhash64("bin", F.lit(9)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    used = F.col("used")
    return ~F.col("final") & ((used <= half) | (used < most) | ((used == most) & drawn))


def pack(pieces: DataFrame, *, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """PIECES -> PIECES, sequence_id long, offset long."""
    pieces = stage(pieces, "pieces")
    full = pieces.where(F.col("length") == length)
    rest = pieces.where(F.col("length") < length)
    n_rows = rest.count()
    n_groups = max(1, -(-n_rows // group))
    key = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32")
    todo = rest.select(F.pmod(key, F.lit(n_groups)).alias("g"), *pieces.columns,
                       F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"))
    done, k, before = [], 0, None
    cols = pieces.columns + ["sequence_id", "offset"]
    while True:
        last = n_groups == 1 or (before is not None and 2 * n_rows > before)
        out = stage(_round(todo, k, length, last), f"pack{k}")
        goes_on = F.lit(False) if last else _open(out, length)
        done.append(out.where(~goes_on).withColumnRenamed("bin", "sequence_id").select(cols))
        if last:
            break
        todo = out.where(goes_on)
        before, n_rows, k = n_rows, todo.count(), k + 1
        if not n_rows:
            break
        n_groups = -(-n_rows // group)
        todo = todo.select(F.pmod(F.xxhash64("bin"), F.lit(n_groups)).alias("g"), *pieces.columns, "bin", "offset")
    # a piece that fills a sequence is one; its number (negative) can't meet a bin's
    whole = full.select(*pieces.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
                        F.lit(0).cast("long").alias("offset"))
    for d in done:
        whole = whole.unionByName(d)
    return whole


@register("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack(token_pieces(table(spark, sf_dir, "documents")))

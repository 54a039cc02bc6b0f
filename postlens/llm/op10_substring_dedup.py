"""Exact substring dedup: windows of ``window`` words, grouped by hash over pieces of the input.

A word goes if a window of words that covers it also starts in a document with a smaller id.
Suffix trees partitioned by prefix are not built: trees cut at the window's depth would hold
every suffix's first words (about 80 bytes a suffix, twelve times the text), and only their
nodes at that depth decide what goes.  A node there is told by a hash instead.

1.  Pieces.  The rows are written once in pieces of about 1.5 MB, each with its number.
2.  Codes out.  A piece sends every distinct window once, as a hash and the least document of
    the piece that has it, to the group that holds the hash's range (about ``GROUP`` windows).
    Places stay behind: however often a piece meets a window, it is one entry.
3.  Groups.  A group sorts its entries by hash.  An entry is answered if another document of
    any piece is less than its own.
4.  Answers back.  The answered (window, document) pairs return to their piece, which makes
    the hashes of its texts again.  A place is covered if its document isn't the least of
    the piece that has the window, or if that document was answered.  Runs of covered places
    are the maximal repeated passages (``spans``).

Hashes have so many bits that two different windows of the whole corpus share one within a
group with a probability below 2^-8.  Windows are judged on the input.  Null ids take no part
(nothing of them is removed); null and empty texts have no words; rows of equal id are one
document.  Columns named in ``keep`` may have any name.  A window that every piece has gives
its group one entry per piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import Words, chunks, forget, stage, table
from postlens.llm.registry import register

WINDOW = 13
GROUP = 800_000        #: windows of a group, about
NARROW = 64            #: bits of a code up to which one hash is enough
_CHUNK = 1_500_000
_SALT = 0x5851F42D4C957F2D
_WORD = 6              #: characters of a word, about; sets the number of groups only

U = np.uint64


def pieces(docs: DataFrame) -> DataFrame:
    """docs(id, text, ..) with a column ``piece`` in front, the same for neighbouring rows of
    about 1.5 MB of text; written, so that it stays what it is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        number, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            mine = []
            for n in pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist():
                if size and size + n > _CHUNK:
                    number, size = number + 1, 0
                size += n + 1
                mine.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), *b.columns], ["piece", *b.schema.names])
    schema = T.StructType([T.StructField("piece", T.LongType()), *docs.schema.fields])
    return stage(docs.mapInArrow(run, schema), "pieces")


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers, byte plane by byte plane (planes of zeros cost nothing once Spark
    compresses them)."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


class Windows:
    """The windows of the texts of a piece: ``at`` (first word), ``doc`` and the code
    (``low``, and ``high`` for codes of over 8 bytes); ``order`` puts equal codes side by side,
    ``fresh`` marks the first of each there, ``least`` is the least document of each."""

    def __init__(self, ids: np.ndarray, texts: list, window: int, wide: bool):
        self.words = w = Words(texts)
        self.at = np.flatnonzero(w.inside(window))
        self.doc = ids[w.doc[self.at]]
        self.low = w.window_hash(window)[self.at]
        self.high = w.window_hash(window, _SALT)[self.at] if wide else None
        self.order = np.lexsort((self.high, self.low)) if wide else np.argsort(self.low, kind="stable")
        if len(self.at):
            self.fresh = _fresh(*[c[self.order] for c in self.codes()])
            self.least = np.minimum.reduceat(self.doc[self.order], np.flatnonzero(self.fresh))

    def codes(self) -> list[np.ndarray]:
        return [self.low] if self.high is None else [self.low, self.high]


def _fresh(*sorted_codes: np.ndarray) -> np.ndarray:
    """Where a sorted run of codes (parts of one code) starts anew."""
    out = np.zeros(len(sorted_codes[0]), bool)
    out[0] = True
    for c in sorted_codes:
        out[1:] |= c[1:] != c[:-1]
    return out


_SENT = "g long, piece long, low binary, high binary, doc binary, base long"
_ANSWER = "piece long, low binary, high binary, doc binary, base long"


def _send(piece: int, ids: np.ndarray, texts: list, window: int, groups: int, wide: bool) -> Iterator[tuple]:
    """Rows for the groups: every distinct window of some texts of a piece, with its least document."""
    w = Windows(ids, texts, window, wide)
    if not len(w.at):
        return
    some = w.order[w.fresh]
    low, high = w.low[some], w.high[some] if wide else None
    group = (((low >> U(32)) * U(groups)) >> U(32)).astype(np.int64)   # ascending, as the codes are
    cut = np.flatnonzero(np.diff(group, prepend=-1))
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(low)]):
        yield (int(group[lo]), piece, *_packed(low[lo:hi], high[lo:hi] if wide else None, w.least[lo:hi]))


def _packed(low: np.ndarray, high: np.ndarray | None, doc: np.ndarray) -> tuple[bytes, bytes, bytes, int]:
    """Ascending codes as differences, documents as distances from the least one."""
    base = int(doc.min())
    return (_planes(np.diff(low, prepend=U(0))), b"" if high is None else high.astype("<u8").tobytes(),
            _planes((doc.view(np.uint64) - np.int64(base).view(np.uint64))), base)


def _unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, low, high, doc) of packed rows; high is zero for short codes."""
    low = [np.cumsum(_from_planes(x, U), dtype=U) for x in t["low"].to_pylist()]
    size = [len(x) for x in low]
    high = [np.frombuffer(x, "<u8") if x else np.zeros(n, U) for x, n in zip(t["high"].to_pylist(), size)]
    doc = [(_from_planes(x, U) + np.int64(b).view(np.uint64)).view(np.int64) for x, b in zip(t["doc"].to_pylist(), t["base"].to_pylist())]
    none = np.zeros(0, U)
    return (np.repeat(np.arange(len(size)), size), np.concatenate([none, *low]), np.concatenate([none, *high]),
            np.concatenate([none.view(np.int64), *doc]))


def _answer(t: pa.Table) -> pa.Table:
    """The entries of a group that a lesser document has, too; a row per row of the group."""
    row, low, high, doc = _unpacked(t)
    order = np.lexsort((high, low))
    fresh = _fresh(low[order], high[order])
    least = np.minimum.reduceat(doc[order], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    hit = np.sort(order[doc[order] > least])   # by row, and in a row by code
    cut = np.flatnonzero(np.diff(row[hit], prepend=-1))
    wide = any(t["high"].to_pylist())
    rows = [(t["piece"][int(row[hit[lo]])].as_py(), *_packed(low[hit[lo:hi]], high[hit[lo:hi]] if wide else None, doc[hit[lo:hi]]))
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(hit)])]
    cols = list(zip(*rows)) or [()] * 5
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in _ANSWER.split(", ")])


def _covered(ids: np.ndarray, known: np.ndarray, texts: list, answers: pa.Table, window: int, wide: bool) -> tuple[Words, np.ndarray]:
    """(words, whether each goes) of the texts of a whole piece."""
    some = np.flatnonzero(known)
    every = Words(texts)
    gone = np.zeros(len(every.start) + 1, np.int64)
    w = Windows(ids[some], [texts[i] for i in some.tolist()], window, wide)
    if len(w.at):
        _, low, high, doc = _unpacked(answers)
        node = np.cumsum(w.fresh) - 1
        later = w.doc[w.order] > w.least[node]
        if len(low):
            # the answered pairs whose document is the piece's least of that window
            mine = np.flatnonzero(w.fresh)
            own_low = w.low[w.order[mine]]
            if wide:
                pairs = np.concatenate([np.stack([own_low, w.high[w.order[mine]], w.least.view(U)], axis=1), np.stack([low, high, doc.view(U)], axis=1)])
                _, inverse = np.unique(pairs, axis=0, return_inverse=True)
                told = np.isin(inverse[:len(mine)], inverse[len(mine):])
            else:
                order = np.lexsort((doc, low))
                low, doc = low[order], doc[order]
                at = np.searchsorted(low, own_low)
                last = np.searchsorted(low, own_low, side="right")
                told = np.zeros(len(mine), bool)
                while (open_ := (at < last) & ~told).any():   # a window is answered a few times per piece at most
                    told |= open_ & (doc[np.minimum(at, len(doc) - 1)] == w.least)
                    at = at + 1
            later |= told[node]
        place = w.at[w.order[later]]
        # places count the words of known texts; in all texts the same words have these numbers
        shift = every.first[some] - w.words.first[:len(some)]
        place = place + shift[w.words.doc[place]]
        gone += np.bincount(place, minlength=len(gone))
        gone -= np.bincount(place + window, minlength=len(gone))[:len(gone)]
    return every, np.cumsum(gone[:-1]) > 0


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   keep: tuple[str, ...] = (), with_text: bool = False, with_spans: bool = False) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_removed, kept_sha256, the columns ``keep`` and, with
    ``with_text``, kept_text (the kept words joined by one space), with ``with_spans``, spans
    (first and last word of every removed passage, from 0)."""
    source = pieces(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                                *[F.col(c).alias(f"keep_{c}") for c in keep]))
    size = source.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, -(-size // (_WORD * GROUP)))
    wide = 2 * (size // 2 + 1).bit_length() + 8 - (groups.bit_length() - 1) > NARROW

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        for b in batches:
            number, ids, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            cut = np.flatnonzero(np.diff(number, prepend=number[0] - 1)).tolist()
            for a, z in zip(cut, [*cut[1:], len(number)]):
                rows = [r for lo, hi in chunks(texts[a:z], _CHUNK)
                        for r in _send(int(number[a]), ids[a + lo:a + hi], texts[a + lo:a + hi], window, groups, wide)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                     [c.split()[0] for c in _SENT.split(", ")])
    known = source.select("piece", "id", "text").where("id is not null and text is not null")
    answers = stage(known.mapInArrow(send, _SENT).groupBy("g").applyInArrow(_answer, _ANSWER), "answers")

    def mark(t: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = t["id"].fill_null(0).to_numpy(), t["text"].to_pylist()
        known = t["id"].is_valid().to_numpy() & t["text"].is_valid().to_numpy()
        w, gone = _covered(ids, known, texts, answers, window, wide)
        raw, first = w.buf.tobytes(), w.first.tolist()
        out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "kept_text", "spans")}
        for lo, hi in zip(first[:len(texts)], first[1:]):
            g = gone[lo:hi]
            stay = np.flatnonzero(~g) + lo
            left = b" ".join([raw[i:j] for i, j in zip(w.start[stay].tolist(), w.end[stay].tolist())])
            out["n_words"].append(hi - lo)
            out["n_removed"].append(hi - lo - len(stay))
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            if with_text:
                out["kept_text"].append(left.decode("utf-8", "surrogatepass"))
            if with_spans:
                edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                out["spans"].append([{"first": i, "last": j - 1} for i, j in zip(edge[::2].tolist(), edge[1::2].tolist())])
        made = [pa.array(out[f.name], k) for f, k in zip(fields, kinds)]
        return pa.table([t["id"], *made, *[t[f"keep_{c}"] for c in keep]], names=["id", *[f.name for f in fields], *[f"keep_{c}" for c in keep]])
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    kinds = [pa.int64(), pa.int64(), pa.string()]
    if with_text:
        fields.append(T.StructField("kept_text", T.StringType()))
        kinds.append(pa.string())
    if with_spans:
        fields.append(T.StructField("spans", span))
        kinds.append(pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
    schema = T.StructType([T.StructField("id", T.LongType()), *fields, *[f for f in source.schema.fields if f.name.startswith("keep_")]])
    out = source.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(mark, schema)
    return out.select(F.col("id").alias(id_col), *[f.name for f in fields], *[F.col(f"keep_{c}").alias(c) for c in keep])


@register("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, how many went, and the digest of what is left."""
    return remove_repeats(table(spark, sf_dir, "documents"))

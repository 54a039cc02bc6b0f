"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's elements are the 64-bit digests of its paragraphs; a paragraph (a line) of more
than ``RUN`` words is cut into runs of that many words, and the k-th occurrence of a
digest in a text is an element of its own.  A sketch has ``cells`` cells; each element
falls into one cell of each third, and a cell keeps the count, the sum of the elements and
the sum of their check codes (modulo 2^64).

Two sketches subtract cell by cell, which leaves the elements that differ.  Peeling takes
cells that hold one element (count +-1 and the check code fits), notes it and removes it
from its cells until nothing is left.  If something is left, both sketches are made anew
with four times the cells, from the digests, until peeling succeeds; so the answer is
exact.  Likeness = common elements / all elements of either text; 1 if neither has any.

The fingerprint is the smallest sketch as text: a digest of the whole text, the number of
elements, then the cells.  Null texts count as empty.

The next document (ascending id, the first after the last) comes by one range shuffle of
the texts: ranges are cut at quantiles of the ids, a range's first document also goes to
the range before, and sorted partitions stream through Python.  Rows of equal id follow
each other by text; rows without an id come last.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.llm.common import Words, mix, table
from postlens.llm.registry import register

RUN = 8                #: words of a paragraph that make one element
CELLS = 24             #: of the sketch that is the fingerprint (a multiple of 3)
GROW = 4
ROWS_PER_RANGE = 5000  #: documents of a range partition, about
MAX_RANGES = 10_000    #: ranges stream, so beyond that they just get longer

U = np.uint64
_CHECK = U(0xA0761D6478BD642F)


def elements(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(text index, element) of all texts, by text."""
    w = Words(texts)
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    line = np.cumsum(w.buf == 10)[w.start]              # each text ends a line, too
    fresh = np.concatenate([[True], line[1:] != line[:-1]])
    place = np.arange(n)
    place -= np.maximum.accumulate(np.where(fresh, place, 0))
    begin = np.flatnonzero(place % RUN == 0)
    weight = np.multiply.accumulate(np.full(RUN, 0x9FB21C651E98DF25, np.uint64))
    digest = mix(np.add.reduceat(w.hash * weight[place % RUN], begin))
    doc = w.doc[begin]
    order = np.lexsort((digest, doc))
    doc, digest = doc[order], digest[order]
    same = np.concatenate([[False], (doc[1:] == doc[:-1]) & (digest[1:] == digest[:-1])])
    at = np.arange(len(doc))
    nth = at - np.maximum.accumulate(np.where(same, 0, at))
    return doc, mix(digest + nth.astype(np.uint64) * U(0xE7037ED1A0B428DB))


def _cells(key: np.ndarray, cells: int) -> list[np.ndarray]:
    third = cells // 3
    return [((mix(key + U(s * 0x51ED270B + 1)) >> U(33)) % U(third)).astype(np.int64) + i * third
            for i, s in enumerate((3, 5, 7))]


def sketches(doc: np.ndarray, key: np.ndarray, docs: int, cells: int,
             sign: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, element sum, check sum), each (docs * cells,)."""
    count = np.zeros(docs * cells, np.int64)
    total, check = np.zeros(docs * cells, np.uint64), np.zeros(docs * cells, np.uint64)
    one = np.ones(len(key), np.int64) if sign is None else sign
    code = mix(key ^ _CHECK)
    k, c = (key, code) if sign is None else (key * one.astype(np.uint64), code * one.astype(np.uint64))
    for at in _cells(key, cells):
        np.add.at(count, doc * cells + at, one)
        np.add.at(total, doc * cells + at, k)
        np.add.at(check, doc * cells + at, c)
    return count, total, check


def peel(count: np.ndarray, total: np.ndarray, check: np.ndarray, cells: int
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Takes the sketches (subtracted, in a row) apart, all at once: (pair, element, +1 or
    -1 for the side that has it) and, per pair, whether nothing was left."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = np.flatnonzero((count == 1) | (count == -1))
    while len(look):
        sign = count[look]
        key = total[look] * sign.astype(np.uint64)
        pure = (np.abs(sign) == 1) & (check[look] * sign.astype(np.uint64) == mix(key ^ _CHECK))
        look, sign, key = look[pure], sign[pure], key[pure]
        pair = look // cells
        order = np.lexsort((key, pair))
        pair, key, sign = pair[order], key[order], sign[order]
        first = np.ones(len(key), bool)
        first[1:] = (pair[1:] != pair[:-1]) | (key[1:] != key[:-1])
        pair, key, sign = pair[first], key[first], sign[first]
        if not len(key):
            break
        found.append((pair, key, sign))
        code, s = mix(key ^ _CHECK), sign.astype(np.uint64)
        touched = []
        for at in _cells(key, cells):
            cell = pair * cells + at
            np.subtract.at(count, cell, sign)
            np.subtract.at(total, cell, key * s)
            np.subtract.at(check, cell, code * s)
            touched.append(cell)
        look = np.unique(np.concatenate(touched))
    left = (count != 0) | (total != 0) | (check != 0)
    done = ~left.reshape(-1, cells).any(axis=1)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), done
    return *(np.concatenate(x) for x in zip(*found)), done


def differences(doc_a, key_a, doc_b, key_b, pairs: int, cells: int = CELLS
                ) -> tuple[np.ndarray, np.ndarray]:
    """Per pair, the elements only a has and only b has, by sketches that grow until all are
    taken apart."""
    only_a, only_b = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    todo = np.arange(pairs)
    while len(todo):
        number = np.full(pairs, -1)
        number[todo] = np.arange(len(todo))
        a, b = number[doc_a] >= 0, number[doc_b] >= 0
        x = sketches(number[doc_a[a]], key_a[a], len(todo), cells)
        y = sketches(number[doc_b[b]], key_b[b], len(todo), cells)
        pair, _, sign, done = peel(*(p - q for p, q in zip(x, y)), cells)
        na = np.bincount(pair[sign > 0], minlength=len(todo))
        nb = np.bincount(pair[sign < 0], minlength=len(todo))
        only_a[todo[done]], only_b[todo[done]] = na[done], nb[done]
        todo, cells = todo[~done], cells * GROW
    return only_a, only_b


def likeness(doc_a, key_a, doc_b, key_b, pairs: int) -> np.ndarray:
    n_a, n_b = np.bincount(doc_a, minlength=pairs), np.bincount(doc_b, minlength=pairs)
    only_a, only_b = differences(doc_a, key_a, doc_b, key_b, pairs)
    either = n_a + only_b
    return np.where(either == 0, 1.0, (n_a - only_a) / np.maximum(either, 1))


def fingerprints(texts: list, doc: np.ndarray, key: np.ndarray) -> list[str]:
    n = np.bincount(doc, minlength=len(texts))
    count, total, check = (x.reshape(len(texts), CELLS) for x in sketches(doc, key, len(texts), CELLS))
    blob = np.concatenate([np.ascontiguousarray(count.astype("<i4")).view(np.uint8),
                           np.ascontiguousarray(total.astype("<u8")).view(np.uint8),
                           np.ascontiguousarray((check >> U(32)).astype("<u4")).view(np.uint8)], axis=1)
    return [f"{hashlib.blake2b(t.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}:{k}:"
            + base64.b64encode(row.tobytes()).decode() for t, k, row in zip(texts, n, blob)]


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _compare(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all texts but the last, each against the one that follows it."""
    own, after = texts[:-1], texts[1:]
    edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(own, after)]
    m = len(own)
    doc, key = elements(texts)
    e_doc, e_key = elements(edited)
    a, b = doc < m, doc > 0
    return pa.RecordBatch.from_arrays([
        pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in own], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
        pa.array(fingerprints(own, doc[a], key[a]), pa.string()),
        pa.array(fingerprints(edited, e_doc, e_key), pa.string()),
        pa.array(likeness(doc[a], key[a], e_doc, e_key, m)),
        pa.array(likeness(doc[a], key[a], doc[b] - 1, key[b], m))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted rows (range, copy, id, text): every row but copies against the next
    row of its range.  About 2 MB of text are held at a time."""
    ids: list = []
    texts: list[str] = []
    at, over, size = None, False, 0
    for b in batches:
        for bucket, copy, key, text in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != at:
                if len(texts) > 1:
                    yield _compare(ids, texts)
                ids, texts, at, over, size = [], [], bucket, False, 0
            if over:
                continue                                   # only the first copy follows the range
            ids.append(key)
            texts.append(text or "")
            size += len(texts[-1])
            over = copy
            if size > 2_000_000 and len(texts) > 1:
                yield _compare(ids, texts)
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if len(texts) > 1:
        yield _compare(ids, texts)


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit with the next document's head, and the
    likeness of the text to that edit and to the next document."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = src.count()
    ranges = int(min(MAX_RANGES, max(2, -(-n // ROWS_PER_RANGE))))
    cuts = src.select(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("c")).first()["c"]
    splits = [-float("inf"), *sorted({float(c) for c in cuts or []} or {0.0}), float("inf")]
    bucket = Bucketizer(splits=splits, inputCol="as_double", outputCol="b")

    def in_range(df: DataFrame) -> DataFrame:
        return (bucket.transform(df.withColumn("as_double", F.col("id").cast("double"))).drop("as_double")
                .withColumn("b", F.coalesce("b", F.lit(float(len(splits))))))    # no id: last
    # at most MAX_RANGES + 1 rows: a range, its first id, and the range before it
    firsts = in_range(src.select("id")).groupBy("b").agg(F.min("id").alias("first_id"))
    before = F.lag("b").over(Window.orderBy("b"))
    last = F.max("b").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("b", "first_id", F.coalesce(before, last).alias("prev"))
    rows = in_range(src).join(F.broadcast(firsts), "b")
    own = F.struct(F.col("b").alias("range"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("prev").alias("range"), F.lit(True).alias("copy"))
    rows = rows.select("id", "text", F.explode(
        F.when(F.col("id").eqNullSafe(F.col("first_id")), F.array(own, copy)).otherwise(F.array(own))).alias("p"))
    dealt = (rows.select("p.range", "p.copy", "id", "text").repartition(ranges, "range")
             .sortWithinPartitions("range", "copy", "id", "text"))
    return dealt.mapInArrow(_follow, _OUT)


@register("op5_iblt")
def op5_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fingerprints of the text and its edit, and their likeness."""
    return compare_with_next(table(spark, sf_dir, "documents"))

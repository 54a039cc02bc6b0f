"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features: texts are lower-cased, every run of non-letters becomes one space, and the
character 1-, 2- and 3-grams are hashed into ``BUCKETS`` columns.  A column's value is
(1 + ln count) x idf, the row scaled to length 1; idf = ln((1 + N) / (1 + df)) + 1 with N
and df counted over every document that may be learned from.

Training: follow-the-regularised-leader (proximal, per-coordinate rates) with elastic-net
penalties, over at most ``PER_LANGUAGE`` documents of each language (chosen by a hash of
the id); four fifths fit the weights, one fifth fits the temperature that divides the
logits (least log loss).  The fit runs in one task over that bounded sample of sparse rows;
statistics and predictions run over all rows.

Null texts and texts without a letter give ``und`` with score 0, and so does everything if
there is nothing to learn from.  Null or empty languages are not learned.  Rows without an
id are predicted, never learned from.  Repeated rows each give a row.  Texts longer than a
million characters are counted in slices of that size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import chunks, map_arrow, table
from postlens.llm.registry import register

BUCKETS = 8192
ORDERS = 3
PER_LANGUAGE = 2500      #: labelled documents a language is learned from, at most
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
SLICE = 1_000_000
_BATCH = 400_000         #: characters turned into features at a time

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, bucket, count) of the texts' hashed n-grams, by text and bucket."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(low)), [len(t) for t in low])
    letter = _letters()[code]
    # a run of non-letters counts as one space; so does the end of a text
    fresh = np.ones(len(code), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | letter[:-1]
    keep = letter | fresh
    code, doc = np.where(letter, code, 32)[keep].astype(np.uint32), doc[keep]
    cells = np.zeros(len(texts) * BUCKETS, np.int64)
    h = np.zeros(len(code), np.uint32)
    for n in range(1, ORDERS + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + (code[n - 1:] + np.uint32(n)) * np.uint32(0x9E3779B1)
        x = h ^ (h >> np.uint32(15))
        x = (x * np.uint32(0x85EBCA77)) >> np.uint32(32 - 13)
        at = doc[:m] * BUCKETS + x
        if n > 1:
            at = at[doc[:m] == doc[n - 1:]]
        cells += np.bincount(at, minlength=len(cells))
    full = np.flatnonzero(cells)
    return full // BUCKETS, full % BUCKETS, cells[full]


def gram_counts(texts: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs lo..hi of texts: (lo, hi, text index from lo, bucket, count)."""
    for lo, hi in chunks(texts, _BATCH):
        part = [t or "" for t in texts[lo:hi]]
        if len(part) == 1 and len(part[0]) > SLICE:
            total = np.zeros(BUCKETS, np.int64)
            for a in range(0, len(part[0]), SLICE):
                _, bucket, n = _grams([part[0][a:a + SLICE]])
                total[bucket] += n
            bucket = np.flatnonzero(total)
            yield lo, hi, np.zeros(len(bucket), np.int64), bucket, total[bucket]
        else:
            yield lo, hi, *_grams(part)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) == 2


def document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents with each bucket, documents), over all rows of docs(text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for b in batches:
            for lo, hi, _, bucket, _ in gram_counts(b.column(0).to_pylist()):
                df[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                n += hi - lo
        df[BUCKETS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["bucket", "n"])
    rows = (docs.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
            .collect())                                   # BUCKETS + 1 rows at most
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        df[r["bucket"]] = r["n"]
    return df[:BUCKETS], int(df[BUCKETS])


def _weigh(doc: np.ndarray, bucket: np.ndarray, n: np.ndarray, idf: np.ndarray, docs: int) -> np.ndarray:
    v = (1 + np.log(n)) * idf[bucket]
    norm = np.sqrt(np.bincount(doc, v * v, minlength=docs))
    return v / norm[doc]


def _with_bias(at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sparse row as doubles, with the bias column."""
    return np.append(at, BUCKETS), np.append(x, 1.0)


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> np.ndarray:
    """Weights (BUCKETS + 1, k); the last row is the bias.  The rows stay as narrow as they
    came, and one at a time is widened."""
    z, s = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(z, s):
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(s)) / ALPHA + L2))
    for _ in range(EPOCHS):
        for at, x, y in rows:
            at, x = _with_bias(at, x)
            zi, si = z[at], s[at]
            w = weights(zi, si)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = np.outer(x, p)
            more = si + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(si)) / ALPHA * w
            s[at] = more
    return weights(z, s)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search."""
    def loss(t):
        x = logits / np.exp(t)
        m = x.max(axis=1)
        return float(np.mean(m + np.log(np.exp(x - m[:, None]).sum(axis=1)) - x[np.arange(len(y)), y]))
    a, b, r = np.log(0.05), np.log(20), (5 ** 0.5 - 1) / 2
    c, d = b - r * (b - a), a + r * (b - a)
    for _ in range(40):
        if loss(c) < loss(d):
            b, d = d, c
            c = b - r * (b - a)
        else:
            a, c = c, d
            d = a + r * (b - a)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE) -> dict | None:
    """The model, as a dict of arrays, from all rows given; None if no row has a language."""
    src = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
           .where(F.col("id").isNotNull() & (F.length("lang") > 0) & F.col("text").isNotNull()))
    langs = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not langs:
        return None
    names = sorted(langs)
    df, n = document_counts(src.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / c))) for k, c in langs.items()])
    draw = F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = src.where(draw < share).select("text", F.xxhash64("id").alias("key"), "lang")

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        at, xs = [], []
        for lo, hi, doc, bucket, count in gram_counts(b.column(0).to_pylist()):
            v = _weigh(doc, bucket, count, idf, hi - lo).astype(np.float32)
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            for i, j in pairwise(cut):
                at.append(bucket[i:j].astype(np.int32))
                xs.append(v[i:j])
        return pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(at, pa.list_(pa.int32())),
                                           pa.array(xs, pa.list_(pa.float32()))], ["key", "lang", "at", "x"])

    def train(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["key", "lang"], kind="stable")
        data = [(a, x, names.index(y)) for a, x, y in zip(t["at"], t["x"], t["lang"])]
        hold = np.arange(len(data)) % 5 == 4
        fit_rows = [r for r, h in zip(data, hold) if not h]
        w = _ftrl(fit_rows, len(names))
        check = [r for r, h in zip(data, hold) if h] or fit_rows
        logits = np.array([v @ w[i] for i, v in (_with_bias(a, x) for a, x, _ in check)])
        temp = _temperature(logits, np.array([y for *_, y in check]))
        return pd.DataFrame({"w": [w.astype("<f4").tobytes()], "temp": [temp]})
    got = (map_arrow(sample, rows, "key long, lang string, at array<int>, x array<float>")
           .withColumn("all", F.lit(1)).groupBy("all").applyInPandas(train, "w binary, temp double").collect())
    if not got:                                            # a tiny table whose draw left no row
        return None
    w = np.frombuffer(got[0]["w"], "<f4").reshape(BUCKETS + 1, len(names))
    return {"names": names, "idf": idf.astype(np.float32), "w": w, "temp": got[0]["temp"]}


def predict(docs: DataFrame, model: dict | None, *, id_col: str = "doc_id", text_col: str = "text",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, held_out, lang_pred, score) and the columns ``keep`` of each row."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"),
                      F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[3:])

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(2).to_pylist()
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        for lo, hi, doc, bucket, count in gram_counts(texts) if model else ():
            v = _weigh(doc, bucket, count, model["idf"], hi - lo)
            w = model["w"]
            logits = np.stack([np.bincount(doc, v * w[bucket, k], minlength=hi - lo) + w[BUCKETS, k]
                               for k in range(w.shape[1])], axis=1) / model["temp"]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            known = np.array([has_letter(t) for t in texts[lo:hi]])
            lang[lo:hi][known] = np.array(model["names"], object)[best][known]
            score[lo:hi][known] = p.max(axis=1)[known]
        cols = [b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)]
        return pa.RecordBatch.from_arrays(cols + b.columns[3:],
                                          ["id", "held_out", "lang_pred", "score"] + b.schema.names[3:])
    schema = "id long, held_out boolean, lang_pred string, score double" + (f", {kinds}" if kinds else "")
    out = map_arrow(src, fn, schema)
    return out.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score",
                      *[F.col(f"keep_{c}").alias(c) for c in keep])


@register("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held out or not, predicted language, calibrated score."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs.where(~held_out("doc_id"))))

"""Ranked lexical search: best-first document intervals under range-maximum bounds.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, with only A-Z
lower-cased.  A term's weight is floor(1000 ln((2N+2) / (2df+1))); a document's impact for a
term is 10^9 tf div (1000 tf + 20 m) with m = 50 + 50 n N div L; its score is the sum of
weight * impact over the item's terms, each once, in integers.

1.  The items (the stated query set) are collected in blocks of at most ``QUERY_BYTES`` of
    text; a block's terms are its vocabulary.  One pass per block turns every document into
    its length and its (term, tf) of the vocabulary, written; N, L and df are summed over it.
2.  A task cuts its documents into indexes of about ``POSTINGS`` postings: documents by
    ascending id, a posting list per term, and on each list a sparse table of the places of
    range maxima.
3.  A query starts with the interval of all documents of the index.  An interval's bound is
    the sum, over the terms, of weight * range maximum.  The best intervals are split at the
    document of their largest single weighted impact, which is scored exactly; the two rests
    get bounds of their own.  What can't reach the k-th best so far (by score, then by
    the smaller id) is dropped; the k best are carried from index to index of a task.
    Intervals of at most ``LEAF`` documents are not split any more but scored.
4.  The k best of the tasks are merged in two steps, the first one salted.

A row of the documents is one document, a row of the items is one item (repeated rows
count again); null texts have no terms.  Among equal scores smaller ids come first, null
ids last.  Items without terms, and documents of score 0, give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.llm.common import forget, stage, table
from postlens.llm.registry import register

K = 50
QUERY_BYTES = 8_000_000
POSTINGS = 400_000
LEAF = 8
WIDE = 1 << 16         #: (interval, term) pairs of a round, about
SALTS = 16
_SLICE = 1 << 20
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_OTHER = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_LAST = np.iinfo(np.int64).max


def term_counts(text: str | None) -> tuple[int, Counter]:
    """(number of terms, term -> occurrences); a long text is cut between terms."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n, count, at = 0, Counter(), 0
    while at < len(raw):
        end = at + _SLICE
        gap = _OTHER.search(raw, end) if end < len(raw) else None
        end = gap.start() if gap else len(raw)
        found = _TERM.findall(raw[at:end].lower())
        n += len(found)
        count.update(found)
        at = end
    return n, count


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The length part m of each document."""
    if len(n) and 50 * int(n.max()) * n_docs >= 1 << 63:   # beyond 64 bits: exact integers
        return np.array([50 + 50 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    return 50 + 50 * n * n_docs // n_terms


def _first_of_term(key: np.ndarray, terms: np.ndarray, docs: int, doc: np.ndarray) -> np.ndarray:
    """For every doc (rows) and term (columns): the first posting of that doc or a later one."""
    return np.searchsorted(key, terms * docs + doc[:, None])


class Index:
    """Posting lists of some documents (ascending ids) with their range-maximum tables."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray):
        self.ids, self.docs = ids, len(ids)
        order = np.lexsort((doc, term))
        term, doc, tf = term[order].astype(np.int64), doc[order], tf[order].astype(np.int64)
        self.doc = doc
        self.key = term * self.docs + doc
        self.impact = 10**9 * tf // (1000 * tf + 20 * m[doc])
        self.terms, at = np.unique(term, return_index=True)
        longest = int(np.diff(np.append(at, len(term))).max())
        # best[j][i]: place of the maximum among the 2^j postings from i on (the first of equal ones)
        self.best = [np.arange(len(term), dtype=np.int32)]
        while 2 << (len(self.best) - 1) <= longest:
            a, half = self.best[-1], 1 << (len(self.best) - 1)
            x, y = a[:-half], a[half:]
            self.best.append(np.concatenate([np.where(self.impact[y] > self.impact[x], y, x), a[-half:]]))
        self.best = np.stack(self.best)

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, impact) of the maxima of the postings lo .. hi - 1; impact 0 where none."""
        size = hi - lo
        level = np.frexp(np.maximum(size, 1))[1] - 1
        some = size > 0
        x = self.best[level, np.where(some, lo, 0)]
        y = self.best[level, np.where(some, hi - (1 << level), 0)]
        place = np.where(self.impact[y] > self.impact[x], y, x)
        return place, np.where(some, self.impact[place], 0)

    def search(self, terms: np.ndarray, w: np.ndarray, k: int, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of this index and of (score, ids), best first."""
        here = np.isin(terms, self.terms) & (w > 0)
        terms, w = terms[here], w[here]
        if not len(terms):
            return score, ids

        def bounds(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(bound, document of the largest weighted impact) of intervals."""
            place, impact = self.maxima(_first_of_term(self.key, terms, self.docs, lo),
                                        _first_of_term(self.key, terms, self.docs, hi + 1))
            each = impact * w
            top = each.argmax(axis=1)
            return each.sum(axis=1), self.doc[place[np.arange(len(lo)), top]]

        def score_of(doc: np.ndarray) -> np.ndarray:
            at = _first_of_term(self.key, terms, self.docs, doc)
            has = self.key[np.minimum(at, len(self.key) - 1)] == terms * self.docs + doc[:, None]
            return (np.where(has, self.impact[np.minimum(at, len(self.key) - 1)], 0) * w).sum(axis=1)

        lo, hi = np.array([0]), np.array([self.docs - 1])
        bound, split = bounds(lo, hi)
        most = max(1, WIDE // len(terms))
        while True:
            live = bound > 0
            if len(score) == k:   # full: what can't come before the last one goes
                live &= (bound > score[-1]) | ((bound == score[-1]) & (self.ids[lo] < ids[-1]))
            lo, hi, bound, split = lo[live], hi[live], bound[live], split[live]
            if not len(lo):
                return score, ids
            took = np.argpartition(-bound, most - 1)[:most] if len(lo) > most else np.arange(len(lo))
            rest = np.ones(len(lo), bool)
            rest[took] = False
            a, b, d = lo[took], hi[took], split[took]
            small = b - a < LEAF
            size = b[small] - a[small] + 1
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a[small], size)
            scored = np.concatenate([d[~small], inner])
            got = score_of(scored)
            score, ids = best_of(np.concatenate([score, got]), np.concatenate([ids, self.ids[scored]]), k)
            a, b, d = a[~small], b[~small], d[~small]
            left, right = a < d, d < b
            new_lo, new_hi = np.concatenate([a[left], d[right] + 1]), np.concatenate([d[left] - 1, b[right]])
            new_bound, new_split = bounds(new_lo, new_hi) if len(new_lo) else (new_lo, new_lo)
            lo, hi = np.concatenate([lo[rest], new_lo]), np.concatenate([hi[rest], new_hi])
            bound, split = np.concatenate([bound[rest], new_bound]), np.concatenate([split[rest], new_split])


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best above 0, best first; equal scores by id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = score >= least
        score, ids = score[some], ids[some]
    order = np.lexsort((ids, -score))[:k]
    order = order[score[order] > 0]
    return score[order], ids[order]


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """docs(doc, text) -> (doc, n, term, tf) of the documents with a term; arrays as bytes."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)   # of at most QUERY_BYTES of text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        words = known.value
        for b in batches:
            n, term, tf = [], [], []
            for text in b.column(1):
                size, count = term_counts(text.as_py())
                own = sorted((words[t], c) for t, c in count.items() if t in words)
                n.append(size)
                term.append(np.array([x for x, _ in own], "<i4").tobytes())
                tf.append(np.array([x for _, x in own], "<i4").tobytes())
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(term, pa.binary()), pa.array(tf, pa.binary())],
                                             ["doc", "n", "term", "tf"])
            yield out.filter(pa.array(np.array(n) > 0))
    return docs.mapInArrow(run, "doc long, n long, term binary, tf binary")


def _document_counts(postings: DataFrame, size: int) -> np.ndarray:
    """df of every term of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4"), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["at", "n"])
    df = np.zeros(size, np.int64)
    for r in postings.select("term").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        df[r["at"]] = r["n"]   # as many rows as the vocabulary at most
    return df


def _search(postings: DataFrame, queries: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(q, doc, score): the k best of every task for every query."""
    asked = postings.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = asked.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]

        def close(parts: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(parts)
            ids = t["doc"].fill_null(int(_LAST)).to_numpy()
            order = np.argsort(ids, kind="stable")
            term = [np.frombuffer(x, "<i4") for x in t["term"].to_pylist()]
            count = np.array([len(x) for x in term])
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            tf = np.frombuffer(b"".join(t["tf"].to_pylist()), "<i4")
            if len(tf):
                index = Index(ids[order], lengths(t["n"].to_numpy(), n_docs, n_terms)[order], np.concatenate(term), np.repeat(rank, count), tf)
                for i, (_, terms) in enumerate(queries):
                    best[i] = index.search(terms, weights[terms], k, *best[i])
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += sum(len(x) for x in b.column(2).to_pylist()) // 4
            if size >= POSTINGS:
                close(held)
                held, size = [], 0
        if held:
            close(held)
        for (q, _), (score, ids) in zip(queries, best):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), q)), pa.array(ids, mask=ids == _LAST), pa.array(score)], ["q", "doc", "score"])
    return postings.mapInArrow(run, "q long, doc long, score long")


def ranked(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    asked = stage(items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"), F.monotonically_increasing_id().alias("q")), "items")
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    number = F.pmod(F.xxhash64("q"), F.lit(blocks))
    out = None
    for block in range(blocks):
        vocabulary: dict[bytes, int] = {}
        queries = []
        for r in asked.where(number == block).orderBy("q").collect():   # QUERY_BYTES, about
            terms = [vocabulary.setdefault(t, len(vocabulary)) for t in term_counts(r["text"])[1]]
            if terms:
                queries.append((r["q"], np.array(sorted(terms), np.int64)))
        postings = stage(_postings(src, vocabulary), "postings")
        total = postings.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        n_docs, n_terms = total["docs"], total["terms"] or 1
        weights = np.array([weight(n_docs, int(x)) for x in _document_counts(postings, len(vocabulary))], np.int64)
        found = _search(postings.where(F.length("term") > 0), queries, weights, n_docs, n_terms, k)
        out = found if out is None else out.unionByName(found)
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    for by in (["q", "salt"], ["q"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("rank")
        out = (out.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))) if "salt" in by else out)
        out = out.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.join(asked.select("q", "item"), "q").select(
        F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, translate(text, '{_UPPER}', '{_LOWER}') AS text FROM documents
), words AS (
  SELECT row, doc_id, unnest(regexp_extract_all(text, '{_CLASS}')) AS term FROM docs
), asked AS (
  SELECT DISTINCT q, item_id, term FROM (
    SELECT q, item_id, unnest(regexp_extract_all(text, '{_CLASS}')) AS term
    FROM (SELECT row_number() OVER () AS q, item_id, translate(text, '{_UPPER}', '{_LOWER}') AS text FROM benchmark))
), size AS (
  SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY row
), total AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size
), counts AS (
  SELECT row, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY row, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), total
), scores AS (
  SELECT q, item_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN size USING (row), total
  GROUP BY q, item_id, row
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores JOIN size USING (row) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {K}
"""


@register("op12_ranked_search", _SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for every item of the benchmark."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

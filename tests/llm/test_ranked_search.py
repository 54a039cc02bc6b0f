"""Ranked lexical search against scores of all documents."""

import math
import random
import re

import numpy as np
import pytest

import postlens.llm.op12_ranked_search as op12

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def _brute(docs, items, k):
    own = [(d, _terms(t)) for d, t in docs]
    own = [(d, w) for d, w in own if w]
    n_docs, n_terms = len(own), sum(len(w) for _, w in own)
    out = []
    for item, text in items:
        scores = []
        for d, w in own:
            m, score = 50 + 50 * len(w) * n_docs // n_terms, 0
            for t in set(_terms(text)):
                df = sum(t in x for _, x in own)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if nul else d, -s) for i, (s, nul, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def _got(spark, docs, items, k):
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, q string, score int")
    return sorted([tuple(r) for r in op12.ranked(docs, asked, k=k).select("item_id", "rank", "doc_id", "score").collect()], key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_against_scores_of_all_documents(spark, docs, monkeypatch, small):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Café", "É", "A1"]
    text = lambda n: "".join(r.choice(vocabulary[:r.choice([3, 43])]) + r.choice([" ", ".", "\n\x00", "_"]) for _ in range(n))
    rows = [(i, text(r.choice([0, 1, 3, 8, 40, 200]))) for i in range(300)]
    rows += [*rows[:60], (7, None), (None, text(9)), (None, text(30)), (400, ""), (401, "w1 " * 5000)]
    rows += [(500 + i, "w1 w2 w3") for i in range(60)]   # ties
    items = [(1, text(6)), (2, text(30)), (3, "w1 W1 w2"), (4, None), (5, "--"), (6, "nowhere"), (None, "w9 é É"), (3, "w1 w2"), (8, "a1")]
    if small:   # several query blocks, several indexes a task, few pairs a round
        monkeypatch.setattr(op12, "QUERY_BYTES", 300)
        monkeypatch.setattr(op12, "POSTINGS", 150)
        monkeypatch.setattr(op12, "WIDE", 16)
        monkeypatch.setattr(op12, "LEAF", 2)
    assert _got(spark, docs(rows, extra=True), items, 9) == _brute(rows, items, 9)


def test_empty_tables(spark, docs):
    assert _got(spark, docs([(1, "a b")]).limit(0), [(1, "a")], 5) == []
    assert _got(spark, docs([(1, "a b"), (2, None)]), [(1, None)], 5) == []


def test_terms_of_long_texts_are_not_cut(monkeypatch):
    monkeypatch.setattr(op12, "_SLICE", 7)
    text = "Abc defghijklmnop, q\x00é ÉÉ " * 9
    n, count = op12.term_counts(text)
    want = [t.encode() for t in _terms(text)]
    assert n == len(want) and all(count[t] == want.count(t) for t in want)


def test_range_maxima_and_lengths():
    r = np.random.default_rng(1)
    tf = r.integers(1, 50, 60).astype(np.int32)
    index = op12.Index(np.arange(60), np.full(60, 100), np.repeat([3, 9], [40, 20]), np.concatenate([np.arange(40), np.arange(20)]), tf)
    lo, hi = np.array([[0, 40], [5, 41], [12, 50], [7, 60]]), np.array([[40, 60], [6, 41], [39, 59], [7, 60]])
    place, most = index.maxima(lo, hi)
    for i, j in np.ndindex(lo.shape):
        part = index.impact[lo[i, j]:hi[i, j]]
        assert most[i, j] == (part.max() if len(part) else 0)
        assert not len(part) or place[i, j] == lo[i, j] + part.argmax()
    big = np.array([10**12, 3])
    assert op12.lengths(big, 10**10, 10**13).tolist() == [50 + 50 * x * 10**10 // 10**13 for x in big.tolist()]
    assert op12.lengths(np.array([7, 3]), 2, 10).tolist() == [50 + 70, 50 + 30]

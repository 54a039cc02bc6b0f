"""Benchmark decontamination against a plain scan."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import postlens.llm.op11_decontaminate as op11
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(text):
    fold = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    return WORD.findall((text or "").translate(fold))


def _brute(docs, items, k):
    grams = {}
    for i, t in items:
        w = _words(t)
        for n in {min(k, len(w))} - {0}:
            for a in range(len(w) - n + 1):
                grams.setdefault(tuple(w[a:a + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, which = _words(t), set(), set()
        for n in {len(g) for g in grams}:
            for a in range(len(w) - n + 1):
                if (g := tuple(w[a:a + n])) in grams:
                    hit |= set(range(a, a + n))
                    which |= grams[g]
        names = sorted(str(i) for i in which if i is not None)
        out.append((d, len(w), len(hit), len(names), ",".join(names), bool(hit)))
    return sorted(out, key=lambda t: [(x is not None, x) for x in t])


def _items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, doc string, h int")


def _got(df):
    return rows_of(df.withColumn("names", F.array_join("items", ",")), "doc_id", "n_words", "n_hit", "n_items", "names", "contaminated")


@pytest.mark.parametrize("blocks", [1, 3])
def test_against_a_plain_scan(spark, docs, monkeypatch, blocks):
    r = random.Random(3)
    vocabulary = ["a", "b", "Cc", "dé", "é7", "x9"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "\x00-", "'"]) for _ in range(n))
    rows = [(i, text(r.choice([0, 1, 2, 4, 9, 30]))) for i in range(150)]
    rows += [(7, None), (8, ""), (None, text(12)), (None, None), (9, "--"), (9, "--"), *rows[:20]]
    items = [(1, text(9)), (2, text(7)), (11, text(4)), (3, text(3)), (4, "Cc dé"), (5, ""), (6, None), (None, text(6)), (1, text(5))]
    if blocks > 1:
        monkeypatch.setattr(op11, "BLOCK_BYTES", 300)
    got = op11.contamination(docs(rows, extra=True), _items(spark, items), window=4)
    assert _got(got) == _brute(rows, items, 4)


def test_one_word_items_long_text_and_empty_tables(spark, docs):
    rows = [(1, "One " + "pad " * 60000 + "ONE"), (2, "none")]
    one = _items(spark, [(5, "one")])
    assert _got(op11.contamination(docs(rows), one)) == [(1, 60002, 2, 1, "5", True), (2, 1, 0, 0, "", False)]
    assert _got(op11.contamination(docs(rows), one.limit(0))) == [(1, 60002, 0, 0, "", False), (2, 1, 0, 0, "", False)]
    assert _got(op11.contamination(docs(rows).limit(0), one)) == []


def test_windows_of_equal_hash_are_told_apart(spark, docs, monkeypatch):
    monkeypatch.setattr(op11, "_hash", lambda w, at, n: F.lit(7).cast("long"))
    rows = [(1, "a b c"), (2, "b c d"), (3, "c a")]
    items = [(1, "a b"), (2, "c d"), (3, "x y z")]
    assert _got(op11.contamination(docs(rows), _items(spark, items), window=2)) == _brute(rows, items, 2)


def test_spans_and_documents_are_removed(spark, docs):
    rows = [(1, "Keep: this, one two three FOUR; and that."), (2, "clean  text "), (3, "one two, three"), (4, None), (None, "two three four!")]
    items = _items(spark, [(1, "one two three"), (2, "Two three four")])
    left = op11.decontaminate(docs(rows, extra=True), items, window=3)
    assert rows_of(left, "doc_id", "text") == [(None, "!"), (1, "Keep: this; and that."), (2, "clean  text "), (3, ""), (4, None)]
    assert left.columns == docs(rows, extra=True).columns
    stay = op11.decontaminate(docs(rows), items, window=3, spans=False)
    assert rows_of(stay, "doc_id") == [(2,), (4,)]


def test_the_scan_broadcasts_windows_and_shuffles_none(spark, docs):
    windows = op11.benchmark_windows(_items(spark, [(1, "a b c d e f g h i j k")]))
    plan = op11.occurrences(docs([(1, "a b")]).select(F.col("doc_id").alias("doc"), "text"), windows)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "Python" not in text and "Arrow" not in text


def test_digest_of_the_items(spark, tmp_path, docs):
    docs([(1, "a b c d e f g h i j"), (2, "z")]).write.parquet(f"{tmp_path}/documents.parquet")
    _items(spark, [(10, "a b c d e f g h i j"), (9, "B C D E F G H I J"), (3, "q")]).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op11.op11_decontaminate(spark, str(tmp_path))
    assert rows_of(got, "doc_id", "n_hit", "items_sha256") == [
        (1, 10, hashlib.sha256(b"10,9").hexdigest()), (2, 0, hashlib.sha256(b"").hexdigest())]

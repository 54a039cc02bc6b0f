"""Preference formatting, nearest neighbours, page text, components and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm.components import components
from postlens.llm.op1_preferences import preferences
from postlens.llm.op2_collision_ann import nearest
from postlens.llm.op4_main_text import blocks, main_text, repeat_counts
from tests.llm.conftest import SCHEMA, rows_of


def _turns(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, part string")


def test_preferences_share_the_longest_prefix(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "good"),
            (2, 0, "user", "hi"), (2, 1, "assistant", "a"), (2, 2, "user", "other"), (2, 3, "assistant", "good"),
            (3, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, None, None), (5, 0, None, None), (None, 0, "user", "x"),
            (6, None, "user", "early"), (6, 1, "assistant", "z" * 50000)]
    pairs = spark.createDataFrame([(10, 1, 2), (11, 3, 4), (12, 5, 99), (13, 98, 6), (14, 1, 1), (None, 1, 2)],
                                  "pair_id long, chosen_id long, rejected_id long")
    got = rows_of(preferences(_turns(spark, rows), pairs), "pair_id", "part", "turn", "role", "text", "loss")
    assert got == sorted([
        (10, "prompt", 0, "user", "hi", False), (10, "prompt", 1, "assistant", "a", False),
        (10, "chosen", 2, "user", "more", False), (10, "chosen", 3, "assistant", "good", True),
        (10, "rejected", 2, "user", "other", False), (10, "rejected", 3, "assistant", "good", True),
        (11, "prompt", 0, "user", "same", False), (12, "chosen", 0, "unknown", "", False),
        (13, "rejected", None, "user", "early", False), (13, "rejected", 1, "assistant", "z" * 50000, True),
    ], key=lambda t: [(x is not None, x) for x in t])
    one = preferences(_turns(spark, rows), pairs).where("pair_id = 10 and part = 'chosen' and turn = 3").first()
    assert one.rendered == "<|im_start|>assistant\ngood<|im_end|>\n"


def test_preferences_of_empty_tables(spark):
    none = _turns(spark, [(1, 0, "user", "hi")]).limit(0)
    pairs = spark.createDataFrame([(1, 1, 2)], "pair_id long, chosen_id long, rejected_id long")
    assert preferences(none, pairs).collect() == []
    assert preferences(_turns(spark, [(1, 0, "user", "hi")]), pairs.limit(0)).collect() == []


def _brute(ids, x, queries, k):
    out = {}
    for q in queries:
        own = x[ids.index(q)]
        d = sorted((float(np.sqrt(((np.array(v) - np.array(own)) ** 2).sum())), i) for i, v in zip(ids, x) if i != q)
        out[q] = [i for _, i in d[:k]]
    return out


def test_nearest_neighbours_find_nine_in_ten(spark, monkeypatch):
    monkeypatch.setattr("postlens.llm.op2_collision_ann.BLOCK", 300)
    monkeypatch.setattr("postlens.llm.op2_collision_ann.QUERIES", 8)
    monkeypatch.setattr("postlens.llm.op2_collision_ann.SAMPLE", 200)
    r = np.random.default_rng(0)
    centres = r.normal(size=(12, 24))
    x = [[float(v) for v in centres[i % 12] + r.normal(size=24) * 0.4] for i in range(1500)]
    ids = list(range(1500))
    df = spark.createDataFrame(list(zip(ids, x, ["x"] * 1500)), "vec_id long, embedding array<double>, rank string")
    got = nearest(df, F.col("vec_id") % 100 == 0).collect()
    want = _brute(ids, x, range(0, 1500, 100), 10)
    hits = sum(r.vec_id in want[r.query_id] for r in got)
    assert len(got) == 150 and hits >= 135
    for row in got:
        assert row.score == pytest.approx(np.linalg.norm(np.array(x[row.query_id]) - np.array(x[row.vec_id])), rel=1e-12)


def test_nearest_neighbours_with_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [1.0, 0.0]), (101, [0.0, 2.0]), (102, None), (103, [0.0, 0.0]),
            (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (106, [1.0]), (107, [None, 1.0]), (None, [1.0, 0.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") % 100 == 0, k=5)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(
        [(0, n, n, 0.0) for n in range(1, 6)] + [(100, n + 1, n, 0.0) for n in range(5)])
    few = nearest(df.where("vec_id in (100, 101)"), F.col("vec_id") % 100 == 0)
    assert rows_of(few, "query_id", "rank", "vec_id") == [(100, 1, 101)]
    assert nearest(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies</div><article class="post"><h1>A &amp; B</h1><p>One<br>two &lt;three&gt;&nbsp;four
five<p>Unclosed <b>bold</b></p><div class="ad">Buy</div><form><label>Mail</label></form><aside>Side</aside>
<section id="comments"><p>First!</p></section><p></p></article><div id="sidebar">More</div><footer>&copy; x</footer></body></html>"""


def test_structure_gives_the_article(spark):
    df = spark.createDataFrame([(1, "http://h.example/a", PAGE, "x"), (2, "http://h.example/b", None, "x"), (3, None, "", "x"),
                                (4, "nohost", "<p>plain &#233;t&eacute; &am</p><script>cut", "x"), (1, "http://h.example/a", PAGE, "x")],
                               "page_id long, url string, html string, part string")
    got = rows_of(main_text(df), "page_id", "url", "text", "n_chars")
    text = "A & B\nOne two <three> four five\nUnclosed bold"
    assert got == [(1, "http://h.example/a", text, len(text)), (1, "http://h.example/a", text, len(text)),
                   (2, "http://h.example/b", "", 0), (3, None, "", 0), (4, "nohost", "plain été &am", 13)]
    assert main_text(df.limit(0)).collect() == []


def test_broken_markup_does_not_hang():
    for html in ("<" * 50000, "<a " * 20000, "<p" * 20000, "<!--" * 10000, '<a "' * 5000, "<script>" * 5000):
        blocks(html)


def test_boilerplate_without_markup_goes_and_unique_runs_stay(spark):
    r = random.Random(2)
    words = lambda n: " ".join(f"w{r.randrange(10 ** 6)}" for _ in range(n))
    notice, menu = words(14), words(9)
    own = {i: words(40) for i in range(12)}
    rows = [(i, f"http://h.example/{i}", f"<div>{menu}</div><div>{own[i]}</div><div>{notice} until {i}</div>") for i in range(12)]
    rows += [(50 + i, f"http://o.example/{i}", f"<div>{words(30)}</div>") for i in range(3)]
    copy = words(60)
    rows += [(90 + i, f"http://h.example/c{i}", f"<article><p>{copy}</p><p>{notice}</p></article>") for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in main_text(df).collect()}
    assert all(got[i] == f"{own[i]}\n{i}" for i in range(12))
    assert all(len(got[50 + i].split()) == 30 for i in range(3))
    assert got[90] == got[91] == f"{copy}\n{notice}"       # a passage of an article is text


def test_a_host_of_many_arrays_is_judged_as_a_whole(spark, monkeypatch):
    r = random.Random(4)
    words = lambda n: " ".join(f"w{r.randrange(10 ** 6)}" for _ in range(n))
    notice, menu, rare = words(14), words(9), words(10)
    rows = [(i, f"http://a.example/{i}", f"<article><p>{words(60)}</p><p>{notice}</p></article>") for i in range(60)]
    rows += [(100 + i, f"http://b.example/{i}", f"<div>{menu * (i % 10 == 0)}</div><div>{words(60)}</div><div>{rare * (i < 2)}</div>")
             for i in range(60)]
    df = spark.createDataFrame(rows + rows[:3], "page_id long, url string, html string")
    whole = rows_of(main_text(df), "page_id", "text")
    monkeypatch.setattr("postlens.llm.op4_main_text.ARRAY_BYTES", 2_000)     # about three pages
    assert rows_of(main_text(df), "page_id", "text") == whole
    assert all(notice not in t and menu not in t for _, t in whole) and sum(rare in t for _, t in whole) == 2


def test_repeat_counts_equal_brute_force():
    r = random.Random(1)
    streams = [np.array([r.randrange(3) for _ in range(r.randrange(0, 30))]) for _ in range(9)]
    for long in (1, 3, 5, 8):
        want = []
        for s in streams:
            for i in range(len(s)):
                run = s[i:i + long].tolist()
                want.append(sum(any(t[j:j + long].tolist() == run for j in range(len(t) - long + 1)) for t in streams)
                            if len(run) == long else 0)
        assert repeat_counts(streams, long).tolist() == want


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200)]
    links += [(7, 7), (300, 300), (201, 200), (400, 139)]
    got = rows_of(components(spark.createDataFrame(links, "a long, b long")), "node", "root")
    want = [(i, 1) for i in range(2, 31)] + [(100 + i, 100) for i in range(1, 40)] + [(201, 200), (202, 200), (400, 100)]
    assert got == sorted(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline as C
    r = random.Random(8)
    text = lambda n: " ".join(f"{r.choice('bcdfgl')}{r.choice(['ing', 'tion', 'the', 'ou'])}{r.randrange(999)}" for _ in range(n))
    passage = text(60)
    rows = [(i, text(80)) for i in range(30)]
    rows += [(40, rows[3][1]), (41, rows[3][1] + " end"), (42, None), (43, "12 34"), (44, f"{text(40)} {passage}"), (45, f"{text(40)} {passage} {text(9)}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = C.language(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, _ in rows} - {42, 43}
    kept = C.near_dedup(spark, kept, str(tmp_path))
    assert {x.doc_id for x in kept.collect()} == {i for i, _ in rows} - {40, 41, 42, 43}
    left = {x.doc_id: x for x in C.substring_dedup(spark, kept, str(tmp_path)).collect()}
    assert passage in left[44].text and passage not in left[45].text and len(left[45].text.split()) == 49
    assert all(left[i].text == t for i, t in rows if i < 30 and i in left) and left[45].n_chars == len(left[45].text)
    out = C.run(spark, str(tmp_path))
    assert {x.doc_id for x in out.collect()} == set(left) and [n for n, _ in C.STAGES] == ["language", "near_dedup", "substring_dedup", "packing"]


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as C
    words = lambda a, n=40: " ".join(f"wort{a}x{i}" for i in range(n))
    long = " ".join(f"lang{i}" for i in range(60_000))
    rows = [(1, words(1)), (1, words(1)), (2, words(2)), (2, words(3)), (3, words(1)), (None, words(4)), (None, words(4)),
            (5, None), (6, "12 34"), (7, long), (8, "a"), (9, "")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    before = spark.conf.get(C.BATCHES)
    for name, df in (("rows", docs), ("none", docs.limit(0))):
        df.selectExpr("*", "'x' AS id", "'x' AS kept", "'x' AS n").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    read = spark.read.parquet(f"{tmp_path}/rows/documents.parquet")
    kept = C.language(spark, read, "")                     # no language is known: letters decide
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id") == sorted([(i,) for i in (1, 1, 2, 2, 3, None, None, 7, 8)], key=lambda t: (t[0] is not None, t[0] or 0))
    kept = C.near_dedup(spark, kept, "")
    got = rows_of(kept, "doc_id", "text")
    assert [x for x in got if x[0] is not None] == [(1, words(1)), (2, words(2)), (7, long), (8, "a")]
    assert got[:2] == [(None, words(4))] * 2
    left = C.substring_dedup(spark, kept, "")
    assert {x.doc_id for x in left.collect()} >= {1, 2, 7, 8}
    out = C.run(spark, f"{tmp_path}/rows")
    assert {x.doc_id for x in out.collect()} >= {1, 2, 7, 8} and out.where("doc_id = 7").count() > 1
    assert C.run(spark, f"{tmp_path}/none").collect() == []
    assert spark.conf.get(C.BATCHES) == before

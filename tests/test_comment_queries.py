"""The queries of the fitted comment classifier on tables of their own (fit, store, load)."""

import pytest

import __spark_entry__ as E

WORDS = {"Relatable": "sun moon", "Neutral": "rain storm", "Negative": "mud ash", "Positive": "gold silk"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, {comment_id: label it was made for}): turns and marked documents told apart by
    their words, unmarked documents, and a turn and a document without a text."""
    d = str(tmp_path_factory.mktemp("comments"))
    turns, docs, marks, made = [], [], [], {}
    for i in range(40):
        label = "Relatable" if i % 2 else "Neutral"
        turns.append((i // 4, i % 4, "user" if i % 2 else "assistant", f"{WORDS[label]} {i}"))
        made[f"c{i // 4}-{i % 4}"] = label
    for i in range(40):
        label = ("Negative", "Positive")[i % 2]
        docs.append((i, f"{WORDS[label]} {i}", "en" if i % 4 < 2 else None, "web", 12))
        made[f"d{i}"] = label
        if i < 30:                                           # the others are not learnt from
            marks.append((i, i % 2, 1 - i % 2))
    turns.append((99, 0, "user", None))
    docs.append((99, None, "en", "web", 0))
    for name, rows, schema in (("conversations", turns, "conv_id long, turn long, role string, text string"),
                               ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
                               ("labels", marks, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d, made


def test_tag_comments_query(spark, tables):
    """One row per turn and document, a label of the corpus for each (those without a text,
    too), the one of its words where it has any."""
    d, made = tables
    rows = E.queries()["tag_comments"](spark, d).collect()
    assert sorted(r.comment_id for r in rows) == sorted([*made, "c99-0", "d99"])
    assert {r.comment_id: r.label for r in rows if r.comment_id in made} == made
    assert {r.label for r in rows} == set(WORDS) and all(0 < r.confidence <= 1 for r in rows)


def test_category_sentiment_query(spark, tables):
    """The averages and shares per category of the rows of tag_comments; rows without a
    category are in none."""
    d, made = tables
    tagged = E.queries()["tag_comments"](spark, d).collect()
    got = {r.content_category: r for r in E.queries()["category_sentiment"](spark, d).collect()}
    assert set(got) == {"user", "assistant", "en"}
    for c, r in got.items():
        mine = [t for t in tagged if t.content_category == c]
        share = lambda label: 100 * sum(t.label == label for t in mine) / len(mine)
        assert r.n_comments == sum(t.comment_id in made for t in mine)
        assert r.pct_relatable == pytest.approx(share("Relatable"), abs=1e-5)
        assert r.pct_negative == pytest.approx(share("Negative"), abs=1e-5)
        assert r.avg_confidence == pytest.approx(sum(t.confidence for t in mine) / len(mine), abs=1e-5)


def test_top_comments_query(spark, tables):
    """The first 10 rows of tag_comments that are labelled Relatable, by score and id, with their texts."""
    d, made = tables
    tagged = [t for t in E.queries()["tag_comments"](spark, d).collect() if t.label == "Relatable"]
    want = sorted(tagged, key=lambda t: (-t.relatability_score, t.comment_id))[:10]
    got = E.queries()["top_comments"](spark, d).collect()
    assert len(got) == 10
    assert [(r.comment_id, r.content_category, r.confidence) for r in got] == [(t.comment_id, t.content_category, t.confidence) for t in want]
    assert all(r.comment_text.startswith("sun moon ") for r in got if r.comment_id in made)

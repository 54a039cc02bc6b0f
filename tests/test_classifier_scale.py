"""The comment classifier's features: made once for a row, the same terms as J12."""

from pyspark.sql import functions as F

from postlens.functions import text as TX
from postlens.operators import learn as K
from postlens.operators import textops as TO

TEXTS = [None, "", "one", "I a b", "aa bb", "aa bb cc", "aa aa aa aa", "Été où naïve café x9 b_c dd-ee\nff", "zz " * 301, "q" * 30_000, "ab" * 9_000 + " cd"]


def test_terms_are_the_unigrams_and_bigrams(spark):
    """The classifier's terms are those of J12 in any order, with repeats; no text, a token, an odd and an even number."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    want = df.select("id", TX.word_bigrams(F.coalesce("text", F.lit(""))).alias("t"))
    got = K.with_terms(df).select("id", F.col("__terms").alias("t"))
    rows = [{r["id"]: sorted(r["t"]) for r in x.collect()} for x in (want, got)]
    assert rows[0] == rows[1] and len(rows[0]) == len(TEXTS) and rows[0][5] == ["aa", "aa bb", "bb", "bb cc", "cc"]
    assert len(rows[0][8]) == 601


def test_filter_on_the_label_leaves_the_classification_single(spark):
    """A filter on the predicted label is applied to classified rows; it does not copy the classification below."""
    rows = [(f"{'sun moon' if i % 2 else 'rain storm'} number {i % 7}", "Relatable" if i % 2 else "Negative") for i in range(40)]
    model = K.fit_comment_classifier(spark.createDataFrame(rows, "text string, label string"), max_iter=20)
    comments = spark.createDataFrame([(f"c{i}", "x", t) for i, (t, _) in enumerate(rows)], "comment_id string, content_category string, comment_text string")
    tagged = K.classify_comments(model, TO.tag_comments(comments))
    top = TO.top_comments(tagged, k=50)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    single = tagged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == single.count("from_json")
    assert {r.comment_id for r in top.collect()} == {r.comment_id for r in tagged.collect() if r.label == "Relatable"} == {f"c{i}" for i in range(1, 40, 2)}

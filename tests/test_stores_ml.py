"""Stores, corpus readers and models (rows-only operators)."""

import os
import uuid

from pyspark.sql import functions as F

from postlens.operators import learn as K
from postlens.operators import enrich as N
from postlens.operators import scoring as M
from postlens.operators import trend as T
from postlens.plans.q_core import posts
from postlens.session import checkpoint_dir
from postlens.sources import store as S
from postlens.sources.corpus import (keyword_trends, labelled_corpus, polarity_rows, scan_corpus,
                                     write_corpus_from_conversations)
from tests.conftest import SF_SMALL


def _path(spark, tag):
    return os.path.join(checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex}")


def test_pool_append_twice_adds_nothing(spark):
    p = posts(spark, SF_SMALL).select(F.col("post_id").alias("link"), "likes")
    path = _path(spark, "pool")
    first = S.pool_append(p, path).first()
    again = S.pool_append(p, path).first()
    assert first.added == first.total == p.count()
    assert again.added == 0 and again.total == first.total


def test_keyword_trends_and_corpus(spark):
    trends = T.trend_velocity(posts(spark, SF_SMALL))
    path = write_corpus_from_conversations(spark, SF_SMALL, _path(spark, "corpus"), trends=trends)
    kw = keyword_trends(spark, path)
    assert kw.count() == trends.count()
    assert set(r.direction for r in kw.collect()) <= {"rising", "declining"}
    corpus = labelled_corpus(scan_corpus(spark, path), polarity_rows(spark, SF_SMALL))
    assert {r.label for r in corpus.select("label").distinct().collect()} == {
        "Relatable", "Neutral", "Positive", "Negative"}


def test_missing_corpus_is_empty(spark):
    assert scan_corpus(spark, "/nonexistent/corpus").count() == 0


def test_training_log_roundtrip_and_deltas(spark):
    path = _path(spark, "log")
    rows = spark.createDataFrame([(0.02, 0.5, 10, 3, 0, 100, "2026-01-01T00:00:00"),
                                  (0.01, 0.6, 12, 3, 5, 100, "2026-01-02T00:00:00")],
                                 "mae double, r2 double, n_train long, n_test long, n_augmented long, "
                                 "n_trees long, timestamp string")
    S.training_log_append(rows, path)
    d = N.run_deltas(S.training_log_read(spark, path)).orderBy("run").collect()
    assert [r.run for r in d] == [1, 2] and d[1].mae_improved and d[1].r2_improved
    assert S.training_log_read(spark, "/nonexistent/log").count() == 0


def test_engagement_model_beats_mean_and_retrain_trees(spark):
    p = posts(spark, SF_SMALL)
    data = N.model_columns(p.withColumnRenamed("post_id", "__pid"))
    model, metrics, (num, cat) = K.train_engagement_model(data, id_col="__pid", num_trees=20, max_depth=6)
    m = metrics.first()
    assert m.r2 > 0 and m.n_train > 0 and m.n_test > 0
    pool = p.where(F.col("media_type") == "reel").select("likes", "shares", "engagement_rate")
    _, m2, _ = K.retrain(p, pool, max_depth=4)
    r = m2.first()
    assert r.n_trees == min(200, 100 + r.n_augmented // 10) and r.n_augmented == pool.count()


def test_classifier_learns_held_out_rows(spark):
    """Two classes told apart by their words: held-out rows are nearly all right, a null
    text is classified, too."""
    from postlens.sources.comments import comments_from_tables
    rows = [(f"{'sun moon' if i % 2 else 'rain storm'} number {i % 7} {i}", "Positive" if i % 2 else "Negative") for i in range(80)]
    df = spark.createDataFrame(rows + [(None, "Negative")], "text string, label string")
    split = K.with_folds(df, label="label", id_col="text")
    model = K.fit_comment_classifier(split.where("fold <> 0").drop("fold"), max_iter=100)
    pred = K.classify_comments(model, split.where("fold = 0").withColumnRenamed("label", "truth"), text="text")
    assert pred.count() > 20
    assert pred.agg(F.avg((F.col("label") == F.col("truth")).cast("double"))).first()[0] > 0.9
    tagged = K.classify_comments(model, comments_from_tables(spark, SF_SMALL, "conversations"))
    assert tagged.where(F.col("confidence").between(0, 1)).count() == tagged.count()


def test_nan_to_null_and_sink_and_model_store(spark):
    from postlens.sources.posts import nan_to_null
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "id int, x double")
    assert [r.x for r in nan_to_null(df).orderBy("id").collect()] == [None, 0.5]
    path = _path(spark, "sink")
    S.predictions_sink(df, path)
    assert spark.read.option("header", True).csv(path).count() == 2
    p = posts(spark, SF_SMALL)
    data = N.model_columns(p.withColumnRenamed("post_id", "__pid"))
    model, metrics, (num, cat) = K.train_engagement_model(data, id_col="__pid", num_trees=5, max_depth=3)
    store = _path(spark, "model")
    S.model_store_save(model, metrics, store)
    loaded, m2 = S.model_store_load(spark, store)
    a = K.batch_predict(model, data, cat).select("predicted_engagement").collect()
    b = K.batch_predict(loaded, data, cat).select("predicted_engagement").collect()
    assert a == b and m2.count() == 1
    assert S.model_store_load(spark, "/nonexistent/model") is None


def test_score_stream_equals_batch(spark):
    from postlens.streaming import streams as ST
    p = posts(spark, SF_SMALL)
    data = N.model_columns(p.withColumnRenamed("post_id", "__pid"))
    model, _, (num, cat) = K.train_engagement_model(data, id_col="__pid", num_trees=5, max_depth=3)
    src = _path(spark, "src")
    data.write.parquet(src)
    stream = spark.readStream.schema(data.schema).parquet(src)
    out, chk = _path(spark, "out"), _path(spark, "chk")
    ST.run_to_files(ST.score_stream(stream, model, cat_features=cat).select("__pid", "predicted_engagement", "viral_coefficient", "engagement_tier"), out, chk)
    got = {r["__pid"]: tuple(r) for r in spark.read.parquet(out).collect()}
    want = {r["__pid"]: tuple(r) for r in M.scored(data, model, cat_features=cat).select(
        "__pid", "predicted_engagement", "viral_coefficient", "engagement_tier").collect()}
    assert got == want
    best = max(want.values(), key=lambda t: t[1])
    assert got[best[0]][1] == round(max(model.transform(data.where(F.col("__pid") == best[0])).first()["prediction"], 0), 6)


def test_same_seed_same_metrics(spark):
    p = posts(spark, SF_SMALL)
    data = N.model_columns(p.withColumnRenamed("post_id", "__pid"))
    a = K.train_engagement_model(data, id_col="__pid", num_trees=10, max_depth=5)[1].first()
    b = K.train_engagement_model(data.repartition(7), id_col="__pid", num_trees=10, max_depth=5)[1].first()
    assert (a.mae, a.r2, a.n_train, a.n_test) == (b.mae, b.r2, b.n_train, b.n_test)


def test_load_or_fit_reuses_stored_model(spark):
    p = posts(spark, SF_SMALL)
    data = N.model_columns(p.withColumnRenamed("post_id", "__pid"))
    calls = []

    def fit():
        calls.append(1)
        model, metrics, _ = K.train_engagement_model(data, id_col="__pid", num_trees=3, max_depth=3)
        return model, metrics

    root = _path(spark, "models")
    key = "t-" + S.input_fingerprint(data)
    m1, _ = S.load_or_fit(spark, key, fit, root=root)
    m2, _ = S.load_or_fit(spark, key, fit, root=root)
    assert calls == [1]
    assert (K.batch_predict(m1, data).select("predicted_engagement").collect()
            == K.batch_predict(m2, data).select("predicted_engagement").collect())


def test_open_windows_equal_the_batch_after_every_file(spark, tmp_path):
    import datetime as dt

    from postlens.streaming import streams as ST
    schema = "ts timestamp, kind string, value double"
    day = lambda n, h=0: dt.datetime(2024, 1, 1, h) + dt.timedelta(days=n)
    files = [[(day(30), "a", 1.0), (day(31), "b", None), (None, "a", 9.0)],
             [(day(2), "a", 2.5), (day(30, 5), "a", 3.0)],                  # four weeks late
             [(day(60), "a", 4.0)], [(day(0), None, 1.0), (day(31), "b", 2.0)], [(day(2, 3), "a", 0.1)] * 3]
    seen = None
    for k, rows in enumerate(files):
        df = spark.createDataFrame(rows, schema).coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/in")
        seen = df if seen is None else seen.union(df)
        for name, windows in (("w", ST.WEEKLY), ("h", ST.HOURLY)):
            with ST.utc_session(spark):
                ST.open_windows_stream(ST.read_stream(spark, f"{tmp_path}/in", df.schema), out=f"{tmp_path}/{name}/log",
                                       checkpoint=f"{tmp_path}/{name}/chk", ts="ts", key="kind", metric="value",
                                       windows=windows).awaitTermination()
                w = F.window("ts", *windows)
                want = (seen.where("ts IS NOT NULL").groupBy(w.alias("w"), "kind")
                        .agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
                        .select(F.col("w.start").cast("timestamp_ntz"), "kind", F.round("m", 9), "n"))
                got = (ST.read_windows(spark, f"{tmp_path}/{name}/log", "kind", upto=k)
                       .select("window_start", "kind", F.round("avg_metric", 9), "n"))
                assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_a_replayed_batch_of_windows_counts_once(spark, tmp_path):
    import shutil

    from postlens.streaming import streams as ST
    spark.sql("SELECT TIMESTAMP '2024-01-01 10:00:00' AS ts, 'a' AS kind, 2.0D AS value").write.parquet(f"{tmp_path}/in")
    for _ in range(2):                                     # the second run has lost the commit of the first
        with ST.utc_session(spark):
            src = ST.read_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
            ST.open_windows_stream(src, out=f"{tmp_path}/log", checkpoint=f"{tmp_path}/chk", ts="ts", key="kind",
                                   metric="value").awaitTermination()
        got = ST.read_windows(spark, f"{tmp_path}/log", "kind").collect()
        assert [(r.kind, r.avg_metric, r.n) for r in got] == [("a", 2.0, 1)]
        shutil.rmtree(f"{tmp_path}/chk/commits")


def test_a_pretty_printed_corpus_is_never_taken_for_an_empty_one(spark, tmp_path):
    import json

    import pytest
    corpus = {"struggle_comments": {"x": ["a", "b"]}, "neutral_comments": ["c"],
              "trend_keywords": {"rising": [{"keyword": "k", "velocity": 3, "category": "x"}], "declining": []}}
    pretty, lines = f"{tmp_path}/pretty.json", f"{tmp_path}/lines.json"
    with open(pretty, "w") as f:
        json.dump(corpus, f, indent=2)
    with open(lines, "w") as f:
        f.write(json.dumps(corpus) + "\n" + "{ broken\n" + json.dumps(corpus) + "\n")
    for read, rows in ((scan_corpus, 3), (keyword_trends, 1)):
        for path in (pretty, lines):
            with pytest.raises(Exception, match="MALFORMED_RECORD"):
                read(spark, path).collect()
        assert read(spark, pretty, multi_line=True).count() == rows
        assert read(spark, lines, skip_bad_lines=True).count() == 2 * rows


def test_spread_by_size_whatever_the_bridge_returns(spark, monkeypatch):
    """The size of a plan is a Java object in some versions of the bridge and an int in others;
    a small frame is dealt over the cores, a large one left as it is, with all rows."""
    from postlens.operators import terms as TM
    df = spark.range(40).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    dealt = TM.spread(df)
    assert dealt.rdd.getNumPartitions() == cores and sorted(r.id for r in dealt.collect()) == list(range(40))
    monkeypatch.setattr(TM, "SPREAD_BYTES", 1)
    assert TM.spread(df).rdd.getNumPartitions() == 1


def test_forest_in_groups_of_trees(spark, monkeypatch):
    """A large frame is fitted in groups of trees: all trees are there, the prediction is their
    mean, the stored pipeline predicts the same, and the input's partitions do not matter."""
    from pyspark.ml.regression import RandomForestRegressionModel
    monkeypatch.setattr(K, "ONE_FOREST_ROWS", 100)
    monkeypatch.setattr(K, "ROWS_PER_TASK", 200)
    monkeypatch.setattr(K, "TREES_PER_GROUP", 2)
    df = spark.range(400).select(F.col("id").cast("string").alias("post_id"), (F.col("id") % 7).alias("likes"),
                                 F.when(F.col("id") % 2 == 0, "reel").otherwise("image").alias("media_type"),
                                 ((F.col("id") % 7) / 100 + (F.col("id") % 2) / 10).alias("engagement_rate"))
    kw = dict(num_trees=5, max_depth=4)
    model, metrics, (_, cat) = K.train_engagement_model(df.repartition(3), **kw)
    forests = [s for s in model.stages if isinstance(s, RandomForestRegressionModel)]
    assert [f.getNumTrees for f in forests] == [2, 2, 1]
    m = metrics.first()
    assert m["n_trees"] == 5 and m["r2"] > 0.9 and m["n_train"] + m["n_test"] == 400
    r = model.transform(df).first()
    assert abs(r["prediction"] - (2 * r["__p0"] + 2 * r["__p1"] + r["__p2"]) / 5) < 1e-12
    path = _path(spark, "groups")
    S.model_store_save(model, metrics, path)
    again, _ = S.model_store_load(spark, path)
    other, _, _ = K.train_engagement_model(df.repartition(8), **kw)
    rows = [sorted(map(tuple, K.batch_predict(x, df, cat).select("post_id", "predicted_engagement").collect()))
            for x in (model, again, other)]
    assert rows[0] == rows[1] == rows[2]

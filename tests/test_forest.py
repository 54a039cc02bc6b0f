"""The forest of large frames (K2) against brute force on rows of its own."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from postlens.operators import forest as FR
from postlens.operators import learn as K


def _rows(n=600, seed=3):
    g = np.random.default_rng(seed)
    a, b, c = g.integers(0, 5, n).astype(float), g.normal(size=n), g.integers(0, 4, n).astype(float)
    return pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": c, "y": 0.1 * a + (b > 0.3) + 2.0 * (c == 2) + 0.01 * g.normal(size=n)})


def test_points_between_values(spark):
    """All points of a column of few values; after the quantiles of another one; none of a constant."""
    rows = spark.range(1000).select((F.col("id") % 3).alias("few"), F.col("id").cast("double").alias("many"), F.lit(7).alias("one"),
                                    F.when(F.col("id") < 990, 0).otherwise(F.col("id")).alias("hot"))
    few, many, one, hot = FR.split_points(rows, ["few", "many", "one", "hot"], 8)
    assert few.tolist() == [0.5, 1.5] and one.tolist() == []
    assert many.tolist() == [124.5, 249.5, 374.5, 499.5, 624.5, 749.5, 874.5]
    assert hot.tolist() == [495.0]


def _tree_by_hand(x, y, w, points, sizes, depth):
    """Predictions of the greedy tree, node by node."""
    out = np.empty(len(y))

    def grow(at, left):
        m = np.average(y[at], weights=w[at])
        out[at] = m
        best = (1e-12, None)
        for f in range(x.shape[0]):
            cuts = range(len(points[f])) if f < len(points) else range(sizes[f - len(points)])
            for c in cuts:
                right = x[f, at] > c if f < len(points) else x[f, at] == c
                l, r = at[~right], at[right]
                if len(l) and len(r):
                    spread = lambda i: (w[i] * (y[i] - np.average(y[i], weights=w[i])) ** 2).sum()
                    gain = spread(at) - spread(l) - spread(r)
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (l, r))
        if left and best[1]:
            for side in best[1]:
                grow(side, left - 1)

    grow(np.flatnonzero(w), depth)
    return out


def test_levels_agree_with_a_tree_by_hand_in_one_task_or_more(spark, monkeypatch):
    """Trees grown level by level from blocks are those of a greedy search over the weighted rows, and the sums
    of several tasks, added by groups of nodes, give the same splits as one task."""
    monkeypatch.setattr(FR, "NODES_PER_GROUP", 2)
    pdf, seed, depth = _rows(), 5, 4
    rows = spark.createDataFrame(pdf)
    points = FR.split_points(rows, ["a", "b"], 8)
    blocks = FR.blocks_of(rows.repartition(2, "id").sortWithinPartitions("id"), ["a", "b"], points, ["c"], [3], "y", 0.5, "|u1")
    kept = blocks.collect()
    assert sum(r.n for r in kept) == 600 and len(kept) == 2
    args = dict(bins=[len(p) + 1 for p in points] + [4], numeric=2, sizes=[3], kind="|u1", seed=seed, per_task=1)
    grown = {}
    for parts in (1, 2):
        trees = [FR.new_tree(), FR.new_tree()]
        for level in range(depth + 1):
            found = FR.level_job(blocks, parts, trees, [0, 1], level, split=level < depth, **args).toPandas()
            trees = [FR.grown(t, found[found["tree"] == i], level == depth) for i, t in enumerate(trees)]
        grown[parts] = trees
    for t in (0, 1):
        assert all(np.array_equal(grown[1][t][k], grown[2][t][k]) for k in ("feature", "cut", "left"))
        x = np.hstack([np.frombuffer(r.x, np.uint8).reshape(3, -1) for r in kept])
        y = np.concatenate([np.frombuffer(r.y) for r in kept])
        w = np.concatenate([FR.WEIGHT[np.random.default_rng([seed, t, r.part, r.at]).integers(0, 65536, r.n, np.uint16)] for r in kept])
        tree, used = grown[1][t], np.flatnonzero(w)
        node = FR.walk(tree, x, used, 2, 9, depth)
        weight, total, _ = tree["stats"].T
        by_hand = _tree_by_hand(x, y, w, points, [3], depth)
        assert np.allclose((total / weight)[node], by_hand[used]) and weight[0] == w.sum()
    assert abs(FR.WEIGHT.mean() - 1) < 1e-3 and abs(FR.WEIGHT.var() - 1) < 1e-2


def test_large_frame_is_fitted_level_by_level(spark, monkeypatch):
    """A frame beyond ``ONE_FOREST_ROWS`` takes the levels, whatever nulls, constants and unseen categories it
    has, predicts as well as Spark ML's forest on held-out rows, and each tree has its nodes' statistics."""
    n = 3000
    df = spark.range(n).select(
        F.col("id").cast("string").alias("post_id"), F.when(F.col("id") % 11 > 0, F.col("id") % 13).alias("likes"),
        F.lit(3).alias("shares"), F.when(F.col("id") % 17 > 0, F.element_at(F.array(*map(F.lit, "abcd")), (F.col("id") % 4 + 1).cast("int"))).alias("kind"),
        ((F.col("id") % 13) / 50 + F.when(F.col("id") % 4 == 2, 0.3).otherwise(0.0) + F.pmod(F.xxhash64("id"), F.lit(100)) / 5000).alias("engagement_rate"))
    fits = []
    real = FR.fit_forest
    monkeypatch.setattr(FR, "fit_forest", lambda *a, **k: fits.append(k) or real(*a, **k))
    _, plain, _ = K.train_engagement_model(df, num_trees=6, max_depth=6)
    assert not fits
    monkeypatch.setattr(K, "ONE_FOREST_ROWS", 100)
    monkeypatch.setattr(K, "ROWS_PER_TASK", 1300)
    model, metrics, (_, cat) = K.train_engagement_model(df, num_trees=6, max_depth=6)
    assert len(fits) == 1 and fits[0]["parts"] == 3
    a, b = plain.first(), metrics.first()
    assert (a["n_train"], a["n_test"]) == (b["n_train"], b["n_test"]) and abs(a["r2"] - b["r2"]) < 0.02 and b["r2"] > 0.9
    new = spark.createDataFrame([("x", None, 3, "zz")], "post_id string, likes bigint, shares int, kind string")
    assert K.batch_predict(model, new, cat).first()["predicted_engagement"] > 0
    forest = model.stages[-2]
    assert forest.getNumTrees == 6 and forest.trees[0].depth <= 6 and abs(sum(forest.featureImportances.toArray()) - 1) < 1e-9

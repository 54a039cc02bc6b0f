"""Random forests over large frames (K2): all trees level by level, from sums over blocks of rows.

Every value of a feature is its bin: numeric ones between at most ``maxBins - 1`` exact
quantiles, categories their index (a split on a one-hot column tells one category from the
others, so one sum by category answers all of them).  The binned rows are written in blocks
of numpy bytes, dealt by a hash of the id.  A level is one Spark job: every task passes over
its blocks for some of the trees, walks the rows down to the level's nodes and adds up weight
and label by (node, feature, bin).  The sums of tasks that share a tree are added in a
shuffle by (tree, some nodes), which picks each node's best split by variance.  The driver
gets a row for every node.

Bins, bootstrap (Poisson weights drawn by tree and block), split and stopping rules are those of
``RandomForestRegressor`` with all features at each split; the result is its model class.
Blocks follow from the rows alone, so the model does not depend on the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.operators import orderstats as O
from postlens.session import stage_path

BLOCK_ROWS = 1 << 18
NODES_PER_GROUP = 128      # nodes of a tree whose sums are added and split in one group
TASKS_PER_CORE = 3
UNION = "spark.sql.unionOutputPartitioning"
BLOCKS = "part int, at int, n int, x binary, y binary"
SUMS = "tree int, chunk int, part int, sums binary"
SPLITS = "tree int, node int, w double, s double, ss double, feature int, cut int, gain double"
# cumulated Poisson(1) chances in 65,536ths
_POISSON = np.round(65536 * np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])).astype(np.int64)
WEIGHT = np.searchsorted(_POISSON, np.arange(65536), "right").astype(np.float64)


def split_points(df: DataFrame, cols: Sequence[str], bins: int) -> list[np.ndarray]:
    """For each column the points between its values: all of them if it has at most ``bins`` values, else
    those after the values that hold its ``bins``-quantiles (exact, by the ranking of D17)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])).alias("s")
    counts = (df.select(pairs).select("s.k", "s.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
              .groupBy("k", "v").agg(F.count(F.lit(1)).alias("cnt")))
    ranks = O.materialized(O.ranks_from_counts(counts, keys=["k"]))
    few = [r["k"] for r in ranks.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= bins).collect()]
    upto = F.col("less") + F.col("cnt")
    strides = lambda rows: F.floor(rows * bins / F.col("n"))
    cuts = ranks.where((upto < F.col("n")) & (F.col("k").isin(few) | (strides(upto) > strides(F.col("less")))))
    above = ranks.select("k", "less", F.col("v").alias("high"))
    found = cuts.select("k", upto.alias("less"), F.col("v").alias("low"))                # < bins rows of a column
    points: list[list[float]] = [[] for _ in cols]
    for r in above.join(F.broadcast(found), ["k", "less"]).collect():
        points[r["k"]].append(r["low"] + (r["high"] - r["low"]) / 2)
    return [np.sort(np.array(p)) for p in points]


def blocks_of(rows: DataFrame, numeric: Sequence[str], points: list[np.ndarray], categories: Sequence[str],
              sizes: Sequence[int], label: str, centre: float, kind: str) -> DataFrame:
    """The binned rows in blocks of at most ``BLOCK_ROWS``, feature by feature; a category beyond those that
    have a one-hot column is the bin after them."""
    def binned(batches):
        part, at, held = TaskContext.get().partitionId(), 0, []

        def block(pdf):
            x = [np.searchsorted(p, pdf[c].to_numpy(np.float64), "left") for c, p in zip(numeric, points)]
            x += [np.minimum(pdf[c].to_numpy(np.float64), k) for c, k in zip(categories, sizes)]
            y = pdf[label].to_numpy(np.float64) - centre
            return pd.DataFrame({"part": [part], "at": [at], "n": [len(pdf)], "x": [np.array(x).astype(kind).tobytes()], "y": [y.tobytes()]})

        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= BLOCK_ROWS:
                pdf = pd.concat(held)
                yield block(pdf[:BLOCK_ROWS])
                at, held = at + 1, [pdf[BLOCK_ROWS:]]
        if sum(map(len, held)):
            yield block(pd.concat(held))

    return O.materialized(rows.select(*numeric, *categories, label).mapInPandas(binned, BLOCKS))


def new_tree() -> dict:
    """Nodes level by level: the split (feature -1: none so far), the place of the left child (the right
    one follows it), weight, sum and sum of squares of the label, gain; ``first``: where the deepest level begins."""
    return {"feature": np.array([-1], np.int32), "cut": np.array([0], np.int32), "left": np.array([0], np.int32),
            "stats": np.zeros((1, 3)), "gain": np.array([-1.0]), "first": 0}


def walk(tree: dict, x: np.ndarray, at: np.ndarray, numeric: int, width: int, depth: int) -> np.ndarray:
    """The node that each of the rows ``at`` of a block reaches in ``depth`` steps."""
    feature, cut, left, n = tree["feature"].astype(np.int64), tree["cut"][:, None], tree["left"].astype(np.int64), x.shape[1]
    bins = np.arange(width)
    right = (np.where((feature < numeric)[:, None], bins > cut, bins == cut) & (feature >= 0)[:, None]).ravel().astype(np.int64)
    start, flat, out = np.maximum(feature, 0) * n, x.ravel(), np.empty(len(at), np.int64)
    for a in range(0, len(at), 1 << 15):                    # a slice's steps stay in the cache
        row = at[a:a + (1 << 15)]
        node = np.zeros(len(row), np.int64)
        for _ in range(depth):
            node = left[node] + right[node * width + flat[start[node] + row]]
        out[a:a + (1 << 15)] = node
    return out


def add_block(sums: np.ndarray, offsets: np.ndarray, tree: dict, x: np.ndarray, y: np.ndarray, weight: np.ndarray, numeric: int,
              width: int, depth: int, split: bool) -> None:
    """Adds a block to a tree's sums (2, all bins, nodes of the level) and, as the last bins, to their totals."""
    nodes = sums.shape[2]
    at = np.flatnonzero(weight)
    node = walk(tree, x, at, numeric, width, depth) - tree["first"]
    if node.size and node.min() < 0:                         # rows that ended in a leaf before
        at, node = at[node >= 0], node[node >= 0]
    w = weight[at]
    wy = w * y[at]
    for k, v in enumerate((w, wy, wy * y[at])):
        sums[0, offsets[-1] + k] += np.bincount(node, v, nodes)
    for f in range(len(x) if split else 0):
        n = offsets[f + 1] - offsets[f]
        place = x[f][at].astype(np.int64)
        place *= nodes
        place += node
        for k, v in enumerate((w, wy)):
            sums[k, offsets[f]:offsets[f + 1]] += np.bincount(place, v, n * nodes).reshape(n, nodes)


def best_splits(sums: np.ndarray, offsets: np.ndarray, numeric: int, sizes: Sequence[int], split: bool) -> tuple[np.ndarray, ...]:
    """For each node: weight, sum, sum of squares, and feature, bin and gain in variance of the best split (gain 0: none)."""
    w, s, ss = sums[0, offsets[-1]:offsets[-1] + 3]
    best, feature, cut = np.full(len(w), -np.inf), np.zeros(len(w), int), np.zeros(len(w), int)
    for f in range(len(offsets) - 1 if split else 0):
        fw, fs = sums[:, offsets[f]:offsets[f + 1]]
        if f < numeric:
            fw, fs = np.cumsum(fw, 0)[:-1], np.cumsum(fs, 0)[:-1]
        else:
            fw, fs = fw[:sizes[f - numeric]], fs[:sizes[f - numeric]]
        if not len(fw):
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where((fw > 0.5) & (w - fw > 0.5), fs * fs / fw + (s - fs) ** 2 / (w - fw), -np.inf)
        at = score.argmax(0)
        score = score[at, np.arange(len(w))]
        better = score > best
        best, feature, cut = np.where(better, score, best), np.where(better, f, feature), np.where(better, at, cut)
    with np.errstate(invalid="ignore"):
        gain = np.maximum((best - s * s / w) / w, 0.0)
        gain[ss / w - (s / w) ** 2 <= 1e-15 * (ss / w)] = 0.0      # one label but for rounding
    return w, s, ss, feature, cut, gain


def level_job(blocks: DataFrame, parts: int, trees: list[dict], growing: list[int], depth: int, *, bins: Sequence[int],
              numeric: int, sizes: Sequence[int], kind: str, seed: int, per_task: int, split: bool) -> DataFrame:
    """Rows of ``SPLITS`` for the nodes of the deepest level of the growing trees."""
    spark = blocks.sparkSession
    # (no features at the last level: only the totals)
    offsets, width = np.concatenate([[0], np.cumsum(bins)]) if split else np.array([0]), max(bins, default=1)
    known = spark.sparkContext.broadcast([{k: t[k] for k in ("feature", "cut", "left", "first")} for t in trees])

    def splits(tree, sums, first):
        w, s, ss, feature, cut, gain = best_splits(sums, offsets, numeric, sizes, split)
        return pd.DataFrame({"tree": tree, "node": first + np.arange(len(w)), "w": w, "s": s, "ss": ss,
                             "feature": feature, "cut": cut, "gain": gain})

    def summed(group: list[int], whole: bool):
        def run(batches):
            trees, sums, part = known.value, {}, -1
            for pdf in batches:
                for r in pdf.itertuples():
                    part = max(part, r.part)
                    x, y = np.frombuffer(r.x, kind).reshape(-1, r.n), np.frombuffer(r.y)
                    for t in group:
                        nodes = len(trees[t]["left"]) - trees[t]["first"]
                        if t not in sums:
                            sums[t] = np.zeros((2, offsets[-1] + 3, nodes))
                        draw = np.random.default_rng([seed, t, r.part, r.at]).integers(0, 65536, r.n, np.uint16)
                        add_block(sums[t], offsets, trees[t], x, y, WEIGHT[draw], numeric, width, depth, split)
            for t, a in sums.items():
                if whole:
                    yield splits(t, a, trees[t]["first"])
                else:
                    for c in range(0, a.shape[2], NODES_PER_GROUP):
                        yield pd.DataFrame({"tree": [t], "chunk": [c], "part": [part], "sums": [a[:, :, c:c + NODES_PER_GROUP].tobytes()]})
        return run

    def added(pdf):
        t, c = int(pdf["tree"].iloc[0]), int(pdf["chunk"].iloc[0])
        sums = pdf.sort_values("part")["sums"]              # always added in the same order
        total = np.sum([np.frombuffer(b) for b in sums], axis=0).reshape(2, offsets[-1] + 3, -1)
        return splits(t, total, known.value[t]["first"] + c)

    groups = [growing[a:a + per_task] for a in range(0, len(growing), per_task)]
    whole = parts == 1                                       # a task has all rows of its trees
    out = reduce(DataFrame.unionAll, [blocks.coalesce(parts).mapInPandas(summed(g, whole), SPLITS if whole else SUMS) for g in groups])
    return out if whole else out.groupBy("tree", "chunk").applyInPandas(added, SPLITS)


def grown(tree: dict, found: pd.DataFrame, last: bool) -> dict:
    """The tree with the statistics and splits of its deepest level, and the nodes of the next one."""
    f = found.sort_values("node")
    first, nodes = tree["first"], len(tree["left"])
    split = (f["gain"].to_numpy() > 0) & (not last)
    kids = nodes + 2 * (np.cumsum(split) - 1)
    own = np.arange(first, nodes)
    put = lambda old, new, more: np.concatenate([old[:first], new, np.full((2 * split.sum(), *old.shape[1:]), more)]).astype(old.dtype)
    out = {"feature": put(tree["feature"], np.where(split, f["feature"], -1), -1), "cut": put(tree["cut"], f["cut"].to_numpy(), 0),
           "left": put(tree["left"], np.where(split, kids, own), 0), "stats": put(tree["stats"], f[["w", "s", "ss"]].to_numpy(), 0.0),
           "gain": put(tree["gain"], np.where(split, f["gain"], -1.0), -1.0), "first": nodes}
    out["left"][nodes:] = np.arange(nodes, len(out["left"]))
    return out


def node_rows(trees: list[dict], centre: float, numeric: int, thresholds: list[np.ndarray], first_column: np.ndarray) -> pd.DataFrame:
    """The trees as rows (tree, node, …) in terms of the feature vector."""
    parts = []
    for t, tree in enumerate(trees):
        w, s, ss = tree["stats"].T
        f, cut, inner = tree["feature"], tree["cut"], tree["feature"] >= 0
        column, value = np.full(len(f), -1), np.full(len(f), 0.5)
        for j in range(numeric):
            column[f == j], value[f == j] = j, thresholds[j][cut[f == j]]
        for j, at in enumerate(first_column, numeric):
            column[f == j] = at + cut[f == j]
        mean = s / w + centre
        parts.append(pd.DataFrame({
            "tree": t, "id": np.arange(len(f)), "prediction": mean, "impurity": np.maximum(ss / w - (s / w) ** 2, 0.0), "w": w,
            "s": s + w * centre, "ss": ss + 2 * centre * s + w * centre * centre, "gain": tree["gain"],
            "left": np.where(inner, tree["left"], -1), "right": np.where(inner, tree["left"] + 1, -1), "column": column, "value": value}))
    return pd.concat(parts)


def as_models(nodes: pd.DataFrame, forest: RandomForestRegressor, sizes: Sequence[int], few_rows: DataFrame, at_once: int = 4
              ) -> list[RandomForestRegressionModel]:
    """The trees as models of ``sizes[g]`` trees each (prediction column ``__p{g}``), through the class's own
    stored form: a model of a few rows gives the files, the nodes are put in their place."""
    spark, starts = few_rows.sparkSession, np.concatenate([[0], np.cumsum(sizes)])
    kind = ("tree int, id int, prediction double, impurity double, w double, s double, ss double, gain double, "
            "left int, right int, column int, value double")

    def model(g: int):
        path = stage_path(spark, "forest")
        forest.copy({forest.numTrees: int(sizes[g]), forest.predictionCol: f"__p{g}"}).fit(few_rows).save(path)
        stored = spark.read.parquet(f"{path}/data").schema
        own = nodes[(nodes["tree"] >= starts[g]) & (nodes["tree"] < starts[g + 1])]
        inner = F.col("left") >= 0
        split = F.struct(F.col("column"), F.when(inner, F.array("value")).otherwise(F.array().cast("array<double>")), F.lit(-1))
        data = F.struct("id", "prediction", "impurity", F.array("w", "s", "ss"), F.col("w").cast("bigint"), "gain", "left", "right", split)
        rows = spark.createDataFrame(_arrow(own, kind)).select(
            (F.col("tree") - int(starts[g])).cast("int").alias("treeID"), data.cast(stored["nodeData"].dataType).alias("nodeData"))
        rows.write.mode("overwrite").parquet(f"{path}/data")
        return RandomForestRegressionModel.load(path)

    with ThreadPool(min(at_once, len(sizes))) as pool:
        return pool.map(inheritable_thread_target(spark)(model), range(len(sizes)), chunksize=1)


def _arrow(pdf: pd.DataFrame, kind: str):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    return pa.Table.from_pandas(pdf, to_arrow_schema(T.StructType.fromDDL(kind)), preserve_index=False)


def fit_forest(rows: DataFrame, forest: RandomForestRegressor, *, numeric: Sequence[str], scale: Sequence[tuple[float, float]],
               categories: Sequence[str], sizes: Sequence[int], label: str, id_col: str, parts: int, groups: Sequence[int],
               few_rows: DataFrame, seed: int) -> list[RandomForestRegressionModel]:
    """Models of ``groups[g]`` trees each, fitted on ``rows``: numeric columns (no nulls) that are (mean, deviation) of
    ``scale`` from the feature vector, then the categories' indices, of which the first ``sizes[j]`` have a one-hot column.

    ``parts``: the tasks that the rows are dealt to; ``few_rows``: any rows with the feature vector."""
    spark = rows.sparkSession
    trees_per_task, max_depth, max_bins = max(groups), forest.getMaxDepth(), forest.getMaxBins()
    points = split_points(rows, numeric, max_bins) if numeric else []
    bins = [len(p) + 1 for p in points] + [k + 1 for k in sizes]
    kind = np.min_scalar_type(max(bins, default=1)).str
    centre = float(f"{rows.agg(F.avg(label)).first()[0]:.2g}")                 # any constant near the mean
    dealt = rows.repartition(parts, F.col(id_col)).sortWithinPartitions(id_col)
    blocks = blocks_of(dealt, numeric, points, categories, sizes, label, centre, kind)
    trees = [new_tree() for _ in range(sum(groups))]
    # else tasks of one partition each would become a single task, in versions that keep a union's partitioning
    joined = spark.conf.get(UNION, None)
    spark.conf.set(UNION, "false")
    try:
        for depth in range(max_depth + 1):
            growing = [t for t, tree in enumerate(trees) if tree["first"] < len(tree["left"])]
            if not growing:
                break
            tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
            per_task = max(1, min(trees_per_task, len(growing) * parts // tasks))
            found = level_job(blocks, parts, trees, growing, depth, bins=bins, numeric=len(numeric), sizes=sizes, kind=kind, seed=seed,
                              per_task=per_task, split=depth < max_depth).toArrow().to_pandas()  # a row for every node of the level
            for t, of in found.groupby("tree"):
                trees[t] = grown(trees[t], of, depth == max_depth)
    finally:
        spark.conf.unset(UNION) if joined is None else spark.conf.set(UNION, joined)
    thresholds = [(p - m) * (1 / d if d else 0.0) for p, (m, d) in zip(points, scale)]
    first_column = len(numeric) + np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return as_models(node_rows(trees, centre, len(numeric), thresholds, first_column.astype(int)), forest, groups, few_rows)

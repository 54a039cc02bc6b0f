"""Connected components of a graph given by its links, without gathering it anywhere.

Union-find: each task first contracts its own links, some hundred thousand at a time; then
large-star and small-star steps alternate over what is left: every node is linked to the
least node that it sees until each component is a star around its least node.  Least
neighbours come from an aggregate (combined before the shuffle) and are joined back, which
Spark may split, so a node with very many links is no hot spot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import stage

#: links that a task contracts at a time
CHUNK = 200_000


def _forest(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Union-find over some links: each node but the least of its component, with that."""
    up: dict[int, int] = {}

    def find(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x
    for a, b in zip(u.tolist(), v.tolist()):
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in list(up)]
    pairs = [p for p in pairs if p[0] != p[1]]
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n >= CHUNK:
            yield _forest(*(np.concatenate(x) for x in zip(*held)))
            held, n = [], 0
    if held:
        yield _forest(*(np.concatenate(x) for x in zip(*held)))


def _is_stars(e: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none: nothing is left to do."""
    ends = e.select(F.col("v").alias("u")).distinct().join(e.select("u"), "u", "left_semi")
    return e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and ends.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node, root) of every node with a link to another one but
    the roots; root is the least node of its component."""
    e = stage(links.where("a <> b").select("a", "b").mapInArrow(_contract, "u long, v long").distinct(), "links")
    while not _is_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = stage(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct("u", F.col("m").alias("v")))).alias("p")).select("p.u", "p.v")
        e = stage(pairs.where("u <> v").distinct(), "small")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))

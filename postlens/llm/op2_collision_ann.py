"""Approximate nearest neighbours by query-aware collision counting.

The index of a block of vectors is ``PROJECTIONS`` sorted arrays, one per random Gaussian
direction.  A query looks at the window of half width ``WIDTH`` / 2 * R around its own
projection in each of them; a vector within R of the query is in a window with probability
0.83.  Vectors that are in at least ``THRESHOLD`` of the windows are verified with their
true distance.  The radius R then grows by ``GROWTH`` (virtual rehashing: the windows only
get wider, so counts only add what is new) until the block has k verified vectors within R,
or R has reached the distance of the query's k-th neighbour in a sample of the index, which
the k-th of all can't exceed.

The sample (at most ``SAMPLE`` vectors, by a hash of the id) only sets that last radius; every
vector is indexed and searched.  Of equal vectors only the k + 1 least ids are indexed: no
other of them can be among the k nearest, since ties go to the smaller id.  Vectors are
dealt into blocks of about ``BLOCK`` and queries into blocks of about ``QUERIES`` by a hash
of the id; each pair of blocks is one task and gives k rows per query at most.

Vectors that are null, zero, of a length other than the most frequent one, or hold a null
or non-finite component take no part, neither do null ids.  Rows of equal id are one vector
(the least).  Fewer than k candidates: all of them are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.llm.common import stage, table
from postlens.llm.registry import register

PROJECTIONS = 80
WIDTH = 2.72
THRESHOLD = 0.68
GROWTH = 1.5
START = 0.25           #: first radius as a share of the last
SAMPLE = 2000
BLOCK = 4096
QUERIES = 1024


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part, one per id."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    v = stage(v.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    size = (v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "d").limit(1).collect())
    return v.where(F.size("v") == (size[0]["d"] if size else 0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


class Block:
    """The sorted arrays of a block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, directions: np.ndarray):
        self.ids, self.x = ids, x
        p = x @ directions
        self.order = np.ascontiguousarray(np.argsort(p, axis=0, kind="stable").T)
        self.value = np.ascontiguousarray(np.take_along_axis(p, self.order.T, axis=0).T)

    def search(self, own: int, q: np.ndarray, at: np.ndarray, last: float, k: int) -> list[tuple[int, float]]:
        """The k nearest found, as (id, distance); last: the largest radius."""
        need = int(np.ceil(THRESHOLD * len(at)))
        count = np.zeros(len(self.ids), np.int64)
        dist = np.full(len(self.ids), np.inf)
        seen = self.ids == own
        low = high = [int(np.searchsorted(v, a)) for v, a in zip(self.value, at)]
        slack = 1e-9 * (1 + np.abs(at))
        radius = last if np.isinf(last) else START * last
        while True:
            wide = WIDTH / 2 * radius + slack
            new_low = [int(np.searchsorted(v, a - w)) for v, a, w in zip(self.value, at, wide)]
            new_high = [int(np.searchsorted(v, a + w, side="right")) for v, a, w in zip(self.value, at, wide)]
            fresh = [o[i:j] for o, i, j in zip(self.order, new_low, low)] + [o[i:j] for o, i, j in zip(self.order, high, new_high)]
            count += np.bincount(np.concatenate(fresh), minlength=len(count))
            low, high = new_low, new_high
            hit = np.flatnonzero((count >= need) & ~seen)
            if len(hit):
                seen[hit] = True
                dist[hit] = np.sqrt(((self.x[hit] - q) ** 2).sum(axis=1))
            if radius >= last or np.count_nonzero(dist <= radius) >= k:
                break
            radius = min(radius * GROWTH, last)
        found = np.flatnonzero(np.isfinite(dist))
        best = found[np.lexsort((self.ids[found], dist[found]))[:k]]
        return [(int(self.ids[i]), float(dist[i])) for i in best]


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding",
            k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found; is_query is on vec_id."""
    every = usable(vectors, id_col, vector_col)
    turn = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    index = stage(every.withColumn("turn", turn).where(F.col("turn") <= k + 1).drop("turn"), "index")
    queries = stage(every.where(is_query), "queries")
    n, n_queries = index.count(), queries.count()
    share = min(1.0, 0.8 * SAMPLE / max(n, 1)) if n > SAMPLE else 1.0
    draw = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = index.where(draw).orderBy("vec_id").limit(SAMPLE).toArrow()
    s_ids = sample["vec_id"].to_numpy()
    s_x = _matrix(sample["v"]) if len(s_ids) else np.zeros((0, 1))
    directions = np.random.default_rng(11).standard_normal((s_x.shape[1], PROJECTIONS))

    def search(key, data: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if data.num_rows and asked.num_rows:
            order = np.argsort(data["vec_id"].to_numpy(), kind="stable")
            block = Block(data["vec_id"].to_numpy()[order], _matrix(data["v"])[order], directions)
            q_ids, q_x = asked["vec_id"].to_numpy(), _matrix(asked["v"])
            at = q_x @ directions
            for own, q, a in zip(q_ids, q_x, at):
                near = np.sqrt(((s_x - q) ** 2).sum(axis=1))[s_ids != own]
                last = float(np.partition(near, k - 1)[k - 1]) if len(near) >= k else np.inf
                out += [(int(own), i, d) for i, d in block.search(own, q, a, last, k)]
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})
    d_blocks, q_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERIES))
    deal = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    all_of = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    data = index.select(deal(d_blocks).alias("d"), all_of(q_blocks).alias("q"), "vec_id", "v")
    asked = queries.select(deal(q_blocks).alias("q"), all_of(d_blocks).alias("d"), "vec_id", "v")
    found = (data.groupBy("d", "q").cogroup(asked.groupBy("d", "q"))
             .applyInArrow(search, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


@register("op2_collision_ann")
def op2_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth vector."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)

"""Hard negatives: cover trees over norm-augmented vectors, searched within score windows.

Components x are taken as floor(256 x); a score is the integer inner product.  An anchor's
positives are its best rows of the same label; its negatives for a positive of score p are
the best rows of another label with a score s in the window 80 p <= 100 s <= 100 p.

1.  Index.  Every row goes into a block of about ``BLOCK`` rows.  A block's vectors get one
    more component, sqrt(M^2 - |x|^2), so that all have the norm M of its longest vector and
    the order by inner product is the order by distance.  A cover tree is built over these:
    a node's points lie within its covering radius of its centre (one of them), its children
    are centres chosen greedily at half that radius, down to leaves of at most ``LEAF``
    points.  Centres, radii, the labels under each node and the points in leaf order are
    one row, written once.
2.  A search goes through the blocks of a task and carries the k best per anchor and window.
    Level by level, a node's scores lie within |q| * radius of its centre's; a node goes if
    they can't reach a window, if it has no row of a wanted label, or if the k best so far
    are better.  The leaves left are visited best bound first and scored exactly.
3.  First the positives, then the negatives in their windows; the k best of the tasks are
    merged in two steps, the first one salted.

Anchors (a stated query set) are broadcast in blocks of at most ``ANCHOR_BYTES``, each a pass
over the index.  Where vectors have no structure (pairwise distances all alike) no radius
separates anything, and all leaves are verified; the result is the same.

Rows with a null id, label or vector, or a null or non-finite component, take no part.
A row of the anchor's own id is none of its positives or negatives; other repeated rows
count separately.  Vectors of different lengths never meet.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.llm.common import forget, stage, table
from postlens.llm.registry import register

POSITIVES = 5
NEGATIVES = 5
BLOCK = 8192
LEAF = 128
ANCHOR_BYTES = 4_000_000
SALTS = 16
_EXACT = 1 << 53
_NONE = np.iinfo(np.int64).min + 1   #: the score of a free place


def usable(vectors: DataFrame, *, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(vec_id, label, v array<double> of whole numbers) of the rows that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                       F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where("vec_id is not null and label is not null and v is not null").where(~bad)
    return v.withColumn("v", F.transform("v", lambda x: F.floor(x * 256).cast("double")))


def _matrix(column: pa.Array | pa.ChunkedArray, rows: np.ndarray, dim: int) -> np.ndarray:
    """The vectors of the rows (all of length dim), a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)


def cover_tree(x: np.ndarray, leaf: int = LEAF, slack: float = 0.0) -> tuple[np.ndarray, list[tuple[int, float, int, int, int]]]:
    """(points in leaf order, nodes) over the rows of x; a node is (centre, radius, first point,
    end, parent), parents first.  Points of a node are neighbours in the order.  Distances
    are off by slack at most, which the radii include; points that near are not split."""
    order = np.arange(len(x))
    size = (x * x).sum(axis=1)

    def far(points: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(np.maximum(size[points] + size[centre] - 2 * (x[points] @ x[centre]), 0))
    first = far(order, 0)
    first[0] = 0   # a centre covers itself, whatever the rounding
    nodes = [(0, float(first.max()) + slack, 0, len(x), -1)]
    todo = [(0, first)]
    while todo:
        at, d = todo.pop()
        centre, radius, lo, hi, _ = nodes[at]
        if hi - lo <= leaf or radius <= 2 * slack:
            continue
        points = order[lo:hi]
        # centres at half the radius: the first point that no centre covers is the next one
        group, free, groups = np.empty(hi - lo, np.int64), np.arange(hi - lo), []
        own = np.empty(hi - lo)
        here = d
        centre_at = centre
        while len(free):
            near = here <= radius / 2
            group[free[near]] = len(groups)
            own[free[near]] = here[near]
            groups.append(centre_at)
            free = free[~near]
            if len(groups) * leaf > 2 * (hi - lo) and len(free):   # no structure at this scale: slices of the rest
                for part in np.array_split(free, -(-len(free) // leaf)):
                    centre_at = int(points[part[0]])
                    group[part] = len(groups)
                    own[part] = far(points[part], centre_at)
                    own[part[0]] = 0
                    groups.append(centre_at)
                break
            if len(free):
                centre_at = int(points[free[0]])
                here = far(points[free], centre_at)
                here[0] = 0
        by = np.argsort(group, kind="stable")
        order[lo:hi] = points[by]
        own, ends = own[by], np.cumsum(np.bincount(group, minlength=len(groups)))
        for c, a, b in zip(groups, [0, *ends[:-1].tolist()], ends.tolist()):
            nodes.append((c, float(own[a:b].max()) + slack, lo + a, lo + b, at))
            todo.append((len(nodes) - 1, own[a:b]))
    return order, nodes


_INDEX = "dim int, most double, ids binary, labels binary, v binary, centre binary, radius binary, lo binary, hi binary, parent binary"


def build_index(rows: DataFrame) -> DataFrame:
    """usable rows -> one row per block: points in leaf order, and the nodes."""
    def block(dim: int, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> dict:
        norm = (x * x).sum(axis=1)
        most = float(norm.max())
        slack = 4 * np.sqrt(np.finfo(float).eps * (dim + 1) * most)
        order, nodes = cover_tree(np.column_stack([x, np.sqrt(most - norm)]), slack=slack)
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        centre, radius, lo, hi, parent = (np.array(c) for c in zip(*nodes))
        return {"dim": dim, "most": most, "ids": ids[order].astype("<i8").tobytes(), "labels": labels[order].astype("<i8").tobytes(),
                "v": x[order].astype("<f8").tobytes(), "centre": place[centre].astype("<i8").tobytes(),
                "radius": radius.astype("<f8").tobytes(), "lo": lo.astype("<i8").tobytes(),
                "hi": hi.astype("<i8").tobytes(), "parent": parent.astype("<i8").tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: dict[int, list] = {}
        schema = pa.schema([("dim", pa.int32()), ("most", pa.float64())] + [(c.split()[0], pa.binary()) for c in _INDEX.split(", ")[2:]])
        emit = lambda dim, parts: pa.RecordBatch.from_pylist(
            [block(dim, *(np.concatenate(c) for c in zip(*parts)))], schema=schema)
        for b in batches:
            dims = np.diff(b.column(2).offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                parts = held.setdefault(dim, [])
                parts.append((b.column(0).to_numpy()[at], b.column(1).to_numpy()[at], _matrix(b.column(2), at, dim)))
                if sum(len(p[0]) for p in parts) >= BLOCK:
                    yield emit(dim, held.pop(dim))
        for dim, parts in held.items():
            yield emit(dim, parts)
    return rows.select("vec_id", "label", "v").mapInArrow(run, _INDEX)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers (beyond 53 bits by Python's integers)."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < _EXACT:
        return (q @ x.T).astype(np.int64)
    whole = [[int(c) for c in row] for row in x.tolist()]
    exact = [[sum(int(a) * b for a, b in zip(row, other)) for other in whole] for row in q.tolist()]
    return np.array([[min(max(s, -(1 << 62)), 1 << 62) for s in row] for row in exact], np.int64).reshape(len(q), len(x))


class Best:
    """The k best (score, id) of each (anchor, window), best first; free places have _NONE."""

    def __init__(self, n: int, windows: int, k: int):
        self.k = k
        self.score = np.full((n, windows, k), _NONE)
        self.id = np.full((n, windows, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        return self.score[:, :, -1]

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        """Scores (who, window, point) of points ids; only those that are ok count."""
        score = np.where(ok, score, _NONE)
        every = np.concatenate([self.score[who], score], axis=2)
        names = np.concatenate([self.id[who], np.broadcast_to(ids, score.shape)], axis=2)
        names = np.where(every == _NONE, np.iinfo(np.int64).max, names)
        order = np.lexsort((names, -every))[:, :, :self.k]
        self.score[who] = np.take_along_axis(every, order, axis=2)
        self.id[who] = np.take_along_axis(names, order, axis=2)


def _arrays(row: dict) -> dict:
    kinds = {"radius": "<f8", "v": "<f8"}
    return {c: np.frombuffer(row[c], kinds.get(c, "<i8")) for c in row if c not in ("dim", "most")}


def search_block(row: dict, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray,
                 same: bool, best: Best) -> int:
    """Add what a block has for the anchors (vectors q, ids, labels) to ``best``.  low, high: the
    windows (anchor, window) of scores; same: rows of the anchor's label, else of the others.
    Returns the number of (anchor, leaf) pairs that were verified."""
    a, dim = _arrays(row), row["dim"]
    x = a["v"].reshape(-1, dim) if dim else np.zeros((len(a["ids"]), 0))
    leaf = ~np.isin(np.arange(len(a["lo"])), a["parent"])
    # which labels a node has: of all, the number of kinds and whether the anchor's is one
    kinds, code = np.unique(a["labels"], return_inverse=True)
    upto = np.zeros((len(x) + 1, len(kinds)), np.int32)
    np.cumsum(code[:, None] == np.arange(len(kinds)), axis=0, out=upto[1:])
    has = upto[a["hi"]] - upto[a["lo"]]
    mine = np.searchsorted(kinds, labels)
    known = (mine < len(kinds)) & (kinds[np.minimum(mine, len(kinds) - 1)] == labels)
    n_same = np.where(known[:, None], has.T[np.minimum(mine, len(kinds) - 1)], 0)
    fits = (n_same > 0) if same else (n_same < (a["hi"] - a["lo"])[None, :])

    # level by level: (anchor, node) pairs whose scores may reach a window
    size = (q * q).sum(axis=1)[:, None]
    upper = np.full((len(q), len(leaf)), -np.inf)
    alive = np.zeros((len(q), len(leaf)), bool)
    level = np.flatnonzero(a["parent"] < 0)
    while len(level):
        about = q @ x[a["centre"][level]].T
        radius = a["radius"][level][None, :]
        away = np.sqrt(np.maximum(size + row["most"] - 2 * about, 0))   # distance of norm-augmented vectors
        error = 1e-9 * (size + row["most"]) + 1e-6
        cosine = np.sqrt(size) * radius
        up = error + np.minimum(about + cosine, (size + row["most"] - np.maximum(away - radius, 0) ** 2) / 2)
        down = about - cosine - error
        ok = fits[:, level]
        parent = a["parent"][level]
        if (parent >= 0).any():
            ok = ok & alive[:, parent]
        floor = np.maximum(low, best.least())
        ok &= ((up[:, :, None] >= floor[:, None, :]) & (down[:, :, None] <= high[:, None, :])).any(axis=2)
        alive[:, level], upper[:, level] = ok, up
        level = np.flatnonzero(np.isin(a["parent"], level[ok.any(axis=0)]))
    alive &= leaf[None, :]

    # leaves, best bound first, in rounds over all anchors
    order = np.argsort(np.where(alive, -upper, np.inf), axis=1, kind="stable")
    left = alive.sum(axis=1)
    done = 0
    for turn in range(int(left.max(initial=0))):
        who = np.flatnonzero(left > turn)
        node = order[who, turn]
        going = (upper[who, node][:, None] >= np.maximum(low, best.least())[who]).any(axis=1)
        left[who[~going]] = 0   # the bounds only get smaller from here
        who, node = who[going], node[going]
        by = np.argsort(node, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(node[by])) + 1) if len(by) else []:
            which, n = who[some], node[some[0]]
            points = slice(a["lo"][n], a["hi"][n])
            score = products(q[which], x[points])[:, None, :]
            equal = a["labels"][points][None, :] == labels[which][:, None]
            want = (equal if same else ~equal) & (a["ids"][points][None, :] != ids[which][:, None])
            ok = want[:, None, :] & (score >= np.maximum(low, best.least())[which][:, :, None]) & (score <= high[which][:, :, None])
            hit, point = ok.any(axis=(1, 2)), ok.any(axis=(0, 1))
            if hit.any():
                best.add(which[hit], np.broadcast_to(score, ok.shape)[hit][:, :, point], a["ids"][points][None, None, point], ok[hit][:, :, point])
            done += len(which)
    return done


def _scan(index: DataFrame, dims: dict[int, tuple], same: bool, k: int) -> DataFrame:
    """(anchor, window, vec_id, score): the k best of each task.  dims: length -> (number, ids,
    labels, vectors, low, high) of the anchors."""
    asked = index.sparkSession.sparkContext.broadcast(dims)   # ANCHOR_BYTES, about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = asked.value
        best = {d: Best(len(t[0]), t[4].shape[1], k) for d, t in dims.items()}
        for b in batches:
            for row in b.to_pylist():
                if row["dim"] in dims:
                    _, ids, labels, q, low, high = dims[row["dim"]]
                    search_block(row, q, ids, labels, low, high, same, best[row["dim"]])
        for d, t in dims.items():
            who, window, place = np.nonzero(best[d].score > _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(t[0][who]), pa.array(window), pa.array(best[d].id[who, window, place]),
                                              pa.array(best[d].score[who, window, place])], ["anchor", "window", "vec_id", "score"])
    return index.mapInArrow(run, "anchor long, window long, vec_id long, score long")


def _best_rows(found: DataFrame, k: int) -> DataFrame:
    """The k best of each (anchor, window) with their rank, in two steps."""
    found = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    for by in (["anchor", "window", "salt"], ["anchor", "window"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.drop("salt")


def mine(vectors: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", label_col: str = "label",
         vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
         least: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the best
    ``negatives`` of another label for each of the best ``positives`` of an anchor, with
    least % of the positive's score at least, and that score at most.  is_anchor is on vec_id."""
    rows = usable(vectors, id_col=id_col, label_col=label_col, vector_col=vector_col)
    index = stage(build_index(rows), "index")
    anchors = stage(rows.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    size = anchors.agg(F.sum(F.size("v") * 8 + 16 + positives * 16)).first()[0] or 0
    blocks = max(1, -(-size // ANCHOR_BYTES))
    number = F.pmod(F.xxhash64("anchor"), F.lit(blocks))
    found = []
    for block in range(blocks):
        t = anchors.where(number == block).orderBy("anchor").toArrow()   # ANCHOR_BYTES, about
        sizes = pc.list_value_length(t["v"]).to_numpy()
        own = {}
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            own[dim] = (t["anchor"].to_numpy()[at], t["vec_id"].to_numpy()[at], t["label"].to_numpy()[at], _matrix(t["v"], at, dim))
        every = lambda dim, x: np.full((len(own[dim][0]), 1), x)
        near = _scan(index, {d: (*a, every(d, -np.inf), every(d, np.inf)) for d, a in own.items()}, True, positives)
        near = stage(_best_rows(near, positives).select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"),
                                                       F.col("score").alias("positive_score")), "positives")
        got = {(r["anchor"], r["place"]): r["positive_score"] for r in near.collect()}   # of a block of anchors
        windows = {}
        for dim, a in own.items():
            low, high = np.full((len(a[0]), positives), np.inf), np.full((len(a[0]), positives), -np.inf)   # none: empty
            for i, n in enumerate(a[0].tolist()):
                for j in range(positives):
                    if (p := got.get((n, j + 1))) is not None:
                        low[i, j], high[i, j] = -(-least * p // 100), p
            windows[dim] = (*a, low, high)
        hard = _best_rows(_scan(index, windows, False, negatives), negatives).withColumn("place", F.col("window") + 1).drop("window")
        hard = hard.join(near, ["anchor", "place"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
        found.append(hard.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                                 F.col("score").alias("negative_score")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_SQL = f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same,
         CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM rows a, rows c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS place
  FROM pairs WHERE same
), negatives AS (
  SELECT p.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, place ORDER BY score DESC, other) AS rank
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same
   AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
  WHERE place <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= {NEGATIVES}
"""


@register("op13_hard_negatives", _SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every hundredth vector; labels of every seventh are moved by one."""
    t = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(t.withColumn("label", label), F.col("vec_id") % 100 == 0)

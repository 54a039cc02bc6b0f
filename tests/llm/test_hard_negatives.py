"""Hard negatives against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import postlens.llm.op13_hard_negatives as op13
from tests.llm.conftest import rows_of

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id long, embedding array<double>, label int, v string, anchor int, score string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, "y") for i, v, y in rows], SCHEMA)


def _brute(rows, every, positives=5, negatives=5):
    part = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, y in part:
        if i % every:
            continue
        near = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in part if j != i and len(w) == len(v)]
        for p, j, _ in sorted(x for x in near if x[2] == y)[:positives]:
            hard = sorted(x for x in near if x[2] != y and -80 * p <= -100 * x[0] <= -100 * p)[:negatives]
            out += [(i, j, n + 1, h, -p, -s) for n, (s, h, _) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_against_all_inner_products(spark, monkeypatch, small):
    r = np.random.default_rng(2)
    centres = r.normal(size=(9, 6))
    rows = [(i, (centres[i % 9] + r.normal(scale=0.3, size=6)).tolist(), int(r.integers(0, 3))) for i in range(900)]
    rows += [(2000 + i, rows[5][1], i % 4) for i in range(400)]                     # copies
    rows += [(5000 + i, [float(i % 3), 1.0, 0.0], i % 2) for i in range(60)]       # another length
    rows += [(None, rows[0][1], 1), (10, None, 1), (20, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (30, [float("nan")] * 6, 1),
             (40, [float("inf")] * 6, 1), (50, rows[0][1], None), (60, [0.0] * 6, 2), (70, [], 1), (71, [], 0), (72, [], 1),
             (80, rows[3][1], 1), (80, rows[3][1], 1), (81, (-centres[0]).tolist(), 7)]
    if small:
        for name, value in (("BLOCK", 100), ("LEAF", 4), ("ANCHOR_BYTES", 4000)):
            monkeypatch.setattr(op13, name, value)
    got = op13.mine(_frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert rows_of(got, *COLUMNS) == _brute(rows, 10)


def test_few_rows_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.9, 0.3], 1)]
    assert rows_of(op13.mine(_frame(spark, rows), F.col("vec_id") == 0), *COLUMNS) == [(0, 1, 1, 2, 65536, 230 * 256)]
    assert op13.mine(_frame(spark, rows).limit(0), F.col("vec_id") == 0).collect() == []
    assert op13.mine(_frame(spark, rows), F.col("vec_id") == 9).collect() == []
    assert op13.mine(_frame(spark, [(0, [1.0], 0)]), F.col("vec_id") == 0).collect() == []


def test_scores_beyond_53_bits_are_exact():
    q, x = np.array([[2.0**31 + 1, 3.0]]), np.array([[2.0**30 + 1, 5.0], [1.0, 1.0]])
    assert op13.products(q, x).tolist() == [[(2**31 + 1) * (2**30 + 1) + 15, 2**31 + 4]]


def test_tree_covers_every_point():
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(500, 5)), np.repeat(r.normal(size=(3, 5)), 200, axis=0)]) * 100
    order, nodes = op13.cover_tree(x, 16, 1e-4)
    assert sorted(order.tolist()) == list(range(len(x)))
    for centre, radius, lo, hi, parent in nodes:
        points = order[lo:hi]
        assert centre in points and np.sqrt(((x[points] - x[centre]) ** 2).sum(axis=1)).max() <= radius
        if parent >= 0:
            assert nodes[parent][2] <= lo < hi <= nodes[parent][3]


def test_close_groups_are_skipped_and_windows_hold(spark):
    """Anchors of one far group verify only its leaves."""
    r = np.random.default_rng(6)
    x = np.concatenate([c + r.normal(size=(200, 4)) for c in np.eye(4) * 10000])
    out = []
    op13_rows = op13.usable(_frame(spark, [(i, (v / 256).tolist(), i % 2) for i, v in enumerate(x)]), id_col="vec_id", label_col="label", vector_col="embedding")
    for row in op13.build_index(op13_rows.coalesce(1)).collect():
        q = np.floor(x[:5])
        best = op13.Best(5, 1, 3)
        every = np.full((5, 1), np.inf)
        out.append((op13.search_block(row.asDict(), q, np.arange(5), np.arange(5) % 2, -every, every, True, best), len(row["lo"]) // 8))
    assert sum(v for v, _ in out) < 5 * sum(n for _, n in out) / 2

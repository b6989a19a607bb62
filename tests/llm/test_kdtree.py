from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import kdtree


def brute(rows, k, scale=256):
    ok = [(i, [math.floor(float(x) * scale) for x in v], q) for i, v, q in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v, q in ok:
        if q and (i not in asked or (len(v), v) > (len(asked[i]), asked[i])):
            asked[i] = v
    out = set()
    for i, v in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, n) for n, (j, w, _) in enumerate(ok) if j != i and len(w) == len(v))
        out |= {(i, r + 1, j, -s) for r, (s, j, _) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("big", [1.0, 1e7])
def test_equals_brute_force(spark, big):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + rng.normal(size=8) * 0.2).tolist(), i % 7 == 0) for i in range(600)]
    rows += [(1000 + i, [big, *[0.5] * 7], i % 50 == 0) for i in range(300)]  # one very common vector
    rows += [(2000, None, True), (2001, [1.0, None, *[0.0] * 6], True), (2002, [math.nan] * 8, True), (2003, [math.inf] * 8, False), (2004, [], True), (None, [1.0] * 8, True)]
    rows += [(3000, [1.0, 2.0], True), (3001, [2.0, 1.0], False), (3000, [1.0, 2.0], True), (14, rows[14][1], True)]
    df = spark.createDataFrame([(i, v, q, 1) for i, v, q in rows], "vec_id long, embedding array<double>, q boolean, dim int")
    got = {tuple(r) for r in kdtree.top_k(df, F.col("q"), shard_rows=200, block_rows=40).collect()}
    assert got == brute(rows, 5)


def test_a_tree_visits_few_points_of_clustered_data():
    rng = np.random.default_rng(1)
    points = (rng.integers(0, 40, size=(40, 1, 4)) * 100 + rng.integers(0, 5, size=(40, 300, 4))).reshape(-1, 4)
    tree = kdtree.Tree(points, np.arange(len(points)), leaf=64)
    upper = kdtree.bounds(points[:1], tree.low, tree.high)
    best = np.sort(points @ points[0])[-5]
    leaves = [k for k, c in enumerate(tree.children) if c[0] < 0]
    assert sum(upper[0, k] >= best for k in leaves) < len(leaves) / 4
    assert all((points[:1] @ tree.points[slice(*tree.ranges[k])].T).max() <= upper[0, k] for k in leaves)


def test_few_pairs_of_queries_and_shards_are_searched(spark, monkeypatch):
    """Every row belongs to one of 40 far clusters; each shard is indexed once."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 6)) * 20
    rows = [(i, (centres[i % 40] + rng.normal(size=6) * 0.1).tolist()) for i in range(2000)]
    seen = {}
    keep = kdtree.stored

    def watched(df, name):
        seen[name] = keep(df, name)
        return seen[name]

    monkeypatch.setattr(kdtree, "stored", watched)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in kdtree.top_k(df, F.col("vec_id") % 20 == 0, shard_rows=50, block_rows=30).collect()}
    assert got == brute([(i, v, i % 20 == 0) for i, v in rows], 5)
    shards, queries = seen["kd-index"].count(), seen["kd-queries"].count()
    assert shards >= 40 and queries == 100 and seen["kd-pairs"].count() < 0.1 * shards * queries


def test_coarse_leaves_hold_equal_shares():
    rng = np.random.default_rng(8)
    points = rng.integers(-500, 500, size=(4000, 5))
    counts = np.bincount(kdtree.Coarse(points[::4], 16).leaf_of(points))
    assert len(counts) == 16 and counts.min() > 150 and counts.max() < 350
    same = np.concatenate([np.full((900, 5), 7), points[:100]])
    coarse = kdtree.Coarse(same, 8)
    assert len(set(coarse.leaf_of(same[:900]).tolist())) == 1 and coarse.leaves > 2


def test_empty_table_and_few_candidates(spark):
    schema = "vec_id long, embedding array<float>"
    assert kdtree.top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    two = spark.createDataFrame([(1, [0.5]), (2, [0.25])], schema)
    assert sorted(tuple(r) for r in kdtree.top_k(two, F.col("vec_id") == 1).collect()) == [(1, 1, 2, 128 * 64)]

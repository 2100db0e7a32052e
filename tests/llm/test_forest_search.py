"""Operator 11: recall against brute force, exact scores, odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quernlake.llm import forest_search

VECTORS = "vec_id long, embedding array<float>"


def best(rows: list[tuple], k: int, every: int) -> dict[int, list[tuple]]:
    """(place of a query row) to its (score, id) in order, by sums in order of the dimensions."""
    ok = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dims = max((len(v) for _, v in ok), default=0)
    x = np.array([v + [0.0] * (dims - len(v)) for _, v in ok])
    out = {}
    for q, (i, _) in enumerate(ok):
        if i % every == 0:
            scores = forest_search.exact_scores(np.repeat(x[q : q + 1], len(x), axis=0), x)
            out[q] = i, sorted(((-s, c) for n, (s, (c, _)) in enumerate(zip(scores.tolist(), ok, strict=True)) if n != q))[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    rows = [(int(i), (centres[i % 30] + 0.6 * rng.normal(size=24)).astype(np.float32).tolist()) for i in rng.permutation(3000)]
    want = {i: found for i, found in best(rows, 20, 20).values()}
    got: dict[int, list] = {}
    for r in sorted(forest_search.nearest(spark.createDataFrame(rows, VECTORS).repartition(5)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 20 for i in want]) >= 0.9  # finds are equal in score, too
    assert all(g == sorted(g) for g in got.values())


def test_few_rows_are_all_found(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(60)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in forest_search.nearest(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == sorted((i, r, v, -s) for i, found in best(rows, 20, 20).values() for r, (s, v) in enumerate(found, 1))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (20, None), (40, [1.0, None]), (60, [nan, 1.0]), (80, [1.0, inf]), (100, []), (None, [1.0, 1.0]), (120, [0.0, 0.0]), (7, [0.5, 0.25]), (7, [0.5, 0.25]), (8, [0.5]), (140, [1.0, -0.5]), (0, [1.0, -0.5]), (-20, [3.0, 1.0])]
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "0 AS row", "1 AS id", "2 AS v", "3 AS rank", "4 AS leaf").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in forest_search.nearest(table, 4).collect())
    assert got == sorted((i, r, v, -s) for i, found in best(rows, 4, 20).values() for r, (s, v) in enumerate(found, 1))
    assert forest_search.nearest(table.limit(0)).collect() == []
    assert forest_search.nearest(table.filter("vec_id = 8")).collect() == []  # no queries
    assert forest_search.nearest(table.filter("vec_id = 140")).collect() == []  # none but the query itself


def test_lanes_in_parts(spark, monkeypatch):
    """Many copies of one vector, small lanes, and more queries than a group takes."""
    monkeypatch.setattr(forest_search, "LANE_ROWS", 64)
    monkeypatch.setattr(forest_search, "LANE_QUERIES", 8)
    monkeypatch.setattr(forest_search, "LEAF_ROWS", 16)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 0.5, 0.0] if i % 3 == 0 else rng.normal(size=4).astype(np.float32).tolist()) for i in range(900)]
    want = {i: found for i, found in best(rows, 20, 20).values()}
    got: dict[int, list] = {}
    for r in sorted(forest_search.nearest(spark.createDataFrame(rows, VECTORS).repartition(3)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert np.mean([len(set(got[i]) & set(want[i])) / 20 for i in want]) >= 0.9
    copies = [v for _, v in got[60] if v % 3 == 0]  # of equal vectors those of the smallest ids
    assert copies and copies == [v for v in range(0, 900, 3) if v != 60][: len(copies)]


@pytest.mark.parametrize("depth", [0, 1, 5])
def test_the_queue_pops_near_leaves_first(depth):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 8))
    norm = float(np.linalg.norm(x, axis=1).max())
    parts = [forest_search.grown(forest_search.lifted(x, norm), depth, s) for s in range(3)]
    forest = forest_search.Forest(8, norm, [p for p, _ in parts], [c for _, c in parts]) if depth else None
    if forest is None:
        return
    q = forest_search.aimed(x[:20], norm)
    far, own = forest.distances(q), forest.leaves(q)
    for t in range(3):  # the leaf that a query falls into waits at distance 0
        assert np.allclose(far[np.arange(20), t * 2**depth + own[:, t]], 0)
    counts = np.bincount(forest.leaves(forest_search.lifted(x, norm))[:, 0], minlength=2**depth)
    assert counts.max() <= 2 * 500 / 2**depth

"""Operator 10 against SQL and brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same, connect

from quernlake.llm import vector_search

VECTORS = "vec_id long, embedding array<float>"


def brute(rows: list[tuple], k: int, every: int) -> list[tuple]:
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, mine) in enumerate(usable):
        if q % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(mine, v, strict=False)), i) for m, (i, v) in enumerate(usable) if m != n))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def found(table, k: int, every: int) -> list[tuple]:
    return sorted(map(tuple, vector_search.top_k(table, k, every).collect()))


def test_sql(spark, small_dir):
    assert_same(vector_search.top_k(spark.read.parquet(f"{small_dir}/embeddings.parquet")), connect(small_dir), vector_search.ORACLE)


@pytest.mark.parametrize("seed", [0, 1])
def test_brute_force_with_ties(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.integers(-3, 4, 40).astype(float).tolist()) for i in rng.permutation(300)]
    assert found(spark.createDataFrame(rows, VECTORS).repartition(5), 5, 10) == brute(rows, 5, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (50, None), (100, [1.0, None]), (150, [nan, 1.0]), (200, [1.0, inf]), (250, []), (None, [1.0, 1.0]), (7, [0.5, 0.25]), (7, [0.5, 0.25]), (8, [0.001, -0.001]), (300, [0.0, 0.0]), (-50, [-1.0, 2.0])]
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "0 AS id", "1 AS v", "2 AS rank", "3 AS score", "4 AS row").repartition(3)
    assert found(table, 5, 50) == brute(rows, 5, 50)
    assert found(table.limit(0), 5, 50) == []
    assert found(table.filter("vec_id = 8"), 5, 8) == []  # a row never meets itself
    assert found(table.filter("vec_id = 7"), 5, 7) == brute(rows[7:9], 5, 7)  # but others of its id
    assert len(found(table.filter("vec_id = 7"), 5, 7)) == 2


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vector_search, "CANDIDATE_BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=24).astype(np.float32).tolist()) for i in range(200)]
    assert found(spark.createDataFrame(rows, VECTORS).repartition(4), 5, 4) == brute(rows, 5, 4)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.integers(1, 60), st.integers(1, 8), st.integers(0, 2**32 - 1))
def test_bounds_lose_nothing(dims, n, k, seed):
    rng = np.random.default_rng(seed)
    q, c = rng.integers(-4, 5, (dims, 3)).astype(float), rng.integers(-4, 5, (dims, n)).astype(float)
    ids, own_ids = rng.permutation(n), np.array([(-1, -1), (-2, -2), (-3, -3)])
    both = np.stack([ids, ids], axis=1)
    got = list(zip(*vector_search.search_pair(own_ids, q, both, c, k), strict=True))
    best, half = vector_search.Best(own_ids, k), n // 2
    for part in (slice(0, half), slice(half, n)):  # bounds go on from one block to the next
        best.add(*vector_search.search_pair(best.q_ids, q, both[part], c[:, part], k, best.floors))
    carried = list(zip(*(col.to_pylist() for col in best.rows().columns), strict=True))
    for i, own in enumerate((-1, -2, -3)):
        want = sorted(((-int(q[:, i] @ c[:, j]), int(ids[j])) for j in range(n)))[:k]
        assert sorted((-int(s), int(v)) for o, v, s in got if o == i) == want
        assert sorted((-s, v) for o, _, v, s in carried if o == own) == want


def test_every_row_of_an_id_searches(spark):
    import duckdb
    from oracle import rows_of

    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), *((i, [i / 8.0, 2.0 - i / 8.0]) for i in range(1, 12))]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings(vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = con.sql(vector_search.ORACLE)
    got = vector_search.top_k(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())

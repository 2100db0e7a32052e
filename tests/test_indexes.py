"""The lexical and the vector index against exact scans."""

import random

import numpy as np
from pyspark.sql import functions as F

from quernlake.operators import lexical_index, retrieval, vector_index

WORDS = [f"w{i}" for i in range(300)]


def corpus(spark, seed, n=2500):
    rng = random.Random(seed)
    rows = [(f"c{i:05d}", " ".join(rng.choices(WORDS, weights=[1 / (k + 1) for k in range(300)], k=rng.randint(0, 60)))) for i in range(n)]
    rows += [("null", None), ("empty", ""), ("phrase", "set client_max_body_size to max_body max body max body"), ("part", "client body size max")]
    return spark.createDataFrame(rows, "id string, text string").repartition(4)


def questions(spark):
    asked = [(1, "w0 w250"), (2, "client_max_body_size"), (3, "what is max_body for w7"), (4, "the and"), (5, ""), (6, "w299 w298 absent"), (7, "w1 W1 w1-w2 w1"), (7, "max_max"), (None, "w3")]
    return spark.createDataFrame(asked, "query_id int, query string")


def same_ranks(spark, path, asked, chunks, limit):
    want = sorted(((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in retrieval.lexical_search(chunks, asked, limit).collect()), key=str)
    got = sorted(((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in lexical_index.search(spark, path, asked, limit).collect()), key=str)
    assert got == want
    return got


def test_index_ranks_as_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK_BITS", 4)
    chunks, path, asked = corpus(spark, 1), str(tmp_path / "index"), questions(spark).filter("query_id IS NOT NULL")
    lexical_index.build(chunks, path)
    for limit in (1, 5, 50):
        got = same_ranks(spark, path, asked, chunks, limit)
    assert [g[2] for g in got if g[0] == 2] == ["phrase"] and not any(g[0] in (4, 5) for g in got)
    # blocks that cannot reach the ranking are not read
    terms = retrieval.query_terms(asked.filter("query_id = 1"))
    blocks = spark.read.parquet(f"{path}/blocks")
    chosen = lexical_index.candidate_blocks(blocks, terms, 5).count()
    assert 0 < chosen < blocks.filter("lexeme IN ('w0', 'w250')").select("block").distinct().count() / 2


def test_a_query_reads_the_parts_of_its_lexemes(spark, tmp_path):
    chunks, path = corpus(spark, 2, 400), str(tmp_path / "index")
    lexical_index.build(chunks, path)
    same_ranks(spark, path, spark.createDataFrame([("a", "w5 w6")], "query_id string, query string"), chunks, 10)
    lexical_index.build(chunks.limit(0), path)
    assert lexical_index.search(spark, path, questions(spark)).collect() == []


def vectors(spark, n=4000, dims=30, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dims))
    x = centres[rng.integers(0, 40, n)] + 0.5 * rng.normal(size=(n, dims))
    return x, spark.createDataFrame([(f"v{i:05d}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<double>").repartition(4)


def test_vector_index_recall(spark, tmp_path):
    x, chunks = vectors(spark)
    path = str(tmp_path / "vectors")
    vector_index.build(chunks, path)
    asked = chunks.filter(F.substring("id", 4, 3) == "000").unionByName(chunks.filter(F.substring("id", 5, 2) == "50")).select(F.col("id").alias("query_id"), "embedding")
    found = vector_index.search(spark, path, asked, 10).collect()
    exact = {(r.query_id, r.id): r.distance for r in retrieval.dense_search(chunks, asked, 10).collect()}
    got = {(r.query_id, r.id): r.distance for r in found}
    assert len(got) == len(exact) and len(got.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(abs(got[k] - exact[k]) < 1e-9 for k in got.keys() & exact.keys())
    lists = vector_index.load(spark, path)
    assert spark.read.parquet(f"{path}/codes").count() == len(x) and lists.probes < len(lists.coarse)
    assert {r["rank"] for r in found} == set(range(1, 11))


def test_vector_index_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "LIST_ROWS", 16)
    monkeypatch.setattr(vector_index, "LIST_QUERIES", 3)
    rows = [(f"c{i:03d}", [1.0, 2.0, 3.0]) for i in range(200)] + [("n", None), ("z", [0.0, 0.0, 0.0]), ("x", [1.0, None, 1.0]), (None, [1.0, 1.0, 1.0]), ("e", []), ("far", [-1.0, 0.5, 0.0]), ("short", [1.0])]
    chunks, path = spark.createDataFrame(rows, "id string, embedding array<double>"), str(tmp_path / "vectors")
    vector_index.build(chunks, path)
    asked = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(7)] + [(9, None)], "query_id int, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.id) for r in vector_index.search(spark, path, asked, 4).collect())
    assert got == [(q, k + 1, f"c{k:03d}") for q in range(7) for k in range(4)]
    vector_index.build(chunks.limit(0), path)
    assert vector_index.search(spark, path, asked, 4).collect() == []


def test_ties_go_to_smaller_ids_whatever_the_length(spark, tmp_path):
    """Blocks hold chunks by length; of equal scores the smaller ids rank, and a task's lists are made without rows of positions."""
    rows = [(i, "hit " + "pad " * (i * 7 % 60)) for i in range(300)]
    chunks, path = spark.createDataFrame(rows, "id long, text string").repartition(2), str(tmp_path / "index")
    lexical_index.build(chunks, path)
    got = same_ranks(spark, path, spark.createDataFrame([(q, "hit") for q in range(400)], "query_id int, query string"), chunks, 5)
    assert [g[2] for g in got if g[0] == 7] == [0, 1, 2, 3, 4]
    order = spark.read.parquet(f"{path}/documents").orderBy("doc").collect()
    assert len(order) == 300 and len({r.doc for r in order}) == 300


def test_blocks_of_long_documents_are_no_larger_than_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK_CHARACTERS", 3000, raising=False)
    rows = [(f"c{i:03d}", " ".join(f"w{(i * k) % 37}" for k in range(i % 300))) for i in range(500)] + [("huge", "w1 w2 " * 2000), ("null", None)]
    chunks, path = spark.createDataFrame(rows, "id string, text string").repartition(2), str(tmp_path / "index")
    lexical_index.build(chunks, path)
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w36"), (3, "w1-w2 w5")], "query_id int, query string")
    same_ranks(spark, path, asked, chunks, 7)
    sizes: dict = {}
    for r in spark.read.parquet(f"{path}/documents").join(chunks, "id").collect():
        sizes.setdefault(r.doc >> lexical_index.BLOCK_BITS, []).append(len(r.text or ""))
    assert sum(map(len, sizes.values())) == len(rows)
    assert all(sum(own) <= 3000 or len(own) == 1 for own in sizes.values())

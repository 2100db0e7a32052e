"""The corpus pipeline, stage by stage, and the registered queries of the subpackage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest

from quernlake.llm import mixing, near_dup, quality


@pytest.fixture(scope="module")
def stages(spark):
    """The tables between the stages, over the smallest input."""
    sf = "/root/testdata/sf0.001"
    tables = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(corpus_pipeline.written(stage(spark, tables[-1], sf), "test-stage"))
    return sf, tables


def test_each_stage_decides(spark, stages):
    sf, (docs, good, single, mixed, pieces) = stages
    assert good.columns == single.columns == mixed.columns == docs.columns
    ids = lambda t: Counter(r[0] for r in t.select("doc_id").collect())
    verdicts = quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1")
    assert ids(good) == ids(verdicts)
    assert ids(single) == ids(near_dup.classes(good).filter("keep"))
    assert 0 < single.count() < good.count() < docs.count()
    want = Counter({r.doc_id: -(-r.taken // r.size) for r in mixing.mix(single).collect() if r.taken})
    assert ids(mixed) == want
    assert ids(pieces) == want and pieces.filter("NOT lossless").count() == 0


def test_clean_labelled_documents_stay(spark, stages):
    sf, (_, good, *_) = stages
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = labels.filter("quality = 1")
    assert clean.join(good, "doc_id", "left_semi").count() >= 0.95 * clean.count()


def test_run_equals_the_stages(spark, stages):
    sf, (*_, pieces) = stages
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == pieces.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, pieces.collect()))


def test_empty_table(spark, stages):
    sf, (docs, *_) = stages
    table = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, sf)
    assert table.collect() == []


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert set(entry.oracle_sql()) <= set(names)


def test_odd_rows_through_all_stages(spark, odd):
    """Nulls, empty and long texts, ties, repeated rows and clashing names pass each stage, as it is defined."""
    from pyspark.sql import functions as F

    table = odd.withColumns({c: F.lit(1) for c in ("row", "_row", "times", "copy", "n_pieces")})
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = corpus_pipeline.written(stage(spark, table, "/root/testdata/sf0.001"), "odd-stage")
        assert out.columns == table.columns, name
        assert out.count() <= 4 * table.count()
        table = out
    texts = [r.text for r in table.collect()]
    assert all(t and t.strip() for t in texts)  # the mix takes words alone
    assert sum(t.startswith("same text") for t in set(texts)) <= 1
    pieces = corpus_pipeline.STAGES[3][1](spark, table, "/root/testdata/sf0.001").collect()
    assert len(pieces) == len(texts) and all(p.lossless for p in pieces)


def test_copies_are_sampled_apart(documents):
    from quernlake.llm import piece_sampling
    from quernlake.llm.queries import vocabulary

    text = "several words that can be cut in many ways, again and again, as often as they stand here"
    rows = piece_sampling.numbered_copies(documents([(1, text, "a")] * 4 + [(2, text, "a")]))
    assert sorted((r.doc_id, r.copy) for r in rows.collect()) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]
    path = vocabulary("piece_bpe_32k.model")
    got = piece_sampling.both_ways(rows, path, copy="copy").collect()
    assert all(r.lossless for r in got) and len({tuple(r.piece_ids) for r in got if r.doc_id == 1}) > 1
    plain = piece_sampling.both_ways(documents([(1, text, "a")]), path).first()
    assert tuple(plain.piece_ids) in {tuple(r.piece_ids) for r in got if r.doc_id == 1}

"""Operator 5: held-out accuracy, isotonic fits by definition, and the folds."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from rows import ODD_ROWS

from quernlake.llm import quality


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def scored(labelled) -> pd.DataFrame:
    return quality.classify(*labelled).toPandas()


def test_held_out_rows_are_told_apart(labelled, scored):
    truth = labelled[1].toPandas().merge(scored, on="doc_id")
    truth = truth[truth.held_out]
    good, bad = truth[truth.quality == 1].score.to_numpy(), truth[truth.quality == 0].score.to_numpy()
    wins = (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()
    assert wins > 0.95
    assert (truth.predicted == truth.quality).mean() > 0.93


def test_folds_and_ranges(scored):
    assert (scored.held_out == [zlib.crc32(str(k).encode()) % 5 == 0 for k in scored.doc_id]).all()
    assert scored.score.between(0, 1).all()
    assert (scored.predicted == (scored.score >= 0.3)).all()


def test_held_out_labels_train_nothing(labelled, scored):
    docs, labels = labelled
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.classify(docs.withColumn("source", F.lit("x")).withColumn("lang", F.lit(None).cast("string")), other).toPandas()
    both = scored.merge(again, on="doc_id")
    assert np.abs(both.score_x - both.score_y).max() < 1e-4


def test_partitioning_changes_nothing(labelled, scored):
    docs, labels = labelled
    both = scored.merge(quality.classify(docs.repartition(13), labels.repartition(5)).toPandas(), on="doc_id")
    assert np.abs(both.score_x - both.score_y).max() < 1e-4


def test_keep_good_keeps_columns(labelled, scored):
    docs, labels = labelled
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(scored[scored.predicted == 1].doc_id)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)).filter(lambda p: sum(p)), min_size=1, max_size=12))
def test_isotonic_is_the_min_max_formula(counts):
    good, total = np.array([g for g, _ in counts], float), np.array([g + b for g, b in counts], float)
    n = len(counts)
    mean = lambda a, b: good[a : b + 1].sum() / total[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    assert quality.isotonic(good, total) == pytest.approx(want)


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, len(quality.NAMES)))
    z = quality.fourier(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x) ** 2).sum(-1) / (2 * quality.BANDWIDTH**2))
    assert np.abs(z @ z.T - kernel).mean() < 0.1


def test_statistics_of_a_small_text():
    got = dict(zip(quality.NAMES, quality.statistics("One two two 3|3 END.\nEnd."), strict=True))
    assert got["repeats"] == pytest.approx(1 / 6)
    assert got["top_word"] == pytest.approx(2 / 6)
    assert got["upper"] == pytest.approx(1 / 6)
    assert got["stops"] == pytest.approx(2 / 6)
    assert all(map(math.isfinite, quality.statistics("\u0000 ퟿ " * 3)))


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0), (4, 1), (5, 0), (6, 1), (7, None), (None, 1), (6, 0)], "doc_id long, quality int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert all(r.held_out for r in got if r.doc_id is None)
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(odd.limit(0), labels).collect() == []


def test_fit_equals_direct_ridge(spark, documents):
    """Weights from summed normal equations equal those of numpy on all training rows at once."""
    import random
    import zlib

    import numpy as np

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["word", "Title.", "x|y", "###", "12", "line\n"]) for _ in range(rng.randrange(1, 60))), "a") for i in range(160)]
    labels = [(i, rng.randrange(2)) for i in range(160)]
    model = quality.fit(documents(rows, 5), spark.createDataFrame(labels, "doc_id long, quality int"))
    train = [i for i in range(160) if zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([quality.statistics(rows[i][1]) for i in train]), np.array([labels[i][1] for i in train], float)
    scale = np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = quality.fourier((x - x.mean(0)) / scale)
    direct = np.linalg.solve(z.T @ z + quality.RIDGE * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(model.weights, direct, atol=1e-6)
    raw = z @ direct
    assert np.corrcoef(raw, model.scores(x))[0, 1] > 0.9 and (np.diff(model.scores(x)[np.argsort(raw)]) >= -1e-9).all()


def test_keep_good_takes_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0), (2, 0), (5, 1), (7, 1), (None, 1), (8, None)], "doc_id long, quality int")
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    want = {(r.doc_id,) for r in quality.classify(odd, labels).filter("predicted = 1").collect()}
    assert {(r.doc_id,) for r in kept.collect()} == want
    assert quality.keep_good(odd.limit(0), labels).collect() == []
    assert quality.keep_good(odd, labels.limit(0)).count() == odd.count()  # without labels every score is 0.5

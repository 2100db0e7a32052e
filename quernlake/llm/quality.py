"""Operator 5: quality classifier on random Fourier features.

A document is described by statistics of its whole text.  Random Fourier features cos(w.x + b) of the standardized
statistics approximate a Gaussian kernel.  Ridge regression of the labels is fitted by normal equations that partitions
sum up and Spark adds; scores are then made monotone in the label rate by isotonic regression over fixed bins.  What
comes to the driver is of constant size: moments, one matrix, one histogram.

Training takes labelled rows whose crc32(doc_id as text) mod 5 is not 0 (null ids are held out); no labels, language,
source or id enter a score.

Defined cases: a null or empty text has zero statistics and gets the score of such; null labels train nothing; several
labels of one document each count; without any label every score is 0.5; repeated rows each get a row; an empty table
gives an empty result; extra columns are dropped.  Statistics join the labels by id, texts are never shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlake.llm.common import written

FOLDS = 5
THRESHOLD = 0.3
FEATURES, BANDWIDTH, RIDGE, SEED = 128, 4.0, 1.0, 20240817
#: Bins of raw scores over [-1, 2] for the isotonic fit.
BINS = 3000
NAMES = ("log_words", "log_chars", "upper", "digit", "symbol", "punct", "pipe", "distinct", "top_word", "repeats", "word_length", "long_words", "line_words", "line_distinct", "stops", "non_ascii")
SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()\-|]")
PUNCT = re.compile(r"[.,;:!?]")


def statistics(text: str) -> tuple[float, ...]:
    """The statistics of NAMES; all but the two logarithms are shares or means."""
    words = text.split()
    if not words:
        return (0.0,) * len(NAMES)
    n, chars = len(words), len(text)
    counts = Counter(words)
    lines = text.split("\n")
    letters = sum(map(len, words))
    repeats = sum(map(str.__eq__, words, words[1:]))
    upper = sum(map(str.isupper, words))
    ends = sum(counts[w] for w in counts if w[-1] in ".!?")
    return (
        np.log1p(n), np.log1p(chars), upper / n, sum(map(text.count, "0123456789")) / chars, len(SYMBOLS.findall(text)) / n, len(PUNCT.findall(text)) / n,
        text.count("|") / n, len(counts) / n, max(counts.values()) / n, repeats / n, letters / n, sum(len(w) > 12 for w in counts) / len(counts),
        np.log1p(n / len(lines)), len(set(lines)) / len(lines), ends / n, 1.0 - len(text.encode("ascii", "ignore")) / chars,
    )


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        raw = self.features(x) @ self.weights
        return np.round(np.interp(raw, self.edges, self.levels), 6)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardized statistics, clipped to 6 deviations, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0.0, 1.0 / BANDWIDTH, (len(NAMES), FEATURES))
    b = rng.uniform(0.0, 2.0 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2.0 / FEATURES) * np.cos(np.clip(x, -6.0, 6.0) @ w + b), np.ones((len(x), 1))])


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(True))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(name).to_numpy(zero_copy_only=False) for name in NAMES]) if batch.num_rows else np.zeros((0, len(NAMES)))


def described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, statistics...) of each whole text."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in rows.T)], ["doc_id", *NAMES])

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(describe, f"doc_id {kind}, " + ", ".join(f"{n} double" for n in NAMES))


def isotonic(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rates of consecutive bins made non-decreasing by pooling adjacent violators; empty bins follow their neighbours."""
    pools: list[list[float]] = []  # good, total, bins
    for g, t in zip(good, total, strict=True):
        pools.append([g, t, 1])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            g2, t2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + g2, pools[-1][1] + t2, pools[-1][2] + n2]
    return np.repeat([g / t if t else 0.5 for g, t, _ in pools], [n for *_, n in pools])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Three small aggregations over the labelled training rows; their statistics are written once to the shared folder."""
    marks = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("double").alias("label")).filter(F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    stats = described(docs.filter(~held_out(F.col(key))), key, text)
    train = written(stats.join(marks, "doc_id"), "quality-train")
    sums = train.agg(F.count("*").alias("n"), F.avg("label").alias("rate"), *(F.avg(c).alias(f"m_{c}") for c in NAMES), *(F.stddev_pop(c).alias(f"s_{c}") for c in NAMES)).first()
    nothing = np.zeros(0)
    if not sums["n"]:
        return Model(nothing, nothing, nothing, nothing, nothing)
    mean = np.array([sums[f"m_{c}"] for c in NAMES])
    scale = np.array([sums[f"s_{c}"] or 1.0 for c in NAMES])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), nothing, nothing, nothing)
    upper = np.triu_indices(FEATURES + 1)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z, y = model.features(_matrix(batch)), batch.column("label").to_numpy(zero_copy_only=False)
            gram += z.T @ z
            right += z.T @ y
        values = np.r_[gram[upper], right]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["cell", "value"])

    cells = train.mapInArrow(equations, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    values = np.zeros(len(upper[0]) + FEATURES + 1)
    values[cells["cell"]] = cells["value"]
    gram = np.zeros((FEATURES + 1, FEATURES + 1))
    gram[upper] = values[: len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    weights = np.linalg.solve(gram + RIDGE * np.eye(FEATURES + 1), values[len(upper[0]) :])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, total = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            at = np.clip(((model.features(_matrix(batch)) @ weights + 1.0) / 3.0 * BINS).astype(int), 0, BINS - 1)
            good += np.bincount(at, batch.column("label").to_numpy(zero_copy_only=False), BINS)
            total += np.bincount(at, minlength=BINS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(good[some]), pa.array(total[some])], ["bin", "good", "total"])

    bins = train.mapInArrow(binned, "bin int, good double, total double").groupBy("bin").agg(F.sum("good").alias("good"), F.sum("total").alias("total")).orderBy("bin").toPandas()
    good, total = bins["good"].to_numpy(), bins["total"].to_numpy()
    # a document of each label at either end keeps the calibrated scores off 0 and 1
    good, total = np.r_[sums["rate"], good, sums["rate"]], np.r_[1.0, total, 1.0]
    edges = np.r_[-1.0, (bins["bin"].to_numpy() + 0.5) / BINS * 3.0 - 1.0, 2.0]
    return Model(model.mean, model.scale, weights, edges, isotonic(good, total))


def scorer(model: Model):  # noqa: ANN201
    """A pandas UDF: text to score."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows = np.array([statistics(t) for t in texts], float).reshape(-1, len(NAMES))
        return pd.Series(model.scores(rows))

    return score


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    score = scorer(fit(docs, labels, key, text, label))
    scored = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), score(F.coalesce(F.col(text), F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The documents predicted good, with all their columns."""
    score = scorer(fit(docs, labels, key, text, label))
    return docs.filter(score(F.coalesce(F.col(text), F.lit(""))) >= THRESHOLD)

"""Approximate vector search by cosine distance: an inverted file of product-quantised residuals, re-ranked exactly.

Fit, on a sample of SAMPLE_CELLS numbers at most (65,536 vectors of 64 dimensions; rows are taken by a hash of their
number): coarse centroids by k-means in one task, then, in a task for each group of SUB dimensions, 256 centres of what the
coarse centroid leaves of a vector.

Index, under one folder: ``vectors`` (row, id, v) of all rows, of length 1; ``codes`` (list, row, code), one byte for SUB
dimensions, in a folder for each coarse centroid; ``model``, one row.

Search: a query probes the lists of its nearest centroids.  How many is measured when the index is built: PROBED of the
vectors are compared with all rows, and the number is the least one whose lists hold the share TARGET of their neighbours.
Queries meet the codes of their lists by a join on the list; a long list, and one that many queries probe, is dealt into
parts.  Inner products with the centres add up to a query's estimates; the best ``limit`` * SHORTLIST rows by them, over all
lists, meet their vectors, and exact distances rank them.

Rows without an id or a vector, of length zero, or with null or non-finite components take no part; shorter vectors count
as padded with zeros.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernlake.operators.retrieval import ranked
from quernlake.sources.scratch import discard, written

SAMPLE_CELLS, SUB, ROUNDS = 1 << 22, 4, 8
#: Vectors of which the neighbours are known by a full scan, how many each, and the share that probed lists must hold.
PROBED, NEIGHBOURS, TARGET = 64, 10, 0.97
#: Rows by estimate for each row returned; rows of a list and queries of one that meet in one group.
SHORTLIST, LIST_ROWS, LIST_QUERIES = 20, 1 << 16, 1 << 12
SEED = 5


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists as rows of ``dims`` numbers; shorter ones end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means by Lloyd's rounds from distinct rows; a centre that loses all its rows stays."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    c = np.vstack([c, np.tile(c[:1], (k - len(c), 1))]) if len(c) < k else c
    for _ in range(ROUNDS):
        own = nearest_centre(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest_centre(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[a : a + 4096] @ c.T - half).argmax(1) for a in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


@dataclass
class Model:
    """Coarse centroids (lists by dims), centres of the residuals (groups by 256 by SUB), and lists to probe."""

    coarse: np.ndarray
    fine: np.ndarray
    probes: int = 1

    @property
    def dims(self) -> int:
        return self.coarse.shape[1]

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = nearest_centre(x, self.coarse)
        rest = x - self.coarse[lists]
        return lists, np.stack([nearest_centre(rest[:, g * SUB : (g + 1) * SUB], self.fine[g]) for g in range(len(self.fine))], axis=1).astype(np.uint8)

    def near_lists(self, q: np.ndarray) -> np.ndarray:
        """Lists of each query in order of their centroids' distance."""
        return np.argsort((self.coarse**2).sum(1) - 2 * q @ self.coarse.T, axis=1, kind="stable")

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Query by group by code: inner products with the residuals' centres."""
        return np.einsum("qgs,gcs->qgc", q.reshape(len(q), len(self.fine), SUB), self.fine)


def unit_rows(rows: DataFrame, key: str, vector: str, name: str = "id") -> DataFrame:
    """(name, v): ids, and vectors of length 1."""
    found = rows.select(F.col(key).alias(name), F.col(vector).cast("array<double>").alias("v")).filter(F.col(name).isNotNull() & (F.size("v") > 0))
    found = found.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return found.withColumn("norm", norm).select(name, F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def _fitted(rows: DataFrame, n: int, dims: int, lists: int) -> Model:
    limit = max(256, SAMPLE_CELLS // dims)
    share = int(min(1.0, limit / n) * (1 << 30))
    sample = written(rows.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < share).select("v"), "vectors-sample")

    def coarse(group: pa.Table) -> pa.Table:
        return pa.table({"g": pa.array([0], pa.int32()), "c": pa.array([centres(matrix(group.column("v"), dims), lists, SEED).tobytes()])})

    schema = "g int, c binary"
    first = np.frombuffer(sample.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(coarse, schema).first().c).reshape(-1, dims)

    def fine(key: tuple, group: pa.Table) -> pa.Table:
        g, x = key[0].as_py(), matrix(group.column("v"), dims)
        rest = x - first[nearest_centre(x, first)]
        return pa.table({"g": pa.array([g], pa.int32()), "c": pa.array([centres(rest[:, g * SUB : (g + 1) * SUB], 256, SEED + g).tobytes()])})

    spread = sample.select("v", F.explode(F.sequence(F.lit(0), F.lit(dims // SUB - 1))).alias("g"))
    found = sorted(spread.groupBy("g").applyInArrow(fine, schema).collect())
    discard(sample)
    return Model(first, np.stack([np.frombuffer(f.c).reshape(256, SUB) for f in found]))


def _probes(rows: DataFrame, model: Model) -> int:
    """Lists to probe so that TARGET of the true neighbours of PROBED rows lie in them."""
    asked = rows.orderBy(F.xxhash64("row"), "row").limit(PROBED).select("v").collect()
    q = matrix(pa.array([a.v for a in asked], pa.list_(pa.float64())), model.dims)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), model.dims)
            near = q @ x.T
            most = min(NEIGHBOURS + 1, x.shape[0])  # each finds itself
            best = np.argpartition(-near, most - 1, axis=1)[:, :most]
            own = nearest_centre(x, model.coarse)
            of = np.repeat(np.arange(len(q)), most)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(near[of, best.ravel()]), pa.array(own[best.ravel()], pa.int32())], ["query_id", "near", "list"])

    true = ranked(rows.select("v").mapInArrow(scan, "query_id int, near double, list int"), NEIGHBOURS + 1, F.desc("near"), F.col("list")).select("query_id", "list").collect()
    order = model.near_lists(q)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
    first = np.sort([place[t.query_id, t.list] for t in true])
    return int(first[int(np.ceil(TARGET * len(first))) - 1]) + 1


def build(chunks: DataFrame, path: str, key: str = "id", vector: str = "embedding") -> None:
    """Writes the index of chunks (key, vector) to ``path``."""
    spark = chunks.sparkSession
    unit_rows(chunks, key, vector).withColumn("row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/vectors")
    rows = spark.read.parquet(f"{path}/vectors")
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(SUB)).alias("dims")).first()
    dims = -(-facts.dims // SUB) * SUB
    if facts.n:
        lists = max(1, int(min(facts.n, SAMPLE_CELLS // dims) ** 0.5))
        model = _fitted(rows, facts.n, dims, lists)
        model.probes = _probes(rows, model)
    else:
        model = Model(np.zeros((1, dims)), np.zeros((dims // SUB, 256, SUB)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, codes = model.codes(matrix(batch.column("v"), dims))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), batch.column("row"), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "row", "code"])

    codes = rows.select("row", "v").mapInArrow(encode, "list int, row long, code binary")
    codes.repartition("list", F.pmod(F.xxhash64("row"), F.lit(4))).write.mode("overwrite").partitionBy("list").parquet(f"{path}/codes")
    arrays = io.BytesIO()
    np.savez(arrays, coarse=model.coarse, fine=model.fine, probes=model.probes)
    spark.createDataFrame([(bytearray(arrays.getvalue()),)], "model binary").write.mode("overwrite").parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> Model:
    arrays = np.load(io.BytesIO(spark.read.parquet(f"{path}/model").first().model))
    return Model(arrays["coarse"], arrays["fine"], int(arrays["probes"]))


def search(spark: SparkSession, path: str, queries: DataFrame, limit: int = 10, probes: int | None = None) -> DataFrame:
    """(query_id, id, distance, rank) of the ``limit`` rows nearest to each of queries (query_id, embedding; one vector each) that are found."""
    model = load(spark, path)
    probes, keep = min(probes or model.probes, len(model.coarse)), limit * SHORTLIST
    asked = written(unit_rows(queries, "query_id", "embedding", "query_id"), "vectors-asked")
    kind = asked.schema["query_id"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                q = matrix(part.column("v"), model.dims)
                lists = model.near_lists(q)[:, :probes]
                base = np.take_along_axis(q @ model.coarse.T, lists, axis=1)
                rows = part.take(pa.array(np.repeat(np.arange(len(q)), probes)))
                yield pa.RecordBatch.from_arrays([rows.column("query_id"), rows.column("v"), pa.array(lists.ravel(), pa.int32()), pa.array(base.ravel())], ["query_id", "v", "list", "base"])

    met = written(asked.mapInArrow(probe, f"query_id {kind}, v array<double>, list int, base double"), "vectors-probes")
    codes = spark.read.schema("row long, code binary, list int").parquet(f"{path}/codes").select("list", "row", "code")
    parts = lambda df, most, name: df.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    facts = written(parts(codes, LIST_ROWS, "parts").join(parts(met, LIST_QUERIES, "q_parts"), "list"), "vectors-lists")
    deal = lambda own, n: F.pmod(F.xxhash64(own), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = codes.join(facts, "list").select("list", deal("row", "parts").alias("part"), copies("q_parts").alias("q_part"), "row", "code")
    right = met.join(facts, "list").select("list", copies("parts").alias("part"), deal("query_id", "q_parts").alias("q_part"), "query_id", "v", "base")

    def estimate(there: pa.Table, here: pa.Table) -> pa.Table:
        groups = len(model.fine)
        code = np.frombuffer(b"".join(there.column("code").to_pylist()), np.uint8).reshape(-1, groups)
        at, most = [], min(keep, len(code))
        tables = model.tables(matrix(here.column("v"), model.dims)) if here.num_rows and len(code) else np.zeros((0, groups, 256))
        for table, base in zip(tables, here.column("base").to_pylist(), strict=False):
            near = base + sum(table[g][code[:, g]] for g in range(groups))
            best = np.argpartition(-near, most - 1)[:most]
            at.append((best, near[best]))
        of = pa.array(np.repeat(np.arange(len(at)), most), pa.int64())
        best = pa.array(np.concatenate([b for b, _ in at] or [np.zeros(0)]).astype(np.int64))
        return pa.table({"query_id": here.column("query_id").take(of), "row": there.column("row").take(best), "near": pa.array(np.concatenate([n for _, n in at] or [np.zeros(0)]))})

    keys = ["list", "part", "q_part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(estimate, f"query_id {kind}, row long, near double")
    short = ranked(found, keep, F.desc("near"), F.col("row")).select("query_id", "row")
    exact = short.join(spark.read.parquet(f"{path}/vectors"), "row").join(asked.select("query_id", F.col("v").alias("q")), "query_id")
    distance: Column = F.lit(1.0) - F.aggregate(F.zip_with("v", "q", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return ranked(exact.select("query_id", "id", distance.alias("distance")), limit, F.col("distance"), F.col("id"))

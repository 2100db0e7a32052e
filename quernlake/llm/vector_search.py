"""Operator 10: exact top-k inner products by columnar branch and bound.

Vectors become integers, floor(256 * x).  Candidates and queries are packed in blocks; each pair of a query block and a
candidate block is one row of a join on the query block's number, so the pairs spread over all tasks and neither side is
ever broadcast without Spark's own size check.  Inside a pair the candidates lie in vertical layout (dimension by
vector): scores accumulate a block of dimensions at a time, and after each one a query keeps only the candidates whose
score so far plus the bound on the remaining mass (the Cauchy-Schwarz product of the norms of what is left) can still
reach its k-th best.  The k best so far, and the bound they set, go on from one candidate block of a task to the next.
A ranking over each query's few finalists of each task ends the search.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
shorter vectors, empty ones too, count as padded with zeros; a query never meets its own row, but other rows of its id;
each row of a repeated id searches for itself; ties go to the smaller id; an empty table gives an empty result; extra
columns are dropped.  Scores are exact while they stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernlake.llm.common import discard, written

#: Rows of a packed block, and queries of it that are scored at once.
QUERY_BLOCK, CANDIDATE_BLOCK, SOME_QUERIES = 16_384, 4096, 256
DIMENSION_BLOCK = 16
#: Each query block stands in so many copies, so that few query blocks still spread over many tasks.
LANES = 32


def _integers(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and row numbers (two columns), and the matrix (vector by dimension) of the usable vectors."""
    ids = np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row")], axis=1)
    vectors = rows.column("v")
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(ids), int(sizes.max(initial=0))))
    out[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(256.0 * flat)
    return ids, out


def _prefixed(p: str) -> str:
    return f"{p}n int, {p}dims int, {p}ids binary, {p}cells binary"


def _cells(ids: np.ndarray, x: np.ndarray) -> list[pa.Array]:
    """A block's columns; cells: all vectors' first dimension, then the second...; 4 bytes each where that is exact."""
    kind = "<f4" if np.abs(x).max(initial=0) < 2**24 else "<f8"
    return [pa.array([len(ids)], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([np.ascontiguousarray(x.T, kind).tobytes()])]


def _packed(limit: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, limit):
                yield pa.RecordBatch.from_arrays(_cells(*_integers(batch.slice(at, limit))), ["n", "dims", "ids", "cells"])

    return pack


def _pack_group(key: tuple, rows: pa.Table) -> pa.Table:
    ids, x = _integers(rows.select(["id", "row", "v"]).combine_chunks().to_batches()[0])
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), *_cells(ids, x)], ["q_block", "q_n", "q_dims", "q_ids", "q_cells"])


def _unpacked(row: dict, p: str) -> tuple[np.ndarray, np.ndarray]:
    n, dims, cells = row[f"{p}n"], row[f"{p}dims"], row[f"{p}cells"]
    kind = "<f4" if len(cells) == 4 * n * dims else "<f8"
    return np.frombuffer(row[f"{p}ids"], "<i8").reshape(n, 2), np.frombuffer(cells, kind).reshape(dims, n).astype(np.float64)


def search_pair(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Branch and bound in one pair of blocks; q and c are dimension by vector, ids are (id, row). (place of the query, candidate's id, score) of the k best.

    ``floors``: scores that each query has reached k times already; what cannot reach them is left out at once.
    """
    floors = np.full(len(q_ids), -np.inf) if floors is None else floors
    (q_rows, c_rows), c_ids = (q_ids[:, 1], c_ids[:, 1]), c_ids[:, 0]
    dims = max(len(q), len(c))
    q, c = (np.vstack([x, np.zeros((dims - len(x), x.shape[1]))]) if len(x) < dims else x for x in (q, c))
    starts = list(range(0, dims, DIMENSION_BLOCK)) or [0]
    rest = lambda x: [np.sqrt((x[s + DIMENSION_BLOCK :] ** 2).sum(0)) * (1 + 1e-9) for s in starts]
    q_rest, c_rest = rest(q), rest(c)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(q_ids), SOME_QUERIES):
        first = q[:DIMENSION_BLOCK, a : a + SOME_QUERIES].T @ c[:DIMENSION_BLOCK]
        may = first + q_rest[0][a : a + SOME_QUERIES, None] * c_rest[0] >= floors[a : a + SOME_QUERIES, None] - 1e-6
        may &= c_rows != q_rows[a : a + SOME_QUERIES, None]
        for i in (a + np.flatnonzero(may.any(1))).tolist():
            alive = np.flatnonzero(may[i - a])
            score = first[i - a, alive]
            for b, s in enumerate(starts):
                if b:
                    block = slice(s, s + DIMENSION_BLOCK)
                    score = score + q[block, i] @ c[block, alive]
                bound, floor = q_rest[b][i] * c_rest[b][alive], floors[i]
                if len(alive) > k:
                    floor = max(floor, np.partition(score - bound, len(alive) - k)[len(alive) - k])
                keep = score + bound >= floor - 1e-6
                alive, score = alive[keep], score[keep]
            if len(alive) > k:
                best = np.lexsort((c_ids[alive], -score))[:k]
                alive, score = alive[best], score[best]
            out.append((np.full(len(alive), i), c_ids[alive], score))
    return tuple(np.concatenate([o[n] for o in out]) if out else np.zeros(0, kind) for n, kind in enumerate((np.int64, np.int64, float)))


class Best:
    """The k best finds so far of the queries of a block, ties to the smaller id."""

    def __init__(self, q_ids: np.ndarray, k: int):
        self.q_ids, self.k = q_ids, k
        self.at, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floors = np.full(len(q_ids), -np.inf)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        at, ids, scores = np.r_[self.at, at], np.r_[self.ids, ids], np.r_[self.scores, scores]
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        n = np.bincount(at, minlength=len(self.q_ids))
        place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        kept = place < self.k
        self.at, self.ids, self.scores = at[kept], ids[kept], scores[kept]
        last = place == self.k - 1
        self.floors[at[last]] = scores[last]

    def rows(self) -> pa.RecordBatch:
        columns = (*self.q_ids[self.at].T, self.ids, np.rint(self.scores).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "q_row", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``: (query_id, rank, vec_id, score) of its ``k`` best other rows.

    Runs one count of the queries first, which sets the number of query blocks.
    """
    usable = (
        vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull())
        .filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    )
    # rows are numbered, and written so that the numbers hold
    usable = written(usable.select("id", F.monotonically_increasing_id().alias("row"), "v"), "search-rows")
    queries = usable.filter(F.col("id") % every == 0)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    packed = queries.groupBy(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("q_block")).applyInArrow(_pack_group, f"q_block int, {_prefixed('q_')}")
    packed = packed.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    candidates = usable.mapInArrow(_packed(CANDIDATE_BLOCK), _prefixed(""))
    candidates = candidates.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(LANES)).cast("int")).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q_ids, q = _unpacked(row, "q_")
                if best is None or row["q_block"] != block:  # rows of one query block stand together where Spark sorted them
                    if best is not None:
                        yield best.rows()
                    block, best = row["q_block"], Best(q_ids, k)
                best.add(*search_pair(q_ids, q, *_unpacked(row, ""), k, best.floors))
        if best is not None:
            yield best.rows()

    pairs = candidates.join(packed, ["q_block", "lane"]).drop("lane")
    best = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.mapInArrow(search, "query_id long, q_row long, vec_id long, score long").withColumn("rank", F.row_number().over(best))
    out = written(ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "search-found")
    discard(usable)
    return out


#: DuckDB SQL for top_k(embeddings).
ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id AS id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.id AS query_id, c.id AS vec_id, CAST(CASE WHEN len(q.e) = 0 OR len(c.e) = 0 THEN 0 ELSE list_dot_product(q.e, c.e) END AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""

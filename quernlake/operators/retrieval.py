"""Hybrid retrieval: exact dense search, lexical search, weighted rank fusion, interleaving and budgets.

All work on batches of questions: a ``query_id`` column partitions every ranking.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import FloatType

from quernlake.operators import term_blocks
from quernlake.operators.ordered import running
from quernlake.sources.scratch import written

#: Candidates of each leg, fusion constant and weights, results, context budget in characters.
CANDIDATES, RRF_K, DENSE_WEIGHT, LEXICAL_WEIGHT, TOP_K, CONTEXT_CHARACTERS = 50, 60, 0.7, 0.3, 12, 30_000
#: Vectors of a packed block of queries and of candidates, and lanes of candidate blocks at most where only tasks are wanted.
QUERY_BLOCK, CANDIDATE_BLOCK, LANES = 512, 2048, 16
#: Bytes of the query blocks of a group, and of the candidate blocks of a lane, which a task holds both.
GROUP_BYTES, LANE_BYTES = 4 << 20, 16 << 20
#: Function words that queries drop.
STOP_WORDS = tuple(
    "از اگر اما ان این با بر برای به بود تا چه چرا چطور چگونه در را روی شد شده شما شود کجا کدام که ما من می و یا یک است باشد هست هستند "
    "a am an and any are as at be been but by can did do does for from get had has have how i if in into is it its me my of on or should so that the their them then there these they this to was we were what when where which who why will with would you your".split()
)
EDGE_PUNCTUATION = "!\"'(),.:;<>?[\\]{}،؛؟«»…"


def dense_search(chunks: DataFrame, queries: DataFrame, limit: int = CANDIDATES, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank) by cosine distance: the best of a query's variants, ``limit`` results.

    ``queries`` is (query_id, embedding); several rows of one query are its variants.  Blocks of queries and of candidates
    are written, and meet in groups of query blocks and lanes of candidate blocks, so many that a task's share does not grow
    with either; of a query, a lane gives out only its best, of equal distances the smaller ids, and a query block's lanes
    are merged before there are rows.  Vectors that are null, of another dimension, or hold null or non-finite components
    take no part.
    """
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))

    def vectors(rows: DataFrame, name: str, column: str) -> tuple[DataFrame, str]:
        """(id, v) and numpy's type of the components, which stay floats if they are."""
        single = isinstance(rows.schema[column].dataType.elementType, FloatType)
        kept = rows.select(F.col(name).alias("id"), F.col(column).cast("array<float>" if single else "array<double>").alias("v"))
        return kept.filter((F.size("v") > 0) & sound), "<f4" if single else "<f8"

    (asked, q_type), (usable, c_type) = vectors(queries, "query_id", "embedding"), vectors(chunks, key, vector)
    kinds = [f.schema["id"].dataType.simpleString() for f in (asked, usable)]
    id_types = [to_arrow_type(f.schema["id"].dataType) for f in (asked, usable)]

    def packed(rows: DataFrame, limit: int, id_type: pa.DataType, kind: str, number: str, tag: str) -> tuple[DataFrame, int, int]:
        """(block, dims, ids, cells) of vectors, how many blocks, and their bytes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.take(pc.sort_indices(batch.column(0)))  # so that of equal distances the first is the smaller id
                lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for n in np.unique(lengths):
                    rows = np.flatnonzero(lengths == n)
                    for at in range(0, len(rows), limit):
                        part = batch.take(pa.array(rows[at : at + limit]))
                        cells = np.ascontiguousarray(part.column(1).flatten().to_numpy(zero_copy_only=False), number).tobytes()
                        ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0).cast(id_type))
                        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), ids, pa.array([cells])], ["dims", "ids", "cells"])

        blocks = rows.mapInArrow(run, f"dims int, ids array<{kind}>, cells binary").select(F.monotonically_increasing_id().alias("block"), "*")
        blocks = written(blocks, tag, options=term_blocks.LARGE_CELLS)
        size = blocks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("cells")), F.lit(0)).alias("bytes")).first()
        return blocks, size.n, size.bytes

    def unpacked(cells: pa.Scalar, dims: int, number: str) -> np.ndarray:
        found = np.frombuffer(cells.as_buffer(), number).reshape(-1, dims).astype(np.float64)
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)

    def first_of(query: np.ndarray, far: np.ndarray, ids: pa.Array) -> np.ndarray:
        """Which rows are the ``limit`` nearest of their query, in order of queries; of equal distances the smaller ids."""
        order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        order = np.lexsort((place, far, query))
        new = np.flatnonzero(np.diff(query[order], prepend=-1))
        return order[np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order)))) < limit]

    def meet(here: pa.Table, there: pa.Table) -> pa.Table:
        """A group of query blocks meets a lane of candidate blocks: a row for each query block."""
        rows = []
        candidates = list(term_blocks.cells(there))
        for own in term_blocks.cells(here) if candidates else ():
            dims = own["dims"].as_py()
            q = unpacked(own["cells"], dims, q_type)
            nearest, found = np.full((limit, len(q)), np.inf), []
            for i, other in enumerate(candidates):
                far = 1.0 - unpacked(other["cells"], dims, c_type) @ q.T
                kept = min(limit, len(far))
                best = np.partition(far, kept - 1, axis=0)[:kept]
                edge = best[-1]
                ties = far == edge
                stay = (far < edge) | ties & (np.cumsum(ties, axis=0, dtype=np.int32) <= kept - (far < edge).sum(0))
                nearest = np.partition(np.vstack([nearest, best]), limit - 1, axis=0)[:limit]  # variants of a query have bounds of their own
                row, column = np.nonzero(stay & (far <= nearest[-1]))
                found.append((np.full(len(row), i), row, column, far[row, column]))
            block, row, column, far = (np.concatenate(x) for x in zip(*found, strict=True))
            stay = far <= nearest[-1][column]
            block, row, column, far = block[stay], row[stay], column[stay], far[stay]
            ids = pa.concat_arrays([other["ids"].values.take(pa.array(row[block == i])).cast(id_types[1]) for i, other in enumerate(candidates)])  # block by block, as they stand
            first = first_of(column, far, ids)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (own["ids"].values.cast(id_types[0]), ids.take(pa.array(first)))]
            cells = [pa.array([x.tobytes()]) for x in (column[first].astype("<i4"), far[first].astype("<f8"))]
            rows.append(pa.RecordBatch.from_arrays([pa.array([own["block"].as_py()], pa.int64()), *lists, *cells], schema.names))
        return pa.Table.from_batches(rows, schema)

    def merged(lanes: pa.Table) -> pa.Table:
        """The lanes of one query block to rows of its queries' nearest."""
        rows = list(term_blocks.cells(lanes))
        query, far = (np.concatenate([np.frombuffer(r[c].as_buffer(), kind) for r in rows]) for c, kind in (("query", "<i4"), ("far", "<f8")))
        ids = pa.concat_arrays([r["ids"].values for r in rows])
        first = first_of(query, far, ids)
        return pa.table([rows[0]["q_ids"].values.take(pa.array(query[first])), ids.take(pa.array(first)), pa.array(far[first])], ["query_id", "id", "distance"])

    schema = pa.schema([("block", pa.int64()), ("q_ids", pa.list_(id_types[0])), ("ids", pa.list_(id_types[1])), ("query", pa.binary()), ("far", pa.binary())])
    (here, _, q_bytes), (there, c_blocks, c_bytes) = packed(asked, QUERY_BLOCK, id_types[0], kinds[0], q_type, "dense-queries"), packed(usable, CANDIDATE_BLOCK, id_types[1], kinds[1], c_type, "dense-candidates")
    groups = max(1, -(-q_bytes // GROUP_BYTES))
    spread = min(LANES, -(-4 * chunks.sparkSession.sparkContext.defaultParallelism // groups), c_blocks)
    lanes = max(1, spread, -(-c_bytes // LANE_BYTES))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    here, there = here.withColumn("group", deal(groups)).withColumn("lane", all_of(lanes)), there.withColumn("lane", deal(lanes)).withColumn("group", all_of(groups))
    by = ["dims", "lane", "group"]
    here, there = (x.repartition(2 * groups * lanes, *by) for x in (here, there))  # small shares of much work are not to be joined in a task
    pairs = here.groupBy(*by).cogroup(there.groupBy(*by)).applyInArrow(meet, f"block long, q_ids array<{kinds[0]}>, ids array<{kinds[1]}>, query binary, far binary")
    nearest = pairs.groupBy("block").applyInArrow(merged, f"query_id {kinds[0]}, id {kinds[1]}, distance double")
    variants = nearest.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return ranked(variants, limit, F.col("distance"), F.col("id"))


def ranked(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """Adds ``rank`` from 1 within each query and keeps the first ``limit``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= limit)


def or_terms(query: Column) -> Column:
    """The words of a query without function words; edge punctuation counts only for that test."""
    bare = lambda w: F.lower(F.btrim(w, F.lit(EDGE_PUNCTUATION)))
    stop = F.array(*map(F.lit, STOP_WORDS))
    words = F.filter(F.split(query, r"(?U)\s+"), lambda w: w != "")
    return F.filter(words, lambda w: (bare(w) != "") & ~F.array_contains(stop, bare(w)))


def or_query(query: Column) -> Column:
    return F.array_join(or_terms(query), " OR ")


def lexemes(text: Column) -> Column:
    """Lower-cased words in order: runs of letters, digits and underscores are cut at underscores, too."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


#: Fixed value: what a cover adds to a chunk's score.
WEIGHT = 0.1


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, size, distinct, place, lexeme): the lexemes of each term of queries (query_id, query), a term once each."""
    terms = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.transform(or_terms(F.col("query")), lexemes), lambda t: F.size(t) > 0))).alias("term")).distinct()
    return terms.select("query_id", "term", F.size("term").alias("size"), F.size(F.array_distinct("term")).alias("distinct"), F.posexplode("term").alias("place", "lexeme"))


def lexical_search(chunks: DataFrame, queries: DataFrame, limit: int = CANDIDATES, key: str = "id", text: str = "text") -> DataFrame:
    """(query_id, id, score, rank): chunks that hold any term, by WEIGHT for each cover.

    ``queries`` is (query_id, query).  A term of one lexeme covers each of its positions; one of several lexemes, as
    ``max_body_size``, covers a run of positions that hold them in order.  Blocks of chunks meet packed queries (see
    ``term_blocks``).  This scans all chunks; ``lexical_index`` searches a written index.
    """
    terms = query_terms(queries).select("query_id", "term").distinct()
    found = term_blocks.ranked_covers(chunks, terms, limit, lexemes, key, text)
    return ranked(found.select("query_id", "id", (F.col("n") * F.lit(WEIGHT)).alias("score")), limit, F.desc("score"), F.col("id"))


def phrase_positions(text: Column, phrase: Sequence[str]) -> Column:
    """How often the lexemes of ``phrase`` stand in a row."""
    words = lexemes(text)
    starts = F.transform(words, lambda _, i: F.slice(words, i + 1, len(phrase)) == F.array(*map(F.lit, phrase)))
    return F.size(F.filter(starts, lambda hit: hit))


def fuse(dense: DataFrame, lexical: DataFrame, top_k: int = TOP_K, rrf_k: int = RRF_K, dense_weight: float = DENSE_WEIGHT, lexical_weight: float = LEXICAL_WEIGHT) -> DataFrame:
    """(query_id, id, score, dense_rank, lexical_rank, rank): weighted reciprocal ranks of two legs (query_id, id, rank)."""
    legs = dense.select("query_id", "id", F.col("rank").alias("dense_rank")).join(lexical.select("query_id", "id", F.col("rank").alias("lexical_rank")), ["query_id", "id"], "full")
    part = lambda rank, weight: F.coalesce(F.lit(weight) / (F.lit(rrf_k) + F.col(rank)), F.lit(0.0))
    scored = legs.withColumn("score", part("dense_rank", dense_weight) + part("lexical_rank", lexical_weight))
    return ranked(scored, top_k, F.desc("score"), F.least("dense_rank", "lexical_rank"), F.col("id"))


def interleave(runs: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """(query_id, id, run, position): round robin over the runs of a query (run, rank, id), each id once."""
    first = runs.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("rank", "run"))).filter("__n = 1")
    order = Window.partitionBy("query_id").orderBy("rank", "run")
    return first.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top_k).select("query_id", "id", "run", "position")


def within_budget(rows: DataFrame, size: Column, budget: int = CONTEXT_CHARACTERS, order: str = "position", number: str = "__n") -> DataFrame:
    """The longest prefix of each query's rows whose sizes fit the budget; the first row always stays.

    ``number``: if given, the name of a column for the row's number in its query.
    """
    found = running(rows, "query_id", order, size, "__sum", number, budget)
    return found.filter((F.col("__sum") <= budget) | (F.col(number) == 1)).drop("__sum", "__n")


def first_by(rows: DataFrame, column: str, order: str = "position") -> DataFrame:
    """The first row of each value of ``column`` within a query."""
    window = Window.partitionBy("query_id", column).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def citation_numbers(rows: DataFrame, url: str = "cite_url", order: str = "position") -> DataFrame:
    """Adds ``number``: sources of one URL share the number of its first appearance."""
    first = rows.groupBy(F.col("query_id").alias("__q"), F.col(url).alias("__u")).agg(F.min(order).alias("__first"))
    first = first.withColumn("number", F.dense_rank().over(Window.partitionBy("__q").orderBy("__first"))).drop("__first")
    return rows.join(first, F.col("query_id").eqNullSafe(F.col("__q")) & F.col(url).eqNullSafe(F.col("__u"))).drop("__q", "__u")


def evidence_summary(rows: DataFrame) -> DataFrame:
    """(query_id, sources, pages, defects) of bound sources (path, defective)."""
    return rows.groupBy("query_id").agg(F.count("*").alias("sources"), F.count_distinct("path").alias("pages"), F.count_if("defective").alias("defects"))


def top_value(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each group; the one seen first wins ties."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "first"))).filter("__n = 1").drop("__n", "first")

"""Operator 11: approximate nearest neighbours by a forest of random-projection trees with one shared priority queue.

Fit: on a bounded sample (``SAMPLE_CELLS`` numbers, so 65,536 vectors of 64 dimensions) each of TREES trees is grown in a
task of its own: a node's plane is the normalised difference of two of its sample vectors, and the median of their
projections is where it cuts.  So that the largest inner product is the nearest vector, vectors stand with one more
coordinate, sqrt(M^2 - |x|^2) for the largest norm M (0 for a query).

Index: every row goes down every tree; its leaves are written, grouped in lanes (runs of neighbouring leaves of a tree, of
some LANE_ROWS rows; a lane that holds more, as many copies of one vector make it, is dealt into parts).

Search: all leaves of all trees wait in one queue, first those with the least sum of squared distances to the planes that
part them from the query; since that sum only grows on the way down, the order in which a queue of nodes would pop leaves
is the order of their sums, which is taken at once for a batch of queries.  Each query pops the same number of leaves.
That number is measured, not guessed: ASKED of the queries are searched by a full scan, and it is the least one that
finds the share TARGET of their true neighbours.  Queries meet the lanes of their leaves by a join; in each lane the
candidates of the popped leaves are ranked by their exact inner products, and a ranking of each query's finds, once each,
ends the search.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without
an id; shorter vectors count as padded with zeros; a query never meets its own row, but other rows of its id; each row
of a repeated id searches for itself; ties go to the smaller id; an empty table gives an empty result; extra columns are
dropped.  Scores are sums in order of the dimensions, in doubles.

Scale: the driver holds the trees (TREES * leaves * dimensions, bounded by the sample) and ASKED queries with their
neighbours; vectors themselves are shuffled once for each tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernlake.llm.common import discard, written

TREES = 8
#: Numbers in the sample on which trees are fitted; rows of a leaf, where the sample allows it, and sample rows of one at least.
SAMPLE_CELLS, LEAF_ROWS, LEAF_SAMPLE = 1 << 22, 192, 8
#: Rows of a lane, and queries of one, that meet in one group.
LANE_ROWS, LANE_QUERIES = 1 << 15, 1 << 14
#: Queries searched by a full scan to set the effort, and the share of their neighbours that it must find.
ASKED, TARGET = 64, 0.95
SEED = 11


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of an Arrow column of lists as a matrix of ``dims`` columns; shorter ones end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Candidates with the coordinate that gives all of them the norm ``norm``."""
    return np.c_[x, np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))]


def aimed(q: np.ndarray, norm: float) -> np.ndarray:
    """Queries of the norm ``norm``, without a part in the further coordinate."""
    return np.c_[q * (norm / np.linalg.norm(q, axis=1, keepdims=True)), np.zeros(len(q))]


@dataclass
class Forest:
    """Trees as levels of planes: planes[t][l] is (2**l, dims + 1), cuts[t][l] is (2**l,)."""

    dims: int
    norm: float
    planes: list[list[np.ndarray]]
    cuts: list[list[np.ndarray]]

    @property
    def depth(self) -> int:
        return len(self.cuts[0])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree, for lifted vectors."""
        out = np.zeros((len(x), len(self.planes)), np.int64)
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts, strict=True)):
            for p, c in zip(planes, cuts, strict=True):
                at = out[:, t]
                out[:, t] = 2 * at + (np.einsum("ij,ij->i", x, p[at]) >= c[at])
        return out

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Query by leaf of all trees: what the shared queue goes by."""
        out = []
        for planes, cuts in zip(self.planes, self.cuts, strict=True):
            far = np.zeros((len(q), 1))
            for p, c in zip(planes, cuts, strict=True):
                margin = q @ p.T - c
                sides = np.stack([np.maximum(margin, 0), np.maximum(-margin, 0)], axis=2)
                far = (far[:, :, None] + sides**2).reshape(len(q), -1)
            out.append(far)
        return np.hstack(out)


def grown(x: np.ndarray, depth: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Planes and cuts of a tree on lifted sample vectors."""
    rng = np.random.default_rng(seed)
    at, planes, cuts = np.zeros(len(x), np.int64), [], []
    for level in range(depth):
        nodes = 1 << level
        order = np.argsort(at, kind="stable")
        n = np.bincount(at, minlength=nodes)
        begin = np.cumsum(n) - n
        pick = lambda: order[np.minimum(begin + (rng.random(nodes) * n).astype(np.int64), len(x) - 1)]  # noqa: E731, B023
        p = x[pick()] - x[pick()]
        size = np.linalg.norm(p, axis=1, keepdims=True)
        p = np.where(size > 1e-9, p, rng.normal(size=p.shape))  # equal vectors, or a node without any
        p = (p / np.linalg.norm(p, axis=1, keepdims=True)).astype(np.float32)
        place = np.einsum("ij,ij->i", x, p[at])
        by = np.lexsort((place, at))
        c = np.where(n > 0, place[by][np.minimum(begin + n // 2, len(x) - 1)], 0.0)
        planes.append(p)
        cuts.append(c)
        at = 2 * at + (place >= c[at])
    return planes, cuts


def usable_rows(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, id, v): the rows that take part, numbered; written, so that the numbers hold."""
    found = (
        vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        .filter(F.col("id").isNotNull() & (F.size("v") > 0))
        .filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    )
    return written(found.withColumn("row", F.monotonically_increasing_id()), "forest-rows")


def fit(rows: DataFrame, trees: int = TREES) -> Forest | None:
    """The forest for (row, id, v); None for an empty table."""
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most")).first()
    if not facts.n:
        return None
    dims, norm, limit = facts.dims, float(np.sqrt(facts.most)) or 1.0, max(64, SAMPLE_CELLS // facts.dims)
    depth = max(0, int(np.log2(min(facts.n / LEAF_ROWS, min(facts.n, limit) / LEAF_SAMPLE))) if facts.n > LEAF_ROWS else 0)
    share = min(1.0, limit / facts.n)
    sample = rows.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))

    def one(key: tuple, group: pa.Table) -> pa.Table:
        tree = key[0].as_py()
        planes, cuts = grown(lifted(matrix(group.column("v").combine_chunks(), dims), norm), depth, SEED + tree)
        flat = [np.concatenate([a.ravel() for a in x] or [np.zeros(0)]) for x in (planes, cuts)]
        return pa.table({"tree": pa.array([tree], pa.int32()), "planes": pa.array([flat[0].astype("<f4").tobytes()]), "cuts": pa.array([flat[1].astype("<f8").tobytes()])})

    models = sorted(sample.groupBy("tree").applyInArrow(one, "tree int, planes binary, cuts binary").collect())
    planes, cuts = [], []
    for m in models:
        p, c = np.frombuffer(m.planes, "<f4").reshape(-1, dims + 1), np.frombuffer(m.cuts, "<f8")
        planes.append([p[(1 << level) - 1 : (2 << level) - 1] for level in range(depth)])
        cuts.append([c[(1 << level) - 1 : (2 << level) - 1] for level in range(depth)])
    return Forest(dims, norm, planes, cuts) if models else None


def index(rows: DataFrame, forest: Forest) -> DataFrame:
    """(tree, leaf, row, id, v) of every row in every tree, written."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                leaves = forest.leaves(lifted(matrix(part.column("v"), forest.dims), forest.norm))
                for t in range(leaves.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, t), pa.int32()), pa.array(leaves[:, t], pa.int32()), *(part.column(c) for c in ("row", "id", "v"))], ["tree", "leaf", "row", "id", "v"])

    return written(rows.select("row", "id", "v").mapInArrow(place, "tree int, leaf int, row long, id long, v array<double>"), "forest-index")


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of equal place, summed in order of the dimensions."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * c[:, d]
    return out


class Finds:
    """The k best rows so far of each query of a group, ties to the smaller id (then row)."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query, self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floors = np.full(n, -np.inf)

    def add(self, query: np.ndarray, row: np.ndarray, ident: np.ndarray, score: np.ndarray) -> None:
        query, row, ident, score = np.r_[self.query, query], np.r_[self.row, row], np.r_[self.id, ident], np.r_[self.score, score]
        order = np.lexsort((row, ident, -score, query))
        query, row, ident, score = query[order], row[order], ident[order], score[order]
        n = np.bincount(query, minlength=self.n)
        place = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)
        kept, last = place < self.k, place == self.k - 1
        self.floors[query[last]] = score[last]
        self.query, self.row, self.id, self.score = query[kept], row[kept], ident[kept], score[kept]


def no_more_copies(x: np.ndarray, rows: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places, by id, of at most ``most`` rows of each distinct vector, those of smallest id: no other copy can be among the best."""
    by = np.lexsort((rows, ids))
    _, group = np.unique(np.ascontiguousarray(x[by] + 0.0).view(np.dtype((np.void, 8 * x.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    n = np.bincount(group)
    place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
    return by[np.sort(order[place < most])]


def in_leaf(finds: Finds, asked: np.ndarray, q: np.ndarray, q_rows: np.ndarray, c: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
    """Ranks the rows of a leaf for the queries at the places ``asked``."""
    for at in range(0, len(asked), 1024):
        own = asked[at : at + 1024]
        near = q[own] @ c.T
        near[q_rows[own][:, None] == rows] = -np.inf
        slack = 1e-12 * (1 + np.abs(near, where=near > -np.inf, out=np.zeros_like(near)).max(initial=0)) * q.shape[1]
        floor = finds.floors[own]
        if c.shape[0] > finds.k and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(near, len(rows) - finds.k, axis=1)[:, len(rows) - finds.k])
        i, j = np.nonzero((near >= floor[:, None] - slack) & (near > -np.inf))
        if len(i):
            finds.add(own[i], rows[j], ids[j], exact_scores(q[own[i]], c[j]))


def effort(rows: DataFrame, queries: DataFrame, forest: Forest, k: int) -> int:
    """Leaves a query must pop so that TARGET of the true neighbours of ASKED queries are found, by a full scan for these."""
    sample = queries.orderBy(F.xxhash64("row"), "row").limit(ASKED).collect()
    if not sample:
        return 1
    q_rows = np.array([r.row for r in sample])
    q = np.array([[*r.v, *([0.0] * (forest.dims - len(r.v)))] for r in sample])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finds = Finds(len(q), k)
        vectors: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, rows, ids = matrix(part.column("v"), forest.dims), part.column("row").to_numpy(), part.column("id").to_numpy()
                kept = no_more_copies(x, rows, ids, k + 1)
                in_leaf(finds, np.arange(len(q)), q, q_rows, x[kept], rows[kept], ids[kept])
                own = dict(zip(rows.tolist(), x, strict=True))
                vectors = {r: own[r] if r in own else vectors[r] for r in set(finds.row.tolist())}
        yield pa.RecordBatch.from_arrays([pa.array(finds.query, pa.int64()), pa.array(finds.row, pa.int64()), pa.array(finds.id, pa.int64()), pa.array(finds.score), pa.array([vectors[r].tolist() for r in finds.row.tolist()], pa.list_(pa.float64()))], ["query", "row", "id", "score", "v"])

    found = rows.select("row", "id", "v").mapInArrow(scan, "query long, row long, id long, score double, v array<double>")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    true = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query", "v").collect()
    if not true:
        return 1
    far = forest.distances(aimed(q, forest.norm))
    place = np.empty(far.shape, np.int64)
    np.put_along_axis(place, np.argsort(far, axis=1, kind="stable"), np.arange(far.shape[1])[None], axis=1)
    leaves = forest.leaves(lifted(np.array([t.v for t in true]), forest.norm)) + np.arange(len(forest.planes)) * (1 << forest.depth)
    first = np.sort(place[np.array([t["query"] for t in true])[:, None], leaves].min(1))  # the pop that finds each of them
    return int(first[min(len(first) - 1, int(np.ceil(TARGET * len(first))) - 1)]) + 1


def search(indexed: DataFrame, queries: DataFrame, forest: Forest, leaves: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows that each of ``queries`` (row, id, v) finds in so many leaves."""
    size, trees = 1 << forest.depth, len(forest.planes)
    # lanes: 2**cut neighbouring leaves of a tree
    n = indexed.count() // trees
    cut = max(0, forest.depth - int(np.ceil(np.log2(max(1, n / LANE_ROWS)))))
    lane = lambda t, leaf: t * (size >> cut) + (leaf >> cut)

    def pop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                far = forest.distances(aimed(matrix(part.column("v"), forest.dims), forest.norm))
                popped = np.sort(np.argsort(far, axis=1, kind="stable")[:, :leaves], axis=1)
                tree, leaf = np.divmod(popped, size)
                lanes = lane(tree, leaf)
                new = np.c_[np.ones((len(lanes), 1), bool), lanes[:, 1:] != lanes[:, :-1]]
                begin = np.flatnonzero(new.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, popped.size], pa.int32()), pa.array(leaf.ravel(), pa.int32()))
                own = part.take(pa.array(begin // popped.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(lanes.ravel()[begin], pa.int32()), own.column("row"), own.column("id"), own.column("v"), lists], ["lane", "q_row", "q_id", "q_v", "leaves"])

    asked = written(queries.select("row", "id", "v").mapInArrow(pop, "lane int, q_row long, q_id long, q_v array<double>, leaves array<int>"), "forest-asked")
    at = (F.col("tree") * (size >> cut) + F.shiftright("leaf", cut)).alias("lane")
    parts = lambda df, by, most, name: df.groupBy(by).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    facts = parts(indexed, at, LANE_ROWS, "parts").join(parts(asked, F.col("lane"), LANE_QUERIES, "q_parts"), "lane")
    facts = written(facts, "forest-lanes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.withColumn("lane", at).join(facts, "lane").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).withColumn("q_part", every("q_parts"))
    right = asked.join(facts, "lane").withColumn("q_part", F.pmod(F.xxhash64("q_row"), F.col("q_parts")).cast("int")).withColumn("part", every("parts"))

    def meet(there: pa.Table, here: pa.Table) -> pa.Table:
        q_rows, q_ids, q = here.column("q_row").to_numpy(), here.column("q_id").to_numpy(), matrix(here.column("q_v").combine_chunks(), forest.dims)
        lists = here.column("leaves").combine_chunks()
        of, wanted = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        order = np.argsort(wanted, kind="stable")
        of, wanted = of[order], wanted[order]
        x, leaf = matrix(there.column("v").combine_chunks(), forest.dims), there.column("leaf").to_numpy()
        rows, ids = there.column("row").to_numpy(), there.column("id").to_numpy()
        order = np.argsort(leaf, kind="stable")
        finds = Finds(len(q), k)
        starts = np.flatnonzero(np.r_[True, leaf[order][1:] != leaf[order][:-1]]) if len(order) else []
        for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
            own = of[slice(*np.searchsorted(wanted, [leaf[order[a]], leaf[order[a]] + 1]))]
            if len(own):
                mine = order[a:b]
                mine = mine[no_more_copies(x[mine], rows[mine], ids[mine], k + 1)]
                in_leaf(finds, own, q, q_rows, x[mine], rows[mine], ids[mine])
        return pa.table({"q_row": pa.array(q_rows[finds.query], pa.int64()), "query_id": pa.array(q_ids[finds.query], pa.int64()), "row": pa.array(finds.row, pa.int64()), "vec_id": pa.array(finds.id, pa.int64()), "score": pa.array(finds.score)})

    keys = ["lane", "part", "q_part"]
    found = left.select(*keys, "leaf", "row", "id", "v").groupBy(*keys).cogroup(right.select(*keys, "q_row", "q_id", "q_v", "leaves").groupBy(*keys))
    found = found.applyInArrow(meet, "q_row long, query_id long, row long, vec_id long, score double").dropDuplicates(["q_row", "row"])
    best = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    out = written(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "forest-found")
    discard(asked, facts)
    return out


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``: (query_id, rank, vec_id, score) of the ``k`` nearest other rows found."""
    rows = usable_rows(vectors, key, vector)
    forest = fit(rows)
    if forest is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    indexed = index(rows, forest)
    queries = rows.filter(F.col("id") % every == 0)
    leaves = effort(rows, queries, forest, k)
    found = search(indexed, queries, forest, leaves, k)
    discard(indexed, rows)
    return found

"""Operator 12: ranked lexical search by WAND in shards of documents.

Index: each task turns its documents into shards of some SHARD_BYTES of text; a shard has one row for its documents (ids,
lengths) and one for each term with its posting list (places of documents in order, and occurrences).  It is written once,
and knows nothing of the questions.

Statistics: N and L are sums over the shards' rows, a term's document frequency the sum of its lists' lengths, both over all
documents.

Search: terms of the items join their lists; each shard meets the items in blocks.  In a shard an item's terms stand as
cursors in order of their current document.  The pivot is the first cursor at which the terms' largest impacts in this
shard add up to what the heap's worst document has; no document before the pivot's can reach the heap, so all cursors
before it go on to that document by binary search, or, when they stand there already, it is scored.  The heap starts from
a score that enough documents reach by one term alone.  Ties go to the smaller id, so documents of a shard are in order of
their ids, and only a document that can beat the heap's worst is looked at.  The heaps of all shards are merged by a ranking.

Defined cases: null texts have no terms; an item or document without terms has no rows; items and documents are rows, so
that each row of a repeated id stands for itself; documents without an id rank behind all others of their score; items
without an id are answered with a null one; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlake.llm.common import discard, spans, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same on UTF-8: A-Z lower-cased, and a space for each byte that is in no term.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Text of a shard, rows of one at most, and items that meet a shard at once.
SHARD_BYTES, SHARD_ROWS, ITEM_BLOCK = 24_000_000, 1 << 16, 256


def terms_of(text: Column) -> Column:
    """All terms of a text, with repeats."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({TERM})"))


class Codes(dict):
    """Numbers of words in the order in which they first came."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def shard_rows(ids: list, texts: list[bytes], name: int) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: first its documents, then a posting list for each term."""
    # by id, null last, so that of equal scores the first is the one to keep
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
    of = Codes()
    codes, sizes = [], []
    for i in order:
        words = texts[i].translate(TERM_BYTES).split()
        sizes.append(len(words))
        codes.append(np.fromiter(map(of.__getitem__, words), np.int64, len(words)))
    sizes = np.array(sizes, np.int64)
    pairs = np.concatenate(codes or [np.zeros(0, np.int64)]) * len(ids) + np.repeat(np.arange(len(ids)), sizes)
    pairs.sort()
    begin = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
    tf = np.diff(np.r_[begin, len(pairs)])
    term, doc = np.divmod(pairs[begin], max(1, len(ids)))
    begin = np.searchsorted(term, np.arange(len(of) + 1))
    yield _batch([name], [None], [[ids[i] for i in order]], [len(ids)], [sizes.astype("<i8").tobytes()], [None], [int((sizes > 0).sum())], [int(sizes.sum())])
    if len(of):
        lists = [pa.Array.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer((4 * begin).astype("<i8").tobytes()), pa.py_buffer(x.astype("<i4").tobytes())]).cast(pa.binary()) for x in (doc, tf)]
        none = [pa.nulls(len(of), t) for t in (pa.list_(pa.int64()), pa.int64())]
        rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(of), name), pa.int64()), pa.array(list(of), pa.binary()).cast(pa.string()), none[0], pa.array(np.diff(begin), pa.int32()), *lists, none[1], none[1]], NAMES)
        yield from (rows.slice(a, 50_000) for a in range(0, len(of), 50_000))


SHARDS = "shard long, term string, ids array<long>, n int, places binary, tfs binary, with_terms long, all_terms long"
NAMES = [x.split()[0] for x in SHARDS.split(", ")]


def _batch(*columns: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], NAMES)


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The shards of all documents, written: documents where ``term`` is null, else a posting list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 24, 0
        ids, texts, size = [], [], 0
        for batch in batches:
            for a, b in spans(batch.column(1), SHARD_BYTES // 4):
                part = batch.slice(a, b - a)
                ids += part.column(0).to_pylist()
                texts += part.column(1).cast(pa.binary()).to_pylist()
                size += part.column(1).nbytes
                if size >= SHARD_BYTES or len(ids) >= SHARD_ROWS:
                    yield from shard_rows(ids, texts, base + made)
                    ids, texts, size, made = [], [], 0, made + 1
        if ids:
            yield from shard_rows(ids, texts, base + made)

    return written(docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, SHARDS), "wand-shards")


#: A document after all others.
END = 1 << 40


def wand(lists: list[tuple[list[int], list[int], int]], k: int, start: int = 1) -> list[tuple[int, int]]:
    """(score, -document) of the ``k`` best documents of the lists (documents in order and then END, impacts, largest impact).

    ``start``: a score that k documents are known to reach, 1 at least.
    """
    n, heap = len(lists), []
    docs, impacts, most = ([x[i] for x in lists] for i in range(3))
    at = [0] * n
    # a cursor is its current document times n, plus its list's number: so they are in order of documents
    cursors = sorted(d[0] * n + t for t, d in enumerate(docs))
    need = start  # what a document must reach; of a full heap more than the worst has, whose documents have smaller ids
    while True:
        reach = 0
        for cursor in cursors:
            reach += most[cursor % n]
            if reach >= need:
                break
        else:
            return heap
        doc = cursor // n  # the pivot
        if doc == END:
            return heap
        first = doc * n
        if cursors[0] >= first:
            score = 0
            for i, cursor in enumerate(cursors):
                t = cursor - first
                if t >= n:
                    break
                a = at[t]
                score += impacts[t][a]
                at[t] = a = a + 1
                cursors[i] = docs[t][a] * n + t
            if score >= need:
                heapq.heappush(heap, (score, -doc))
                if len(heap) > k:
                    heapq.heappop(heap)
                if len(heap) == k:
                    need = max(need, heap[0][0] + 1)
        else:
            for i, cursor in enumerate(cursors):
                if cursor >= first:
                    break
                t = cursor % n
                at[t] = a = bisect_left(docs[t], doc, at[t] + 1)
                cursors[i] = docs[t][a] * n + t
        cursors.sort()


def search_shard(ids: list, sizes: np.ndarray, whole: int, total: int, lists: dict[str, tuple[np.ndarray, np.ndarray, int]], items: list[tuple[int, list[str]]], k: int) -> Iterator[tuple[int, int | None, int]]:
    """(item, document id, score) of each item's ``k`` best documents of a shard; lists: term to (places, occurrences, weight)."""
    m = 50 + (50 * sizes * whole) // max(1, total)
    made: dict[str, tuple[list[int], list[int], int, int]] = {}
    for term, (places, tf, weight) in lists.items():
        impact = weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[places]))
        # k documents reach this by the term alone
        sure = int(np.partition(impact, len(impact) - k)[len(impact) - k]) if len(impact) >= k else 0
        made[term] = [*places.tolist(), END], impact.tolist(), int(impact.max()), sure
    for item, terms in items:
        own = [made[t] for t in terms if t in made]
        for score, place in wand([x[:3] for x in own], k, max([1, *(x[3] for x in own)])):
            yield item, ids[-place], score


def rank(docs: DataFrame, items: DataFrame, k: int = 50, item_key: str = "item_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` documents that rank highest for each item."""
    shards = index(docs, key, text)
    heads = shards.filter("term IS NULL")
    facts = heads.agg(F.coalesce(F.sum("with_terms"), F.lit(0)).alias("n"), F.coalesce(F.sum("all_terms"), F.lit(0)).alias("l")).first()
    whole, total = facts.n, facts.l
    asked = items.select(F.col(item_key).alias("item_id"), F.array_distinct(terms_of(F.col(text))).alias("terms")).filter(F.size("terms") > 0)
    blocks = max(1, -(-asked.count() // ITEM_BLOCK))
    asked = asked.withColumn("item", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    asked = written(asked, "wand-items")
    terms = written(asked.select("block", F.explode("terms").alias("term")).distinct(), "wand-terms")
    lists = shards.filter("term IS NOT NULL").join(terms.select("term").distinct(), "term", "left_semi").select("shard", "term", "n", "places", "tfs")
    lists = written(lists, "wand-lists")
    df = written(lists.groupBy("term").agg(F.sum("n").alias("df")), "wand-df")
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2 * whole + 2).cast("double")) / (2 * F.col("df") + 1).cast("double"))).cast("long").alias("w")
    left = lists.join(terms.join(df, "term").select("term", "block", weight), "term").select("shard", "block", "term", "places", "tfs", "w")
    packed = asked.groupBy("block").agg(F.collect_list(F.struct("item", "terms")).alias("items"))
    right = heads.select("shard", "ids", F.col("places").alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).join(packed, "block")

    def meet(there: pa.Table, here: pa.Table) -> pa.Table:
        out: list[tuple[int, int | None, int]] = []
        if here.num_rows and there.num_rows:
            head = here.to_pylist()[0]
            numbers = lambda b: np.frombuffer(b, "<i4").astype(np.int64)
            own = {r["term"]: (numbers(r["places"]), numbers(r["tfs"]), r["w"]) for r in there.select(["term", "places", "tfs", "w"]).to_pylist()}
            out = list(search_shard(head["ids"], np.frombuffer(head["sizes"], "<i8"), whole, total, own, [(i["item"], i["terms"]) for i in head["items"]], k))
        return pa.table({name: pa.array([o[i] for o in out], pa.int64()) for i, name in enumerate(("item", "doc_id", "score"))})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, "item long, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    out = written(ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"), "wand-found")
    discard(shards, lists, terms, df, asked)
    return out


#: DuckDB SQL for rank(documents, benchmark).
ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents WHERE text IS NOT NULL
), docs AS (SELECT d, doc_id, terms, len(terms) AS n FROM t WHERE len(terms) > 0
), facts AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs
), postings AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY 1, 2
), weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM postings, facts GROUP BY term, n_docs
), items AS (SELECT item, item_id, unnest(list_distinct(terms)) AS term FROM (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM benchmark WHERE text IS NOT NULL)
), scored AS (
  SELECT i.item, i.item_id, p.d, docs.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * docs.n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM items i JOIN postings p USING (term) JOIN weights w USING (term) JOIN docs USING (d), facts GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

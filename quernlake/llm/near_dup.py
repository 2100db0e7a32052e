"""Operator 3: near-duplicates by Order MinHash, verified by banded alignment.

Sketch: words are hashed, every three consecutive words make a k-mer, and repeats of a k-mer in a text are told apart by
their occurrence number.  Under each of PERMUTATIONS hash orders the 2 smallest k-mers are taken and hashed in the order
in which they stand in the text (Marcais et al., "Locality-sensitive hashing for the edit distance", 2019): texts agree
in a sketch if they share these k-mers and their order, which follows edit similarity.

Short texts, of SHORT words at most, also have runs of 2 to 4 words by place: e edits leave one of e + 1 runs of the longer
text untouched, and move it by e places at most, so that no link between two short texts is missed.

Candidates: all texts of one sketch value.  A pair is a link if the banded alignment of its words needs at most 20 % of
the longer text's words as edits.  First they meet the value's smallest text (stars, never all pairs).  Where a value
still holds several classes, its members go on in turns: in blocks, each names its nearest partner of another class by
bitmaps of words and word pairs, so that a group of copies grows together at a cost linear in its size; at last all blocks
of what still stands apart meet, and every pair of two classes is aligned unless lengths or bitmaps already tell that it is
no link.  What is in one class needs no alignment,
which leaves classes as they would be.  Classes are the connected components of links, with equal texts as one.

Result: one row per document with the smallest document id of its class, the size of the class, and whether the
document is kept (it has the class's smallest id; where texts share that id, the one of smallest digest).

Defined cases: a null text is an empty one, and empty or blank texts equal in bytes are one class; texts under three words
have one k-mer, their whole word sequence; null ids are no class's smallest unless all are null; repeated rows are in one
class; an empty table gives an empty result; classes() drops columns not named, deduplicate() keeps all; texts of any
length are taken whole.

Scale: texts themselves are never shuffled, but 4-byte word hashes of texts that have a candidate are.  Equal texts are
sketched once per task.  Tables that meet on a hot key (a large group's representative) are written first, so that both
sides of the join are plain exchanges, which Spark splits where they are skewed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.llm.common import TID, discard, fresh_name, row_digest, slices, text_digest, written

K = 3
PERMUTATIONS, LEVEL = 48, 2
#: Texts of so many words at most get exact candidates among each other.
SHORT = 25
SIMILARITY = 0.8
#: Of a text's k-mers so many are expected below the threshold that spares sorting them all.
EXPECTED = 16
#: Members of a sketch value that are compared at once.
BLOCK = 256
#: Share of nearest partners that must be links for another turn in blocks.
WORTH = 0.02
SEED = 0x5DEECE66D


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    import xxhash

    words = [t.split() for t in texts]
    distinct = set().union(*words)
    of = {w: xxhash.xxh3_64_intdigest(w.encode()) for w in distinct}
    counts = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter(map(of.__getitem__, chain.from_iterable(words)), np.uint64, int(counts.sum())), counts


def _labelled(value: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes of values with their occurrence numbers: equal values of a text are told apart in text order."""
    order = np.lexsort((value, text))
    same = np.r_[False, (value[order][1:] == value[order][:-1]) & (text[order][1:] == text[order][:-1])][: len(order)]
    run = np.flatnonzero(~same)
    number = np.arange(len(order)) - np.repeat(run, np.diff(np.r_[run, len(order)]))
    out = np.empty(len(value), np.uint64)
    out[order] = _mix(value[order] + number.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return out


def sketches(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Text by permutation: Order MinHash values; texts without words get zeros."""
    out = np.zeros((len(counts), PERMUTATIONS), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    ends = np.cumsum(counts)[some]
    begins = ends - counts[some]
    sizes = np.maximum(counts[some] - K + 1, 1)  # k-mers
    text = np.repeat(np.arange(len(some)), sizes)
    at = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[text]
    value = np.zeros(len(text), np.uint64)
    for i in range(K):
        inside = at + i < ends[text]
        value = value * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, hashes[np.minimum(at + i, len(hashes) - 1)], np.uint64(0))
    labelled = _labelled(value, text)
    odd = np.random.default_rng(SEED).integers(1, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
    top = np.uint64(2**64 - 1)
    bound = lambda factor: np.where(sizes > factor, np.minimum(factor / sizes, 0.99) * 2.0**64, 0).astype(np.uint64) + np.where(sizes > factor, np.uint64(0), top)
    limit = np.repeat(bound(EXPECTED), sizes)
    for p in range(PERMUTATIONS):
        ranked = labelled * odd[p]
        low = np.flatnonzero(ranked <= limit)
        few = np.flatnonzero(np.bincount(text[low], minlength=len(some)) < np.minimum(sizes, LEVEL))
        if len(few):  # these take all
            low = np.union1d(low, np.flatnonzero(np.isin(text, few)))
        found = np.bincount(text[low], minlength=len(some))
        heads, value = np.cumsum(found) - found, ranked[low]
        place = np.full((len(some), LEVEL), len(text))  # absent ones stand last
        for i in range(LEVEL):
            there = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, heads), found))
            there = there[np.r_[True, text[low[there]][1:] != text[low[there]][:-1]]]
            own = text[low[there]]
            there, own = there[found[own] > i], own[found[own] > i]
            place[own, i] = low[there]
            value[there] = top
        place.sort(axis=1)  # places rise with the text
        key = np.full(len(some), p + 1, np.uint64)
        for i in range(LEVEL):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + np.where(place[:, i] < len(text), labelled[np.minimum(place[:, i], len(text) - 1)], np.uint64(0)))
        out[some, p] = key
    return out


def _most(n: int) -> int:
    """Edits that a link with a longer text of n words has at most."""
    return int((1 - SIMILARITY) * n + 1e-9)


def short_keys(hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(texts, text by key) of the texts of SHORT words at most, by length: two texts of a link share a key.

    A longer text of n words keeps a run of (n - e) / (e + 1) words; texts that reach each other name its place and the next ones.
    """
    begins = np.cumsum(counts) - counts
    for size in range(1, SHORT + 1):
        texts = np.flatnonzero(counts == size)
        longer = [n for n in range(size, SHORT + 1) if n - _most(n) <= size and _most(n)]
        if not len(texts) or not longer:
            continue
        words, keys = hashes[begins[texts][:, None] + np.arange(size)], []
        for run in {-(-(n - _most(n)) // (_most(n) + 1)) for n in longer}:
            at = np.arange(size - run + 1)
            value = np.full((len(texts), len(at)), run, np.uint64)
            for i in range(run):
                value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + words[:, i : i + len(at)])
            keys += [_mix(value + (at + move + 1).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) for move in range(_most(max(longer)) + 1)]
        yield texts, np.hstack(keys)


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]], share: float = 1 - SIMILARITY) -> np.ndarray:
    """Edit distances of pairs of word sequences, or -1 where above ``share`` of the longer one.

    Alignments run in a band about the diagonal, for many pairs in step; the band widens only where it proved too narrow.
    """
    out = np.full(len(pairs), -1, np.int64)
    waiting = []
    for i, (a, b) in enumerate(pairs):
        n = max(len(a), len(b))
        most = int(share * n + 1e-9)
        if abs(len(a) - len(b)) > most:
            continue
        short = min(len(a), len(b))
        differ = np.flatnonzero(a[:short] != b[:short])
        head = int(differ[0]) if len(differ) else short
        a, b = a[head:], b[head:]
        short = min(len(a), len(b))
        differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
        tail = int(differ[0]) if len(differ) else short
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        if not len(a) or not len(b):
            out[i] = max(len(a), len(b))
        elif max(len(a), len(b)) - _common(a, b) <= most:  # words in common bound the distance from below
            waiting.append((len(a), i, a, b, most))
    band = 8
    while waiting:
        waiting.sort(key=lambda w: w[:2])
        wider = []
        at = 0
        while at < len(waiting):
            n, stop = waiting[at][0], at
            while stop < len(waiting) and waiting[stop][0] <= n * 1.3 + 16 and (stop - at) * (2 * band + 1) < 60_000:
                stop += 1
            group = waiting[at:stop]
            for (_, i, a, b, most), d in zip(group, _banded([(g[2], g[3], min(band, g[4])) for g in group], band).tolist(), strict=True):
                if 0 <= d <= min(band, most):
                    out[i] = d
                elif band < most:
                    wider.append((len(a), i, a, b, most))
            at = stop
        waiting, band = wider, band * 4
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Number of words that a and b have in common, repeats counted."""
    (va, ca), (vb, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(vb, va), len(vb) - 1)
    return int(np.minimum(ca, cb[at])[vb[at] == va].sum())


def _banded(group: list[tuple[np.ndarray, np.ndarray, int]], band: int) -> np.ndarray:
    """Edit distances within the band, -1 where above the pair's limit."""
    width, far = 2 * band + 1, np.int32(1 << 29)
    rows = max(len(a) for a, _, _ in group)
    left = np.zeros((len(group), rows), np.int64)
    right = np.full((len(group), rows + 2 * width + max(len(b) for _, b, _ in group)), -1, np.int64)
    for k, (a, b, _) in enumerate(group):
        left[k, : len(a)] = a
        right[k, band : band + len(b)] = b  # column t of row i is word i - band + t of b
    sizes_a = np.array([len(a) for a, _, _ in group])
    sizes_b = np.array([len(b) for _, b, _ in group])
    limit = np.array([m for *_, m in group])
    slope = np.arange(width, dtype=np.int32)
    row = np.tile(np.where(slope >= band, slope - band, far), (len(group), 1)).astype(np.int32)
    live, out = np.arange(len(group)), np.full(len(group), -1, np.int64)
    for i in range(1, rows + 1):
        step = row + (left[live, i - 1][:, None] != right[live, i - 1 : i - 1 + width])
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
        if i <= band:
            step[:, band - i] = i  # the empty prefix of b
            step[:, : band - i] = far
        row = np.minimum.accumulate(step - slope, axis=1) + slope
        done = sizes_a[live] == i
        if done.any():
            t = sizes_b[live] - i + band
            ok = done & (t >= 0) & (t < width)
            out[live[ok]] = row[np.flatnonzero(ok), t[ok]]
        if done.any() or i % 32 == 0:
            go = ~done & (row.min(1) <= limit[live])
            if not go.all():
                live, row = live[go], row[go]
                if not len(live):
                    break
    return np.where(out <= limit, out, -1)


def _sketched(docs: DataFrame) -> DataFrame:
    """(tid, keys, words) of each text, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            tids, texts, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, tid in enumerate(tids):
                if tid not in seen:
                    seen.add(tid)
                    rows.append(i)
            texts = [texts[i] for i in rows]
            for a, b in slices(texts):
                hashes, counts = word_hashes(texts[a:b])
                keys = sketches(hashes, counts)
                filled = np.flatnonzero(counts)
                parts = [(filled, keys[filled]), *short_keys(hashes, counts)]
                owner = np.concatenate([np.repeat(own, of.shape[1]) for own, of in parts])
                values = np.concatenate([of.ravel() for _, of in parts])[np.argsort(owner, kind="stable")]
                ends = np.cumsum(counts).tolist()
                raw = hashes.astype("<u4")
                words = [raw[e - n : e].tobytes() for e, n in zip(ends, counts.tolist(), strict=True)]
                offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(counts)))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tids[i] for i in rows[a:b]], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64))), pa.array(words, pa.binary())],
                    ["tid", "keys", "words"],
                )

    return docs.select("tid", "text").mapInArrow(run, "tid binary, keys array<long>, words binary")


def _verified(edges: DataFrame, words: DataFrame) -> DataFrame:
    """The (a, b) of ``edges`` that are links; ``edges`` is a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sides = [[np.frombuffer(w, "<u4") for w in part.column(c).to_pylist()] for c in ("words_a", "words_b")]
                links = edit_distances(list(zip(*sides, strict=True))) >= 0
                yield part.select(["a", "b"]).filter(pa.array(links))

    one = words.select(F.col("tid").alias("a"), F.col("words").alias("words_a"))
    two = words.select(F.col("tid").alias("b"), F.col("words").alias("words_b"))
    both = edges.select("a", "b").join(one, "a").join(two, "b")
    return both.select("a", "b", "words_a", "words_b").mapInArrow(run, "a binary, b binary")


def bag_of(words: np.ndarray) -> bytes:
    """Two bitmaps of one size, of the hashed words and of the pairs of neighbours, repeats told apart: some 8 to 16 bits for each word (1,024 at least)."""
    bits = 1 << max(10, (8 * len(words) - 1).bit_length())
    flags = np.zeros((2, bits), bool)
    wide = words.astype(np.uint64)
    for k, x in enumerate((wide, (wide[:-1] << np.uint64(32)) | wide[1:])):
        flags[k, (_labelled(x, np.zeros(len(x), np.int8)) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def folded(bags: np.ndarray, size: int) -> np.ndarray:
    """Rows of two bitmaps as the same of ``size`` bytes in all: a bit stands where any of those that fall together stood."""
    return np.ascontiguousarray(np.bitwise_or.reduce(bags.reshape(len(bags), 2, -1, size // 2), axis=2)).reshape(len(bags), 2, -1).view(np.uint64)


def _bags(words: DataFrame) -> DataFrame:
    """(tid, n, bag) of (tid, words): word count, and the bitmaps of words and word pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(w, "<u4") for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, found)), pa.int64()), pa.array(list(map(bag_of, found)), pa.binary())], ["tid", "n", "bag"])

    return words.select("tid", "words").mapInArrow(run, "tid binary, n long, bag binary")


def near_bags(x: list[dict], y: list[dict], same: bool, nearest: bool = False) -> list[tuple[int, int]]:
    """Places (i, j) of members of two blocks that are in two classes and that lengths and bitmaps allow to be a link.

    An edit takes away a word and two word pairs at most, and brings as many, so that the words of one text that the other
    lacks, repeats counted, and half the pairs, bound the edits from below.  ``nearest``: of each member's partners only the one of the
    least bound.
    """
    nx, ny = np.array([m["n"] for m in x]), np.array([m["n"] for m in y])
    most = ((1 - SIMILARITY) * np.maximum(nx[:, None], ny) + 1e-9).astype(np.int64)
    may = np.abs(nx[:, None] - ny) <= most
    may &= np.array([m["root"] for m in x], f"S{TID}")[:, None] != np.array([m["root"] for m in y], f"S{TID}")
    if same:
        may = np.triu(may, 1)
    sizes = np.array([len(m["bag"]) for m in y])
    groups = {}
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        groups[size] = own, np.frombuffer(b"".join(y[j]["bag"] for j in own.tolist()), np.uint8).reshape(len(own), size), {}
    out = []
    for i in np.flatnonzero(may.any(1)).tolist():
        bag, found = np.frombuffer(x[i]["bag"], np.uint8)[None], []
        for size, (own, bags, smaller) in groups.items():
            at = np.flatnonzero(may[i, own])
            if len(at):
                least = min(size, bag.shape[1])
                if least not in smaller:
                    smaller[least] = folded(bags, least)
                here, there = folded(bag, least), smaller[least][at]
                lacking = np.maximum(np.bitwise_count(here & ~there).sum(2, dtype=np.int64), np.bitwise_count(there & ~here).sum(2, dtype=np.int64))
                found += zip(np.maximum(lacking[:, 0], -(-lacking[:, 1] // 2)).tolist(), own[at].tolist(), strict=True)
        if nearest:
            found = [min(found)]
        out += [(i, j) for edits, j in found if edits <= most[i, j]]
    return out


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The (key, tid, root, size) of ``members`` (key, tid) whose sketch value holds several classes."""
    tagged = members.join(roots.withColumnRenamed("node", "tid"), "tid", "left").select("key", "tid", F.coalesce("root", "tid").alias("root"))
    tagged = written(tagged, "near-tagged")
    several = tagged.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).filter(F.col("low") != F.col("high"))
    several = written(several.select("key", "size"), "near-several")
    left = written(tagged.join(several, "key"), "near-open")
    discard(tagged, several)
    return left


def _met_blocks(members: DataFrame, bags: DataFrame, across: bool, turn: int = 0) -> DataFrame:
    """(a, b), a > b, of pairs of ``members`` (key, tid, root, size) of one value that may be a link of two classes.

    Members meet across all blocks of the value, or inside their block alone and then name their nearest partner only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[bytes, bytes]] = set()
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                x = row["x"]
                y = row["y"] if across and row["y"] is not None else x
                for i, j in near_bags(x, y, not across or row["block"] == row["other"], not across):
                    a, b = x[i]["tid"], y[j]["tid"]
                    if across and min(set(x[i]["keys"]) & set(y[j]["keys"])) != row["key"]:
                        continue  # they meet under a smaller value, too
                    found.add((max(a, b), min(a, b)))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in range(2)], ["a", "b"])

    # blocks differ from value to value and from turn to turn, so that members of a group mix
    block = F.pmod(F.xxhash64("tid", "key", F.lit(turn)), F.ceil(F.col("size") / BLOCK)).alias("block")
    rows = members.select("key", "tid", "root", "size", block).join(bags, "tid")
    if not across:
        packed = rows.groupBy("key", "block").agg(F.collect_list(F.struct("tid", "root", "n", "bag")).alias("x"))
        return packed.select("x").mapInArrow(run, "a binary, b binary").distinct()
    rows = rows.join(members.groupBy("tid").agg(F.collect_set("key").alias("keys")), "tid")
    packed = written(rows.groupBy("key", "block").agg(F.first("size").alias("size"), F.collect_list(F.struct("tid", "root", "n", "bag", "keys")).alias("x")), "near-blocks")
    large = packed.filter(F.col("size") > BLOCK)
    two = large.select(F.col("key").alias("k"), F.col("block").alias("other"), F.col("x").alias("y"))
    met = large.join(two, (F.col("key") == F.col("k")) & (F.col("block") <= F.col("other")))
    # a value of one block meets itself where it lies
    alone = packed.filter(F.col("size") <= BLOCK).select("key", "block", F.col("block").alias("other"), "x", F.lit(None).cast(packed.schema["x"].dataType).alias("y"))
    met = met.select("key", "block", "other", "x", "y").unionByName(alone).mapInArrow(run, "a binary, b binary").distinct()
    met.blocks = packed
    return met


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``edges`` (a, b) that are not roots themselves: the smallest node of each connected component.

    Alternating large-star and small-star steps, until all edges lead from a node to its only, parentless neighbour; each
    round is written to the shared folder, and the tables of the one before go.
    """
    edges = written(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-edges")
    while True:
        several = edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1")
        if several.isEmpty() and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # large star: every larger neighbour of a node meets the node's smallest neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "component-least")
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
        large = written(large, "component-large")
        # small star: a node and its smaller neighbours meet the smallest of them
        lowest = written(large.groupBy("a").agg(F.min("b").alias("m")), "component-least")
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
        after = written(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "component-edges")
        discard(edges, least, large, lowest)
        edges = after


def widened(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further links (a, b): the components of the graph in which each class is one node."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    merged = components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left")
    return written(moved.select("node", F.coalesce("above", "root").alias("root")).unionByName(merged), "near-roots")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), text_digest(whole).alias("tid"), whole.alias("text"))


def text_classes(rows: DataFrame) -> DataFrame:
    """(tid, class_id, kept_tid, class_size) of each distinct text of (doc_id, tid, text); tid is the text's digest."""
    sketched = written(_sketched(rows), "near-sketches")
    keys = sketched.select("tid", F.explode("keys").alias("key"))
    stars = written(keys.groupBy("key").agg(F.min("tid").alias("rep"), F.max("tid").alias("other"), F.count("*").alias("size")).filter(F.col("rep") != F.col("other")).select("key", "rep", "size"), "near-stars")
    members = written(keys.join(stars, "key"), "near-members")
    discard(stars)
    stars = members.filter(F.col("tid") != F.col("rep")).select(F.col("tid").alias("a"), F.col("rep").alias("b")).distinct()
    edges = written(stars, "near-edges")
    # word hashes of the texts that have a candidate, once each
    needed = edges.select(F.col("a").alias("tid")).unionByName(edges.select(F.col("b").alias("tid"))).distinct()
    words = sketched.select("tid", "words").join(needed, "tid", "left_semi").groupBy("tid").agg(F.first("words").alias("words"))
    words = written(words, "near-words")
    discard(sketched)
    links = written(_verified(edges, words), "near-links")
    roots = components(links)
    discard(links)
    # values of three members and more that hold several classes: nearest partners in blocks while these often are links, then all that is left
    tried = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    left = _open(members.filter(F.col("size") > 2).select("key", "tid").distinct(), roots)
    discard(members)
    bags = written(_bags(words.join(left.select("tid").distinct(), "tid", "left_semi")), "near-bags")
    turn, across, pending, done = 0, False, None, [edges, words, bags]
    while not left.isEmpty():
        met = _met_blocks(left, bags, across, turn)
        pairs = written(met.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        if across:
            discard(met.blocks)
        more = written(_verified(pairs, words), "near-links")
        done += pairs, more
        asked, found = pairs.count(), more.count()
        if found:
            pending = more if pending is None else pending.unionByName(more)
        if across:
            break
        tried, turn = tried.unionByName(pairs), turn + 1
        if found and found >= WORTH * asked:
            roots, pending, before = widened(roots, pending), None, left
            left = _open(before.select("key", "tid"), roots)
            discard(before)
        else:
            across = True
    if pending is not None:
        roots = widened(roots, pending)
    discard(left, *done)
    # texts, their smallest ids, and the smallest id of each class
    ids = rows.groupBy("tid", "doc_id").agg(F.count("*").alias("n"))
    texts = written(ids.groupBy("tid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("low"), F.sum("n").alias("n")), "near-texts")
    joined = texts.join(roots.withColumnRenamed("node", "tid"), "tid", "left").select("tid", "low", "n", F.coalesce("root", "tid").alias("root"))
    joined = written(joined, "near-rooted")
    best = F.min(F.struct("low", "tid"))
    grouped = joined.groupBy("root").agg(best.alias("best"), F.sum("n").alias("class_size"))
    grouped = grouped.select("root", F.col("best.low.doc_id").alias("class_id"), F.col("best.tid").alias("kept_tid"), "class_size")
    grouped = written(grouped, "near-grouped")
    facts = written(joined.select("tid", "root").join(grouped, "root").drop("root"), "near-classes")
    discard(texts, joined, grouped)
    return facts


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size, keep) for each document."""
    rows = _rows(docs, key, text)
    facts = text_classes(rows)
    keep = (F.col("tid") == F.col("kept_tid")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return rows.select("doc_id", "tid").join(facts, "tid").select("doc_id", "class_id", "class_size", keep.alias("keep"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with all its columns: the kept one (of rows alike in id and text, one).

    Texts are shuffled once, by a digest of id and text; rows alike in both are one per task before that.
    """
    facts = text_classes(_rows(docs, key, text)).filter(F.col("tid") == F.col("kept_tid"))
    row = fresh_name(docs, "row")
    marked = docs.withColumn(row, row_digest(F.col(key), text_digest(F.coalesce(F.col(text), F.lit("")))))
    kept = facts.select(row_digest(F.col("class_id").cast(docs.schema[key].dataType), F.col("tid")).alias(row))
    return marked.dropDuplicates([row]).join(kept, row, "left_semi").select(*docs.columns)

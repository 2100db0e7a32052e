"""Operator 13: spelling variants grouped by two-dimensional range reporting.

Words one edit apart, of length L the longer one, agree in all before the edited position and in all after it.  For each
position the words with that beginning are an interval of the words in forward order, and those with that ending an
interval of them in order of their reversals; a wavelet tree over the reverse ranks in forward order reports the words in
both, which are the near words and no others, so that nothing is verified afterwards.

Dealing: an edit in the second half of the longer word leaves its first L // 2 code points alone, one in the first half
leaves the rest alone; words meet by that part and L, in buckets of some BUCKET words, in each of which one wavelet tree
stands.  A part that more words share, as one of a common prefix, is dealt into blocks, and searched from all of them.
Each bucket sends a word's count of near words and the best of them, never pairs.

Forms lead to words of at least twice the count, so that they end; roots are found by pointer doubling over written
tables.

Defined cases: a null text is an empty one; a null doc_id counts as an empty text in the checksum; repeated rows count as often as they
stand; ties of counts go to the smaller word in code-point order; words of any length are taken; an empty table gives an
empty result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlake.llm.common import discard, written

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run loses a code point where so much divides its checksum.
EVERY = 97
#: Code points and occurrences of a word, and how many times its own occurrences its form must have.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: Words of a bucket, and ranges that one call of a tree reports.
BUCKET, RANGES = 1 << 14, 1 << 17


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word): each run of letters, lower-cased, some without a code point."""
    whole = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    each = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(whole, F.lit(f"({RUN})"))).alias("run"))
    check = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    at = (F.col("check") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return each.withColumn("check", check).select(F.when(F.col("check") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the distinct words that count."""
    return runs(docs, key, text).filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class WaveletTree:
    """A permutation, whose values in a range of places and a range of values are reported for many pairs of ranges at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []  # by level: how many of the first i bits are 0
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b) & 1
            self.zeros.append(np.r_[0, np.cumsum(1 - one)])
            values = np.r_[values[one == 0], values[one == 1]]

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(range, value) of all values in [low, high) at places in [left, right)."""
        of = np.flatnonzero((left < right) & (low < high))
        a, b, prefix = left[of], right[of], np.zeros(len(of), np.int64)
        for level, zeros in enumerate(self.zeros):
            width = 1 << (self.bits - 1 - level)
            a0, b0 = zeros[a], zeros[b]
            half = prefix + width
            left_side, right_side = (a0 < b0) & (low[of] < half) & (high[of] > prefix), (a - a0 < b - b0) & (low[of] < half + width) & (high[of] > half)
            shift = int(zeros[-1])
            of, a, b, prefix = (
                np.r_[of[left_side], of[right_side]], np.r_[a0[left_side], (shift + a - a0)[right_side]],
                np.r_[b0[left_side], (shift + b - b0)[right_side]], np.r_[prefix[left_side], half[right_side]],
            )
        return of, prefix


def letters(texts: list[bytes], width: int) -> np.ndarray:
    """Words as rows of ``width`` bytes; shorter ones end in zeros, which no word holds."""
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)


class Order:
    """Rows in byte order, and for each length of a beginning the interval of ``points`` that begin as a row does."""

    def __init__(self, rows: np.ndarray, points: np.ndarray):
        n, width = rows.shape
        self.order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
        differ = rows[self.order][1:] != rows[self.order][:-1]
        #: how many bytes a row shares with the one before it
        self.shared = np.r_[0, np.where(differ.any(1), differ.argmax(1), width)] if n else np.zeros(0, np.int64)
        self.before = np.r_[0, np.cumsum(points[self.order])]  # points before each place
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)

    def intervals(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.r_[True, self.shared[1:] < length])
        group = np.searchsorted(starts, self.rank, "right") - 1
        bounds = self.before[np.r_[starts, len(self.rank)]]
        return bounds[group], bounds[group + 1]


def near_in(texts: list[bytes], home: np.ndarray, length: int, front: bool) -> tuple[np.ndarray, np.ndarray]:
    """(place of a word, place of a near one) in a bucket: the words at home, all of ``length``, near those that search, both ways.

    ``front``: edits in the first half of the longer word, else those in the second.
    """
    at = np.flatnonzero(home)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    rows = letters(texts, length)
    back = letters([t[::-1] for t in texts], length)
    forward, backward = Order(rows, home), Order(back, home)
    # the tree holds the points alone: their reverse ranks among points, in forward order
    points_back = backward.order[home[backward.order]]
    rank = np.empty(len(texts), np.int64)
    rank[points_back] = np.arange(len(at))
    tree = WaveletTree(rank[forward.order[home[forward.order]]])
    places = list(range(length // 2) if front else range(length // 2, length))
    step = max(1, RANGES // len(texts))
    words, others = [], []
    for a in range(0, len(places), step):
        some = places[a : a + step]
        sides = [(*forward.intervals(p), *backward.intervals(length - 1 - p)) for p in some]
        of, value = tree.report(*(np.concatenate([s[k] for s in sides]) for k in range(4)))
        place, i = np.divmod(of, len(texts))
        p, k = np.array(some)[place], points_back[value]
        same = sizes[i] == length
        # of the places where a run of one letter may have grown, the first
        kept = np.where(same, i != k, (p == 0) | (rows[i, p - 1] != rows[k, p]))
        i, k, same = i[kept], k[kept], same[kept]
        words += [i, k[~same]]
        others += [k, i[~same]]
    return np.concatenate(words), np.concatenate(others)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best) for the words of ``vocabulary`` (word, n; written) that have near words; best: (-n, word) of the first of them."""
    length = F.length("word")
    half = lambda n: F.floor(n / 2).cast("int")
    first = lambda n: F.substring("word", F.lit(1), half(n))
    rest = lambda begin: F.substring("word", begin, length)
    role = lambda front, home, size, part: F.struct(F.lit(front).alias("front"), F.lit(home).alias("home"), size.alias("size"), part.alias("part"))
    # what an edit leaves alone of a word, and the same part of one that an insertion makes it
    roles = F.array(role(False, True, length, first(length)), role(True, True, length, rest(half(length) + 1)), role(False, False, length + 1, first(length + 1)), role(True, False, length + 1, rest(half(length + 1))))
    rows = vocabulary.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.*").withColumn("key", F.xxhash64("front", "size", "part"))
    buckets = F.lit(max(1, -(-2 * vocabulary.count() // BUCKET)))
    hot = rows.filter("home").groupBy("key").agg(F.count("*").alias("members")).filter(F.col("members") > BUCKET)
    hot = written(hot.select("key", F.ceil(F.col("members") / BUCKET).cast("int").alias("blocks")), "spelling-hot")
    dealt = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # a word stands in its own block, and searches all
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("word", "key"), F.col("blocks"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.pmod(F.xxhash64("key"), buckets).alias("bucket"), "block", "front", "size", (F.col("home") & (F.col("own") == F.col("block"))).alias("home"), "word", F.encode("word", "ISO-8859-1").alias("text"), "n")

    def search(group: pa.Table) -> pa.Table:
        out = []
        for part in _parts(group, "front", "size"):
            texts, n = part.column("text").to_pylist(), part.column("n").to_numpy()
            i, k = near_in(texts, part.column("home").to_numpy(zero_copy_only=False), part.column("size")[0].as_py(), part.column("front")[0].as_py())
            by_bytes = np.empty(len(texts), np.int64)
            by_bytes[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
            order = np.lexsort((by_bytes[k], -n[k], i))
            i, k = i[order], k[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
            out.append(pa.table({"word": part.column("word").take(pa.array(i[first])), "n_near": pa.array(np.diff(np.r_[first, len(i)]), pa.int64()), "m": pa.array(-n[k[first]], pa.int64()), "near": part.column("word").take(pa.array(k[first]))}))
        return pa.concat_tables(out)

    found = dealt.groupBy("bucket", "block").applyInArrow(search, "word string, n_near long, m long, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("m", "near")).alias("best"))


def _parts(group: pa.Table, *by: str) -> Iterator[pa.Table]:
    """The rows of a group by the values of some columns."""
    rows = group.combine_chunks()
    keys = np.array([rows.column(c).to_numpy(zero_copy_only=False) for c in by], np.int64)
    order = np.lexsort(keys[::-1])
    starts = np.flatnonzero(np.r_[True, (np.diff(keys[:, order]) != 0).any(0)]) if len(order) else []
    for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
        yield rows.take(pa.array(order[a:b])).combine_chunks()


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from links (word, up) that end: each turn doubles the distance that a word looks ahead."""
    links = written(links, "spelling-links")
    while True:
        ahead = links.select(F.col("word").alias("up"), F.col("up").alias("above"))
        after = written(links.join(ahead, "up", "left").select("word", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved")), "spelling-links")
        discard(links)
        if after.filter("moved").isEmpty():
            return after.select("word", F.col("up").alias("root"))
        links = after.drop("moved")
        links.written_path = after.written_path


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of the documents."""
    vocabulary = written(words(docs, key, text), "spelling-words")
    known = vocabulary.join(near_words(vocabulary), "word", "left")
    m, enough = -F.col("best.m"), -F.col("best.m") >= TIMES * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, m).alias("form_n"))
    known = written(known, "spelling-forms")
    ends = roots(known.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("up")))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))

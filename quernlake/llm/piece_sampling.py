"""Operator 9: sampled SentencePiece segmentations, and their lossless decoding.

Each pre-token has a lattice of the pieces that cover it.  Forward filtering sums the weights of all ways to each
position; backward sampling draws, from the end, the piece that ends there by its share of that sum.  A piece weighs
(rank + 2) ** -ALPHA, with its rank in the vocabulary.  Lattices are built once per distinct pre-token; the draws run
for all occurrences of a batch in step.  Random numbers are hashes of the row key, the pre-token's place in the text and the
draw's number, so a row gets the same segmentation in any partitioning and rerun.  Where rows repeat on purpose, as in a
mix, numbered_copies() tells them apart, and each copy gets its own segmentation.

Characters without a piece, and the space mark where a text itself holds it, become byte pieces, so decoding gives every
text back exactly.

Defined cases: null and empty texts have no pieces and decode to an empty text; null keys share one seed; repeated rows
get equal pieces; very long texts and words are taken whole; an empty table gives an empty result; columns named in
``keep`` pass through, others are dropped.  Nothing is shuffled but by numbered_copies().
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.llm.common import fresh_name, row_digest, spans
from quernlake.llm.token_counts import MARK, ranks_of

ALPHA, SEED = 0.5, 7
#: Bytes of text whose lattices stand in memory at a time; a longer text stands alone.
SLICE = 600_000
#: Stands for a space mark that the text itself holds; no valid text contains it.
OWN_MARK = "\ud800"
#: Weight of a character spelled in bytes.
BYTES_WEIGHT = 1e-3


class Lattices:
    """Piece lattices of many pre-tokens at once; a trie of all pieces finds the edges."""

    def __init__(self, path: str):
        ranks = ranks_of(path)
        self.bytes = ranks.bytes
        self.raw = spelled(path)
        chars = {c: k for k, c in enumerate(sorted({c for p in ranks.pieces for c in p}))}
        self.base = len(chars) + 1
        self.of_char = np.full(0x110000, len(chars), np.int64)
        self.of_char[[ord(c) for c in chars]] = list(chars.values())
        steps: dict[int, int] = {}
        piece = [-1]
        for p, i in ranks.pieces.items():
            node = 0
            for c in p:
                key = node * self.base + chars[c]
                if key not in steps:
                    steps[key] = len(piece)
                    piece.append(-1)
                node = steps[key]
            piece[node] = i
        self.keys = np.array(sorted(steps), np.int64)
        self.next = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.piece_of = np.array(piece, np.int64)
        self.is_piece = np.zeros(0x110000, bool)
        self.is_piece[[ord(p) for p in ranks.pieces if len(p) == 1]] = True
        self.weight = np.zeros(ranks.total)
        self.weight[list(ranks.pieces.values())] = [(min(ranks.rank_of[p], ranks.total) + 2.0) ** -ALPHA for p in ranks.pieces]
        self.longest = max(map(len, ranks.pieces))

    def edges(self, chars: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all edges between places of ``chars``; ``room``: characters from there to the word's end.

        A character that is no piece has an edge as bytes: -1 - code point."""
        code = self.of_char[chars]
        at, node, depth = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        odd = np.flatnonzero(~self.is_piece[chars])
        found = [(odd, odd + 1, -1 - chars[odd].astype(np.int64))]
        while len(at):
            key = node * self.base + code[at + depth]
            place = np.searchsorted(self.keys, key)
            place[place == len(self.keys)] = 0
            ok = self.keys[place] == key
            depth += 1
            at, node = at[ok], self.next[place[ok]]
            piece = self.piece_of[node]
            ends = piece >= 0
            found.append((at[ends], at[ends] + depth, piece[ends]))
            go = room[at] > depth
            at, node = at[go], node[go]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def flat(self, words: Sequence[str]) -> tuple[np.ndarray, ...]:
        """First place and length of each word; key (place of the end + cumulative share), start in the word and piece of each edge."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(lengths) - lengths
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = np.arange(len(chars)) - first[owner]
        start, end, piece = self.edges(chars, lengths[owner] - inside)
        order = np.argsort(end, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        weight = np.where(piece >= 0, self.weight[np.maximum(piece, 0)], BYTES_WEIGHT)
        at_start, level = inside[start] == 0, inside[end - 1]
        # forward: the sum of the weights of all ways to each place, all words in step by the place in the word
        sums, share = np.zeros(len(chars)), np.empty(len(start))
        by_level = np.argsort(level.astype(np.uint16) if len(level) and level.max() < 1 << 16 else level, kind="stable")
        bounds = np.r_[0, np.cumsum(np.bincount(level))]
        for depth, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            edge = by_level[a:b]
            ways = weight[edge] * np.where(at_start[edge], 1.0, sums[start[edge] - 1])
            here = end[edge]
            heads = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
            total = np.add.reduceat(ways, heads)
            sums[here[heads] - 1] = total
            share[edge] = ways / np.repeat(total, np.diff(np.r_[heads, b - a]))
            if depth % 32 == 31:  # only ratios matter: long words are scaled before their sums vanish
                far = first[lengths > depth + 1] + depth
                window = far[:, None] - np.arange(min(self.longest, depth + 1))
                sums[window] /= sums[far][:, None]
        heads = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
        running = np.cumsum(share)
        running -= np.repeat(running[heads] - share[heads], np.diff(np.r_[heads, len(end)]))
        running[np.r_[heads[1:] - 1, len(end) - 1]] = 1.0
        return first, lengths, (end - 1) + np.minimum(running, 1.0), inside[start], piece


@lru_cache(2)
def lattices_of(path: str) -> Lattices:
    return Lattices(path)


@lru_cache(2)
def spelled(path: str) -> list[bytes]:
    """What each id spells; ids that spell nothing are empty."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(MARK, " ").encode())
    return out


def cut(text: str) -> list[str]:
    """Pre-tokens: runs of space marks with what follows, and single line feeds; one mark stands before the text."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, OWN_MARK)
    if text[0] != " " and "  " not in text and text[-1] != " ":
        return list(filter(None, (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")))
    return re.findall(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+", MARK + text.replace(" ", MARK))


def uniform(seeds: np.ndarray, draw: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit seeds: the splitmix64 finalizer."""
    z = seeds + np.uint64((draw + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(12)).astype(np.float64) * 2.0**-52 + 2.0**-54


def sample(texts: Sequence[str], keys: Sequence[object], lattices: Lattices, seed: int = SEED) -> list[np.ndarray]:
    """A sampled segmentation of each text, as ids."""
    words = [cut(t) for t in texts]
    distinct = list(set().union(*words))
    if not distinct:
        return [np.zeros(0, np.int64) for _ in texts]
    index = {w: i for i, w in enumerate(distinct)}
    first, lengths, key, start, piece = lattices.flat(distinct)
    per_text = np.fromiter(map(len, words), np.int64, len(words))
    word = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), np.int64, int(per_text.sum()))
    row_seed = np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{k}".encode(), digest_size=8).digest(), "little") for k in keys], np.uint64)
    place = np.arange(len(word)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    seeds = np.repeat(row_seed, per_text) ^ (place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    active = np.argsort(word, kind="stable")  # equal words together read the same edges
    at = lengths[word[active]]
    drawn, counts = [], np.zeros(len(word), np.int64)
    while len(active):
        node = first[word[active]] + at - 1
        edge = np.searchsorted(key, node + uniform(seeds[active], len(drawn)))
        drawn.append((active, piece[edge]))
        counts[active] += 1
        at = start[edge]
        go = at > 0
        active, at = active[go], at[go]
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]), np.int64)
    for step, (which, pieces) in enumerate(drawn):
        out[ends[which] - 1 - step] = pieces
    stops = np.cumsum(np.bincount(np.repeat(np.arange(len(words)), per_text), counts, len(words)).astype(np.int64))
    odd = out < 0
    if odd.any():  # characters become their bytes
        letters = [(MARK if c == ord(OWN_MARK) else chr(c)).encode() for c in (-1 - out[odd]).tolist()]
        widths = np.ones(len(out), np.int64)
        widths[odd] = list(map(len, letters))
        whole = np.repeat(out, widths)
        whole[np.repeat(odd, widths)] = [lattices.bytes[b] for s in letters for b in s]
        stops, out = np.r_[0, np.cumsum(widths)][stops], whole
    return np.split(out, stops[:-1])


def _columns(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)


def _sampled(batch: pa.RecordBatch, lattices: Lattices, seed: int) -> Iterator[tuple[pa.RecordBatch, list[str], list[np.ndarray]]]:
    """Some rows of (doc_id, copy, ..., text) at a time, with their texts and sampled ids."""
    column = batch.column("text")
    for a, b in spans(column, SLICE):
        part = batch.slice(a, b - a)
        texts = part.column("text").to_pylist()
        keys = [f"{k}:{c}" if c else k for k, c in zip(part.column("doc_id").to_pylist(), part.column("copy").to_pylist(), strict=True)]
        yield part, texts, sample(texts, keys, lattices, seed)


def _listed(ids: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(list(map(len, ids)))], pa.int32()), pa.array(np.concatenate(ids), pa.int32()))


def spell(ids: np.ndarray, raw: list[bytes]) -> str:
    """The text that piece ids spell."""
    return b"".join([raw[i] for i in ids.tolist()])[1:].decode()


def numbered_copies(docs: DataFrame, name: str = "copy", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(all columns, and the copy's number as ``name``): rows alike in id and text are counted from 0, so that each may have a seed of its own.

    Of such rows the other columns are those of one of them.  Texts are shuffled once, alike ones once per task.
    """
    row = fresh_name(docs, "row")
    alike = docs.withColumn(row, row_digest(F.col(key), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).cast("binary")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    counted = alike.groupBy(row).agg(F.first(whole).alias("whole"), F.count("*").alias("n"))
    return counted.select("whole.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias(name))


def _rows(docs: DataFrame, keep: Sequence[str], key: str, text: str, copy: str | None) -> DataFrame:
    number = F.col(copy).cast("long") if copy else F.lit(0).cast("long")
    return docs.select(F.col(key).alias("doc_id"), *keep, number.alias("copy"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def encode(docs: DataFrame, model: str, keep: Sequence[str] = (), key: str = "doc_id", text: str = "text", seed: int = SEED, copy: str | None = None) -> DataFrame:
    """(doc_id, keep..., text, piece_ids) of each document: a sampled segmentation seeded by its key, and by the copy's number where a column has that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, ids in _sampled(batch, lattices_of(model), seed):
                yield pa.RecordBatch.from_arrays([*part.drop_columns(["copy"]).columns, _listed(ids)], [*kept, "piece_ids"])

    rows = _rows(docs, keep, key, text, copy)
    kept = rows.drop("copy").columns
    return rows.mapInArrow(run, f"{_columns(rows.drop('copy'))}, piece_ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Adds ``decoded``, the text that ``piece_ids`` spell, and ``ids_crc32``, the CRC of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = spelled(model)
        for batch in batches:
            column = batch.column("piece_ids")
            ids = column.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            offsets = np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].tolist()
            each = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            texts, digests = [spell(x, raw) for x in each], [zlib.crc32(x.tobytes()) for x in each]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(digests, pa.int64())], [*batch.schema.names, "decoded", "ids_crc32"])

    return encoded.mapInArrow(run, f"{_columns(encoded)}, decoded string, ids_crc32 long")


def both_ways(docs: DataFrame, model: str, keep: Sequence[str] = (), key: str = "doc_id", text: str = "text", seed: int = SEED, copy: str | None = None) -> DataFrame:
    """(doc_id, keep..., n_bytes, n_pieces, piece_ids, ids_crc32, decoded_sha256, lossless): encode() and decode() in one pass.

    Texts and their decoded copies stay in the worker, some at a time; of them come back the ids, sizes and digests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = spelled(model)
        for batch in batches:
            for part, texts, ids in _sampled(batch, lattices_of(model), seed):
                sizes, digests, lossless = [], [], []
                for t, x in zip(texts, ids, strict=True):
                    back = spell(x, raw)
                    data = back.encode()
                    sizes.append(len(data) if back == t else len(t.encode()))
                    digests.append(hashlib.sha256(data).hexdigest())
                    lossless.append(back == t)
                crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                made = [pa.array(sizes, pa.int64()), pa.array(list(map(len, ids)), pa.int64()), _listed(ids), pa.array(crcs, pa.int64()), pa.array(digests, pa.string()), pa.array(lossless, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.drop_columns(["copy", "text"]).columns, *made], [*names, *MADE])

    rows = _rows(docs, keep, key, text, copy)
    kept = rows.drop("copy", "text")
    names = kept.columns
    return rows.mapInArrow(run, f"{_columns(kept)}, n_bytes long, n_pieces long, piece_ids array<int>, ids_crc32 long, decoded_sha256 string, lossless boolean")


MADE = ("n_bytes", "n_pieces", "piece_ids", "ids_crc32", "decoded_sha256", "lossless")


def round_trip(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_pieces, ids_crc32, decoded_sha256, lossless) of each document, digests taken from the real ids and decoded texts."""
    return both_ways(docs, model, (), key, text).drop("piece_ids")

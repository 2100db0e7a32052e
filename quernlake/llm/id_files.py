"""Operator 8: token ids in files of adaptively coded blocks.

Ids are cut into blocks of BLOCK ids.  A block is coded by a range coder whose model adapts within the block alone:
the ids that followed the same two ids, the same one id, and the block's leading id are predictions of order 2, 1 and 0;
what the first two hit of the last two ids chooses one of 16 contexts, and the context's counts are mixed with order-0 counts over
"which prediction holds, or how long is the id otherwise".  An id that no prediction hits adds its low bits as they are.
All blocks of a batch are coded in step as numpy arrays; each begins anew and carries the CRC of its ids, checked when read.

A file row holds up to some megabytes of text: document ids, their token counts, and coded blocks.  Rows lie in Parquet
files by ascending document id (range partitioned, sorted within), so lost tasks are written again by Spark's committer.

Defined cases: a null or empty text has the end id alone; null document ids come first; rows of equal document id go by
a digest of their text; repeated rows each get a row of their own; an empty table writes no rows; very long texts are
coded whole; extra columns are dropped.  Vocabularies beyond 65,536 ids are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernlake.llm.common import written

END = 0
BLOCK = 2048
#: Bytes of text in a file row and in a call of token_ids, blocks coded in step, and units that a worker remembers.
ROW_BYTES, TEXT_BYTES, LANES, MEMO = 20_000_000, 10_000_000, 4096, 1_000_000
#: Units that go to the library as one text.
JOINED = 100
#: Prediction tables of a block have so many slots.
SLOT_BITS = 9
SLOTS = 1 << SLOT_BITS
#: Symbols: hit of order 2, 1, 0; else the id has up to so many bits, which follow as they are.
BITS = np.array([0, 0, 0, 8, 11, 13, 15, 16], np.uint64)
PLAIN = np.array([0, 0, 0, 1, 1, 1, 1, 1], np.uint64)
CLASS = (np.digitize(np.arange(1 << 16), [1 << 8, 1 << 11, 1 << 13, 1 << 15]) + 3).astype(np.uint8)
#: By bits "order 2 hits", "order 1 hits", "order 0 hits": the symbol; 7 and more where none hits.
FIRST_HIT = np.array([7, 0, 1, 0, 2, 0, 1, 0])
#: The vote for the leading id.
VOTE = np.array([-1, 1])
#: Sums over the symbols before each, over all symbols, and over the contexts of a lane.
CUMULATE, ONES, CONTEXTS = np.tri(9, 8, -1, np.float32), np.ones(8, np.float32), np.tile(np.eye(8, dtype=np.float32), (16, 1))
STEP, FULL = np.float32(48), 16384
HASH = np.array([40503, 30011], np.uint16)  # products wrap around
U = np.uint64
LOW31, RENEW = U((1 << 31) - 1), U(1 << 31)
#: White space; white space for which a text's cuts look at the bytes beside them.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
ODD_SPACE = rf"{SPACE}{SPACE}|\A{SPACE}|{SPACE}\z"
#: Kinds of bytes at which texts are cut.
BLANK, LINE_END, MARK = 1, 2, 3
KINDS = bytes({b" ": BLANK, b"\n": LINE_END, **{bytes([m]): MARK for m in b".,;:!?"}}.get(bytes([i]), 0) for i in range(256))
#: Bytes that no white space ends with, and bytes that none begins with.
ENDS_NONE, BEGINS_NONE = (np.array([i > 0x20 and i not in some for i in range(256)]) for some in ({*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF}, {0xC2, 0xE1, 0xE2, 0xE3}))
#: Letters and digits, by their code points below 2,048, such as every Unicode version has.
LETTERS = np.isin(np.arange(1 << 11), [*b"0123456789", *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x250), *range(0x410, 0x450)])
IDEOGRAPHS = 0x4E00, 0x9FA5


class Model:
    """The adaptive model of many blocks at once; ids are told to it one per block and step.  Counts are whole floats, which sum exactly."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.slots, self.contexts = np.arange(2 * lanes).reshape(2, lanes) * SLOTS, self.lane * 16
        self.table = np.zeros(2 * lanes * SLOTS, np.uint16)  # the ids that followed: order 2, then order 1
        self.counts, self.zero = np.full((lanes * 16, 8), 2, np.float32), np.tile(np.array([8, 8, 2, 4, 4, 8, 8, 8], np.float32), (lanes, 1))
        self.flat_counts = self.counts.ravel()
        self.hash = np.zeros((2, lanes), np.uint16)
        self.guess = np.zeros((4, lanes), np.uint16)  # of order 2, 1 and 0; the last row is the reader's
        self.lead, self.lead_n = self.guess[2], np.zeros(lanes, np.int64)
        self.last, self.before = np.zeros(lanes, np.uint16), np.zeros(lanes, np.uint16)
        self.recent = np.zeros(lanes, np.uint8)

    def predict(self) -> np.ndarray:
        """Cumulative frequencies (9 bounds of 8 symbols, in rows) by lane, as whole floats."""
        np.right_shift(self.before * HASH[0] + self.last * HASH[1], 16 - SLOT_BITS, out=self.hash[0])
        np.bitwise_and(self.last, SLOTS - 1, out=self.hash[1])
        self.at = self.slots + self.hash
        self.guess[:2] = self.table.take(self.at)
        self.context = self.contexts + self.recent
        mixed = self.counts.take(self.context, 0)
        mixed += self.zero
        return CUMULATE @ mixed.T

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Bits "order 2 hits", "order 1 hits", "order 0 hits"."""
        hit = (self.guess[:3] == ids).view(np.uint8)
        return hit[0] | hit[1] << 1 | hit[2] << 2

    def learn(self, ids: np.ndarray, hit: np.ndarray, symbol: np.ndarray, step: int) -> None:
        self.table[self.at] = ids
        at = (self.context << 3) + symbol
        self.flat_counts[at] = self.flat_counts.take(at) + STEP
        self.recent = (self.recent << 2 & 12) | (hit & 3)
        if step % 4 == 3:  # every fourth id votes for the leading id
            self.lead_n += VOTE.take(hit >> 2)
            lost = np.flatnonzero(self.lead_n < 0)
            self.lead[lost] = ids.take(lost)
            self.lead_n[lost] = 1
        if step % 32 == 31:  # order 0 sums what the contexts have seen
            over = np.flatnonzero(self.counts @ ONES > FULL)
            self.counts[over] = np.floor(self.counts[over] / 2) + 1
            self.zero = np.floor(self.counts.reshape(len(ids), 128) @ CONTEXTS / 16) + 1
        self.before, self.last = self.last, ids


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Codes blocks; each gives its own bytes.  A block shorter than the longest is followed by zeros that no reader asks for."""
    lanes, longest = len(blocks), max(map(len, blocks))
    ids = np.zeros((lanes, longest), np.uint16)
    for lane, block in enumerate(blocks):
        ids[lane, : len(block)] = block
    ids = np.ascontiguousarray(ids.T)
    kinds = CLASS.take(ids)
    model = Model(lanes)
    low, width = np.zeros(lanes, U), np.full(lanes, (1 << 63) - 1, U)
    # word k of a lane is at k * lanes + lane, so that a step writes to places near each other
    words, put = np.zeros((longest + 3, lanes), U), np.arange(lanes)
    flat = words.ravel()
    for step in range(longest):
        now = ids[step]
        bounds = model.predict()
        hit = model.hits(now)
        s = np.minimum(FIRST_HIT.take(hit), kinds[step])
        at = s * lanes + model.lane
        base, top = bounds.ravel().take(at).astype(U), bounds.ravel().take(at + lanes).astype(U)
        width //= bounds[8].astype(U)
        low += width * base
        width *= top - base
        width >>= BITS.take(s)
        low += width * (now * PLAIN.take(s))
        full = np.flatnonzero(width < RENEW)
        some, place = low.take(full), put.take(full)
        flat[place] = some >> U(31)
        put[full] = place + lanes
        low[full] = (some & LOW31) << U(32)
        width[full] = width.take(full) << U(32)
        model.learn(now, hit, s, step)
    flat[put], flat[put + lanes] = low >> U(31), (low & LOW31) << U(1)
    ends = put // lanes + 2
    words = words[: ends.max()]
    while (carry := words >> U(32)).any():
        words &= U(0xFFFFFFFF)
        words[:-1] += carry[1:]
    packed = np.ascontiguousarray(words.astype("<u4").T)
    return [packed[lane, : ends[lane]].tobytes() for lane in range(lanes)]


def decode(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The blocks that encode() was given, from their bytes and lengths."""
    lanes, longest = len(coded), max(sizes)
    most = max(map(len, coded)) // 4 + 4
    words = np.zeros((lanes, most), "<u4")
    for lane, block in enumerate(coded):
        words[lane, : len(block) // 4] = np.frombuffer(block, "<u4")
    words = np.ascontiguousarray(words.T).astype(U)
    ahead = np.zeros((most, lanes), U)
    ahead[:-2] = ((words[1:-1] & U(1)) << U(31)) | (words[2:] >> U(1))
    rest = (words[0] << U(31)) | (words[1] >> U(1))
    model = Model(lanes)
    flat, got = ahead.ravel(), np.arange(lanes)
    end = got + (most - 1) * lanes
    width = np.full(lanes, (1 << 63) - 1, U)
    ids = np.zeros((longest, lanes), np.uint16)
    for step in range(longest):
        bounds = model.predict()
        width //= bounds[8].astype(U)
        s = np.add.reduce((bounds[1:8] <= (rest // width).astype(np.float32)).view(np.uint8), 0, np.uint8).astype(np.int64)
        at = s * lanes + model.lane
        base, top = bounds.ravel().take(at).astype(U), bounds.ravel().take(at + lanes).astype(U)
        rest -= width * base
        width *= top - base
        width >>= BITS.take(s)
        np.maximum(width, U(1), out=width)
        plain = (rest // width) * PLAIN.take(s) & U(0xFFFF)
        rest -= width * plain
        model.guess[3] = plain
        now = model.guess.ravel().take(np.minimum(s, 3) * lanes + model.lane)
        full = np.flatnonzero(width < RENEW)
        place = got.take(full)
        rest[full] = rest.take(full) << U(32) | flat.take(place)
        got[full] = np.minimum(place + lanes, end.take(full))
        width[full] = width.take(full) << U(32)
        ids[step] = now
        model.learn(now, model.hits(now), s, step)
    ids = np.ascontiguousarray(ids.T)
    return [ids[lane, :n] for lane, n in enumerate(sizes)]


def shares(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges [a, b) of rows of like sizes, of about ``limit`` at most: a step costs much the same for a few blocks as for many, so no small rest is left."""
    ends = np.cumsum(sizes)
    n = int(-(-ends[-1] // limit)) if len(ends) else 0
    cuts = np.unique(np.r_[0, np.searchsorted(ends, ends[-1] * np.arange(1, n) / n, "right"), len(ends)]) if n > 1 else [0, len(ends)]
    return [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def in_lanes(n: int) -> list[tuple[int, int]]:
    """Ranges of ``n`` blocks that are coded in step."""
    return shares(np.ones(n, np.int64), LANES)


def text_shares(texts: pa.StringArray, limit: int) -> list[tuple[int, int]]:
    return shares(pc.binary_length(texts).to_numpy().astype(np.int64), limit)


@lru_cache(2)
def _tokenizer(path: str):  # noqa: ANN202
    """The library's tokenizer, a pattern of its special strings, and the number of bytes that each id spells."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("this format holds vocabularies of up to 65,536 ids")
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    spelled = np.array([len(tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())])
    return tokenizer, "|".join(["\\x00", *map(re.escape, special)]), spelled


class Memo:
    """Units that a worker has had from the library, with their ids; beyond MEMO units it keeps those of the last texts, which changes no result."""

    def __init__(self):
        self.place, self.flat, self.sizes = {}, np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def ids(self, units: pa.StringArray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the distinct units are among all that the worker has; ids of these, and their numbers."""
        words = units.to_numpy(zero_copy_only=False)
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        flat, sizes = unit_ids(units.take(pa.array(new)), path)
        at[new] = len(self.sizes) + np.arange(len(new))
        self.place.update(zip(words[new], at[new].tolist(), strict=True))
        self.flat, self.sizes = np.r_[self.flat, flat], np.r_[self.sizes, sizes]
        out = at, self.flat, self.sizes
        if len(self.place) > MEMO:
            self.place = dict(zip(words, range(len(words)), strict=True))
            self.flat, self.sizes = _picked(self.flat, self.sizes, at), self.sizes[at]
        return out


@lru_cache(2)
def _memo(path: str) -> Memo:
    return Memo()


def _flat(encodings: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all encodings, and their numbers."""
    ids = [np.array(e.ids, np.uint32) for e in encodings]
    return np.concatenate([np.zeros(0, np.uint32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))


def _picked(flat: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` (of the given sizes) that ``pick`` names, one after another; some at a time, so that they stay in the cache."""
    begins, n, at = np.cumsum(sizes) - sizes, sizes[pick], 0
    out = np.empty(int(n.sum()), flat.dtype)
    for a in range(0, len(pick), 1 << 15):
        part = n[a : a + (1 << 15)]
        ends = np.cumsum(part)
        source = np.repeat(begins[pick[a : a + (1 << 15)]] - (ends - part), part)
        source += np.arange(len(source))
        np.take(flat, source, out=out[at : at + len(source)], mode="clip")
        at += len(source)
    return out


def unit_ids(units: pa.StringArray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units, and their numbers.  Units that begin with a single space go to the library many in a text, which is told apart by the bytes that ids spell."""
    tokenizer, _, spelled = _tokenizer(path)
    joins = pc.and_(pc.match_substring_regex(units, rf"\A [^{SPACE[1:]}"), pc.match_substring_regex(units, rf"[^{SPACE[1:]}\z"))
    together, alone = np.flatnonzero(joins), np.flatnonzero(pc.invert(joins))
    some = units.take(pa.array(together))
    ends = np.r_[0, np.cumsum(pc.binary_length(some).to_numpy())]
    data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), "")[0].as_buffer().to_pybytes() if len(some) else b""
    cuts = ends[np.r_[0 : len(some) : JOINED, len(some)]].tolist()
    ids, _ = _flat(tokenizer.encode_batch_fast([data[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a], add_special_tokens=False))
    spelt = np.cumsum(spelled[ids])
    stops = np.searchsorted(spelt, ends[1:])
    if len(stops) and (stops[-1] >= len(spelt) or not np.array_equal(spelt[stops], ends[1:])):
        raise ValueError("ids of this vocabulary do not spell the bytes of a text")
    own, n = _flat(tokenizer.encode_batch_fast(units.take(pa.array(alone)).to_pylist(), add_special_tokens=False))
    sizes = np.r_[np.diff(np.r_[0, stops + 1]), n]
    order = np.empty(len(units), np.int64)
    order[np.r_[together, alone]] = np.arange(len(units))
    return _picked(np.r_[ids, own], sizes, order), sizes[order]


def after_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the UTF-8 character before each place is one of LETTERS or IDEOGRAPHS."""
    third, second, first = (data[np.maximum(at - i, 0)].astype(np.int64) for i in (1, 2, 3))
    two, three = (second & 31) << 6 | third & 63, (first & 15) << 12 | (second & 63) << 6 | third & 63
    more = third >> 6 == 2
    return np.where(more, (second >> 5 == 6) & LETTERS[two] | (second >> 6 == 2) & (first >> 4 == 14) & (three >= IDEOGRAPHS[0]) & (three <= IDEOGRAPHS[1]), LETTERS[third])


def units_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The units of all texts, one after another, and the number of units up to each text's end; see token_ids."""
    odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2][bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else pa.py_buffer(b"")
    bounds, data = bounds - bounds[0], np.frombuffer(raw, np.uint8)
    kinds = np.frombuffer(raw.to_pybytes().translate(KINDS), np.uint8)
    at = np.flatnonzero(kinds != 0)
    kind = kinds[at]
    fits = np.ones(len(at), bool)
    if odd.any():  # elsewhere white space is single and between other characters
        beside = ENDS_NONE[data[np.maximum(at - 1, 0)]] & BEGINS_NONE[data[np.minimum(at + 1, len(data) - 1)]]
        beside &= ~(np.isin(at, bounds) | np.isin(at + 1, bounds))  # neighbours of the same text
        fits = beside | ~np.repeat(odd, np.diff(bounds))[at]
    marks, ends = at[kind == MARK], at[(kind == LINE_END) & fits]
    cut = np.zeros(len(data) + 1, bool)
    cut[at[(kind == BLANK) & fits]] = cut[ends] = cut[ends + 1] = cut[bounds] = True
    cut[marks[after_letter(data, marks)]] = True
    cut[-1] = False
    begins = np.flatnonzero(cut)
    offsets = pa.py_buffer(np.r_[begins, len(data)].astype(np.int32))
    return pa.StringArray.from_buffers(len(begins), offsets, raw), np.searchsorted(begins, bounds[1:])


def token_ids(texts: pa.StringArray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, END after each, and their numbers by text, as the library gives them for the whole texts.

    Texts are cut before single spaces and around single line ends between characters that are none, and between a letter
    or digit and a mark of ".,;:!?": byte-level pre-tokens never cross such places.  Each distinct unit goes to the library
    once.  Texts with special strings or null characters go to it whole.
    """
    tokenizer, special, _ = _tokenizer(path)
    whole = pc.match_substring_regex(texts, special).to_numpy(zero_copy_only=False)
    units, stops = units_of(pc.if_else(pa.array(whole), "", texts))
    coded = units.dictionary_encode()
    place, flat, sizes = _memo(path).ids(coded.dictionary, path)
    # END, and the texts that went whole, are further units
    own, n_units = np.flatnonzero(whole), len(sizes)
    ids, n = _flat([tokenizer.encode(t, add_special_tokens=False) for t in texts.take(pa.array(own)).to_pylist()])
    flat, sizes = np.r_[flat, np.uint32(END), ids].astype(np.uint32), np.r_[sizes, 1, n]
    text, more = np.r_[own, : len(texts)], np.r_[n_units + 1 + np.arange(len(own)), np.full(len(texts), n_units)]
    order = np.argsort(text, kind="stable")
    at = np.insert(place[coded.indices.to_numpy()], stops[text[order]], more[order])
    starts = np.r_[0, stops][:-1] + np.arange(len(texts)) + np.cumsum(whole) - whole
    counts = np.add.reduceat(sizes[at], starts) if len(texts) else np.zeros(0, np.int64)
    return _picked(flat, sizes, at), counts


ROW = "part int, seq int, doc_ids array<{key}>, n_tokens array<long>, block_sizes array<int>, block_crcs array<long>, blocks array<binary>"


def write_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenizes, codes and writes the ids; returns the files' table as read back."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in text_shares(batch.column(1), ROW_BYTES):
                texts = batch.column(1).slice(a, b - a)
                parts = [token_ids(texts.slice(c, d - c), path) for c, d in text_shares(texts, TEXT_BYTES)]
                ids, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
                blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
                coded = [x for i, j in in_lanes(len(blocks)) for x in encode(blocks[i:j])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
                    pa.array([batch.column(0).slice(a, b - a).to_pylist()], pa.list_(batch.schema.field(0).type)),
                    pa.array([counts.tolist()], pa.list_(pa.int64())),
                    pa.array([[len(x) for x in blocks]], pa.list_(pa.int32())),
                    pa.array([[zlib.crc32(x.astype("<u4").tobytes()) for x in blocks]], pa.list_(pa.int64())), pa.array([coded], pa.list_(pa.binary())),
                ], ["part", "seq", "doc_ids", "n_tokens", "block_sizes", "block_crcs", "blocks"])
                seq += 1

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return written(ordered.mapInArrow(code, ROW.format(key=rows.schema["doc_id"].dataType.simpleString())), "token-ids", "none")


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the coded blocks alone; ``start`` counts the ids before it."""
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def uncode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                sizes, coded = row["block_sizes"].as_py(), row["blocks"].as_py()
                blocks = [x for a, b in in_lanes(len(coded)) for x in decode(coded[a:b], sizes[a:b])]
                raw = [x.astype("<u4").tobytes() for x in blocks]
                if [zlib.crc32(x) for x in raw] != row["block_crcs"].as_py():
                    raise ValueError("a block of token ids is damaged")
                whole, counts = memoryview(b"".join(raw)), row["n_tokens"].as_py()
                ends = np.cumsum(counts)
                begins = ends - counts
                crcs = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, pa.array([row["part"].as_py()] * n, pa.int32()), pa.array([row["seq"].as_py()] * n, pa.int32()), pa.array(begins, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "part", "seq", "begin", "n_tokens", "ids_crc32"],
                )

    docs = files.mapInArrow(uncode, f"doc_id {kind}, part int, seq int, begin long, n_tokens long, ids_crc32 long")
    # a row of sums for each file row, ordered inside its part; then one for each part
    sums = files.select("part", "seq", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
    inside = sums.withColumn("inside", F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")).drop("n")
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    return docs.join(inside.join(parts, "part"), ["part", "seq"]).select("doc_id", (F.col("ahead") + F.col("inside") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")

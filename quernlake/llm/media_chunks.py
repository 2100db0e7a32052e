"""Operator 1: media payloads in content-defined, deduplicated chunks.

A text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576, are its payload of 8-bit samples.  A rolling
gear hash cuts it into chunks at places that depend on the content alone; chunks are known by their SHA-256.

1. A first pass lists each distinct text's chunk digests.  Joins on the digest find the chunks that stand in several
   places, and the place that owns each: the first by text digest and order.
2. A second pass makes a frame of each chunk (its length and its zlib stream).  A text's row in the store keeps the
   frames of the chunks it owns and the ordered digest list.  Only texts that share a chunk, or that several tasks hold,
   need to meet what the joins found, by a shuffle of their frames; a Bloom filter of fixed size (4 MB) tells them from
   the others, which are stored at once.  Texts that it takes in by mistake are shuffled for nothing; once it is full,
   beyond some ten million such texts, all are.
3. The store is read back.  Texts that own all their chunks are complete; the others fetch shared frames by a join on
   the digest.  Frames in list order are the medium; every chunk is checked against its digest.

Results are computed from the bytes read back, per distinct text, and joined to the documents.

Defined cases: null is an empty text, whose payload is 576 bytes of 255; equal texts have equal results; texts of any
length below 2 GB are taken whole; repeated rows each get a row; an empty table gives an empty result; extra columns are
dropped.  Texts of a task are listed once, tables that meet on a hot digest or text are written first, so that Spark can
split such joins.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.llm.common import slices, text_digest, written

UNIT, FILL = 576, b"\xff"
#: Last bytes of a payload whose checksum is told.
TAIL = 32
#: Chunk sizes in bytes; a cut falls where the top bits of the hash are 0, every 2**CUT_BITS bytes on average.
SMALLEST, LARGEST, CUT_BITS = 1024, 16384, 11
#: Bits of the Bloom filter, and places of it that a text sets.
FILTER_BITS, PROBES = 1 << 25, 3
GEAR = np.random.default_rng(0x6EA4).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw + FILL * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def cut_places(data: bytes) -> np.ndarray:
    """Ends of possible chunks: where the gear hash of the 32 bytes up to there has its top bits 0."""
    hashed = GEAR[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8, 16):  # doubling: a hash of 2n bytes is that of n bytes, and of the n before them, shifted
        earlier = hashed[:-shift] << np.uint32(shift)
        hashed = hashed.copy()
        hashed[shift:] += earlier
    return np.flatnonzero(hashed >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunked(payloads: list[bytes]) -> list[list[bytes]]:
    """The chunks of each payload.  A window never reaches back over a chunk's start, as chunks are longer than it."""
    whole = b"".join(payloads)
    places = cut_places(whole)
    out, begin = [], 0
    for data in payloads:
        end, at, chunks = begin + len(data), begin, []
        while end - at > SMALLEST:
            k = np.searchsorted(places, at + SMALLEST)
            stop = min(int(places[k]) if k < len(places) else end, at + LARGEST, end)
            chunks.append(whole[at:stop])
            at = stop
        if at < end:
            chunks.append(whole[at:end])
        out.append(chunks)
        begin = end
    return out


def to_frame(chunk: bytes) -> bytes:
    return struct.pack("<I", len(chunk)) + zlib.compress(chunk, 6)


def from_frame(frame: bytes) -> bytes:
    chunk = zlib.decompress(frame[4:])
    if len(chunk) != struct.unpack("<I", frame[:4])[0]:
        raise ValueError("a chunk frame is damaged")
    return chunk


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, entropy in bits, and mean step of the samples."""
    share = np.bincount(samples, minlength=256) / len(samples)
    share = share[share > 0]
    step = np.abs(np.diff(samples.astype(np.int16))).mean()
    return f"mean={samples.mean():.4f};std={samples.std():.4f};entropy={-(share * np.log2(share)).sum():.4f};step={step:.4f}"


def _each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    """(digests, texts) of some distinct texts at a time, each once per task."""
    seen: set[bytes] = set()
    for batch in batches:
        tids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = []
        for i, tid in enumerate(tids):
            if tid not in seen:
                seen.add(tid)
                rows.append(i)
        some = [texts[i] for i in rows]
        for a, b in slices(some):
            yield [tids[i] for i in rows[a:b]], some[a:b]


def _digests(chunks: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(c).digest() for c in chunks]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tids, texts in _each_text(batches):
        digests = list(map(_digests, chunked([payload(t) for t in texts])))
        yield pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), pa.array(digests, pa.list_(pa.binary()))], ["tid", "digests"])


def in_filter(tids: list[bytes], bits: np.ndarray) -> np.ndarray:
    """Which text digests a Bloom filter may hold: at the PROBES places that their first words name."""
    places = np.frombuffer(b"".join(t[: 4 * PROBES] for t in tids), ">u4").reshape(-1, PROBES) & (FILTER_BITS - 1)
    return ((bits[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def filter_of(tids: DataFrame) -> np.ndarray:
    """The Bloom filter of (tid): FILTER_BITS bits at any number of texts, summed up by Spark."""
    word = lambda k: F.conv(F.substring(F.hex("tid"), 8 * k + 1, 8), 16, 10).cast("long")
    places = tids.select(F.explode(F.array(*map(word, range(PROBES)))).alias("place")).select((F.col("place") % FILTER_BITS).alias("place"))
    found = places.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))).alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    bits[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bits.view(np.uint64)


def _framed(bits: np.ndarray, met: bool):
    """The frames of the texts in the filter, or of those that are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tids, texts in _each_text(batches):
            rows = np.flatnonzero(in_filter(tids, bits) == met).tolist()
            tids, texts = [tids[i] for i in rows], [texts[i] for i in rows]
            chunks = chunked([payload(t) for t in texts])
            frames = [list(map(to_frame, c)) for c in chunks]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(list(map(_digests, chunks)), pa.list_(pa.binary())), pa.array(frames, pa.list_(pa.binary()))], ["tid", "n_bytes", "digests", "frames"]
            )

    return run


FRAMED = "tid binary, n_bytes long, digests array<binary>, frames array<binary>"


def _places(listed: DataFrame) -> DataFrame:
    return listed.select("tid", F.posexplode("digests").alias("place", "digest"))


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes the chunk store of (tid, text); returns it as read back, with the list of borrowed places.

    Store: tid, n_bytes, digests (the ordered list), own (the frame at each place, null where it is lent or borrowed),
    lent (place, digest and frame of owned chunks that other places borrow), borrows.  Borrowed: tid, place, digest.
    """
    each = docs.mapInArrow(_listed, "tid binary, digests array<binary>").groupBy("tid")
    listed = written(each.agg(F.first("digests").alias("digests"), F.count("*").alias("tasks")), "chunk-lists")
    owners = _places(listed).groupBy("digest").agg(F.min(F.struct("tid", "place")).alias("owner"), F.count("*").alias("n"))
    owners = written(owners.filter(F.col("n") > 1).select("digest", "owner"), "chunk-owners")
    owned = (F.col("tid") == F.col("owner.tid")) & (F.col("place") == F.col("owner.place"))
    shared = written(_places(listed).join(owners, "digest").select("tid", "place", "digest", owned.alias("owned")), "chunk-shared")
    roles = shared.groupBy("tid").agg(F.collect_list(F.when(F.col("owned"), F.col("place"))).alias("lends"), F.collect_list(F.when(~F.col("owned"), F.col("place"))).alias("borrows"))
    # texts that share a chunk, or that several tasks hold, meet by an exchange; those surely neither are stored at once
    bits = filter_of(shared.select("tid").unionByName(listed.filter(F.col("tasks") > 1).select("tid")))
    alone = docs.mapInArrow(_framed(bits, False), FRAMED)
    lone = alone.select("tid", "n_bytes", "digests", F.col("frames").alias("own"), F.array().cast(LENT).alias("lent"), F.lit(False).alias("borrows"))
    met = docs.mapInArrow(_framed(bits, True), FRAMED).groupBy("tid").agg(*[F.first(c).alias(c) for c in ("n_bytes", "digests", "frames")])
    none = F.array().cast("array<int>")
    rows = met.join(roles, "tid", "left").withColumn("lends", F.coalesce("lends", none)).withColumn("borrows", F.coalesce("borrows", none))
    away = F.concat("lends", "borrows")
    own = F.transform("frames", lambda f, i: F.when(~F.array_contains(away, i), f))
    lent = F.transform("lends", lambda i: F.struct(i.alias("place"), F.get("digests", i).alias("digest"), F.get("frames", i).alias("frame")))
    rows = rows.select("tid", "n_bytes", "digests", own.alias("own"), lent.cast(LENT).alias("lent"), (F.size("borrows") > 0).alias("borrows"))
    kept = written(lone.unionByName(rows), "chunk-store", "none")
    return kept, shared.filter(~F.col("owned")).select("tid", "place", "digest")


LENT = "array<struct<place:int,digest:binary,frame:binary>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Media and payloads from the frames at their places; digests are checked."""
    for batch in batches:
        rows = []
        for r in range(batch.num_rows):
            row = {name: batch.column(name)[r].as_py() for name in batch.schema.names}
            frames = row["own"]
            for place, frame in [(x["place"], x["frame"]) for x in (*row["lent"], *(row["fetched"] or ()))]:
                frames[place] = frame
            chunks = list(map(from_frame, frames))
            if [hashlib.sha256(c).digest() for c in chunks] != row["digests"]:
                raise ValueError("a chunk differs from its digest")
            medium, data = b"".join(frames), b"".join(chunks)
            if len(data) % UNIT or data[row["n_bytes"] :] != FILL * (len(data) - row["n_bytes"]):
                raise ValueError("a payload is damaged")
            rows.append((row["tid"], row["n_bytes"], len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-TAIL:]), len(medium), hashlib.sha256(medium).hexdigest(), feature(np.frombuffer(data, np.uint8)), len(chunks)))
        columns = list(zip(*rows, strict=True)) or [()] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], NAMES)


NAMES = ["tid", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
SCHEMA = "tid binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"


def read_back(kept: DataFrame, borrowed: DataFrame) -> DataFrame:
    """What _read() finds of each distinct text in the store."""
    lent = kept.select(F.explode("lent").alias("l")).select("l.digest", "l.frame")
    fetched = borrowed.join(lent, "digest").groupBy("tid").agg(F.collect_list(F.struct("place", "frame")).alias("fetched"))
    columns = ["tid", "n_bytes", "digests", "own", "lent", "fetched"]
    alone = kept.filter(~F.col("borrows")).withColumn("fetched", F.lit(None).cast("array<struct<place:int,frame:binary>>")).select(*columns)
    joined = kept.filter("borrows").join(fetched, "tid").select(*columns)
    return alone.mapInArrow(_read, SCHEMA).unionByName(joined.mapInArrow(_read, SCHEMA))


def media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks) of each document."""
    texts = docs.select(text_digest(F.coalesce(F.col(text), F.lit(""))).alias("tid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    facts = written(read_back(*store(texts)), "media-facts")
    return docs.select(F.col(key).alias("doc_id"), text_digest(F.coalesce(F.col(text), F.lit(""))).alias("tid")).join(facts, "tid").drop("tid")

"""Operator 1: payloads come back exactly, chunks follow the content, shared chunks are stored once."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from rows import ODD_ROWS

from quernlake.llm import media_chunks


def facts(text: str | None) -> tuple:
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // 576)) * 576
    data = raw + b"\xff" * (size - len(raw))
    return len(raw), size, hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:])


def check_rows(got, texts: dict) -> None:
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in [facts(t) for t in texts[r.doc_id]]


def test_odd_rows(odd):
    texts: dict = {}
    for key, text, _ in ODD_ROWS:
        texts.setdefault(key, []).append(text)
    got = media_chunks.media(odd).collect()
    assert len(got) == len(ODD_ROWS)
    check_rows(got, texts)
    same = {tuple(r)[1:] for r in got if r.doc_id == 7} & {tuple(r)[1:] for r in got if r.doc_id == 6}
    assert len(same) == 1  # equal texts, equal values
    assert media_chunks.media(odd.limit(0)).collect() == []


def test_documents(spark, small, small_dir):
    got = media_chunks.media(spark.read.parquet(f"{small_dir}/documents.parquet")).collect()
    assert len(got) == len(small)
    check_rows(got, {k: [t] for k, t in zip(small.doc_id, small.text, strict=True)})


def slow_cuts(data: bytes) -> list[int]:
    out, gear = [], media_chunks.GEAR.tolist()
    for end in range(1, len(data) + 1):
        value = 0
        for byte in data[max(0, end - 32) : end]:
            value = (value << 1) + gear[byte] & 0xFFFFFFFF
        if value >> (32 - media_chunks.CUT_BITS) == 0:
            out.append(end)
    return out


def test_cuts_are_those_of_a_rolling_hash():
    data = random.Random(1).randbytes(20_000)
    assert media_chunks.cut_places(data).tolist() == slow_cuts(data)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=200).map(lambda b: b * 40), min_size=1, max_size=4))
def test_chunks_make_up_the_payload(payloads):
    got = media_chunks.chunked(payloads)
    assert [b"".join(c) for c in got] == payloads
    assert all(0 < len(c) <= media_chunks.LARGEST for chunks in got for c in chunks)
    assert media_chunks.chunked(payloads[::-1]) == got[::-1]  # each by itself
    assert [media_chunks.from_frame(media_chunks.to_frame(c)) for chunks in got for c in chunks] == [c for chunks in got for c in chunks]


def _stored(docs):
    return media_chunks.store(docs.select(media_chunks.text_digest(F.col("text")).alias("tid"), F.coalesce("text", F.lit("")).alias("text")))


def test_shared_passages_are_stored_once(documents):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = " ".join(word() for _ in range(9000))
    texts = [" ".join(word() for _ in range(rng.randrange(300))) + " " + passage + " " + word() for _ in range(12)]
    kept, borrowed = _stored(documents([(i, t, "a") for i, t in enumerate(texts)]))
    listed = [d for r in kept.select("digests").collect() for d in r.digests]
    own = kept.select(F.explode("own").alias("f")).filter("f IS NOT NULL").count() + kept.select(F.explode("lent")).count()
    assert own == len(set(map(bytes, listed)))
    assert borrowed.count() == len(listed) - own > 0.8 * len(listed)
    got = media_chunks.read_back(kept, borrowed).collect()
    assert sorted(r.payload_sha256 for r in got) == sorted(facts(t)[2] for t in texts)


def test_a_chunk_repeated_in_one_text(documents):
    text = "x" * 200_000
    (row,) = media_chunks.media(documents([(1, text, "a")])).collect()
    assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == facts(text)


def test_damage_is_found(documents):
    kept, borrowed = _stored(documents([(1, "some text " * 500, "a")]))
    worse = kept.withColumn("digests", F.transform("digests", lambda d: F.unhex(F.sha2(d, 256))))
    with pytest.raises(Exception, match="differs from its digest"):
        media_chunks.read_back(worse, borrowed).collect()


def test_feature():
    samples = np.array([0, 10, 20, 30], np.uint8)
    assert media_chunks.feature(samples) == "mean=15.0000;std=11.1803;entropy=2.0000;step=10.0000"


def test_tail_is_the_last_32_bytes(documents):
    """Texts of whole units that differ before their last 32 bytes have one checksum of the tail, and others where these differ."""
    whole = ["a" * 544 + "z" * 32, "b" * 544 + "z" * 32, "a" * 544 + "y" * 32]
    got = {r.doc_id: r.tail_crc32 for r in media_chunks.media(documents([(i, t, "a") for i, t in enumerate(whole)])).collect()}
    assert got == {0: zlib.crc32(b"z" * 32), 1: zlib.crc32(b"z" * 32), 2: zlib.crc32(b"y" * 32)}

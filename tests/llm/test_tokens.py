"""Operators 7, 8 and 9 against the libraries, and exact round trips."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernlake.llm import id_files, piece_sampling, token_counts
from rows import ODD_ROWS

TEXTS = st.lists(st.text(st.one_of(st.sampled_from(" \n\t▁aeinrst."), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=8)


@pytest.fixture(scope="module")
def pieces(vocabulary):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def byte_level(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def counted(texts, ranks):
    return [int(sum(ranks.counts(w))) if (w := token_counts.pre_tokens(t)) else 0 for t in texts]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_merging_counts_what_the_library_counts(vocabulary, pieces, texts):
    ranks = token_counts.ranks_of(vocabulary("piece_bpe_32k.model"))
    assert counted(texts, ranks) == [len(x) for x in pieces.encode(texts, num_threads=1)]


def test_repeated_letters(vocabulary, pieces):
    texts = [c * n for c in "aet. " for n in (1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 33, 1000)] + ["abababab" * 9, "aaabaaab" * 7, "..,..,.." * 5]
    ranks = token_counts.ranks_of(vocabulary("piece_bpe_32k.model"))
    assert counted(texts, ranks) == [len(x) for x in pieces.encode(texts, num_threads=1)]


def test_counts_of_odd_rows(odd, vocabulary, pieces):
    got = sorted(map(tuple, token_counts.count_tokens(odd, vocabulary("piece_bpe_32k.model")).collect()), key=str)
    want = []
    for key, text, _ in ODD_ROWS:
        n = len(pieces.encode(text or ""))
        want.append((key, len((text or "").encode()), n, n > 4096))
    assert got == sorted(want, key=str)


def test_counts_of_documents(spark, small, vocabulary, pieces):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, vocabulary("piece_bpe_32k.model")).collect()}
    assert got == dict(zip(small.doc_id, [len(x) for x in pieces.encode([t or "" for t in small.text])], strict=True))
    assert token_counts.count_tokens(docs.limit(0), vocabulary("piece_bpe_32k.model")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 3)), min_size=1, max_size=400), min_size=1, max_size=5))
def test_coded_blocks_come_back(blocks):
    arrays = [np.array(b, np.int64) for b in blocks]
    back = id_files.decode(id_files.encode(arrays), list(map(len, arrays)))
    assert [b.tolist() for b in back] == blocks


def test_blocks_are_independent_and_small():
    rng = np.random.default_rng(1)
    text = np.tile(rng.integers(0, 50_000, 60), 40)[: id_files.BLOCK]
    noise = rng.integers(0, 1 << 16, id_files.BLOCK)
    alone, both = id_files.encode([text])[0], id_files.encode([noise, text])
    assert both[1] == alone
    assert len(alone) < len(text)  # under a quarter of 32-bit integers
    assert len(both[0]) < 2.4 * len(noise)


SPACED = st.lists(st.text(st.one_of(st.sampled_from("  \n\t'ast.,;7\u00a0\u3000é\0"), st.characters(exclude_categories=["Cs"])), max_size=50) | st.sampled_from(["<|endoftext|> a", "it's  'tis", " x ", "a \n b"]), min_size=1, max_size=8)


@settings(max_examples=400, deadline=None)
@given(SPACED)
def test_ids_are_those_of_whole_texts(vocabulary, byte_level, texts):
    flat, counts = id_files.token_ids(pa.array(texts, pa.string()), vocabulary("byte_bpe_50k.json"))
    got = np.split(flat, np.cumsum(counts)[:-1]) if texts else []
    assert [x.tolist() for x in got] == [byte_level.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_line_ends_part_units(vocabulary, byte_level, monkeypatch):
    """A word before or after a line end is the unit that it is elsewhere, and goes to the library once."""
    asked = []
    unit_ids = id_files.unit_ids
    monkeypatch.setattr(id_files, "_memo", lambda path, memo=id_files.Memo(): memo)
    monkeypatch.setattr(id_files, "unit_ids", lambda units, path: asked.extend(units.to_pylist()) or unit_ids(units, path))
    texts = ["one two.\none\ntwo, one", "one\n two", "one two two.\none", "\none", "two\n\none two"]
    flat, counts = id_files.token_ids(pa.array(texts), vocabulary("byte_bpe_50k.json"))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [byte_level.encode(t).ids + [0] for t in texts]
    assert len(asked) == len(set(asked))
    assert set(asked) == {"one", "two", " one", " two", ".", ",", "\n", "one\n two", "\none", "two\n\none"}  # the last three have odd white space


def test_a_full_memo_changes_no_ids(vocabulary, byte_level, monkeypatch):
    monkeypatch.setattr(id_files, "MEMO", 4)
    monkeypatch.setattr(id_files, "_memo", lambda path, memo=id_files.Memo(): memo)
    for text in ["a few words here, and more", "more words. here and", "other few", "a few words here, and more"]:
        flat, _ = id_files.token_ids(pa.array([text]), vocabulary("byte_bpe_50k.json"))
        assert flat.tolist() == byte_level.encode(text).ids + [0]


def test_no_small_rest():
    """Rows and steps of coding are of like size: 17 MB are not 14 and 3 MB, and 4,700 blocks not 4,096 and 604."""
    assert [b - a for a, b in id_files.shares(np.full(1700, 10_000), 14_000_000)] == [850, 850]
    assert [b - a for a, b in id_files.in_lanes(4700)] == [2350, 2350]
    assert id_files.shares(np.array([5, 900, 5]), 100)[-1][1] == 3
    assert id_files.shares(np.zeros(3, np.int64), 100) == [(0, 3)] and id_files.shares(np.zeros(0, np.int64), 100) == []


def test_marks_part_units_after_letters():
    """A mark is parted from a letter or digit of any length before it, wherever it stands, and from nothing else."""
    texts = ["3.14 né:один;汉!a", ").” x", "a  b,é c", "", " \u3000a \u3000b"]
    units, stops = id_files.units_of(pa.array(texts))
    got = [x.tolist() for x in np.split(units.to_numpy(zero_copy_only=False), stops[:-1])]
    assert got == [["3", ".14", " né", ":один", ";汉", "!a"], [").”", " x"], ["a  b", ",é c"], [], [" \u3000a \u3000b"]]


def brute_ids(rows, byte_level):
    """Rows in ascending order of id (nulls first), with the ids before each."""
    start, out = 0, []
    for key, text in rows:
        ids = np.array(byte_level.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_ids_of_documents(spark, small, vocabulary, byte_level):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    path = vocabulary("byte_bpe_50k.json")
    got = id_files.read_ids(id_files.write_ids(docs, path)).orderBy("doc_id").collect()
    rows = sorted(zip(small.doc_id.tolist(), small.text.tolist(), strict=True))
    assert list(map(tuple, got)) == brute_ids(rows, byte_level)
    assert id_files.read_ids(id_files.write_ids(docs.limit(0), path)).collect() == []


def test_ids_of_odd_rows(odd, vocabulary, byte_level):
    got = sorted(map(tuple, id_files.read_ids(id_files.write_ids(odd, vocabulary("byte_bpe_50k.json"))).collect()), key=lambda r: r[1])
    keys = [k for k, *_ in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert [r[1] for r in got] == np.r_[0, np.cumsum([r[2] for r in got])[:-1]].tolist()
    want = brute_ids([(k, t) for k, t, _ in ODD_ROWS], byte_level)
    assert sorted(((k, n, c) for k, _, n, c in got), key=str) == sorted(((k, n, c) for k, _, n, c in want), key=str)


def test_damage_is_found(spark, documents, vocabulary):
    from pyspark.sql import functions as F

    files = id_files.write_ids(documents([(1, "some text", "a")]), vocabulary("byte_bpe_50k.json"))
    worse = files.withColumn("block_crcs", F.transform("block_crcs", lambda c: c + 1))
    with pytest.raises(Exception, match="damaged"):
        id_files.read_ids(worse).collect()


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_samples_decode_to_their_text(vocabulary, pieces, texts):
    lattices = piece_sampling.lattices_of(vocabulary("piece_bpe_32k.model"))
    raw = piece_sampling.spelled(vocabulary("piece_bpe_32k.model"))
    ids = piece_sampling.sample(texts, list(range(len(texts))), lattices)
    assert [b"".join(raw[i] for i in x.tolist())[1:].decode() for x in ids] == texts


def test_sampling_follows_the_lattice(vocabulary):
    """Shares of sampled segmentations of one word match their weights, by enumeration of all segmentations."""
    path = vocabulary("piece_bpe_32k.model")
    lattices, ranks = piece_sampling.lattices_of(path), token_counts.ranks_of(path)
    word = token_counts.MARK + "then"

    def ways(rest: str) -> list[tuple[tuple[int, ...], float]]:
        if not rest:
            return [((), 1.0)]
        return [((ranks.pieces[p], *more), w * lattices.weight[ranks.pieces[p]]) for n in range(1, len(rest) + 1) if (p := rest[:n]) in ranks.pieces for more, w in ways(rest[n:])]

    every = dict(ways(word))
    total, n = sum(every.values()), 40_000
    drawn: dict[tuple[int, ...], int] = {}
    for x in piece_sampling.sample(["then"] * n, list(range(n)), lattices):
        drawn[tuple(x.tolist())] = drawn.get(tuple(x.tolist()), 0) + 1
    assert set(drawn) <= set(every)
    for way, weight in every.items():
        share = weight / total
        assert abs(drawn.get(way, 0) / n - share) < 5 * (share / n) ** 0.5 + 1e-4


def test_samples_depend_on_the_key_alone(odd, vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    one = sorted(map(str, piece_sampling.round_trip(odd, path).collect()))
    two = sorted(map(str, piece_sampling.round_trip(odd.repartition(7), path).collect()))
    assert one == two and len(one) == len(ODD_ROWS)
    assert all("lossless=True" in r for r in one)
    ids = {r.doc_id: r.piece_ids for r in piece_sampling.encode(odd.filter("doc_id IN (6, 7) AND text LIKE 'same%'"), path).collect()}
    assert ids[6] != ids[7]
    assert piece_sampling.round_trip(odd.limit(0), path).collect() == []


def test_piece_ids_are_pieces(odd, vocabulary, pieces):
    for row in piece_sampling.encode(odd, vocabulary("piece_bpe_32k.model")).collect():
        if not (set(row.text) & {token_counts.MARK, "\x00"}):
            assert pieces.decode(list(row.piece_ids)) == row.text or row.text != row.text.strip()


def test_arrow_batches_of_one_row(spark, documents, vocabulary):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        docs = documents([(i, f"text number {i}", "a") for i in range(9)], 2)
        got = id_files.read_ids(id_files.write_ids(docs, vocabulary("byte_bpe_50k.json"))).orderBy("doc_id").collect()
        assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])[:-1]].tolist()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pa.__version__

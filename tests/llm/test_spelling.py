"""Operator 13 against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import ODD_ROWS

from quernlake.llm import spelling

LOWERED = str.maketrans(spelling.UPPER, spelling.LOWER)


def counted(docs: list[tuple]) -> dict[str, int]:
    found: Counter = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:p] + b[p + 1 :] == a for p in range(len(b)))


def brute(words: dict[str, int]) -> set[tuple]:
    near = defaultdict(set)
    by: dict[tuple, set] = defaultdict(set)
    for w in words:  # words one apart share what is left after a code point goes from one or both
        by[w, -1].add(w)
        for p in range(len(w)):
            by[w[:p] + w[p + 1 :], p].add(w)
            by[w[:p] + w[p + 1 :], -1].add(w)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_apart(a, b)}
    form = {}
    for w, n in words.items():
        first = min(((-words[x], x) for x in near[w]), default=None)
        form[w] = (first[1], -first[0]) if first and -first[0] >= 2 * n else (None, None)
    out = set()
    for w, n in words.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        out.add((w, form[w][0], root, n, len(near[w]), form[w][1]))
    return out


def found(docs) -> set[tuple]:
    rows = spelling.groups(docs).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_documents(spark, small, small_dir):
    want = brute(counted(list(zip(small.doc_id, small.text, strict=True))))
    assert found(spark.read.parquet(f"{small_dir}/documents.parquet")) == want
    assert sum(w[1] is not None for w in want) > 20


@pytest.mark.parametrize("bucket", [4, 1 << 14])
def test_shared_parts_in_blocks(documents, monkeypatch, bucket):
    """Small alphabets make hot parts, and forms of forms; words reach from 5 to 80 code points."""
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    monkeypatch.setattr(spelling, "RANGES", 64)
    rng = random.Random(bucket)
    words = ["".join(rng.choices("abÿ", k=rng.choice((5, 6, 7)))) for _ in range(120)] + ["prefixed" + "".join(rng.choices("xy", k=3)) for _ in range(20)] + ["k" * n for n in (5, 6, 7, 79, 80)]
    rows = [(i, " ".join(rng.choices(words, k=40)), "a") for i in range(30)] + [(50 + i, " ".join(["k" * n] * 3 ** (n % 7)), "a") for i, n in enumerate((5, 6, 7, 79, 80))]
    want = brute(counted([r[:2] for r in rows]))
    assert found(documents(rows)) == want and max(w[4] for w in want) >= 5


def test_odd_rows(odd, documents):
    assert found(odd) == brute(counted([r[:2] for r in ODD_ROWS]))
    assert found(odd.limit(0)) == set()
    long = "z" * 3000  # three times, beside one letter less and one more
    rows = [(i, f"{long} {long[1:]} {long}z ÀÉÎõü ÀÉÎõv", None) for i in range(4)]
    assert found(documents(rows)) == brute(counted([r[:2] for r in rows]))


def test_chains_of_forms(documents):
    steps = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb"]
    rows = [(i, " ".join([w] * 3 * 2**k), "a") for k, w in enumerate(steps) for i in [k]]
    words = counted([r[:2] for r in rows])
    got = found(documents(rows))
    assert got == brute(words) and {r[2] for r in got} != {r[0] for r in got}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(0, 2**32 - 1))
def test_ranges(n, seed):
    rng = np.random.default_rng(seed)
    values = rng.permutation(n)
    left, right, low, high = (rng.integers(0, n + 1, 25) for _ in range(4))
    of, value = spelling.WaveletTree(values).report(left, right, low, high)
    want = {(r, v) for r in range(25) for v in values[left[r] : right[r]].tolist() if low[r] <= v < high[r]}
    assert len(of) == len(want) and set(zip(of.tolist(), value.tolist(), strict=True)) == want

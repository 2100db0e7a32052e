"""Operator 12 against SQL and brute force."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same, connect, rows_of
from rows import ODD_ROWS

from quernlake.llm import wand

LOWERED = str.maketrans(wand.UPPER, wand.LOWER)
ITEMS = [(0, "same text for us, and a WORD"), (1, None), (2, "..."), (3, "null mark endoftext ▁ é漢字🙂"), (None, "one text"), (3, "absent terms alone"), (3, "one"), (4, "É word")]


def brute(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    terms = lambda t: re.findall(wand.TERM, (t or "").translate(LOWERED))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    whole, total = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b, n in bags:
            m = 50 + (50 * n * whole) // total
            s = sum(math.floor(1000 * math.log((2 * whole + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if b[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def found(docs, items, k: int = 50) -> list[tuple]:
    return sorted(map(tuple, wand.rank(docs, items, k).collect()), key=repr)


def test_sql(spark, small_dir):
    docs, items = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert_same(wand.rank(docs, items), connect(small_dir), wand.ORACLE)


def test_small_shards_and_brute_force(spark, small, small_dir, monkeypatch):
    monkeypatch.setattr(wand, "SHARD_BYTES", 40_000)
    monkeypatch.setattr(wand, "ITEM_BLOCK", 7)
    docs, items = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute(list(zip(small.doc_id, small.text, strict=True)), [tuple(r) for r in items.select("item_id", "text").collect()], 5)
    assert found(docs, items, 5) == sorted(want, key=repr)


def test_odd_rows(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "0 AS item", "0 AS block", "0 AS terms", "0 AS shard")
    want = brute([r[:2] for r in ODD_ROWS], ITEMS, 50)
    assert found(odd, items) == sorted(want, key=repr) and len(want) > 8
    assert found(odd, items, 2) == sorted(brute([r[:2] for r in ODD_ROWS], ITEMS, 2), key=repr)
    assert found(odd.limit(0), items) == found(odd, items.limit(0)) == found(odd.filter("text = ''"), items) == []


def test_odd_rows_in_sql(spark, odd):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in ODD_ROWS])
    con.execute("CREATE TABLE benchmark(item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", ITEMS)
    want, got = con.sql(wand.ORACLE), wand.rank(odd, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_index_rows():
    batches = list(wand.shard_rows([5, None, 2], [b"b a b", b"", b"A"], 9))
    rows = [r for b in batches for r in b.to_pylist()]
    assert rows[0]["ids"] == [2, 5, None] and rows[0]["with_terms"] == 2 and rows[0]["all_terms"] == 4
    assert {r["term"]: (r["places"], r["tfs"], r["n"]) for r in rows[1:]} == {"a": (b"\0\0\0\0\1\0\0\0", b"\1\0\0\0\1\0\0\0", 2), "b": (b"\1\0\0\0", b"\2\0\0\0", 1)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 40), st.integers(0, 9), max_size=30), max_size=7), st.integers(1, 6))
def test_nothing_that_could_enter_the_heap_is_skipped(lists, k):
    scores = Counter()
    for x in lists:
        scores.update(x)
    want = sorted(((-s, d) for d, s in scores.items() if s > 0))[:k]
    own = [([*sorted(x), wand.END], [x[d] for d in sorted(x)], max(x.values())) for x in lists if x]
    sure = max([1, *(sorted(x.values())[-k] for x in lists if len(x) >= k)])
    for start in (1, sure):
        assert sorted((-s, -d) for s, d in wand.wand(own, k, start)) == want


def test_documents_before_a_pivot_are_not_scored():
    class Watched(list):
        read = 0

        def __getitem__(self, i):
            Watched.read += 1
            return super().__getitem__(i)

    common = list(range(5000))
    rare = list(range(0, 5000, 500))
    lists = [([*common, wand.END], Watched([1] * 5000), 1), ([*rare, wand.END], Watched([100] * 10), 100)]
    assert sorted(wand.wand(lists, 3, 100), reverse=True) == [(101, 0), (101, -500), (101, -1000)]
    assert Watched.read < 50

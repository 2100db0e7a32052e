"""Operator 4 against SQL, a plain water filling, and its own promises."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F
from rows import ODD_ROWS

from quernlake.llm import mixing


def filled(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize(
    "sizes",
    [{"a": 10}, {"a": 1, "b": 1000, None: 5}, {"a": 5, "b": 5, "c": 5, "d": 5}, {"z": 900, "é": 3, "B": 7, "a": 1, None: 2}, {"a": 0, "b": 7}, {f"s{i}": (i * 37) % 101 for i in range(20)}],
)
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(table).collect()}
    assert got == pytest.approx(filled(sizes), rel=1e-9)


def test_sql(spark, small_dir):
    assert_same(mixing.mix(spark.read.parquet(f"{small_dir}/documents.parquet")), connect(small_dir), mixing.ORACLE)


def test_native(spark, small_dir):
    plan = mixing.mix(spark.read.parquet(f"{small_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


def test_hot_source(documents):
    rows = [(i, "w " * (1 + i * i % 90), "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    docs = documents(rows)
    got = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    whole = sum(target.values())
    assert sum(taken.values()) == pytest.approx(whole, rel=0.01)
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6
    assert sum(r.scheduled for r in got) >= 0.98 * whole  # the rest are the sources' last parts
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_interleaves(spark):
    """Any stretch of slots holds about each source's share; ranks count each source's slots."""
    goals = spark.createDataFrame([("a", 100, 600.0), ("b", 100, 300.0), (None, 100, 100.0)], "source string, source_size long, target double")
    slots = mixing.schedule(goals, 1000, 1000).orderBy("slot").collect()
    assert [r.slot for r in slots] == list(range(1000))
    seen: Counter = Counter()
    for r in slots:
        assert r.rank == seen[r.source]
        seen[r.source] += 1
    for start in range(0, 1000, 100):
        part = Counter(r.source for r in slots[start : start + 100])
        assert abs(part["a"] - 60) <= 4 and abs(part["b"] - 30) <= 4 and abs(part[None] - 10) <= 4


def test_odd_rows(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD_ROWS)
    for r in got:
        assert r.size in [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t, _ in ODD_ROWS if k == r.doc_id]
    assert mixing.mix(odd.limit(0)).collect() == []
    blank = odd.filter("text IS NULL OR trim(text) = ''")
    assert all(r.taken == 0 for r in mixing.mix(blank).collect())
    repeated = mixing.repeat(odd)
    assert repeated.columns == odd.columns
    assert repeated.filter(F.trim("text") == "").count() == 0


def test_repeat_follows_the_schedule(documents):
    docs = documents([(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(200)])
    want = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix(docs).collect() if r.taken}
    got = Counter(r.doc_id for r in mixing.repeat(docs).collect())
    assert got == Counter(want)
    assert max(got.values()) <= 2


def test_repeat_keeps_tiny_sources(documents, monkeypatch):
    """Sources below one slot keep their documents in the pipeline."""
    monkeypatch.setattr(mixing, "SLOTS", 16)
    docs = documents([(i, "w " * 50, "huge") for i in range(100)] + [(1000 + i, "v " * (1 + i % 3), f"tiny{i}") for i in range(12)])
    got = Counter(r.doc_id for r in mixing.repeat(docs).collect())
    assert all(got[1000 + i] == 2 for i in range(12))  # a target of twice the source
    assert set(range(100)) <= set(got)


def test_repeat_takes_odd_rows(odd):
    from collections import Counter

    from pyspark.sql import functions as F

    table = odd.withColumns({c: F.lit(1) for c in ("row", "_row", "times", "__n", "__k", "__digest")})
    got = mixing.repeat(table)
    assert got.columns == table.columns
    rows = got.collect()
    counts = Counter((r.doc_id, r.text) for r in rows)
    assert all(r["row"] == r["times"] == r["__n"] == 1 for r in rows)
    assert not [k for k in counts if not (k[1] or "").strip()]  # texts without words give nothing
    assert max(counts.values()) <= 4  # twice its size, for each of two rows alike
    assert mixing.repeat(table.limit(0)).collect() == []


@pytest.mark.parametrize("slots", [1 << 17, 32])
def test_tiny_sources_beside_huge_ones_reach_their_targets(documents, monkeypatch, slots):
    monkeypatch.setattr(mixing, "SLOTS", slots)
    docs = documents([(i, "w " * 40_000, f"huge{i % 2}") for i in range(60)] + [(1000 + i, "v " * (1 + i % 20), f"tiny{i % 9}") for i in range(60)] + [(2000, "one", None)])
    taken, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        assert 0 <= r.scheduled <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in target.items())


def test_many_rows_alike_are_copied_in_parts(documents, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    docs = documents([(5, "same words", "a")] * 50 + [(6, "other", "b")])
    got = Counter(r.doc_id for r in mixing.repeat(docs).collect())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += -(-r.taken // r.size)
    assert got == want and got[5] > 50


def test_a_slot_that_the_schedule_leaves_out_gives_nothing(documents, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 64)
    docs = documents([(i, "w " * 50, f"s{i % 2}") for i in range(100)])
    taken = lambda: sum(r.taken for r in mixing.mix(docs).collect())
    whole, plain = taken(), mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a: plain(*a).filter("NOT (source = 's0' AND rank = 2)"))
    assert taken() == whole - -(-whole // 64)

"""Percentiles and running sums of groups of any size."""

import random

import pytest
from pyspark.sql import functions as F

from quernlake.operators import ordered, retrieval
from quernlake.operators.markdown import fence_state, pack_ranges


def test_percentiles_equal_the_aggregate(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice((None, rng.randint(-5, 5), rng.randint(0, 10**9), rng.random() * 1e-3))) for g in ("a", "b", None) for _ in range(200)] + [("one", 4.0), ("none", None), ("two", -1e308), ("two", 1e308)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double").repartition(5)
    fractions = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    want = df.filter("v IS NOT NULL").groupBy("g").agg(*[F.percentile("v", F.lit(f)).alias(n) for n, f in fractions.items()])
    key = lambda r: str(r.g)
    got = ordered.percentiles(df, ["g"], "v", fractions)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert ordered.percentiles(df.limit(0), ["g"], "v", fractions).collect() == [] and key


def test_a_hot_group_is_never_one_buffer(spark):
    """Two million distinct values of one group: only one range of it is put in order, and no aggregate holds values."""
    df = spark.range(2_000_000, numPartitions=8).select(F.lit(1).alias("g"), F.pmod(F.col("id") * 7919, F.lit(2_000_003)).alias("v"))
    got = ordered.percentiles(df, ["g"], "v", {"p50": 0.5, "p99": 0.99})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "collect" not in plan
    low, high = got.first()[1:]
    exact = df.agg(F.expr("percentile(v, array(0.5, 0.99))")).first()[0]
    assert [low, high] == exact


def test_running_sums_equal_one_window(spark):
    from pyspark.sql import Window

    rng = random.Random(2)
    rows = [(rng.choice((1, 1, 1, None, 2)), i * rng.choice((1, 1, 1000)), rng.choice((None, 0, rng.randint(0, 99)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "query_id int, position long, size int").dropDuplicates(["query_id", "position"]).repartition(6)
    w = Window.partitionBy("query_id").orderBy("position")
    want = df.select("query_id", "position", F.sum(F.coalesce("size", F.lit(0))).over(w).alias("s"), F.row_number().over(w).alias("n")).collect()
    got = ordered.running(df, "query_id", "position", F.col("size"), "s", "n").select("query_id", "position", "s", "n").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    kept = retrieval.within_budget(df, F.coalesce("size", F.lit(0)), 5000).select("query_id", "position").collect()
    assert sorted(map(tuple, kept), key=str) == sorted(((r.query_id, r.position) for r in want if r.s <= 5000 or r.n == 1), key=str)


def folded(marks):
    state, out = "", []
    for m in marks:
        state = m if m and not state else "" if m and m == state else state
        out.append(state != "")
    return out


def test_fences_of_random_pages_equal_the_fold(spark):
    rng = random.Random(3)
    pages = {f"p{k}": [rng.choice(("", "", "```", "~~~", "x", "````py")) for _ in range(rng.choice((1, 255, 256, 257, 3000)))] for k in range(8)}
    rows = [(p, n, line) for p, lines in pages.items() for n, line in enumerate(lines)]
    got = fence_state(spark.createDataFrame(rows, "path string, n int, line string").repartition(4)).collect()
    found = {(r.path, r.n): r.in_fence for r in got}
    assert len(got) == len(rows)
    for p, lines in pages.items():
        assert [found[p, n] for n in range(len(lines))] == folded([x[:1] if x[:1] in "`~" else "" for x in lines])


def test_a_page_of_a_million_lines(spark):
    n = 1_000_000
    lines = spark.range(n, numPartitions=8).select(F.lit("p").alias("path"), F.col("id").cast("int").alias("n"), F.when(F.col("id") % 5 == 2, "```").when(F.col("id") % 7 == 3, "~~~").otherwise("text").alias("line"))
    got = fence_state(lines).agg(F.count("*").alias("n"), F.count_if("in_fence").alias("inside")).first()
    want = folded(["`" if i % 5 == 2 else "~" if i % 7 == 3 else "" for i in range(n)])
    assert (got.n, got.inside) == (n, sum(want))


@pytest.mark.parametrize("head", [0, 3, 200])
def test_pack_ends_equal_a_loop(spark, head):
    import math

    rng = random.Random(head)
    cases = [[rng.choice((0, 5, 60, 115, 116, 130, 145, 500)) for _ in range(rng.randint(0, 40))] for _ in range(60)]

    def loop(words):
        ends, now, total = [], 0, 0
        for i, w in enumerate(words):
            if i > now and math.ceil((head + total + w) * 3.45) > 500:
                ends.append(i)
                now, total = i, 0
            total += w
            if math.ceil((head + total) * 3.45) >= 400:
                ends.append(i + 1)
                now, total = i + 1, 0
        if now < len(words) or not words:
            ends.append(len(words))
        return ends

    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, words array<int>")
    got = {r.i: [p.begin + p.n for p in r.packs] for r in df.select("i", pack_ranges(F.col("words"), F.lit(head)).alias("packs")).collect()}
    assert got == {i: loop(c) for i, c in enumerate(cases)}

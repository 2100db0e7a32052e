import pytest
from pyspark.sql import functions as F

from quernlake.operators import answers, corpus_store, retrieval


def leg(spark, ids):
    return spark.createDataFrame([(0, i, r + 1) for r, i in enumerate(ids)], "query_id int, id string, rank int")


def test_adversarial_fusion(spark):
    fused = retrieval.fuse(leg(spark, ["a", "b", "c", "n"]), leg(spark, ["n", "c", "b", "a"]), 3).orderBy("rank")
    assert [r.id for r in fused.collect()] == ["a", "b", "c"]
    even = retrieval.fuse(leg(spark, ["a", "b"]), leg(spark, ["b", "a"]), 2, dense_weight=0.5, lexical_weight=0.5).collect()
    assert even[0].score == even[1].score


def test_stop_words(spark):
    ask = lambda q: spark.createDataFrame([(q,)], "q string").select(retrieval.or_query(F.col("q"))).first()[0]
    assert ask("how do I deploy a Django app") == "deploy OR Django OR app" and ask("go version") == "go OR version"
    assert ask("را و از") == "" and ask("(the) client_max_body_size?") == "client_max_body_size?"


def test_lexical(spark):
    chunks = spark.createDataFrame([("a", "deploy deploy app"), ("b", "how do I"), ("c", "App store"), ("d", None)], "id string, text string")
    asked = spark.createDataFrame([(1, "how do I deploy the app"), (2, "how do I")], "query_id int, query string")
    got = [(r.query_id, r.id, round(r.score, 3), r["rank"]) for r in retrieval.lexical_search(chunks, asked).orderBy("rank").collect()]
    assert got == [(1, "a", 0.3, 1), (1, "c", 0.1, 2)]
    hits = chunks.select("id", retrieval.phrase_positions(F.col("text"), ["deploy", "app"]).alias("n")).filter("n > 0").collect()
    assert [(h.id, h.n) for h in hits] == [("a", 1)]


def test_dense(spark):
    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("d", None), ("e", [2.0, 0.0])], "id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 3.0])], "query_id int, embedding array<double>")
    got = retrieval.dense_search(chunks, asked, 3).orderBy("rank").collect()
    assert [g.id for g in got] == ["a", "b", "e"] and got[0].distance == pytest.approx(0)
    assert retrieval.dense_search(chunks, asked.limit(0), 3).count() == 0


def test_interleave_budget_numbers(spark):
    runs = spark.createDataFrame([(0, "u0", 1, 0), (0, "u1", 2, 0), (0, "d0", 1, 1), (0, "u0", 2, 1), (0, "d1", 3, 1)], "query_id int, id string, rank int, run int")
    assert [r.id for r in retrieval.interleave(runs).orderBy("position").collect()] == ["u0", "d0", "u1", "d1"]
    rows = spark.createDataFrame([(0, 1, 40000), (0, 2, 10), (1, 1, 10), (1, 2, 29990), (1, 3, 1), (1, 4, 0)], "query_id int, position int, size int")
    kept = {(r.query_id, r.position) for r in retrieval.within_budget(rows, F.col("size")).collect()}
    assert kept == {(0, 1), (1, 1), (1, 2)}
    urls = spark.createDataFrame([(0, 1, "x"), (0, 2, "y"), (0, 3, "x")], "query_id int, position int, cite_url string")
    assert [r.number for r in retrieval.citation_numbers(urls).orderBy("position").collect()] == [1, 2, 1]
    assert [r.position for r in retrieval.first_by(urls, "cite_url").orderBy("position").collect()] == [1, 2]


def columns(spark, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))


def test_follow_ups(spark):
    df = columns(spark, text="what about Laravel?", previous="How do I deploy Django with MySQL?")
    got = df.select(answers.contextual_query(F.col("text"), F.col("previous"))).first()[0]
    assert got == "How do I deploy Laravel with MySQL?\nFollow-up: what about Laravel?"
    plain = columns(spark, text="How do disks work?", previous="x").select(answers.contextual_query(F.col("text"), F.col("previous"), F.array(F.lit("django")))).first()[0]
    assert plain == "How do disks work?\ndjango"
    assert not columns(spark, t="and " + "x" * 200).select(answers.is_follow_up(F.col("t"))).first()[0]


def test_plans(spark):
    plan = lambda q: columns(spark, q=q).select(answers.planned_queries(F.col("q"))).first()[0]
    assert plan("plain") == ["plain"]
    assert plan("files disappear") == ["files disappear", "ephemeral filesystem user uploads create disk and disk mount path"]
    assert plan("worker timeout on upload limit")[0].startswith("Django WORKER TIMEOUT") and len(plan("worker timeout on upload limit")) == 3
    assert len(plan("next cache survive")) == 1
    assert "دیسک" in plan("فایل پاک می شود")[1]


def test_surface_rules(spark):
    keep = lambda q, p: columns(spark, q=q, p=p).select(answers.keep_for_question(F.col("q"), F.col("p"))).first()[0]
    assert keep("deploy django", "paas/django/x") and not keep("deploy django", "paas/laravel/x") and not keep("deploy django", "iaas/ubuntu")
    assert keep("deploy django with postgres", "dbaas/postgres") and not keep("deploy django", "dbaas/postgres")
    assert not keep("disks", "ai/x") and keep("chatbot help", "ai/x") and keep("disks", "object-storage/x")
    assert not keep("category of goods", "x/y") or keep("category of goods", "x/y")  # "go" inside a word names nothing
    assert keep("goods", "paas/laravel/x")


def test_citation_gate(spark):
    text = "intro without source\n# Title [[S1]]\nUse it [[S1]].\nSee https://x.y [[S1]]\n```\ncode password=abc\n```\nBad [[S9]]\nDefect [[S2]]\nBoth [[S1]] [[S3]]\n"
    lines = spark.createDataFrame([("a", text), ("b", "nothing cited")], "answer_id string, text string")
    sources = spark.createDataFrame([("a", "S1", 1, "u1", False), ("a", "S2", 2, "u2", True), ("a", "S3", 1, "u1", False)], "answer_id string, source_id string, number int, cite_url string, defective boolean")
    got = [r.line for r in answers.citation_gate(lines, sources).orderBy("n").collect()]
    assert got == ["# Title", "Use it [1](u1).", "```", "code password=<REDACTED_CREDENTIAL>", "```", "Both [1](u1) [1](u1)", ""]


def test_sources_and_chips(spark):
    rows = spark.createDataFrame([(0, 1, "p/a", ["H", "I"], "see https://a.b"), (0, 2, "p/b", ["J"], "x")], "query_id int, position int, path string, heading_path array<string>, text string")
    bound = answers.bound_sources(rows, ["p/b"])
    assert [(r.source_id, r.defective) for r in bound.orderBy("position").collect()] == [("S1", False), ("S2", True)]
    assert answers.prompt_blocks(bound).first().context == "[S1] H > I\nsee <REDACTED_LINK>\n\n[S2] J\nx"
    chips = spark.createDataFrame([(0, i, v) for i, v in enumerate(["a", "A", *"bcdefghij"])], "conv_id int, ord int, value string")
    assert answers.merged_chips(chips).count() == 8
    turns = spark.createDataFrame([(0, i, "user", "x" * 2000) for i in range(9)], "conv_id int, turn int, role string, text string")
    kept = answers.recent_history(turns).collect()
    assert sorted(r.turn for r in kept) == [3, 4, 5, 6, 7, 8] and all(len(r.text) == 1500 for r in kept)


def test_upsert_and_embedding(spark):
    old = spark.createDataFrame([("a", "t", ["h"], [1.0]), ("b", "t", ["h"], [2.0]), ("c", "t", ["h"], [3.0])], "id string, text string, heading_path array<string>, embedding array<float>")
    new = spark.createDataFrame([("a", "t", ["h"]), ("b", "changed", ["h"]), ("d", "t", ["h"])], "id string, text string, heading_path array<string>")
    merged = {r.id: r for r in corpus_store.upsert(old, new).collect()}
    assert merged["a"].embedding == [1.0] and merged["b"].embedding is None and merged["c"].embedding == [3.0] and merged["d"].embedding is None
    calls = corpus_store.hash_embedder(8)
    done = corpus_store.embed_missing(corpus_store.upsert(old, new), calls, 8)
    assert done.filter("embedding IS NULL").count() == 0
    again = corpus_store.embed_missing(done, lambda texts: 1 / 0, 8)  # nothing is left to embed
    assert again.count() == 4
    with pytest.raises(Exception, match="wrong number or size"):
        corpus_store.embed(old, calls, 9).collect()


def test_embedder_gives_unit_vectors_where_words_cancel():
    texts = ["src12\nAvec.", "", " \n", "two words", *(f"w{i} w{j}" for i in range(20) for j in range(20))]
    made = corpus_store.hash_embedder(16)(texts)
    assert [sum(x * x for x in v) for v in made] == pytest.approx([1.0] * len(texts))
    assert made == corpus_store.hash_embedder(16)(texts)
    assert corpus_store.hash_embedder(4)([]) == []


def test_dense_search_takes_any_number_of_queries(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 64)
    monkeypatch.setattr(retrieval, "CANDIDATE_BLOCK", 8)
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(30, 4)), rng.normal(size=(10_050, 4))
    chunks = spark.createDataFrame([(f"c{i:02d}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.dense_search(chunks, asked, 2).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(1 - unit(q) @ unit(x).T, axis=1)[:, :2]
    assert got == {(i, r + 1): f"c{best[i, r]:02d}" for i in range(len(q)) for r in range(2)}


def test_citation_numbers_rank_urls_not_rows(spark):
    rows = spark.createDataFrame([("q", i, u) for i, u in enumerate(["b", None, "a", "b", None, "c", "a"])] + [(None, 3, "z")], "query_id string, position int, cite_url string")
    numbered = retrieval.citation_numbers(rows)
    got = {(r.query_id, r.position): r.number for r in numbered.collect()}
    assert got == {("q", 0): 1, ("q", 1): 2, ("q", 2): 3, ("q", 3): 1, ("q", 4): 2, ("q", 5): 4, ("q", 6): 3, (None, 3): 1}
    assert "Aggregate" in numbered._jdf.queryExecution().optimizedPlan().toString()  # before any window


def test_embedding_goes_on_after_a_kill(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i}", ["h"], f"text {i}", None) for i in range(90)] + [("own", ["h"], "x", [9.0, 9.0])], "id string, heading_path array<string>, text string, embedding array<float>")
    root, log = str(tmp_path / "vectors"), str(tmp_path / "asked")
    (tmp_path / "asked").mkdir()

    def asking(fail):
        def embedder(texts):
            import os
            import uuid

            asked = sum(open(os.path.join(log, f)).read().count("\n") for f in os.listdir(log))
            if fail and asked >= 40:
                raise RuntimeError("killed")
            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write("".join(t.replace("\n", " ") + "\n" for t in texts))
            return [[1.0, float(len(t))] for t in texts]

        return embedder

    with pytest.raises(Exception, match="killed"):
        corpus_store.embed_in_batches(rows.coalesce(1), root, asking(True), 2, batch_rows=20)
    saved = {r.id for r in corpus_store.committed_vectors(spark, root, rows).collect()}
    assert 0 < len(saved) < 90
    before = set((tmp_path / "asked").iterdir())
    corpus_store.embed_in_batches(rows.coalesce(1), root, asking(False), 2, batch_rows=20)
    again = {line.removeprefix("h text ").strip() for p in set((tmp_path / "asked").iterdir()) - before for line in p.read_text().splitlines()}
    assert not {f"c{n}" for n in again} & saved
    found = {r.id: r.embedding for r in corpus_store.with_vectors(rows, root).collect()}
    assert len(found) == 91 and found["own"] == [9.0, 9.0] and all(v is not None for v in found.values())
    assert corpus_store.embed_in_batches(rows, root, asking(True), 2) == 0


def test_equal_vectors_leave_a_block_once_each(spark):
    chunks = spark.createDataFrame([(f"c{i:05d}", [1.0, 2.0]) for i in range(3000)] + [("n", [1.0, None]), ("o", [float("nan"), 1.0])], "id string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(q, [2.0, 4.0 + q]) for q in range(5)], "query_id int, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.id) for r in retrieval.dense_search(chunks, asked, 4).collect())
    assert got == [(q, k + 1, f"c{k:05d}") for q in range(5) for k in range(4)]


def test_text_of_message_parts(spark):
    part = lambda kind, text: {"type": kind, "text": text}
    rows = [(1, 0, "user", [part("text", "old")]), (1, 2, "user", [part("text", " how "), part("image", "x"), part("text", None), part("text", "now\n")]), (1, 3, "assistant", [part("text", "so")]), (2, 0, "system", [part("text", "s")]), (3, 0, "user", [])]
    messages = spark.createDataFrame(rows, "conv_id int, turn int, role string, parts array<struct<type:string,text:string>>")
    assert {r.conv_id: r.text for r in answers.latest_user_text(messages).collect()} == {1: "how now", 2: "", 3: ""}


def test_lexical_search_gives_out_few_rows_and_all_ranks(spark, monkeypatch):
    """Questions that share a word with all chunks: what reaches the ranking stays near limit times questions, whatever the chunks."""
    import random
    from collections import Counter

    from quernlake.operators import term_blocks

    for name, value in (("BLOCK_DOCS", 50), ("LONG_DOCS", 8), ("FIRST_BLOCKS", 4), ("PACK", 7)):
        monkeypatch.setattr(term_blocks, name, value)
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["the-word", "all", "w1", "w2", "w3", "max_size"], [1, 9, 5, 2, 1, 1], k=rng.randint(1, 3 + i % 90))) for i in range(1500)]
    rows = [(i // 2 if i < 40 else i, t) for i, t in enumerate(texts)] + [(5000, None), (5001, "")]  # some ids stand twice
    chunks = spark.createDataFrame(rows, "id long, text string").repartition(3)
    asked = [(q, rng.choice(["all w1", "all max_size w3", "w2 word max_size", "size absent"])) for q in range(60)] + [(60, "all"), (60, "w1"), (61, "")]
    questions = spark.createDataFrame(asked, "query_id int, query string")
    lexemes = lambda text: [w for w in text.lower().replace("-", " ").replace("_", " ").split()]
    terms: dict = {}
    for q, text in asked:
        terms.setdefault(q, set()).update(tuple(lexemes(w)) for w in text.split())
    want = []
    for q, own in terms.items():
        found: Counter = Counter()
        for i, text in rows:
            words = lexemes(text or "")
            found[i] += sum(tuple(words[at : at + len(t)]) == t for t in own for at in range(len(words)))
        best = sorted(((-n, i) for i, n in found.items() if n))[:5]
        want += [(q, r, i, round(-n * 0.1, 6)) for r, (n, i) in enumerate(best, 1)]
    got = [(r.query_id, r["rank"], r.id, round(r.score, 6)) for r in retrieval.lexical_search(chunks, questions, 5).collect()]
    assert sorted(got) == sorted(want)
    left = term_blocks.ranked_covers(chunks, retrieval.query_terms(questions).select("query_id", "term").distinct(), 5, retrieval.lexemes, "id", "text").count()
    assert left < 60 * 5 * 12  # of some 60,000 pairs that share a word


def test_dense_search_gives_out_its_best_of_a_lane_alone(spark, monkeypatch):
    import numpy as np

    for name, value in (("QUERY_BLOCK", 8), ("CANDIDATE_BLOCK", 20), ("LANES", 2)):
        monkeypatch.setattr(retrieval, name, value)
    seen, plain = [], retrieval.ranked
    monkeypatch.setattr(retrieval, "ranked", lambda rows, *a: seen.append(rows) or plain(rows, *a))
    x = np.random.default_rng(7).normal(size=(1500, 6))
    x[700:720] = x[3]  # ties, across blocks
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "query_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.id) for r in retrieval.dense_search(chunks, asked, 5).filter("query_id <> 3").collect())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [(q, r, int(i)) for q in range(60) if q != 3 for r, i in enumerate(np.lexsort((np.arange(1500), np.round(1 - unit @ unit[q], 12)))[:5], 1)]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    near = lambda q, i: round(float(1 - unit[i] @ unit[q]), 9)
    assert [near(q, i) for q, _, i in got] == [near(q, i) for q, _, i in want]
    assert seen[0].count() <= 60 * 5 * 2 + 60 * 40  # ties alone go beyond
    assert seen[0].filter("query_id > 3 AND (id < 700 OR id >= 720)").count() <= 56 * 5 * 2


def test_a_task_of_lexical_search_holds_a_bounded_share_of_questions_and_blocks(spark, monkeypatch):
    """However many questions there are, a task gets packs up to TURN_BYTES, and the blocks of one part."""
    import random
    from collections import Counter

    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    from quernlake.operators import term_blocks

    for name, value in (("BLOCK_DOCS", 20), ("LONG_DOCS", 20), ("FIRST_BLOCKS", 2), ("PACK", 100), ("TURN_BYTES", 20_000), ("PART_BLOCKS", 4), ("GROWTH", 3), ("PENDING", 50)):
        monkeypatch.setattr(term_blocks, name, value, raising=False)
    apply, met = PandasCogroupedOps.applyInArrow, spark.sparkContext.accumulator(0)

    def checked(self, f, schema):
        def run(there, here):
            assert there.num_rows <= 20 and here.nbytes <= 80_000, (there.num_rows, here.nbytes)
            met.add(1)
            return f(there, here)

        return apply(self, run, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", checked)
    rng = random.Random(3)
    texts = [rng.choices([f"w{i}" for i in range(40)], k=rng.randint(1, 60)) for _ in range(700)]
    asked = [(q, rng.sample([f"w{i}" for i in range(40)], 3)) for q in range(3000)]
    chunks = spark.createDataFrame([(f"c{i:03d}", " ".join(t)) for i, t in enumerate(texts)], "id string, text string").repartition(2)
    questions = spark.createDataFrame([(q, " ".join(t)) for q, t in asked], "query_id int, query string")
    got: dict = {}
    for r in retrieval.lexical_search(chunks, questions, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.score * 10)))
    counts = [Counter(t) for t in texts]
    for q, terms in asked:
        best = sorted((-sum(c[t] for t in terms), f"c{i:03d}") for i, c in enumerate(counts))[:3]
        assert sorted(got[q]) == [(k, i, -n) for k, (n, i) in enumerate(best, 1)]
    assert met.value > 20


def test_a_task_of_dense_search_holds_a_bounded_share_of_queries_and_candidates(spark, monkeypatch):
    import numpy as np
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    for name, value in (("QUERY_BLOCK", 16), ("CANDIDATE_BLOCK", 32), ("LANES", 1), ("GROUP_BYTES", 2000), ("LANE_BYTES", 8000)):
        monkeypatch.setattr(retrieval, name, value, raising=False)
    apply = PandasCogroupedOps.applyInArrow

    def checked(self, f, schema):
        def run(here, there):
            assert here.nbytes <= 12_000 and there.nbytes <= 32_000, (here.nbytes, there.nbytes)
            return f(here, there)

        return apply(self, run, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", checked)
    x = np.random.default_rng(2).normal(size=(2000, 8)).astype("f4")
    x[900:960] = x[5]  # ties, across blocks and lanes
    chunks = spark.createDataFrame([(f"c{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(150)] + [(0, x[1].tolist())], "query_id long, embedding array<double>")
    found: dict = {}
    for r in retrieval.dense_search(chunks, asked, 4).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.id))
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    far = np.round(1 - unit @ unit[:150].T, 12)
    far[:, 0] = np.minimum(far[:, 0], far[:, 1])  # two variants of one query
    for q in (*range(5), *range(6, 150)):
        assert [i for _, i in sorted(found[q])][q < 1 and 2 or 0 :] == [f"c{i:04d}" for i in np.lexsort((np.arange(2000), far[:, q]))[:4]][q < 1 and 2 or 0 :]
    assert len(found[5]) == 4 and {i for _, i in found[5]} <= {"c0005", *(f"c{i:04d}" for i in range(900, 960))}

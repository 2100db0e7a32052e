import pytest
from pyspark.sql import functions as F

from quernlake.operators import answering, answers, corpus_store, recordings, retrieval
from quernlake.plans.scope import Range, Scope, ScopeError, scope_metadata

DIM = 64
PAGES = [
    ("paas/django/deploy#a:0", "paas/django/deploy", "https://d.example/1#a", ["Django", "Deploy"], "Deploy a django app with gunicorn"),
    ("paas/django/deploy#a:1", "paas/django/deploy", "https://d.example/1#a", ["Django", "Deploy"], "More about a django deploy"),
    ("paas/laravel/deploy#page:0", "paas/laravel/deploy", "https://d.example/2", ["Laravel"], "Deploy a laravel app"),
    ("iaas/vps#page:0", "iaas/vps", "https://d.example/3", [], "A vps can deploy an app, too; see https://other.example/x and password=hunter22"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = spark.createDataFrame(PAGES, "id string, path string, cite_url string, heading_path array<string>, text string").withColumn("text_norm", F.lower("text"))
    vectors = corpus_store.embed(rows.select("id", "text_norm"), corpus_store.hash_embedder(DIM), DIM, "id", "text_norm")
    return rows.join(vectors, "id").cache()


def test_retrieve_composes_both_legs(spark, chunks):
    asked = spark.createDataFrame([(1, "django gunicorn"), (2, "  "), (3, "laravel")], "query_id int, query string")
    got = answering.retrieve(chunks, asked, corpus_store.hash_embedder(DIM), DIM, 3)
    rows = {(r.query_id, r["rank"]): r for r in got.collect()}
    assert rows[1, 1].id == "paas/django/deploy#a:0" and rows[3, 1].id == "paas/laravel/deploy#page:0"
    assert not [k for k in rows if k[0] == 2] and max(k[1] for k in rows) <= 3
    assert rows[1, 1].score == pytest.approx(0.7 / 61 + 0.3 / 61)


def test_retrieve_for_answer_filters_by_the_question(spark, chunks):
    asked = spark.createDataFrame([(1, "how to deploy a django app"), (2, "django WORKER TIMEOUT with gunicorn")], "query_id int, query string")
    got = answering.retrieve_for_answer(chunks, asked, corpus_store.hash_embedder(DIM), DIM, 5)
    by = {}
    for r in got.orderBy("position").collect():
        by.setdefault(r.query_id, []).append(r)
    assert {r.path for r in by[1]} == {"paas/django/deploy"}  # no other platform, no server
    assert [r.position for r in by[1]] == [1, 2]
    assert {r.run for r in answering.planned(asked).filter("query_id = 2").collect()} == {0, 1}


def test_answer_context(spark, chunks):
    turns = spark.createDataFrame(
        [(7, 1, "user", "How do I deploy Django?"), (7, 2, "assistant", "Like this. secret: abcdef12345 " + "x" * 2000), (7, 3, "user", "what about Laravel?"), (8, 1, "system", "s"), (8, 2, "user", "deploy django")],
        "conv_id int, turn int, role string, text string",
    )
    chips = spark.createDataFrame([(8, 1, "platform", "Django"), (8, 2, "platform", "django"), (8, 3, "plan", "small")], "conv_id int, ord int, kind string, value string")
    defects = spark.createDataFrame([("paas/django/deploy", "fa", "this page is wrong")], "path string, fa string, en string")
    got = answering.answer_context(chunks, turns, corpus_store.hash_embedder(DIM), DIM, chips, defects)
    questions = {r.query_id: r for r in got.questions.collect()}
    assert questions[7].retrieval_query == "How do I deploy Laravel?\nFollow-up: what about Laravel?"
    assert questions[8].retrieval_query == "deploy django\nDjango small"
    parts = {(r.query_id, r.title) for r in got.parts.collect()}
    assert parts == {(7, "Laravel"), (8, "⚠ Deploy")}
    assert [(r.query_id, r.notice) for r in got.notices.collect()] == [(8, "this page is wrong")]
    messages = {r.query_id: r.messages for r in got.messages.collect()}
    assert [m.role for m in messages[7]] == ["user", "assistant", "user"]
    assert "abcdef12345" not in messages[7][1].content and len(messages[7][1].content) == answers.TURN_CHARACTERS
    last = messages[8][-1].content
    assert len(messages[8]) == 1 and "- platform: Django\n- plan: small\n\n" in last
    assert last.startswith("REQUIRED ANSWER LANGUAGE: English.") and '<SOURCE id="S1" path="paas/django/deploy" defective="true">\nHEADING: Django > Deploy\n' in last
    assert got.sources.filter("query_id = 8").select("number").distinct().count() == 1


def test_gate_tells_why_nothing_is_shown(spark):
    texts = spark.createDataFrame([(1, "Yes [[S1]]"), (2, " [[NO_GROUNDING]] "), (3, "No source"), (4, "Yes [[S1]]\n[[NO_GROUNDING]]")], "answer_id int, text string")
    sources = spark.createDataFrame([(i, "S1", 1, "https://d.example/1", False) for i in range(1, 5)], "answer_id int, source_id string, number int, cite_url string, defective boolean")
    assert {r.answer_id: r.outcome for r in answers.gate_outcomes(texts, sources).collect()} == {1: "shown", 2: "no_grounding", 3: "no_citation", 4: "no_grounding"}
    assert {r.answer_id for r in answers.citation_gate(texts, sources).collect()} == {1}


def test_reasoning_fragments(spark):
    long = "word " * 100
    rows = spark.createDataFrame([(1, "one https://x.example/y\ntwo"), (2, long), (3, None), (4, "z" * 400)], "k int, t string")
    got = {r.k: r.f for r in rows.select("k", answering.reasoning_fragments(F.col("t")).alias("f")).collect()}
    assert got[1] == ["one <REDACTED_LINK>\n", "two"] and got[3] == []
    assert "".join(got[2]) == long and all(len(f) <= answering.FRAGMENT for f in got[2]) and len(got[2][0]) == 190
    assert [len(f) for f in got[4]] == [193, 207]


def test_references_take_the_section_and_paragraph_before(spark):
    page = """<Layout><p>Read <b>this</b> first</p>
{/* <Section id="gone" title="x"><Asciinema id="hidden" /> */}
<Asciinema id="zero" />
<Section id="one" title="One"><p>Make it with {`db create`} and {props.x} &amp; wait</p><Asciinema id="first" /></Section>
<Section id='two' title='Two'>text<Asciinema id='second'/></Section>"""
    rows = recordings.references(spark.createDataFrame([("p", page), ("q", 'Only text <Asciinema id="alone" />')], "path string, text string"))
    got = [(r.path, r.cast_id, r.context, r.anchor_scope) for r in rows.orderBy("path", "ord").collect()]
    assert got == [
        ("p", "zero", "Read this first", None), ("p", "first", "Make it with db create and & wait", "one"), ("p", "second", "Make it with db create and & wait", "two"), ("q", "alone", "Only text", None),
    ]


def best(texts, context, commands):
    """The place of the best section, counted word by word."""
    def score(text):
        n = 200 if context and context in text else 0
        n += sum(w in text for w in {w for w in context.split() if len(w) > 2})
        for c in commands:
            words = c.split()
            n += 300 if c in text else 120 if " ".join(words[:2]) in text else 30 if words[0] in text else 0
        return n
    scores = [score(t) for t in texts]
    return scores.index(max(scores))


def test_attach_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    words = "db create list plan small public network app deploy logs".split()
    sections, found, commands, want = [], [], [], {}
    for page in range(40):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 12))) for _ in range(rng.randrange(1, 5))]
        anchors = [rng.choice(["a", "b", None]) for _ in texts]
        sections += [(f"p{page}", n, ["h"], anchors[n], t) for n, t in enumerate(texts)]
        scope = rng.choice(["a", "b", "c", None])
        context = " ".join(rng.choice(words) for _ in range(3))
        told = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 3))]
        found.append((f"p{page}", 5, f"c{page}", context, scope))
        commands += [(f"c{page}", k, c) for k, c in enumerate(told)]
        chosen = [n for n in range(len(texts)) if anchors[n] == scope] or list(range(len(texts)))
        want[f"p{page}"] = (chosen[best([f"h {texts[n]}" for n in chosen], context, told)], told)
    made = recordings.attach(
        spark.createDataFrame(sections, "path string, section int, heading_path array<string>, anchor string, body string"),
        spark.createDataFrame(found, "path string, ord int, cast_id string, context string, anchor_scope string"), spark.createDataFrame(commands, "cast_id string, ord int, command string"),
    )
    got = {}
    for r in made.orderBy("path", "ord").collect():
        got.setdefault(r.path, (r.section, []))[1].append(r.text)
    assert got == want
    with pytest.raises(Exception, match="no recording zz"):
        recordings.attach(
            spark.createDataFrame(sections, "path string, section int, heading_path array<string>, anchor string, body string"),
            spark.createDataFrame([("p0", 1, "zz", "", None)], "path string, ord int, cast_id string, context string, anchor_scope string"), spark.createDataFrame(commands, "cast_id string, ord int, command string"),
        ).collect()


def test_scope_by_key_and_metadata(spark, small):
    from datetime import datetime

    from quernlake.sources import testdata

    merchants = spark.createDataFrame([(0, "zero")], "merchant_id long, merchant_key string")
    rows = testdata.sessions(spark, small)
    assert Scope.for_merchant(merchants, rows, rows, "zero").merchant_id == 0
    for key in ("none", None):
        with pytest.raises(ScopeError):
            Scope.for_merchant(merchants, rows, rows, key)
    one = scope_metadata(rows, Range(datetime(2000, 7, 1), datetime(2000, 7, 11)), terminal_key="t").first()
    assert (str(one.previous_start), str(one.end), one.interval, one.terminal_key, one.refreshed_at) == ("2000-06-21", "2000-07-11", "[start, end)", "t", None)


def test_usage_totals(spark):
    rows = spark.createDataFrame([(3, 3, 0.5, 1), (4, 5, 0.25, 2)], "prompt_tokens long, total_tokens long, latency_seconds double, request_count int")
    assert tuple(corpus_store.usage_totals(rows).first()) == (7, 8, 3, 0.75, 2)
    assert tuple(corpus_store.usage_totals(rows.limit(0)).first()) == (0, 0, 0, 0.0, 0)


def test_interleaved_counts_anew(spark):
    runs = spark.createDataFrame([(1, 0, 1, "a", "iaas/x"), (1, 0, 2, "b", "paas/django/x"), (1, 1, 1, "c", "paas/x")], "query_id int, run int, rank int, id string, path string")
    asked = spark.createDataFrame([(1, "deploy django")], "query_id int, query string")
    assert [r.id for r in answering.interleaved(runs, asked, 5).orderBy("position").collect()] == ["b", "c"]
    assert retrieval.TOP_K == 12

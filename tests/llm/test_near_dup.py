"""Operator 3 against brute force: alignments, sketches, components, and planted copies."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quernlake.llm import near_dup
from quernlake.sources.scratch import shared_folder
from rows import ODD_ROWS


def edits(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


WORDS = st.lists(st.integers(0, 4), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=5), st.sampled_from([0.2, 0.5, 1.0]))
def test_alignment_is_the_edit_distance(pairs, share):
    got = near_dup.edit_distances([(np.array(a, np.uint32), np.array(b, np.uint32)) for a, b in pairs], share)
    want = []
    for a, b in pairs:
        d = edits(a, b)
        want.append(d if d <= int(share * max(len(a), len(b)) + 1e-9) else -1)
    assert got.tolist() == want


def prose(rng: random.Random, n: int) -> list[str]:
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng: random.Random, words: list[str], share: float) -> list[str]:
    """A copy in which so many words are replaced, dropped or doubled."""
    out = []
    for w in words:
        if rng.random() >= share:
            out.append(w)
        elif (kind := rng.random()) < 0.34:
            out.append(f"n{rng.randrange(10**6)}")
        elif kind < 0.67:
            out += [w, f"i{rng.randrange(10**6)}"]
    return out


def test_planted_copies_are_found_and_others_left(spark, documents):
    rng = random.Random(5)
    rows, want, key = [], {}, 0
    for group in range(120):
        words = prose(rng, rng.choice([40, 80, 300, 1500]))
        first = key
        for copy in range(rng.choice([1, 1, 2, 4])):
            text = words if not copy else edited(rng, words, rng.choice([0.0, 0.02, 0.05]))
            rows.append((key, " ".join(text), f"s{group % 3}"))
            want[key] = first
            key += 1
    got = {r.doc_id: r.class_id for r in near_dup.classes(documents(rows)).collect()}
    assert sum(got[k] != v for k, v in want.items() if k == v) == 0  # no two groups meet
    missed = sum(got[k] != v for k, v in want.items())
    assert missed <= 0.02 * len(want)


def brute_classes(texts: list[str]) -> list[int]:
    """Class of each text by all pairs within 20 % of edits of words."""
    words = [t.split() for t in texts]
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            longest = max(len(words[i]), len(words[j]))
            if texts[i] == texts[j] or (longest and edits(words[i], words[j]) <= 0.2 * longest):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_classes_equal_brute_force(documents):
    rng = random.Random(11)
    texts = []
    for _ in range(25):
        words = prose(rng, rng.choice([30, 60]))
        texts += [" ".join(edited(rng, words, 0.03 * k)) for k in range(rng.choice([1, 2, 3]))]
    want = brute_classes(texts)
    got = {r.doc_id: r for r in near_dup.classes(documents([(i, t, "a") for i, t in enumerate(texts)])).collect()}
    differ = [i for i in range(len(texts)) if got[i].class_id != want[i]]
    assert len(differ) <= 1  # sketches may miss one
    assert sum(r.keep for r in got.values()) == len({r.class_id for r in got.values()})


def test_large_group_of_copies(documents):
    rng = random.Random(2)
    words = prose(rng, 60)
    rows = [(i, " ".join(words), "a") for i in range(300)] + [(1000 + i, " ".join(edited(rng, words, 0.02)), "a") for i in range(300)] + [(5000 + i, " ".join(prose(rng, 60)), "b") for i in range(50)]
    got = near_dup.classes(documents(rows)).collect()
    assert sum(r.class_size for r in got if r.keep) == len(rows)
    assert sum(r.keep for r in got) <= 53
    kept = near_dup.deduplicate(documents(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.count() == sum(r.keep for r in got)


def test_chain_is_one_component(spark):
    chars = [f"n{i:03d}".encode() for i in range(40)]
    edges = spark.createDataFrame(list(zip(chars, chars[1:], strict=False)) + [(b"x", b"y"), (b"y", b"z"), (b"q", b"q")], "a binary, b binary")
    roots = {bytes(r.node): bytes(r.root) for r in near_dup.components(edges).collect()}
    assert all(roots[c] == chars[0] for c in chars[1:])
    assert roots[b"y"] == b"x" and roots[b"z"] == b"x" and b"q" not in roots


def test_odd_rows(odd):
    got = near_dup.classes(odd).collect()
    assert len(got) == len(ODD_ROWS)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add((r.class_id, r.class_size))
    assert (1, 3) in of[1] and (1, 3) in of[2]  # null and empty texts, with the null id
    assert (6, 3) in of[6] and (6, 3) in of[7]
    assert near_dup.classes(odd.limit(0)).collect() == []
    assert near_dup.deduplicate(odd.limit(0)).collect() == []
    kept = near_dup.deduplicate(odd).collect()
    assert sorted((r.doc_id for r in kept if r.doc_id in (1, 2, 6, 7))) == [1, 6, 6]


def test_sketch_sees_order():
    a = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    same, order = near_dup.sketches(np.r_[a, a], np.array([199, 199])), near_dup.sketches(np.r_[a, a[100:], a[:100]], np.array([199, 199]))
    assert (same[0] == same[1]).all()
    assert 0 < (order[0] == order[1]).mean() < 0.9


def replaced(rng: random.Random, words: list[str], places: list[int]) -> list[str]:
    out = list(words)
    for at in places:
        out[at] = f"n{rng.randrange(10**9)}"
    return out


def test_hub_whose_copies_are_not_links(documents, monkeypatch):
    """Copies of one text that only that text links, all in one sketch value whose smallest text is any of them."""
    rng = random.Random(9)
    base = prose(rng, 150)
    texts = [base] + [replaced(rng, base, list(range(k * 24, k * 24 + 24))) for k in range(3)] + [prose(rng, 150) for _ in range(20)]
    rows = [(i, " ".join(t), "a") for i, t in enumerate(texts)]
    want = brute_classes([r[1] for r in rows])
    assert sorted(set(want)) == [0, *range(4, 24)]
    assert min(range(24), key=lambda i: hashlib.sha256(rows[i][1].encode()).digest()) != 0
    made = near_dup._sketched
    monkeypatch.setattr(near_dup, "_sketched", lambda frame: _one_value(made, frame))
    assert {r.doc_id: r.class_id for r in near_dup.classes(documents(rows)).collect()} == dict(enumerate(want))


def _one_value(made, frame):
    from pyspark.sql import functions as F

    return made(frame).withColumn("keys", F.array(F.lit(7).cast("long")))


def test_bags_bound_edits():
    rng = random.Random(3)
    for _ in range(50):
        a = [rng.randrange(1000) for _ in range(rng.randrange(1, 60))]
        b = [w for w in a if rng.random() > 0.1] or a
        x, y = ([{"n": len(w), "root": r, "bag": near_dup.bag_of(np.array(w, np.uint32))}] for w, r in ((a, b"x"), (b, b"y")))
        if edits(a, b) <= 0.2 * max(len(a), len(b)):
            assert near_dup.near_bags(x, y, False) == [(0, 0)]


def test_bags_count_repeats():
    """Two texts that share a line said a hundred times, and differ in a quarter of their words, are ruled out."""
    line, rng = [1, 2, 3], random.Random(6)
    a, b = (line * 100 + [rng.randrange(10, 10**6) for _ in range(110)] for _ in range(2))
    x, y = ([{"n": len(w), "root": r, "bag": near_dup.bag_of(np.array(w, np.uint32))}] for w, r in ((a, b"x"), (b, b"y")))
    assert edits(a, b) > 0.2 * len(a) and near_dup.near_bags(x, y, False) == []
    c = line * 100 + a[300:390] + line * 6  # the same length, fewer words changed
    z = [{"n": len(c), "root": b"z", "bag": near_dup.bag_of(np.array(c, np.uint32))}]
    assert edits(a, c) <= 0.2 * len(a) and near_dup.near_bags(x, z, False) == [(0, 0)]
    d = [1, 2, 3] * 140  # repeats of one line against fewer of them
    w = [{"n": len(d), "root": b"w", "bag": near_dup.bag_of(np.array(d, np.uint32))}]
    assert near_dup.near_bags(z, w, False) == ([(0, 0)] if edits(c, d) <= 0.2 * len(d) else [])


def test_members_of_several_values_meet_all(spark):
    """Members share one, two or no values: each pair that shares any and may be a link comes out."""
    rng = random.Random(8)
    base, values = prose(rng, 60), [[7, 8], [8, 9], [7, 9], [10], [10, 7, 8, 9]]
    rows = [(hashlib.sha256(str(i).encode()).digest()[: near_dup.TID], values[i % 5], np.array([hash(w) & 0xFFFF for w in replaced(rng, base, rng.sample(range(60), 5))], np.uint32)) for i in range(40)]
    members = spark.createDataFrame([(k, t, t, 400) for t, of, _ in rows for k in of], "key long, tid binary, root binary, size long")
    bags = spark.createDataFrame([(t, len(w), near_dup.bag_of(w)) for t, _, w in rows], "tid binary, n long, bag binary")
    blocks = [{"tid": t, "root": t, "n": len(w), "bag": near_dup.bag_of(w)} for t, _, w in rows]
    may = near_dup.near_bags(blocks, blocks, True)
    want = {(max(rows[i][0], rows[j][0]), min(rows[i][0], rows[j][0])) for i, j in may if set(rows[i][1]) & set(rows[j][1])}
    got = [(bytes(r.a), bytes(r.b)) for r in near_dup._met_blocks(members, bags, True).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def met(rng: random.Random, n: int, changed: int, pairs: int = 300) -> float:
    """Share of pairs with a common key; one text has so many of the other's n words replaced."""
    texts = []
    for _ in range(pairs):
        words = prose(rng, n)
        texts += [" ".join(words), " ".join(replaced(rng, words, rng.sample(range(n), changed)))]
    hashes, counts = near_dup.word_hashes(texts)
    keys = near_dup.sketches(hashes, counts)
    found = (keys[0::2] == keys[1::2]).any(axis=1)
    for own, values in near_dup.short_keys(hashes, counts):
        of = dict(zip(own.tolist(), map(set, values.tolist()), strict=True))
        for i in of:
            if i % 2 == 0 and i + 1 in of and of[i] & of[i + 1]:
                found[i // 2] = True
    return float(found.mean())


def test_recall_by_edit_share_and_length():
    rng = random.Random(4)
    for n in range(5, near_dup.SHORT + 1):
        assert met(rng, n, n // 5, 100) == 1.0  # exact
    for n, changed in ((26, 5), (30, 6), (40, 8), (80, 16), (200, 20), (200, 30), (200, 36), (200, 40), (1000, 200)):
        assert met(rng, n, changed) >= 0.95


def test_short_texts_equal_brute_force(documents):
    rng = random.Random(12)
    texts = []
    for n in range(1, 26):
        for _ in range(3):
            words = prose(rng, n)
            at = rng.randrange(n)
            texts += [" ".join(words), " ".join(replaced(rng, words, [n // 2])), " ".join(words[:at] + words[at + 1 :]), " ".join([*words[:at], f"i{rng.randrange(10**6)}", *words[at:]])]
    got = {r.doc_id: r.class_id for r in near_dup.classes(documents([(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert got == dict(enumerate(brute_classes(texts)))


def test_copies_in_a_template_family_keep_their_links(documents):
    """Texts that share three quarters of their words are no links, but each has one copy: the copies must not be lost in the crowd."""
    rng = random.Random(21)
    template, texts = prose(rng, 80), []
    for _ in range(60):
        own = replaced(rng, template, rng.sample(range(80), 24))
        texts += [" ".join(own), " ".join(replaced(rng, own, rng.sample(range(80), 10)))]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    hashes, counts = near_dup.word_hashes(texts)
    keys = near_dup.sketches(hashes, counts)
    sharing = [i for i in range(0, len(texts), 2) if (keys[i] == keys[i + 1]).any()]
    got = {r.doc_id: r.class_id for r in near_dup.classes(documents(rows)).collect()}
    assert len(sharing) >= 55
    assert all(got[i] == got[i + 1] for i in sharing)
    assert got == dict(enumerate(brute_classes(texts))) or len(sharing) < 60


def test_large_group_grows_together_at_linear_cost(documents, monkeypatch):
    """Copies of a text that is not in the table: rounds name few pairs, never all."""
    rng = random.Random(22)
    base = prose(rng, 60)
    texts = [" ".join(replaced(rng, base, rng.sample(range(60), 5))) for _ in range(400)]
    named = []
    made = near_dup._verified

    def counted(edges, words):
        named.append(edges.count())
        return made(edges, words)

    monkeypatch.setattr(near_dup, "_verified", counted)
    got = near_dup.classes(documents([(i, t, "a") for i, t in enumerate(texts)])).collect()
    assert {r.class_id for r in got} == {0}
    assert sum(named) < 60 * len(texts)


def test_tables_go_when_done(spark, documents):
    """Only the facts, and what their classes were read from, stay in the shared folder."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    rows = [(i, " ".join(replaced(rng, base, rng.sample(range(60), i % 16))), "a") for i in range(60)]
    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    near_dup.classes(documents(rows)).collect()
    assert {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before} <= {"near-classes", "near-roots", "component-edges"}

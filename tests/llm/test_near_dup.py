import itertools
import random

import numpy as np
import pytest

from gridhead.llm import near_dup as D
from tests.llm.helpers import clashing, documents, prose


def sets(texts):
    owner, cell, _ = D.cells(texts)
    return [set(x.tolist()) for x in np.split(cell, np.searchsorted(owner, np.arange(1, len(texts))))]


def brute(texts):
    """The least position of each text's component over exact similarities."""
    s = sets([t or "" for t in texts])
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if s[i] and s[j] and len(s[i] & s[j]) >= D.SIMILARITY * len(s[i] | s[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(rng, text, k):
    words = text.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def sample():
    rng = random.Random(12)
    base = [prose(rng, 120) for _ in range(12)]
    texts = [*base, *(edited(rng, b, k) for b in base for k in (0, 1, 2, 4, 8))]
    texts += [edited(rng, base[0], rng.randrange(1, 5)) for _ in range(80)]  # many under one leader
    texts += [base[1].upper(), base[1] + "!", *(base[2].split(" ", 3)[3:]), "one two", "One, two", "one two three", "one", "", None, "...", prose(rng, 6000)]
    return texts


@pytest.mark.parametrize("few", [D.FEW, 0])
def test_classes_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(D, "FEW", few)
    monkeypatch.setattr(D, "ENTRIES", D.ENTRIES if few else 50)
    texts = sample()
    got = {r.doc_id: r.class_id for r in D.classes(clashing(documents(spark, texts))).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_sizes_far_from_the_largest_text(spark):
    """Excerpts of one text, some with a near copy: a leader is never so large that it hides the links among small texts."""
    rng = random.Random(9)
    whole = prose(rng, 900)
    words = whole.split()
    texts = [edited(rng, whole, k % 9) for k in range(60)]
    texts += [edited(rng, " ".join(words[:n]), k) for n in (300, 350, 420, 500, 560, 640, 700) for k in (0, 2, 5)]
    got = {r.doc_id: r.class_id for r in D.classes(documents(spark, texts)).collect()}
    assert got == dict(enumerate(brute(texts)))


def replaced(base, places, tag):
    words = base.split()
    for k in places:
        words[k] = f"{tag}{k}"
    return " ".join(words)


def test_links_that_a_leader_of_many_does_not_make(spark):
    """Each far text is linked to its near one only, with which it shares a fifth of its differences from the text of which both are copies."""
    base = " ".join(f"w{k}" for k in range(204))
    near = [replaced(base, [10 + 3 * i], f"x{i}y") for i in range(60)]
    far = [replaced(t, [(10 + 3 * i + 40 * j) % 200 for j in range(1, 5)], f"z{i}y") for i, t in enumerate(near)]
    got = {r.doc_id: r.class_id for r in D.classes(documents(spark, [base, *near, *far])).collect()}
    assert brute([base, *near, *far]) == [0] * 121 and {k for k, c in got.items() if c != 0} == set()


def test_shared_rare_differences_find_every_link(spark, monkeypatch):
    """Random texts around a leader, of any size and distance: no pair at the threshold is missed."""
    rng = random.Random(4)
    leader = set(range(90))
    texts = []
    for _ in range(60):
        seed = (leader - set(rng.sample(range(90), rng.randrange(16)))) | set(rng.sample(range(100, 130), rng.randrange(16)))
        for _ in range(3):
            texts.append((seed - set(rng.sample(sorted(seed), rng.randrange(7)))) | set(rng.sample(range(100, 130), rng.randrange(7))))
    def links(x, y):
        return 9 * len(x & y) >= 4 * (len(x) + len(y))

    def packed(cells):
        return bytearray(np.array(sorted(cells), np.uint64).tobytes())

    rows = [(i, -1, 0, len(t), len(leader), packed(t ^ leader), own, -1, 2 * own, len(texts)) for i, t in enumerate(texts) for own in (-1 if links(t, leader) else i,)]
    df = spark.createDataFrame(rows, "u long, v long, round int, n int, m int, apart binary, u_in long, v_in long, own long, size long")
    inside = [links(t, leader) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if links(texts[i], texts[j]) and not (inside[i] and inside[j])}
    for entries in (D.ENTRIES, 40):
        monkeypatch.setattr(D, "ENTRIES", entries)
        got = {tuple(r) for r in D._sharing(df).collect()}
        assert len(want) > 100 and want <= got and all(i < j for i, j in got)


def test_pairs_are_the_same_however_they_are_cut(monkeypatch):
    rng = np.random.default_rng(3)
    entries = np.zeros(400, D._ENTRY)
    entries["cell"], entries["node"], entries["inside"] = rng.integers(0, 12, 400), rng.integers(0, 90, 400), 0
    entries["inside"], entries["n"], entries["d"], entries["place"] = entries["node"] // 4, 100, 30, rng.integers(0, 9, 400)
    entries["own"] = np.where(entries["node"] < 45, 2 * entries["inside"], 2 * (entries["node"] % 3) + 1)
    entries["asks"], entries["asked"] = rng.random(400) < 0.3, rng.random(400) < 0.8
    want = {(min(x["node"], y["node"]), max(x["node"], y["node"])) for x, y in itertools.product(entries[entries["asks"]], entries[entries["asked"]]) if x["cell"] == y["cell"] and x["inside"] != y["inside"] and x["own"] != y["own"]}
    for at_once in (7, 1000, 10**6):
        monkeypatch.setattr(D, "PAIRS_AT_ONCE", at_once)
        assert {tuple(p) for p in D.met(entries).tolist()} == want


def around_templates(rng, templates, n, edits):
    """n copies of templates, each with edits of its own at places of its own: few or none are linked but by chance."""
    out = []
    for k in range(n):
        words = templates[k % len(templates)].split()
        for place in rng.sample(range(len(words)), edits):
            words[place] = f"own{k}x{place}"
        out.append(" ".join(words))
    return out


def templates(rng):
    """Texts of one origin: three changed in places of their own, and two that share most of their changes."""
    base = " ".join(f"w{k}" for k in range(100))
    apart = [replaced(base, range(10 * k, 10 * k + 6), f"t{k}y") for k in range(3)]
    pair = replaced(base, range(50, 58), "py")
    return [*apart, replaced(pair, range(70, 74), "qy"), replaced(pair, range(80, 84), "ry")]


def searched(spark, monkeypatch, texts):
    """The classes, and how many pairs the last search hands on."""
    counts, search = [], D._left_apart

    def spied(*args):
        pairs, links = search(*args)
        pairs = pairs.cache()
        counts.append(pairs.count())
        return pairs, links

    monkeypatch.setattr(D, "_left_apart", spied)
    got = {r.doc_id: r.class_id for r in D.classes(documents(spark, texts)).collect()}
    monkeypatch.setattr(D, "_left_apart", search)
    return got, counts[0]


def test_texts_around_several_templates_do_not_meet_each(spark, monkeypatch):
    rng = random.Random(31)
    origin = templates(rng)
    texts = around_templates(rng, origin, 400, 3) + [edited(rng, t, 1) for t in around_templates(rng, origin, 40, 2)]
    got, few = searched(spark, monkeypatch, texts)
    assert got == dict(enumerate(brute(texts)))
    _, many = searched(spark, monkeypatch, around_templates(rng, origin, 1600, 3))
    assert few < 40 * len(texts) and many / 1600 < 1.5 * few / len(texts)  # all pairs would be 3.6 times as many a text


def test_centres_of_a_group():
    rng = np.random.default_rng(8)
    own = [rng.choice(np.arange(10_000, 10**6), 20, replace=False) for _ in range(90)]
    far = D.distances([np.sort(x).astype(np.uint64) for x in own])
    assert all(far[i, j] == len(np.setxor1d(own[i], own[j])) for i, j in itertools.product(range(0, 90, 7), repeat=2))
    assert D.centres([np.sort(x) for x in own]) == ([], False)  # nothing in common: the leader is the centre
    shared = [np.sort(np.concatenate([x, np.arange(100)])) for x in own]
    at, moved = D.centres(shared)
    assert len(at) == 1 and moved
    three = [np.sort(np.concatenate([x, np.arange(100) + 200 * (k % 3)])) if k % 3 else np.sort(x) for k, x in enumerate(own)]
    at, moved = D.centres(three)
    assert {k % 3 for k in at} == {1, 2} and len(at) == 2 and not moved
    assert D.distances([np.zeros(0, np.uint64)] * 2).tolist() == [[0, 0], [0, 0]]


def test_one_of_each_class_stays(spark):
    texts = sample()
    docs = clashing(documents(spark, texts))
    kept = D.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in D.classes(docs).where("doc_id = class_id").collect())


def test_null_and_repeated_ids(spark):
    a, b = prose(random.Random(1), 60), prose(random.Random(2), 60)
    docs = documents(spark, [a, a, b, a, b], ids=[None, 4, 7, 9, 7])
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in D.classes(docs).collect()) == [(0, 0), (4, 4), (7, 7), (7, 7), (9, 4)]
    assert sorted((r.doc_id or 0, r.text) for r in D.keep_one(docs).collect()) == sorted([(0, a), (4, a), (7, min(a, b))])
    # both texts under one id are compared, and neither takes the other's place
    c, e = edited(random.Random(3), a, 1), edited(random.Random(3), b, 1)
    docs = documents(spark, [a, b, c, e], ids=[5, 5, 6, 8])
    assert {r.doc_id: r.class_id for r in D.classes(docs).collect()} == {5: 5, 6: 5, 8: 5}
    assert D.classes(docs.limit(0)).isEmpty()


def test_darts_estimate_the_weighted_similarity():
    rng = random.Random(5)
    a = prose(rng, 300)
    b = edited(rng, a, 12)
    owner, cell, _ = D.cells([a, b])
    found = D.signatures(owner, cell, 2, 2000)
    x, y = sets([a, b])
    assert (found != 0).all() and abs((found[0] == found[1]).mean() - len(x & y) / len(x | y)) < 0.05


def test_short_and_repeated_words():
    s = sets(["one two", "one two three four five", "a a a a a a a", "", "x"])
    assert [len(x) for x in s] == [1, 1, 3, 0, 1]

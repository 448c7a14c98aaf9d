import random

import numpy as np
import pytest

from gridhead.llm import decontaminate as D
from tests.llm.helpers import clashing, documents, prose


def tiling(doc, item, size):
    """Greedy string tiling by its definition."""
    marked_d, marked_i, covered = set(), set(), 0
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in marked_i and d + n not in marked_d:
                    n += 1
                if n >= size and (best is None or n > best[0]):
                    best = (n, i, d)
        if best is None:
            return covered
        n, i, d = best
        covered += n
        marked_i |= set(range(i, i + n))
        marked_d |= set(range(d, d + n))


@pytest.mark.parametrize("limit", [D.BROADCAST_WORDS, 0])
def test_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "MATCHES", 3)
    rng = random.Random(3)
    items = [prose(rng, n) for n in (40, 25, 12, 5, 4, 60)] + ["a b a b a b a b a b", None, ""]
    x = items[0].split()
    texts = [
        f"{prose(rng, 30)} {items[0]} {prose(rng, 30)}",
        " ".join(x[20:] + ["zz"] + x[:20]),  # reordered
        " ".join(x[:24]),
        " ".join(x[:23]),
        items[0].upper().replace(" ", ", "),
        items[3], items[4], "b a b a b a b", "a b " * 40,
        f"{items[1]} {items[2]} {items[1]}",
        prose(rng, 300), None, "", items[5] * 3 + prose(rng, 3000),
    ]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in D.contaminated(clashing(documents(spark, texts)), clashing(benchmark), broadcast_words=limit).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            words = [w.strip(",").lower() for w in (item or "").split()]
            cover = tiling([w.strip(",").lower() for w in (t or "").split()], words, D.MIN_MATCH) / max(1, len(words))
            if cover >= D.COVERAGE:
                want[i, j] = cover
    assert got == pytest.approx(want) and (1, 0) in got and (2, 0) in got and (3, 0) not in got


def test_tiles_against_the_definition():
    rng = random.Random(11)
    for _ in range(300):
        doc, item = ([rng.choice("abc") for _ in range(rng.randrange(2, 25))] for _ in range(2))
        found = D.tiles(*(np.array([ord(c) for c in x], np.uint64) for x in (doc, item)), 2)
        assert sum(n for *_, n in found) == tiling(doc, item, 2)
        assert all(doc[d : d + n] == item[i : i + n] for d, i, n in found)


def test_equal_hashes_of_different_words_are_no_match(monkeypatch):
    """A base of 1 makes the running hash a sum: windows with the same words in another order agree."""
    monkeypatch.setattr(D, "_BASE", 1)
    doc, item = np.array([1, 2, 3, 4, 9, 5, 6, 7], np.uint64), np.array([4, 3, 2, 1, 8, 5, 6, 7], np.uint64)
    assert D.tiles(doc, item, 2) == [(5, 5, 3)]


def test_seeds_that_many_items_and_texts_share(spark, monkeypatch):
    """A phrase in every item and document leads to no pair, and the items are found all the same."""
    monkeypatch.setattr(D, "MATCHES", 100)
    rng = random.Random(5)
    phrase = "in the middle of the night"
    items = [f"{phrase} {prose(rng, 40)}" for _ in range(60)] + [f"{prose(rng, 14)} {phrase}"] * 3
    texts = [f"{prose(rng, 20)} {phrase} " * 3 for _ in range(80)] + [f"{phrase} x {items[k]} y {phrase}" for k in (4, 60)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    words = D.item_words(benchmark)
    assert D.item_seeds(words).groupBy("seed").count().where("count > 3").isEmpty()
    for limit in (D.BROADCAST_WORDS, 0):
        got = {(r.doc_id, r.item_id) for r in D.contaminated(documents(spark, texts), benchmark, broadcast_words=limit).collect()}
        assert got == {(80, 4), (81, 60), (81, 61), (81, 62)}


def test_repeated_rows_are_judged_alone(spark):
    item = prose(random.Random(4), 30)
    benchmark = spark.createDataFrame([(1, item), (1, prose(random.Random(5), 30)), (None, item)], "item_id long, text string")
    docs = documents(spark, [item, item, item, "x"], ids=[5, 5, None, 5])
    for limit in (D.BROADCAST_WORDS, 0):
        assert sorted((r.doc_id or 0, r.item_id) for r in D.contaminated(docs, benchmark, broadcast_words=limit).collect()) == [(0, 1), (5, 1), (5, 1)]


def test_keep_clean(spark):
    item = prose(random.Random(4), 30)
    docs = clashing(documents(spark, [item, "clean text", None, item], ids=[1, 2, 3, None]))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = D.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3]
    assert D.keep_clean(docs, benchmark.limit(0)).count() == 4
    assert D.contaminated(docs.limit(0), benchmark).isEmpty()

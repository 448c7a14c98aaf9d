import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridhead.llm import suffix_dedup as S
from tests.llm.helpers import clashing, documents, prose


def brute(texts):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(d[k : k + 200] for d in data for k in range(len(d) - 199))
    out = []
    for d in data:
        under = np.zeros(len(d) + 1, int)
        for k in range(len(d) - 199):
            if count[d[k : k + 200]] > 1:
                under[k] += 1
                under[k + 200] -= 1
        gone = np.cumsum(under)[: len(d)] > 0
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def sample():
    rng = random.Random(8)
    passage, other = prose(rng, 80), prose(rng, 60)
    texts = [prose(rng, 150) for _ in range(30)]
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(100)]  # hot in a block
    texts += [f"{x}{passage[:199]}{y}" for x, y in ("ab", "cd")] + [f"{x}{passage[-200:]}{y}" for x, y in ("ab", "cd")]
    texts += [texts[3]] * 5 + [texts[4].replace("e", "é", 1), other + other, "a" * 1000, "ab" * 300, "ab" * 300, "é" * 150, "x" * 199, "x" * 199, "", None, " ", "日本" * 60 + passage]
    texts += [prose(rng, 9000)]
    return texts


@pytest.mark.parametrize("hot", [64, 3])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "BLOCK_BYTES", 20_000)
    texts = sample()
    got = {r.doc_id: tuple(r)[1:5] for r in S.removed(clashing(documents(spark, texts))).collect()}
    want = dict(enumerate(brute(texts)))
    assert {k: v for k, v in got.items() if want[k] != v} == {} and len(got) == len(want)


def test_a_line_in_thousands_of_surroundings(spark, monkeypatch):
    rng = random.Random(3)
    line = prose(rng, 90)[:190]
    ends = [(prose(rng, 25), prose(rng, 25)) for _ in range(2000)]
    texts = [f"{a} {line} {b}" for a, b in ends]
    texts += [f"{a[-90:]} {line} {b[:20]}{i}" for i, (a, b) in enumerate(ends[:40])] + texts[:3] + [f"{prose(rng, 9)} {texts[7][9:-9]}"]
    together = []
    indexed = S._indexed

    def watched(stretches, parts):
        together.append(max((r.n for r in stretches.groupBy("h").agg(F.countDistinct("f").alias("n")).collect()), default=0))
        return indexed(stretches, parts)

    monkeypatch.setattr(S, "_indexed", watched)
    got = {r.doc_id: tuple(r)[1:5] for r in S.removed(documents(spark, texts)).collect()}
    want = dict(enumerate(brute(texts)))
    assert sum(w[1] > 0 for w in want.values()) > 80
    assert {k: v for k, v in got.items() if want[k] != v} == {} and len(got) == len(want)
    assert together[0] <= 1000


def test_documents_without_repeats(spark):
    texts = sample()
    docs = clashing(documents(spark, texts))
    kept = S.without_repeats(docs)
    assert kept.columns == docs.columns and kept.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = {r.doc_id: r for r in kept.collect()}
    want = dict(enumerate(brute(texts)))
    for k, t in enumerate(texts):
        if want[k][1] == 0:
            assert rows[k].text == t
        else:
            assert len(rows[k].text.encode()) <= want[k][0] - want[k][1] and rows[k].n_chars == len(rows[k].text)


def test_null_and_repeated_ids_and_no_rows(spark):
    rng = random.Random(1)
    a, b = prose(rng, 90), prose(rng, 90)
    got = sorted((r.doc_id or -1, r.n_removed > 0) for r in S.removed(documents(spark, [a, a, b, None], ids=[None, 5, 5, 5])).collect())
    assert got == [(-1, True), (5, False), (5, False), (5, True)]
    assert S.removed(documents(spark, ["x"]).limit(0)).isEmpty()


def test_index_is_the_order_of_all_suffixes():
    rng = random.Random(2)
    for _ in range(40):
        strings = [bytes(rng.choice(b"ab\xff\0") for _ in range(rng.randrange(25))) for _ in range(rng.randrange(1, 9))]
        string, offset, prefix = S.suffix_index(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]))
        got = [(strings[i][k:], int(i)) for i, k in zip(string, offset, strict=True)]
        assert got == sorted(got) and len(set(zip(string.tolist(), offset.tolist(), strict=True))) == len(got)
        for (x, _), (y, _), p in zip(got, got[1:], prefix[1:], strict=False):
            n = next((k for k, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
            assert p == n


def test_repeated_starts_weighs_copies():
    one = bytes(range(200)) + b"tail"
    assert [len(x) for x in S.repeated_starts([one], np.array([1]))] == [0]
    assert [x.tolist() for x in S.repeated_starts([one], np.array([2]))] == [[0, 1, 2, 3, 4]]

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridhead.llm import merkle
from gridhead.llm.queries import op13_merkle_manifest
from tests.llm.helpers import SF, clashing, documents, prose


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    """The definition: all levels of a tree from its leaves to the root."""
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        out.append(nodes)
    return out


def way(levels, place):
    found = []
    for nodes in levels[:-1]:
        first = place // 3 * 3
        found.append((place - first, [n for i, n in enumerate(nodes[first : first + 3]) if first + i != place]))
        place //= 3
    return found


def by_hand(rows, tampered):
    """rows: (doc_id, source, lang, n_chars, text); what each proves, in order of leaves."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    keys = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for k in keys:
        ordered = sorted(sources[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[k] = (ordered, levels_of([leaf_of(r) for r in ordered]))
    top = levels_of([trees[k][1][-1][0] for k in keys])
    out = []
    for j, k in enumerate(keys):
        for i, r in enumerate(trees[k][0]):
            steps = way(trees[k][1], i) + way(top, j)
            value = leaf_of((*r[:4], tampered(r)))
            for at, others in steps:
                value = h(*others[:at], value, *others[at:])
            out.append((r[0], leaf_of(r), trees[k][1][-1][0], top[-1][0], tuple(o for _, others in steps for o in others), value))
    return out


def shape(rows):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple(r.proof), r.folded_root) for r in rows), key=str)


def cut(r):
    return r[4] if r[4] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else r[4].replace("\n", "")


def random_rows(n, sources, rng):
    return [(rng.choice([i, i, None]), rng.choice(sources), rng.choice(["en", None]), rng.choice([i, None]), rng.choice([None, "", "a\nb", prose(rng, 5) + "\n", "é日"])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").repartition(5)


def claim():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


@pytest.mark.parametrize(("n", "block", "n_sources"), [(1, 4, 1), (3, 4, 1), (4, 2, 3), (60, 5, 7), (200, 16, 2), (40, 3, 40)])
def test_proofs_equal_the_definition(spark, monkeypatch, n, block, n_sources):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rng = random.Random(n)
    rows = random_rows(n, [None, "", "é", "Z", *(f"s{i}" for i in range(n_sources))][: max(1, n_sources)], rng)
    rows += rows[: n // 5]
    assert shape(merkle.prove(clashing(frame(spark, rows)), claim()).collect()) == sorted(by_hand(rows, cut), key=str)


def test_trees_of_several_chunks(spark, monkeypatch):
    """Three levels of chunks, and hot rows: half of the table is one row again and again."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "CHUNK", 9)
    monkeypatch.setattr(merkle, "BLOCK", 32)
    rng = random.Random(9)
    rows = random_rows(400, ["hot"] * 9 + ["s1", "s2", None], rng) + [(5, "hot", "en", 1, "again\n")] * 300
    assert shape(merkle.prove(frame(spark, rows), claim()).collect()) == sorted(by_hand(rows, cut), key=str)


def test_query_equals_the_definition(spark):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {d: (leaf, sub, root, h(*proof), folded, folded == root) for d, leaf, sub, root, proof, folded in by_hand(rows, cut)}
    got = {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in op13_merkle_manifest(spark, SF).collect()}
    assert got == want and {v[5] for v in got.values()} == {True, False}


def test_octopus_is_least():
    """Nothing is fetched that the leaves give, and with it every path can be derived; arbitrary sets of leaves."""
    rng = random.Random(4)
    for _ in range(300):
        size = rng.randrange(1, 100)
        places = np.array(rng.sample(range(size), rng.randrange(1, size + 1)))
        known, n = {(0, int(p)) for p in places}, size
        for level, lack in merkle.missing(places, size):
            lack = {(level, int(p)) for p in lack}
            assert not lack & known
            own = {p for at, p in known if at == level}
            parents = {p // 3 for p in own}
            needed = {(level, i) for p in parents for i in range(3 * p, min(3 * p + 3, n))}
            assert needed == {(level, p) for p in own} | lack
            known |= {(level + 1, p) for p in parents}
            n = -(-n // 3)
        assert n == 1


def test_whole_blocks_fetch_only_their_edges(spark):
    """A block of consecutive leaves lacks at most two nodes on each side of a level."""
    for first, last, size in ((0, 4095, 10**6), (5000, 9095, 10**6), (999_000, 999_999, 10**6), (0, 0, 1)):
        assert all(len(lack) <= 4 for _, lack in merkle.missing(np.arange(first, last + 1), size))


def test_nothing_and_odd_texts(spark):
    assert merkle.prove(documents(spark, ["a"]).limit(0)).isEmpty()
    wrong = documents(spark, ["a", "b"]).withColumns({"text": F.expr("cast(x'61ff0a62' as string)"), "LEAF": F.lit(1), "a.b": F.lit(2)})
    rows = merkle.prove(wrong, F.replace("text", F.lit("\n"), F.lit(""))).collect()
    assert len(rows) == 2 and all(r.folded_root != r.root for r in rows)
    assert all(r.folded_root == r.root for r in merkle.prove(documents(spark, ["a", None, "x" * 500_000])).collect())

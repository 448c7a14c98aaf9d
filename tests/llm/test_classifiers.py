import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridhead.llm import langid, quality
from gridhead.llm.common import HASH_RANGE, hash_bar
from gridhead.llm.queries import QUERIES
from tests.llm.helpers import SF, clashing, documents, prose


def test_quality_of_held_out_documents(spark):
    rows = QUERIES["op8_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.8


@pytest.fixture(scope="module")
def learnable():
    rng = random.Random(4)
    texts = [prose(rng, 60) if i % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 50).split()) for i in range(300)]
    return texts, [(i, int(i % 3 > 0), 0) for i in range(250)]


def test_quality_of_odd_texts(spark, learnable):
    texts, labels = learnable
    labels = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    odd = [None, "", " \n", "!!!", texts[0], texts[0], "a" * 100_000, "word " * 30_000]
    docs = documents(spark, texts + odd)
    got = {r.doc_id: r for r in quality.score_quality(clashing(docs), labels).collect()}
    assert len(got) == len(texts) + len(odd)
    assert np.mean([got[i].predicted == int(i % 3 > 0) for i in range(250, 300)]) > 0.95
    assert len({got[300 + k].score for k in (0, 1, 2)}) == 1 and got[304].score == got[305].score == got[0].score
    kept = quality.keep_good(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {k for k, r in got.items() if r.predicted}


def test_quality_without_labels_and_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, ["a", None])
    assert [r.score for r in quality.score_quality(docs, labels).collect()] == [0.5, 0.5]
    assert quality.score_quality(docs.limit(0), labels).isEmpty()
    one_class = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0.5 < r.score < 1 for r in quality.score_quality(docs, one_class).collect())


def test_descent_separates():
    ratio, rng = np.ones(quality.DIMENSIONS), np.random.default_rng(0)
    rows = [np.unique(np.concatenate([rng.integers(10, 1000, 20), [i % 2]])) for i in range(60)]
    label = np.array([1.0 if i % 2 else -1.0 for i in range(60)])
    w = quality._descent(rows, ratio, label, np.full(60, 10.0))
    assert all(y * w[r].sum() > 0 for r, y in zip(rows, label, strict=True))


def test_language_of_held_out_documents(spark):
    rows = QUERIES["op3_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    assert np.mean([r.lang_pred == r["lang"] for r in rows if r.held_out]) >= 0.9


def test_language_of_odd_texts(spark):
    good = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    odd = [None, "", "123 !", "İİİ", "日本", good[0].text, "é" * 50_000]
    texts, langs = [r.text for r in good] + odd, [r["lang"] for r in good] + [None] * len(odd)
    got = {r.doc_id: r for r in langid.identify(clashing(documents(spark, texts, langs=langs))).collect()}
    base = len(good)
    assert [got[base + k].lang_pred for k in range(3)] == ["und"] * 3 and [got[base + k].score for k in range(3)] == [0.0] * 3
    assert all(got[base + k].lang_pred in {r["lang"] for r in good} for k in range(3, 7))
    assert got[base + 5].lang_pred == got[0].lang_pred


def test_language_without_training_rows(spark):
    docs = documents(spark, ["abc", None], langs=[None, None])
    assert [r.lang_pred for r in langid.identify(docs).collect()] == ["und", "und"]
    assert langid.identify(docs.limit(0)).isEmpty()


def test_kernel_is_the_shared_share_of_n_grams():
    a, b = "abcd", "abxd"
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    found, _ = langid.presence([a, b])
    unit = found[1:].astype(np.float32) / np.sqrt(found[1].sum())
    want = len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    assert abs(langid.kernel(found[:1], unit)[0, 0] - want) < 1e-6


def test_held_out_of_null(spark):
    assert spark.range(1).select(quality.held_out(F.lit(None).cast("long"), 5, 0)).first()[0] is False


def plain_grams(text: str) -> set[int]:
    """The hashed 1- to 3-grams of a text, one by one in plain numbers."""
    out = set()
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            code = 0
            for k, c in enumerate(text[i : i + n]):
                code = ((code + ord(c)) * 0x9E3779B1) % 2**32 if k else ord(c) * 0x9E3779B1 % 2**32
            code ^= code >> 15
            out.add((code * 0x85EBCA6B % 2**32) >> (32 - langid.BITS))
    return out


def test_language_scores_equal_a_plain_ridge_regression(spark):
    """Kernel values from sets, the regression by least squares on a stretched system, over whole small tables."""
    rng = random.Random(11)
    texts = [prose(rng, 12) if i % 2 else " ".join(rng.choice("zum der ich auf nicht wir".split()) for _ in range(12)) for i in range(80)]
    langs = ["en" if i % 2 else "de" for i in range(80)]
    got = {r.doc_id: r for r in langid.identify(documents(spark, texts, langs=langs), 10**6, 10**6).collect()}
    taught = [i for i in range(80) if not got[i].held_out]
    grams = [plain_grams(t.lower()) for t in texts]

    def alike(a, b):
        return len(a & b) / np.sqrt(len(a) * len(b))

    marks = list(map(set, {tuple(sorted(grams[i])) for i in taught}))
    k = np.array([[alike(grams[i], m) for m in marks] for i in taught])
    own = np.array([[alike(a, b) for b in marks] for a in marks])
    y = np.array([[langs[i] == c for c in ("de", "en")] for i in taught], float)
    root = np.linalg.cholesky(langid.RIDGE * len(taught) * own + 1e-8 * np.eye(len(marks))).T
    weights = np.linalg.lstsq(np.vstack([k, root]), np.vstack([y, np.zeros((len(marks), 2))]), rcond=None)[0]
    for i in range(80):
        values = np.array([alike(grams[i], m) for m in marks]) @ weights
        assert abs(got[i].score - min(1, max(0, values.max()))) < 5e-3 and got[i].lang_pred == ("de", "en")[int(values.argmax())]


def test_quality_ratios_and_scores_equal_plain_sums(spark, learnable):
    texts, labels = learnable
    docs, marks = documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, marks, 10**6)
    own = [set(quality.features([t])[1].tolist()) for t in texts]
    counts = {side: {} for side in (0, 1)}
    for i, y, _ in labels:
        for f in own[i]:
            counts[y][f] = counts[y].get(f, 0) + 1
    total = {side: sum(c.values()) + quality.DIMENSIONS for side, c in counts.items()}
    for f in set().union(*own[:40]):
        want = np.log((counts[1].get(f, 0) + 1) / total[1]) - np.log((counts[0].get(f, 0) + 1) / total[0])
        assert abs(model["ratio"][f] - want) < 1e-5
    got = {r.doc_id: r.s for r in docs.select("doc_id", quality.score_column(docs, model).alias("s")).collect()}
    for i in range(0, 300, 7):
        length = sum(float(model["ratio"][f]) ** 2 for f in own[i]) ** 0.5
        margin = sum(float(model["weight"][f]) for f in own[i]) / length
        assert abs(got[i] - 1 / (1 + np.exp(-(model["slope"] * margin + model["offset"])))) < 1e-6


def test_descent_finds_the_optimum_of_the_dual(monkeypatch):
    """Against projected gradient steps on the dense dual problem."""
    monkeypatch.setattr(quality, "EPOCHS", 3000)
    rng = np.random.default_rng(1)
    ratio = rng.standard_normal(quality.DIMENSIONS)
    rows = [np.unique(rng.integers(0, 60, 12)) for _ in range(40)]
    label = np.where(rng.random(40) < 0.5, 1.0, -1.0)
    cost = rng.uniform(0.3, 1.5, 40)
    x = np.zeros((40, 60))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
    signed = x * label[:, None]
    alpha = np.zeros(40)
    step = 1 / np.linalg.eigvalsh(signed @ signed.T).max()
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (signed @ (alpha @ signed) - 1), 0, cost)
    value = [0.5 * w @ w + cost @ np.maximum(0, 1 - signed @ w) for w in (quality._descent(rows, ratio, label, cost)[:60], alpha @ signed)]
    assert abs(value[0] - value[1]) < 2e-2 * value[1]


def test_samples_of_any_size():
    """A share of a table of a trillion rows is small but never nothing."""
    for n in (1, 7, 10**4, 10**9, 10**12, 10**15):
        for wanted in (1, 8, 32, 6_000, 20_000):
            bar = hash_bar(wanted, n)
            assert bar >= 1 and abs(bar / HASH_RANGE * n - min(wanted, n)) <= 1e-3 * wanted


def test_sample_has_every_language_and_repeated_ids_once(spark):
    rows = [(i % 5 if i < 2000 else i, f"t{i}", "en") for i in range(4000)] + [(9000 + i, "x", f"l{i % 30}") for i in range(90)] + [(9999, "only", "rare")]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    got = langid.sampled(known, counts, 64).collect()
    each = {k: sum(r["lang"] == k for r in got) for k in counts}
    assert min(each.values()) >= 1 and max(each.values()) <= 2 and len(got) <= 64
    everything = langid.sampled(known, counts, 10**6).where("lang = 'en'").collect()
    assert len(everything) == 2005 and {"t0", "t1", "t1002"} <= {r.text for r in everything}
    assert set(each) == set(counts)


def test_repeated_documents_do_not_enlarge_the_fitting_set(spark, learnable):
    texts, labels = learnable
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once = documents(spark, texts)
    often = documents(spark, texts + [texts[0]] * 500, ids=[*range(300), *[0] * 500])
    a, b = quality.train(once, marks), quality.train(often, marks)
    assert np.array_equal(a["weight"], b["weight"]) and a["slope"] == b["slope"]


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    texts, ids = ["one two three", "one two three", None, "vier fünf"], [None, 5, 5, None]
    docs = documents(spark, texts, ids=ids)
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    for rows in (langid.identify(docs).collect(), quality.score_quality(docs, labels).collect()):
        assert sorted(r.doc_id or 0 for r in rows) == [0, 0, 5, 5] and all(not r.held_out for r in rows if r.doc_id is None)


def test_prediction_replaces_columns_of_its_names(spark):
    docs = documents(spark, ["abc"]).withColumns({"lang_pred": F.lit("old"), "score": F.lit(7), "guess": F.lit(1)})
    got = langid.predict(docs, None)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "guess", "lang_pred", "score"]
    assert got.first().lang_pred == "und"

"""Text quality by a support vector machine over naive-Bayes-scaled n-gram indicators.

A text's features are the word 1- and 2-grams and the 1- to 3-grams of its tokens' shapes that it holds
(hashed to `DIMENSIONS`). Each is scaled by its class log-count ratio, the vector is brought to unit length,
and a linear hinge-loss model is fitted by dual coordinate descent.

The model is fitted on a bounded sample of labelled rows (`SAMPLE`, chosen by a hash of the id): its ids are
broadcast, so texts are not shuffled; only the sampled rows' feature numbers meet in the fitting task.
Scoring is a narrow pass over all whole texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridhead.llm.common import blocks, code_points, hash_bar, hash_rank, mix, shingles, span_hashes, valid, words, written

#: Labelled rows that the model is fitted on, about.
SAMPLE = 12_000
BITS = 18
DIMENSIONS = 1 << BITS
#: Added to every feature's count in either class.
SMOOTHING = 1.0
#: Upper bound of a dual variable (times the class weight).
PENALTY = 1.0
#: Share of the fitted weights against their mean magnitude.
INTERPOLATION = 0.25
EPOCHS = 12
#: A document is kept (predicted 1) from this score on.
THRESHOLD = 0.3


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point: 0 blank, 1 upper-case, 2 lower-case, 3 other letter, 4 digit, 5 any other."""
    return np.fromiter((0 if c.isspace() else 1 if c.isupper() else 2 if c.islower() else 3 if c.isalpha() else 4 if c.isdigit() else 5 for c in map(chr, range(0x110000))), np.uint8, 0x110000)


def _shapes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text index and shape hash of every blank-separated token: letter case, digits, last mark, and whether it repeats the one before."""
    flat, begins = code_points(texts)
    kind = _kinds()[flat]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (kind != 0).view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    has = [np.logical_or.reduceat(kind == k, starts) for k in (1, 2, 3, 4)]
    last = np.where(kind[ends - 1] == 5, flat[ends - 1], 0).astype(np.uint64)
    doc = np.searchsorted(begins, starts, "right") - 1
    token = span_hashes(flat, starts, ends)
    again = np.zeros(len(token), bool)
    again[1:] = (token[1:] == token[:-1]) & (doc[1:] == doc[:-1])
    first = kind[starts] == 1
    code = sum(h.astype(np.uint64) << np.uint64(k) for k, h in enumerate([*has, again, first, ends - starts > 1, ends - starts > 12]))
    return doc, mix(code + (last << np.uint64(16)) + np.uint64(0xA5A5))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The (text, feature) pairs of a block of texts, each once, ordered by text."""
    pairs = []
    for salt, (doc, token), sizes in ((1, words(texts), (1, 2)), (2, _shapes(texts), (1, 2, 3))):
        for size in sizes:
            at, gram = shingles(doc, token, size)
            index = mix(gram + np.uint64(salt * 16 + size)) >> np.uint64(64 - BITS)
            pairs.append((doc[at] << BITS) | index.astype(np.int64))
    found = np.unique(np.concatenate(pairs))
    return found >> BITS, found & (DIMENSIONS - 1)


def _descent(rows: list[np.ndarray], ratio: np.ndarray, label: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Dual coordinate descent for the L1-loss SVM without bias; `rows` holds each example's features."""
    weight, alpha = np.zeros(DIMENSIONS), np.zeros(len(rows))
    values = [(v := ratio[r]) / max(np.sqrt(v @ v), 1e-12) for r in rows]
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            r, x, y = rows[i], values[i], label[i]
            gradient = y * (weight[r] @ x) - 1
            new = min(max(alpha[i] - gradient, 0.0), cost[i])
            if new != alpha[i]:
                weight[r] += (new - alpha[i]) * y * x
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weight


def _calibrated(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-out margins, by Newton steps with smoothed targets."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-6 * np.eye(2), x.T @ (p - target) + 1e-6 * theta)
        theta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-6)), float(theta[1])


def _fitted(rows: list[np.ndarray], positive: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Feature weights, log-count ratios, and the calibration."""
    prior = float(np.log((positive.sum() + 1) / ((~positive).sum() + 1)))
    if len(rows) < 20 or positive.all() or not positive.any():
        return np.zeros(DIMENSIONS), np.ones(DIMENSIONS), 1.0, prior
    counts = [SMOOTHING + np.bincount(np.concatenate([r for r, p in zip(rows, positive, strict=True) if p == side]), minlength=DIMENSIONS) for side in (True, False)]
    ratio = np.log((counts[0] / counts[0].sum()) / (counts[1] / counts[1].sum()))
    held = np.arange(len(rows)) % 5 == 4
    cost = PENALTY * len(rows) / (2 * np.where(positive, positive.sum(), (~positive).sum()))
    use = np.flatnonzero(~held)
    weight = _descent([rows[i] for i in use], ratio, np.where(positive[use], 1.0, -1.0), cost[use])
    weight = INTERPOLATION * weight + (1 - INTERPOLATION) * np.abs(weight[weight != 0]).mean() * (weight != 0)
    final = weight * ratio
    margin = np.array([final[r].sum() / max(np.sqrt((ratio[r] ** 2).sum()), 1e-12) for r in rows])
    check = held if positive[held].any() and not positive[held].all() else ~held
    return final, ratio, *_calibrated(margin[check], positive[check])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model from `docs` (doc_id, text) and `labels` (doc_id, quality): arrays of fixed size, whatever the input's.

    Rows with a null id or label teach nothing; a document with both labels counts as 1, and one with several rows is
    one example. With fewer than 20 labelled rows, or of one class only, the model is the smoothed share of label 1.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") > 0).cast("int")).alias("quality"))
    chosen = written(known.where(hash_rank("doc_id") < hash_bar(sample, known.count())), "quality-labels")
    taught = docs.select("doc_id", valid("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    # a document that has several rows is one example, the one of its least text
    taught = taught.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("quality").alias("quality")).select("text", "quality")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            for cut in blocks([len(t) for t in texts]):
                doc, index = features(texts[cut])
                each = np.split(index.astype(np.uint32), np.searchsorted(doc, np.arange(1, cut.stop - cut.start)))
                yield pa.RecordBatch.from_pydict({"label": b.column(1).slice(cut.start, cut.stop - cut.start), "features": pa.array([e.tobytes() for e in each], pa.binary())})

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(((f, y) for b in batches for y, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), key=lambda x: (hash_bytes(x[0]), x[1]))
        rows = [np.frombuffer(f, np.uint32).astype(np.int64) for f, _ in got]
        final, ratio, slope, offset = _fitted(rows, np.array([y == 1 for _, y in got], bool))
        yield pa.RecordBatch.from_pydict({"weight": [final.astype(np.float32).tobytes()], "ratio": [ratio.astype(np.float32).tobytes()], "slope": [slope], "offset": [offset]}, pa.schema([("weight", pa.binary()), ("ratio", pa.binary()), ("slope", pa.float64()), ("offset", pa.float64())]))

    rows = taught.mapInArrow(featured, "label int, features binary").repartition(1).mapInArrow(fit, "weight binary, ratio binary, slope double, offset double").collect()
    if not rows:
        return {"weight": np.zeros(DIMENSIONS, np.float32), "ratio": np.ones(DIMENSIONS, np.float32), "slope": 1.0, "offset": 0.0}
    return {"weight": np.frombuffer(rows[0].weight, np.float32), "ratio": np.frombuffer(rows[0].ratio, np.float32), "slope": rows[0].slope, "offset": rows[0].offset}


def hash_bytes(data: bytes) -> int:
    """An order of the examples that does not follow the order in which tasks end."""
    return int(mix(np.frombuffer(data, np.uint32).astype(np.uint64)).sum()) if data else 0


def score_column(docs: DataFrame, model: dict, text: str = "text") -> Column:
    """The score (0 to 1) of every whole text; a null or empty text has the score of no features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        squared = m["ratio"] ** 2
        for batch in batches:
            texts = [t or "" for t in batch]
            out = np.zeros(len(texts))
            for cut in blocks([len(t) for t in texts]):
                doc, index = features(texts[cut])
                n = cut.stop - cut.start
                norm = np.sqrt(np.maximum(np.bincount(doc, squared[index], n), 1e-24))
                margin = np.bincount(doc, m["weight"][index], n) / norm
                out[cut] = 1 / (1 + np.exp(-np.clip(m["slope"] * margin + m["offset"], -30, 30)))
            yield pd.Series(out)

    return score(valid(text))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`doc_id, held_out, score, predicted` of every row of `docs`, learnt from the labels of rows that are not held out.

    Null and empty texts are scored as texts without features, very long ones whole. Equal texts have equal scores; ids
    may repeat or be null; bytes that are no valid UTF-8 are read as U+FFFD. Further columns are ignored. An empty table gives an empty result.
    """
    model = train(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)), sample)
    scored = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), score_column(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that score at least `THRESHOLD`, with all their columns; an empty table stays empty."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)), sample)
    return docs.where(score_column(docs, model) >= THRESHOLD)

"""The language of texts by a string kernel.

Two texts are as alike as the character 1- to 3-grams that both hold: K(x, y) = |x and y| / sqrt(|x| |y|)
over n-gram presence (hashed to `DIMENSIONS`). Kernel ridge regression, one language against the rest, is
fitted on Nystroem landmarks and scored by two matrix products per block of texts.

Landmarks and fitted rows are bounded samples of the labelled rows, as many of each language; what reaches
the driver has a fixed size (landmarks x dimensions bits, sample x landmarks kernel values).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhead.llm.common import blocks, code_points, hash_bar, hash_rank, others, quoted, unused, valid
from gridhead.llm.quality import held_out

#: Labelled rows that the regression is fitted on, and those of them that serve as landmarks, about.
SAMPLE = 6_000
LANDMARKS = 128
GRAMS = (1, 2, 3)
BITS = 14
DIMENSIONS = 1 << BITS
RIDGE = 1e-3
#: Texts in a block: the presence matrix of a block is held as floats.
BLOCK_TEXTS = 256
#: Given to texts without a letter.
UNDETERMINED = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which n-grams each text holds (texts x dimensions), and which texts hold a letter."""
    flat, begins = code_points(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(begins))
    last = begins[1:] - 1  # the line end after each text
    inside = np.ones(len(flat), bool)
    inside[last] = False
    found = np.zeros(len(texts) << BITS, bool)
    code = np.zeros(len(flat), np.uint32)
    valid = inside.copy()
    for n in range(1, max(GRAMS) + 1):
        stop = len(flat) - n + 1
        code = (code[:stop] + flat[n - 1 :]) * np.uint32(0x9E3779B1)
        valid = valid[:stop] & inside[n - 1 :]
        if n in GRAMS:
            spread = code ^ (code >> np.uint32(15))
            index = ((spread * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int64)
            found[((doc[:stop] << BITS) + index)[valid]] = True
    letters = np.logical_or.reduceat(_letters()[flat], begins[:-1]) if len(texts) else np.zeros(0, bool)
    return found.reshape(len(texts), DIMENSIONS), letters


def kernel(found: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of texts (rows) with landmarks (rows of floats, already of unit length)."""
    x = found.astype(np.float32)
    return (x @ landmarks.T) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]


def _cuts(texts: list[str]) -> Iterator[slice]:
    for cut in blocks([len(t) for t in texts]):
        for at in range(cut.start, cut.stop, BLOCK_TEXTS):
            yield slice(at, min(cut.stop, at + BLOCK_TEXTS))


def _low(texts) -> list[str]:
    return [(t or "").lower() for t in texts]


def sampled(known: DataFrame, counts: dict[str, int], limit: int) -> DataFrame:
    """`text, lang`: of each language as many of the rows of `known` (doc_id, text, lang) as of any other, `limit` in all, about.

    Chosen by a hash of the id; rows that share an id are one example (the one of the least text), so that they cannot
    enlarge the sample. A language has a row at least where it has rows, and twice its even share at most.
    """
    each = max(1, math.ceil(limit / len(counts)))
    # twice as many by the hash, the first of which are taken: a language is not left out by chance
    bars = known.sparkSession.createDataFrame([(k, hash_bar(2 * each + 8, n)) for k, n in counts.items()], "lang string, bar long")
    picked = known.withColumn("at", hash_rank("doc_id")).join(F.broadcast(bars), "lang").where("at < bar")
    single = picked.groupBy("lang", "at").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("at")
    return single.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each).select("text", "lang")


def train(docs: DataFrame, sample: int = SAMPLE, n_landmarks: int = LANDMARKS) -> dict | None:
    """The model from `docs` (doc_id, text, lang), or None without a usable row. Rows with a null id, text or lang teach nothing.

    Each different lang is a class with weights of its own: a few hundred at most.
    """
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").withColumn("text", valid("text"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return None
    langs = sorted(counts)
    spark = docs.sparkSession

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _low(b.column(0).to_pylist())
            for cut in _cuts(texts):
                found, letters = presence(texts[cut])
                yield pa.RecordBatch.from_pydict({"found": pa.array([np.packbits(f).tobytes() if ok else None for f, ok in zip(found, letters, strict=True)], pa.binary())})

    rows = sampled(known, counts, n_landmarks).mapInArrow(grams, "found binary").where("found IS NOT NULL").distinct().orderBy("found").collect()
    if not rows:
        return None
    landmarks = np.stack([np.unpackbits(np.frombuffer(r.found, np.uint8)) for r in rows]).astype(np.float32)
    landmarks /= np.sqrt(landmarks.sum(1))[:, None]
    shared = spark.sparkContext.broadcast(landmarks)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _low(b.column(0).to_pylist())
            for cut in _cuts(texts):
                found, letters = presence(texts[cut])
                k = kernel(found, shared.value)
                yield pa.RecordBatch.from_pydict({"lang": b.column(1).slice(cut.start, cut.stop - cut.start), "k": pa.array([v.tobytes() if ok else None for v, ok in zip(k, letters, strict=True)], pa.binary())})

    fitted = sampled(known, counts, sample).mapInArrow(values, "lang string, k binary").where("k IS NOT NULL").orderBy("k", "lang").collect()
    k = np.stack([np.frombuffer(r.k, np.float32) for r in fitted]).astype(np.float64)
    y = (np.array([r["lang"] for r in fitted])[:, None] == np.array(langs)[None, :]).astype(np.float64)
    return {"landmarks": landmarks, "weights": solved(k, (landmarks @ landmarks.T).astype(np.float64), y).astype(np.float32), "langs": langs}


def solved(k: np.ndarray, own: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The landmarks' weights of kernel ridge regression: `k` rows x landmarks, `own` landmarks x landmarks, `y` a column of 0 and 1 per class."""
    return np.linalg.solve(k.T @ k + RIDGE * len(k) * own + 1e-8 * np.eye(len(own)), k.T @ y)


def predict(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score` (0 to 1) from the whole text alone; `und` and 0 for null texts and texts without a letter.

    Columns of these names (in whatever case) are replaced; bytes that are no valid UTF-8 are read as U+FFFD. A very long text is read whole, in a block of its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            texts = _low(batch)
            names, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            for cut in _cuts(texts) if m else ():
                found, letters = presence(texts[cut])
                y = kernel(found, m["landmarks"]) @ m["weights"]
                names[cut] = np.where(letters, np.array(m["langs"], object)[y.argmax(1)], UNDETERMINED)
                scores[cut] = np.where(letters, np.clip(y.max(1), 0, 1), 0)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    name = unused("guess", docs)
    kept = quoted(*others(docs, "lang_pred", "score"))
    return docs.withColumn(name, guess(valid(text))).select(*kept, f"{name}.lang_pred", f"{name}.score")


def identify(docs: DataFrame, sample: int = SAMPLE, n_landmarks: int = LANDMARKS) -> DataFrame:
    """`doc_id, held_out, lang_pred, score` of every row of `docs`, learnt from the rows that are not held out.

    Equal texts have equal results; ids may repeat or be null; texts of any length are read whole. Without any labelled
    row all predictions are `und`. Further columns are ignored. An empty table gives an empty result.
    """
    out = held_out(F.col("doc_id"), 4, 2)
    model = train(docs.select("doc_id", "text", "lang").where(~out), sample, n_landmarks)
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")

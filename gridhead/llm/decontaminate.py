"""Benchmark items inside documents, by greedy string tiling.

Word runs of `MIN_MATCH` words seed the join of documents and items. Tiles that cover enough of an item hold a least
number of its seeds, so only the others' rarest ones need to be looked for: a document that has none of these cannot
hold the item (`item_seeds`). In a document and item that share such a seed, running Karp-Rabin finds the longest runs
of equal words that are not tiled yet: windows of a length are compared by their running hashes, the longest length
with a common window is found by bisection, and its windows are compared word by word and tiled, first ones first;
then shorter lengths follow, down to `MIN_MATCH`. The order of the passages does not matter. The item is in the
document if the tiles cover at least `COVERAGE` of the item's words.

Items go to the tasks while they are few (`BROADCAST_WORDS`, counted first); then nothing is shuffled. Beyond that,
seeds meet in a shuffle join, and the texts join the pairs that it found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhead.llm.common import blocks, shingles, valid, words, written

MIN_MATCH = 5
COVERAGE = 0.6
#: Words of all items that are broadcast at most (8 bytes each, and 16 for a seed).
BROADCAST_WORDS = 1_000_000
#: Matches of seeds that are looked at at once.
MATCHES = 1_000_000
_BASE = 0x100000001B3

_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("longest", pa.int32())])
_FOUND_DDL = "doc_id long, item_id long, coverage double, n_tiles int, longest int"


class _Words:
    """A sequence of words of which some are marked, and the running hashes of its windows."""

    def __init__(self, word: np.ndarray):
        self.word, self.marked = word, np.zeros(len(word), bool)
        powers = np.cumprod(np.full(len(word), _BASE, np.uint64))
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum((word + np.uint64(1)) * powers)))
        self.inverse = np.cumprod(np.full(len(word) + 1, pow(_BASE, -1, 2**64), np.uint64))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every window without a marked word."""
        marks = np.concatenate(([0], np.cumsum(self.marked)))
        start = np.flatnonzero(marks[size:] == marks[:-size])
        return start, (self.sums[start + size] - self.sums[start]) * self.inverse[start]


def _longest(doc: _Words, item: _Words, least: int, most: int) -> int:
    """The greatest length up to `most` of which both have a common window, `least` - 1 if there is none. A common window holds shorter ones, so lengths are bisected."""
    low, high = least - 1, most
    while low < high:
        size = (low + high + 1) // 2
        if np.isin(item.windows(size)[1], doc.windows(size)[1]).any():
            low = size
        else:
            high = size - 1
    return low


def tiles(doc_words: np.ndarray, item_words: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (document position, item position, words) of each tile of at least `size` words.

    Longest first; among equals the first in the item, then in the document.
    """
    doc, item, found = _Words(doc_words), _Words(item_words), []
    length = min(len(doc_words), len(item_words))
    while length >= size and (length := _longest(doc, item, size, length)) >= size:
        at, own = doc.windows(length)
        order = np.lexsort((at, own))
        at, own = at[order], own[order]
        start, key = item.windows(length)
        low, high = np.searchsorted(own, key), np.searchsorted(own, key, "right")
        for i, a, z in zip(start.tolist(), low.tolist(), high.tolist(), strict=True):
            if a == z or item.marked[i : i + length].any():
                continue
            for d in at[a:z].tolist():
                if not doc.marked[d : d + length].any() and np.array_equal(doc_words[d : d + length], item_words[i : i + length]):
                    found.append((d, i, length))
                    doc.marked[d : d + length] = item.marked[i : i + length] = True
                    break
        length -= 1
    return found


def _tiled(doc_id: int | None, item_id: int, doc: np.ndarray, seed: np.ndarray, item: np.ndarray, size: int, coverage: float) -> dict | None:
    """The result for a document's words (with the hashes of its runs of `size` words) and an item's, if the tiles reach the coverage."""
    _, item_seed = shingles(np.zeros(len(item), np.int64), item, size)
    near = np.isin(seed, item_seed)
    reach = np.zeros(len(item) + 1, np.int64)  # words of the item under a seed: no tiling covers more
    at = np.flatnonzero(np.isin(item_seed, seed[near]))
    np.add.at(reach, at, 1)
    np.add.at(reach, at + size, -1)
    if (np.cumsum(reach[:-1]) > 0).sum() < coverage * len(item):
        return None
    # only words under a seed can be tiled: the others become one gap, a word that no item has
    under = np.zeros(len(doc) + 1, np.int64)
    np.add.at(under, np.flatnonzero(near), 1)
    np.add.at(under, np.flatnonzero(near) + size, -1)
    under = np.cumsum(under[:-1]) > 0
    kept = np.where(under, doc, np.uint64(0))
    kept = kept[under | np.concatenate(([True], under[:-1]))]
    found = tiles(kept, item, size)
    covered = sum(t[2] for t in found)
    return {"doc_id": doc_id, "item_id": item_id, "coverage": covered / len(item), "n_tiles": len(found), "longest": max(t[2] for t in found)} if covered and covered >= coverage * len(item) else None


def item_words(benchmark: DataFrame, size: int = MIN_MATCH) -> DataFrame:
    """`item_no, item_id, n, words` (hashes, packed) of every row with an id and at least `size` words; `item_no` is its own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for part in blocks([len(t) for t in texts]):
                doc, word = words(texts[part])
                each = np.split(word, np.searchsorted(doc, np.arange(1, part.stop - part.start)))
                yield pa.RecordBatch.from_pydict({"item_id": b.column(0).slice(part.start, part.stop - part.start), "n": pa.array([len(e) for e in each], pa.int32()), "words": pa.array([e.tobytes() for e in each], pa.binary())})

    rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), valid("text").alias("text"))
    found = rows.mapInArrow(cut, "item_id long, n int, words binary").where(F.col("n") >= size)
    return written(found.withColumn("item_no", F.monotonically_increasing_id()), "bench-words")


def item_seeds(items: DataFrame, size: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """`seed, item_no`: the seeds by which items are looked for.

    Tiles of at least `size` words that cover c words of an item hold c / size of its seeds or more, so one of the item's
    seeds without its (c / size - 1) most frequent ones is in every document that holds it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word = [np.frombuffer(w, np.uint64) for w in b.column(2).to_pylist()]
            n = [len(w) - size + 1 for w in word]
            seed = [shingles(np.zeros(len(w), np.int64), w, size)[1].astype(np.int64) for w in word]
            need = [math.ceil(math.ceil(coverage * len(w) - 1e-9) / size) for w in word]
            yield pa.RecordBatch.from_pydict({"item_no": np.repeat(b.column(0).to_numpy(), n), "seed": np.concatenate(seed), "chosen": np.repeat(np.array([k - m + 1 for k, m in zip(n, need, strict=True)], np.int32), n)})

    seeds = written(items.select("item_no", "n", "words").mapInArrow(cut, "item_no long, seed long, chosen int"), "bench-seeds")
    times = seeds.groupBy("seed").agg(F.count("*").alias("times"))
    order = Window.partitionBy("item_no").orderBy("times", "seed")
    ranked = seeds.join(times, "seed").withColumn("place", F.row_number().over(order))
    return written(ranked.where("place <= chosen").select("seed", "item_no").distinct(), "bench-triggers")


def _split(texts: list[str], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, words and seeds of each text that has a seed."""
    for part in blocks([len(t) for t in texts]):
        doc, word = words(texts[part])
        ends = np.searchsorted(doc, np.arange(part.stop - part.start + 1))
        for k, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if z - a >= size:
                yield part.start + k, word[a:z], shingles(doc[a:z], word[a:z], size)[1]


def _by_broadcast(docs: DataFrame, items: DataFrame, seeds: DataFrame, size: int, coverage: float) -> DataFrame:
    rows = items.orderBy("item_no").select("item_no", "item_id", "words").collect()  # counted: at most BROADCAST_WORDS words
    numbers = np.array([r.item_no for r in rows], np.int64)
    got = seeds.orderBy("seed", "item_no").toPandas()
    shared = docs.sparkSession.sparkContext.broadcast((got["seed"].to_numpy(), np.searchsorted(numbers, got["item_no"].to_numpy()), [r.item_id for r in rows], [bytes(r.words) for r in rows]))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, item, item_id, item_word = shared.value
        for b in batches:
            ids, out = b.column(0), []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for part in blocks([len(t) for t in texts]):
                doc, word = words(texts[part])
                at, seed = shingles(doc, word, size)
                ends, edges = (np.searchsorted(x, np.arange(part.stop - part.start + 1)) for x in (doc, doc[at]))
                low = np.searchsorted(known, seed.astype(np.int64))
                hit = np.flatnonzero(low < len(known))
                hit = hit[known[low[hit]] == seed[hit].astype(np.int64)]
                met = np.unique(np.stack([doc[at[hit]], low[hit]], 1), axis=0)  # a seed counts once in a text
                n = np.searchsorted(known, known[met[:, 1]], "right") - met[:, 1] if len(met) else np.zeros(0, np.int64)
                pairs = np.zeros((0, 2), np.int64)
                cuts = np.searchsorted(np.cumsum(n), np.arange(MATCHES, int(n.sum()), MATCHES))
                for some in np.split(np.arange(len(met)), np.unique(cuts)):
                    k = n[some]
                    row = np.repeat(met[some, 1] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                    pairs = np.unique(np.concatenate([pairs, np.stack([np.repeat(met[some, 0], k), item[row]], 1)]), axis=0)
                for d, i in pairs.tolist():
                    out.append(_tiled(ids[part.start + d].as_py(), item_id[i], word[ends[d] : ends[d + 1]], seed[edges[d] : edges[d + 1]], np.frombuffer(item_word[i], np.uint64), size, coverage))
            yield pa.RecordBatch.from_pylist([r for r in out if r], _FOUND)

    return docs.mapInArrow(match, _FOUND_DDL)


def _by_join(docs: DataFrame, items: DataFrame, seeds: DataFrame, size: int, coverage: float) -> DataFrame:
    # rows with equal id and text have equal results, so two hashes of both stand for them
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(1), F.col("doc_id"), F.col("text")).alias("also"), "doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, _, seed in _split([t or "" for t in b.column(2).to_pylist()], size):
                each = np.unique(seed.astype(np.int64))
                yield pa.RecordBatch.from_pydict({"key": np.full(len(each), b.column(0)[k].as_py(), np.int64), "also": np.full(len(each), b.column(1)[k].as_py(), np.int64), "seed": each})

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_id, item_id, item = (b.column(k).to_pylist() for k in (0, 2, 3))
            rows = [_tiled(doc_id[k], item_id[k], word, seed, np.frombuffer(item[k], np.uint64), size, coverage) for k, word, seed in _split([t or "" for t in b.column(1).to_pylist()], size)]
            yield pa.RecordBatch.from_pylist([r for r in rows if r], _FOUND)

    met = keyed.select("key", "also", "text").mapInArrow(cut, "key long, also long, seed long").join(seeds, "seed")
    pairs = written(met.select("key", "also", "item_no").distinct(), "bench-pairs")
    both = keyed.join(pairs, ["key", "also"]).join(items, "item_no").select("doc_id", "text", "item_id", "words")
    return both.mapInArrow(tile, _FOUND_DDL)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = MIN_MATCH, coverage: float = COVERAGE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """`doc_id, item_id, coverage, n_tiles, longest` of every row of `docs` and item whose tiles reach the coverage.

    Null and empty texts hold nothing; very long ones are searched whole; items with fewer than `size` words are in no
    document; rows of `docs` that share an id (or have none) are each judged alone. Equal items are all reported.
    Bytes that are no valid UTF-8 are read as U+FFFD. Further columns are ignored. Without documents or items the result is empty.
    """
    items = item_words(benchmark, size)
    seeds = item_seeds(items, size, coverage)
    rows = docs.select(F.col("doc_id").cast("long"), valid("text").alias("text"))
    few = (items.agg(F.sum("n")).first()[0] or 0) <= broadcast_words
    return (_by_broadcast if few else _by_join)(rows, items, seeds, size, coverage)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose id has no item; rows without an id stay, and an empty table stays empty."""
    found = written(contaminated(docs, benchmark).select("doc_id").distinct(), "bench-found")
    return docs.join(found, docs["doc_id"].cast("long") == found["doc_id"], "left_anti")

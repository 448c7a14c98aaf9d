"""Removal of byte strings that occur more than once, by a suffix index of many documents built column by column.

A 200-byte string is found again through its anchor, the 64-byte run inside it that has the least hash: equal
strings have equal anchors at equal places. Consecutive starts that share an anchor form a stretch; only stretches
whose anchor occurs elsewhere can repeat anything, and equal stretches are indexed once, with their number. Where all
stretches of an anchor are equal there is nothing to compare: every string in them starts more than once.

The different stretches of one anchor meet in one task. There the Burrows-Wheeler transform of many stretches and their
common prefixes are built together: each round puts one more symbol of every stretch (from its end) in front and
inserts the new suffixes by last-to-first mapping. Transform and prefixes are plain sequences that are read and
written front to back, and as a batch of stretches is small they stay in memory. Runs of suffixes with common
prefixes of 200 bytes or more, weighed by the stretches' numbers, are the strings that start more than once.
An anchor of more than `SPLIT` different stretches is not indexed: its 200-byte strings are counted by 128-bit hashes.

Of an anchor that is frequent in a block of text, stretches are counted where their content's hash puts them, so that
no task gets all of them.

Texts are keyed by two 64-bit hashes, stretches by one of their anchor and one of their content; equal texts are
handled once.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhead.llm.common import mix, partitions, quoted, release_memory, valid, written

#: Bytes of a string that must not occur twice, and of an anchor.
LENGTH, ANCHOR = 200, 64
#: Bytes of text that are hashed at once, and stretches that are indexed at once (all of an anchor together).
BLOCK_BYTES, BATCH = 1_500_000, 240
#: Bytes of a symbol of the index; divides `LENGTH`.
SYMBOL = 8
#: From so many stretches of one anchor in a block on, only a mark goes to the anchor's bucket.
HOT = 64
#: Different stretches of one anchor that are indexed in one task at most.
SPLIT = 1000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3

_FIELDS = [("h", np.int64), ("f", np.int64), ("key", np.int64), ("also", np.int64), ("at", np.int32), ("span", np.uint8), ("n", np.int32)]
#: What a packed row holds: stretches of the bucket's anchors, stretches of frequent anchors (in any bucket), sums of such stretches.
_OWN, _PLACES, _SUMS = 0, 1, 2
#: The offsets 0, 1, 2 and so on of a stretch that is repeated as a whole.
_EVERY = bytes(range(LENGTH - ANCHOR + 1))


def _stretches(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: text index, start, last start, anchor hash and content hash of every stretch."""
    begins = np.cumsum(sizes) - sizes
    width = LENGTH - ANCHOR + 1
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    h, step = mix(np.arange(1, 257, dtype=np.uint64))[data], 1
    while step < ANCHOR:
        h = mix(h[:-step] * _STEP + h[step:])
        step *= 2
    bits = np.uint64(int(len(h)).bit_length())
    least, size = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64), 1  # the position breaks ties: first one
    while size * 2 <= width:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if width > size:
        least = np.minimum(least[: -(width - size)], least[width - size :])
    room = np.zeros(len(data) + 1, np.int32)
    long = sizes >= LENGTH
    np.add.at(room, begins[long], 1)
    np.add.at(room, (begins + sizes)[long] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(room[: len(least)]))
    anchor = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
    if not len(new):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    first, last, anchor = start[new], start[np.append(new[1:], len(start)) - 1], anchor[new]
    powers = np.cumprod(np.full(len(data), _BASE, np.uint64))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers)))
    inverse = np.cumprod(np.full(len(data), pow(_BASE, -1, 2**64), np.uint64))
    content = mix((sums[last + LENGTH] - sums[first]) * inverse[first] + mix((anchor - first).astype(np.uint64) * np.uint64(512) + (last - first).astype(np.uint64)))
    doc = np.searchsorted(begins, first, "right") - 1
    return doc, first - begins[doc], last - begins[doc], h[anchor], content


def _packed(bucket: int, kind: int, rows: dict[str, np.ndarray]) -> dict:
    return {"bucket": bucket, "kind": kind} | {k: rows[k].astype(t).tobytes() for k, t in _FIELDS}


_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32())] + [(k, pa.binary()) for k, _ in _FIELDS])
_PACKED_DDL = "bucket int, kind int, " + ", ".join(f"{k} binary" for k, _ in _FIELDS)


def _by_bucket(rows: dict[str, np.ndarray], bucket: np.ndarray, kind: int) -> Iterator[dict]:
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            yield _packed(int(bucket[part[0]]), kind, {k: v[part] for k, v in rows.items()})


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    return np.flatnonzero(np.logical_or.reduce([np.diff(c, prepend=~c[:1]) != 0 for c in columns])) if len(columns[0]) else np.zeros(0, np.int64)


def _anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """The stretches of `texts` (key, also, text), packed by bucket of the anchor. Of an anchor that is frequent in a
    block, the stretches are in any bucket and their sums in that of anchor and content; its own bucket has a mark only."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[tuple, list] = {}
            for key, also, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if text is not None and len(text) * 4 >= LENGTH:
                    held.setdefault((key, also), [text, 0])[1] += 1
            waiting, size = [], 0
            for key, (text, n) in held.items():
                data = text.encode("utf-8", "surrogatepass")
                if waiting and size + len(data) > BLOCK_BYTES:
                    yield from packed(waiting)
                    waiting, size = [], 0
                waiting.append((key, data, n))
                size += len(data)
            if waiting:
                yield from packed(waiting)
            del held, waiting
            release_memory()

    def packed(held: list) -> Iterator[pa.RecordBatch]:
        doc, first, last, h, f = _stretches(np.frombuffer(b"".join(d for _, d, _ in held), np.uint8), np.array([len(d) for _, d, _ in held]))
        key, also = (np.array([k[side] for k, _, _ in held], np.int64)[doc] for side in (0, 1))
        rows = {"h": h.astype(np.int64), "f": f.astype(np.int64), "key": key, "also": also, "at": first, "span": last - first, "n": np.array([n for _, _, n in held])[doc]}
        order = np.lexsort((rows["f"], rows["h"]))
        rows = {k: v[order] for k, v in rows.items()}
        out = []
        if len(order):
            begin = _firsts(rows["h"])
            each = np.diff(np.append(begin, len(order)))
            hot = np.repeat(each >= HOT, each)
            if hot.any():
                frequent = {k: v[hot] for k, v in rows.items()}
                out.append(_packed(int(frequent["key"][0] % buckets), _PLACES, frequent))
                same = _firsts(frequent["h"], frequent["f"])
                sums = {k: v[same] for k, v in frequent.items()} | {"n": np.add.reduceat(frequent["n"], same)}
                out += _by_bucket(sums, (mix(sums["h"].astype(np.uint64) ^ mix(sums["f"].astype(np.uint64))) % np.uint64(buckets)).astype(np.int64), _SUMS)
                marks = {k: v[begin[each >= HOT]] for k, v in rows.items()} | {"n": np.zeros((each >= HOT).sum(), np.int64)}
                rows = {k: np.concatenate([v[~hot], marks[k]]) for k, v in rows.items()}
            out += _by_bucket(rows, (mix(rows["h"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), _OWN)
        yield pa.RecordBatch.from_pylist(out, _PACKED)

    return texts.mapInArrow(cut, _PACKED_DDL)


def _repeated(packed: DataFrame) -> DataFrame:
    """The stretches whose anchor occurs more than once. A row per stretch (`m` = 0; -1 where it is repeated as a whole), and
    one per content (`m` > 0: how often). `hot`: other rows of the same anchor and content may be elsewhere, and are to be added."""
    kinds = [("h", pa.int64()), ("f", pa.int64()), ("key", pa.int64()), ("also", pa.int64()), ("at", pa.int32()), ("span", pa.int32()), ("m", pa.int64()), ("hot", pa.bool_())]

    def made(columns: tuple, m: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip((*columns, m, hot), kinds, strict=True)], schema=pa.schema(kinds))

    def sums(parts: list) -> Iterator[pa.RecordBatch]:
        *columns, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((columns[1], columns[0]))
        columns, n = [c[order] for c in columns], n[order].astype(np.int64)
        begin = _firsts(columns[0], columns[1])
        yield made([c[begin] for c in columns], np.add.reduceat(n, begin), np.ones(len(begin), bool))

    def own(parts: list) -> Iterator[pa.RecordBatch]:
        *columns, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((columns[4], columns[3], columns[2], columns[1], columns[0]))
        columns, n = [c[order] for c in columns], n[order].astype(np.int64)
        begin = _firsts(columns[0])
        each = np.diff(np.append(begin, len(n)))
        frequent = np.minimum.reduceat(n, begin) == 0
        again = np.repeat((np.add.reduceat(n, begin) > 1) | frequent, each) & (n > 0)
        hot = np.repeat(frequent, each)[again]
        columns, n = [c[again] for c in columns], n[again]
        if not len(n):
            return
        begin = _firsts(columns[0], columns[1])
        anchor = _firsts(columns[0])
        contents = np.diff(np.append(np.searchsorted(begin, anchor), len(begin)))
        alone = np.repeat(contents == 1, np.diff(np.append(anchor, len(n)))) & ~hot
        some = ~alone[begin]
        yield made([c[begin][some] for c in columns], np.add.reduceat(n, begin)[some], hot[begin][some])
        one = _firsts(*columns[:5])
        yield made([c[one] for c in columns], np.where(alone[one], -1, 0), hot[one])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {_OWN: [], _SUMS: []}
        for b in batches:
            for kind, *columns in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                part = [np.frombuffer(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)]
                if kind == _PLACES:
                    yield made(part[:-1], np.zeros(len(part[0]), np.int64), np.ones(len(part[0]), bool))
                else:
                    parts[kind].append(part)
        if parts[_SUMS]:
            yield from sums(parts.pop(_SUMS))
        if parts[_OWN]:
            yield from own(parts.pop(_OWN))
        release_memory()

    return packed.mapInArrow(select, "h long, f long, key long, also long, at int, span int, m long, hot boolean")


def _sorted(codes: np.ndarray) -> np.ndarray:
    """The stable order of the codes, by halves of 16 bits where they are wider (short codes are counted, not compared)."""
    if codes.itemsize <= 2:
        return np.argsort(codes, kind="stable")
    order = np.argsort(codes.astype(np.uint16), kind="stable")
    return order[np.argsort((codes >> 16).astype(np.uint16)[order], kind="stable")]


def suffix_index(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, offset and common prefix with the one before of all suffixes (the empty ones first) in their order.

    `symbols` holds the strings end to end. Equal suffixes are ordered by their strings; a common prefix ends with the
    shorter suffix.
    """
    m, ends = len(sizes), np.cumsum(sizes)
    used, flat = np.unique(symbols, return_inverse=True)
    # 0 stands for "nothing before it yet", so symbols are counted from 1, by their order
    kind = next(t for t in (np.uint8, np.uint16, np.uint32) if len(used) <= np.iinfo(t).max)
    flat = (flat + 1).astype(kind)
    before, prefix = np.zeros(m, kind), np.zeros(m + 1, np.int32)
    place, owner = np.arange(m), np.arange(m)  # of the suffixes of the last round, in their order
    for j in range(int(sizes.max(initial=0))):
        live = sizes[owner] > j
        place, owner = place[live], owner[live]
        before[place] = flat[ends[owner] - 1 - j]
        who = np.full(len(before), -1, np.int32)
        who[place] = owner
        order = _sorted(before)
        order = order[len(before) - np.count_nonzero(before) :]  # by symbol, then by what follows it
        chosen = who[order]
        rank = np.flatnonzero(chosen >= 0)
        here, owner = order[rank], chosen[rank]
        # common prefix with the neighbours that start with the same symbol: the least one between the two, and the symbol
        up, down = order[np.maximum(rank - 1, 0)], order[np.minimum(rank + 1, len(order) - 1)]
        above = (rank > 0) & (before[up] == before[here])
        below = (rank < len(order) - 1) & (before[down] == before[here]) & (who[down] < 0)
        lows = np.concatenate([up[above], here[below]])
        highs = np.concatenate([here[above], down[below]])
        least = np.zeros(len(lows), np.int32)
        if len(lows):
            far = np.argsort(-lows, kind="stable")  # so that what lies between two ranges is a single entry
            least[far] = np.minimum.reduceat(prefix, np.stack([lows[far] + 1, highs[far] + 1], 1).ravel())[::2]
        place = m + rank
        old = np.ones(len(before) + len(rank), bool)
        old[place] = False
        grown, common = np.zeros(len(old), kind), np.zeros(len(old) + 1, np.int32)
        grown[old], common[:-1][old] = before, prefix[:-1]
        common[place[above]] = least[: above.sum()] + 1
        common[place[below] + 1] = least[above.sum() :] + 1
        before, prefix = grown, common
    # walk back from the empty suffixes to name every entry
    order = _sorted(before)[len(before) - np.count_nonzero(before) :]
    to = np.zeros(len(before), np.int64)
    to[order] = m + np.arange(len(order))
    string, offset = np.zeros(len(before), np.int64), np.zeros(len(before), np.int64)
    at, who = np.arange(m), np.arange(m)
    string[at], offset[at] = who, sizes
    for j in range(int(sizes.max(initial=0))):
        live = sizes[who] > j
        who, at = who[live], to[at[live]]
        string[at], offset[at] = who, sizes[who] - 1 - j
    return string, offset, prefix[:-1]


def repeated_starts(strings: list[bytes], times: np.ndarray) -> list[np.ndarray]:
    """For each string (that occurs so many times), the offsets whose next `LENGTH` bytes start more than once in all.

    A string is indexed as `SYMBOL` rows of symbols of `SYMBOL` bytes, one for each first offset, which saves rounds.
    """
    data = np.frombuffer(b"".join(strings) + bytes(SYMBOL), np.uint8).astype(np.uint64)
    wide = sum(data[k : len(data) - SYMBOL + k] << np.uint64(8 * (SYMBOL - 1 - k)) for k in range(SYMBOL))
    length = np.array([len(s) for s in strings])
    shift = np.arange(SYMBOL)
    sizes = (np.maximum(length[:, None] - shift, 0) // SYMBOL).ravel()
    base = ((np.cumsum(length) - length)[:, None] + shift).ravel()
    row = np.repeat(np.arange(len(sizes)), sizes)
    symbols = wide[base[row] + SYMBOL * (np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row])]
    string, offset, prefix = suffix_index(symbols, sizes)
    full = sizes[string] - offset >= LENGTH // SYMBOL
    group = np.cumsum((prefix < LENGTH // SYMBOL) | ~full) - 1
    total = np.bincount(group, np.where(full, times[string // SYMBOL], 0))
    hit = full & (total[group] > 1)
    offset = offset[hit] * SYMBOL + string[hit] % SYMBOL
    string = string[hit] // SYMBOL
    order = np.lexsort((offset, string))
    return np.split(offset[order], np.searchsorted(string[order], np.arange(1, len(strings))))


def _indexed(stretches: DataFrame, parts: int) -> DataFrame:
    """`h, f, starts` (repeated offsets, packed) of `stretches` (h, f, m, data), all of an anchor in one batch."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []

        def done(rows: list[tuple]) -> pa.RecordBatch:
            found = repeated_starts([r[3] for r in rows], np.array([r[2] for r in rows])) if rows else []
            return pa.RecordBatch.from_pydict({"h": pa.array([r[0] for r in rows], pa.int64()), "f": pa.array([r[1] for r in rows], pa.int64()), "starts": pa.array([s.astype(np.uint8).tobytes() for s in found], pa.binary())})

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(waiting) >= BATCH and waiting[-1][0] != row[0]:
                    yield done(waiting)
                    waiting = []
                if not waiting or waiting[-1][:2] != row[:2]:  # the same stretch may come from several equal texts
                    waiting.append(row)
        yield done(waiting)
        release_memory()

    together = stretches.repartition(parts, "h").sortWithinPartitions("h", "f")
    return together.mapInArrow(index, "h long, f long, starts binary").where(F.length("starts") > 0)


def start_hashes(data: bytes, seed: int) -> np.ndarray:
    """A 64-bit hash of each `LENGTH`-byte string of `data`."""
    n, at, total, step = len(data) - LENGTH + 1, 0, np.uint64(seed), 1
    h = mix(np.arange(1 + 256 * seed, 257 + 256 * seed, dtype=np.uint64))[np.frombuffer(data, np.uint8)]
    while step <= LENGTH:
        if LENGTH & step:
            total = mix(total * _STEP + h[at : at + n])
            at += step
        h = mix(h[:-step] * _STEP + h[step:])
        step *= 2
    return total


def _counted(stretches: DataFrame) -> DataFrame:
    """`h, f, starts` (repeated offsets, packed) of `stretches` (h, f, m, data), without bringing those of an anchor together."""
    schema = pa.schema([("h", pa.int64()), ("f", pa.int64()), ("m", pa.int64()), ("at", pa.int32()), ("s", pa.int64()), ("t", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, len(b), BATCH):
                part = b.slice(first, BATCH)
                data = part.column(3).to_pylist()
                n = np.array([len(d) - LENGTH + 1 for d in data])
                s, t = (np.concatenate([start_hashes(d, seed) for d in data]).astype(np.int64) for seed in (1, 2))
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                h, f, m = (np.repeat(part.column(k).to_numpy(), n) for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, f, m, at.astype(np.int32), s, t)], schema=schema)
        release_memory()

    # the same stretch may come from several equal texts
    starts = written(stretches.dropDuplicates(["h", "f"]).mapInArrow(hashed, "h long, f long, m long, at int, s long, t long"), "suffix-starts")
    again = starts.groupBy("h", "s", "t").agg(F.sum("m").alias("times")).where("times > 1").select("h", "s", "t")
    found = starts.join(again, ["h", "s", "t"]).groupBy("h", "f").agg(F.sort_array(F.collect_list("at")).alias("at"))
    return found.select("h", "f", F.unhex(F.array_join(F.transform("at", lambda x: F.lpad(F.hex(x), 2, "0")), "")).alias("starts"))


def _cut_out(texts: DataFrame) -> DataFrame:
    """`h, f, m, data` from `texts` (key, also, text, wanted): the bytes of the wanted stretches, once per batch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("f", pa.int64()), ("m", pa.int64()), ("data", pa.binary())])
        for b in batches:
            seen, rows = set(), {k: [] for k in schema.names}
            for *key, text, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if tuple(key) in seen:
                    continue
                seen.add(tuple(key))
                data = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    rows["h"].append(w["h"])
                    rows["f"].append(w["f"])
                    rows["m"].append(w["m"])
                    rows["data"].append(data[w["at"] : w["at"] + w["span"] + LENGTH])
            yield pa.RecordBatch.from_pydict(rows, schema)
            del rows
            release_memory()

    return texts.mapInArrow(cut, "h long, f long, m long, data binary")


def spans(runs: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
    """The maximal runs of bytes under the repeated strings of a text, given as (stretch start, repeated offsets)."""
    if not runs:
        return []
    start = np.unique(np.concatenate([np.frombuffer(s, np.uint8).astype(np.int64) + at for at, s in runs]))
    cuts = np.flatnonzero(np.diff(start) > LENGTH) + 1
    return [(int(a), int(b) + LENGTH) for a, b in zip(start[np.concatenate(([0], cuts))], start[np.concatenate((cuts, [len(start)])) - 1], strict=True)]


def with_spans(docs: DataFrame) -> DataFrame:
    """`row` (the columns of `docs`) with `runs`: where repeated strings start in its whole `text` (null: nowhere). See `spans`.

    Rows with equal texts are different places of the same strings, so such texts of `LENGTH` bytes or more are repeated as a whole.
    """
    docs = docs.withColumn("text", valid("text"))
    keyed = docs.select(F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), F.col("text")).alias("also"), F.struct(*quoted(*docs.columns)).alias("row"))
    parts = partitions(docs)
    packed = _anchors(keyed.select("key", "also", "row.text"), parts).repartitionById(parts, F.col("bucket"))
    repeated = written(_repeated(packed), "suffix-stretches")
    place = F.struct("key", "also", "at", "span")
    hot = repeated.where("m > 0 AND hot").groupBy("h", "f").agg(F.sum("m").alias("m"), F.min(place).alias("place")).select("h", "f", "m", "place.*")
    contents = repeated.where("m > 0 AND NOT hot").select(hot.columns).unionByName(hot)
    # anchors of one content (found here only for frequent ones), and those of too many
    odd = written(contents.groupBy("h").agg(F.count("*").alias("contents")).where((F.col("contents") == 1) | (F.col("contents") > SPLIT)), "suffix-odd")
    starts = []
    if not odd.where("contents = 1").isEmpty():
        alone = odd.where("contents = 1").select("h")
        starts.append(contents.join(alone, "h", "left_semi").select("h", "f", F.substring(F.lit(_EVERY), F.lit(1), F.col("span") + 1).alias("starts")))
        contents = contents.join(alone, "h", "left_anti")
    # a table of its own, so that the join with it can be split where many texts are equal
    wanted = written(contents.groupBy("key", "also").agg(F.collect_list(F.struct("h", "f", "m", "at", "span")).alias("wanted")), "suffix-wanted")
    data = _cut_out(keyed.where("row.text IS NOT NULL").select("key", "also", "row.text").join(wanted, ["key", "also"]))
    many = odd.where(F.col("contents") > SPLIT).select("h")
    if many.isEmpty():
        starts.append(_indexed(data, parts))
    else:
        data = written(data, "suffix-data")
        starts += [_indexed(data.join(many, "h", "left_anti"), parts), _counted(data.join(many, "h", "left_semi"))]
    places = repeated.where("m = 0").select("h", "f", "key", "also", "at").join(functools.reduce(DataFrame.unionByName, starts), ["h", "f"])
    whole = repeated.where("m = -1").withColumn("starts", F.substring(F.lit(_EVERY), F.lit(1), F.col("span") + 1))
    found = places.select("key", "also", "at", "starts").unionByName(whole.select("key", "also", "at", "starts"))
    runs = written(found.groupBy("key", "also").agg(F.collect_set(F.struct("at", "starts")).alias("runs")), "suffix-runs")
    return keyed.join(runs, ["key", "also"], "left").select("row", "runs")


def removed(docs: DataFrame) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans` of every row of `docs` (doc_id, text).

    Removed is each UTF-8 byte under a `LENGTH`-byte string that also starts anywhere else, in the same text or another;
    strings are judged on the input. A null text is empty; shorter texts keep everything; very long ones are handled
    whole; bytes that are no valid UTF-8 are U+FFFD; ids may repeat or be null. Further columns are ignored. An empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                found = spans([(r["at"], r["starts"]) for r in runs or ()])
                rows.append({"doc_id": doc_id, "n_bytes": len(data), "n_removed": sum(e - s for s, e in found), "n_spans": len(found), "kept_sha256": hashlib.sha256(kept(data, found)).hexdigest(), "spans": [[s, e] for s, e in found]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<int>>"
    return with_spans(docs.select(F.col("doc_id").cast("long"), "text")).select("row.doc_id", "row.text", "runs").mapInArrow(cut, ddl)


def kept(data: bytes, found: list[tuple[int, int]]) -> bytes:
    """What is left of `data` without the spans."""
    edges = [0, *(x for s in found for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with all columns, the repeated strings taken out of `text` and `n_chars` (if there) counted anew.

    Where a span cuts a character, the rest of that character goes too. Every row stays, if need be with an empty text.
    Bytes of a text that are no valid UTF-8 become U+FFFD.
    """

    @F.pandas_udf("string")
    def rest(texts: pd.Series, runs: pd.Series) -> pd.Series:
        out = [kept(t.encode("utf-8", "surrogatepass"), spans([(r["at"], r["starts"]) for r in rs])).decode("utf-8", "ignore") if rs is not None and t is not None else t for t, rs in zip(texts, runs, strict=True)]
        return pd.Series(out, dtype=object)

    found = with_spans(docs)
    whole = F.col("runs").isNull()
    new = {"text": F.when(whole, F.col("row.text")).otherwise(rest("row.text", "runs"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.char_length(new["text"])).cast(docs.schema["n_chars"].dataType)
    return found.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))

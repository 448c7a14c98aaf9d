"""Near-duplicate documents by dart MinHash over five-word shingles.

A text is a weighted set: its shingles with their counts, cut into cells of weight one. Hashed darts arrive
at every cell along the rank axis; each dart belongs to one of `COORDINATES` coordinates, and the earliest
dart of a coordinate is its sample. Only the darts under a rank limit that shrinks with the text's weight are
ever made, so a sketch costs its cells once plus about t ln t darts, and two texts agree in a coordinate with
their weighted Jaccard similarity as probability.

Texts with equal words are one text from the start. Candidates share a band of `ROWS` samples. In a bucket
each text is compared with the bucket's leader, the text that shares most bands with others (among near copies:
the one that they were copied from), so thousands of near copies are thousands of comparisons.

A leader may leave texts unlinked that are linked to each other. To compare them all would be all pairs of a group,
so a large group is split about more central texts, and the differences from these are joined by prefixes: two texts
that are linked although the leader links not both must share so many differences that they share one among the first
of each (rare ones first), while copies that were changed independently share few. No pair at the threshold that shares a bucket is missed by this.

Every comparison is of whole sets of 64-bit cells, and classes are the connected components of the links at
`SIMILARITY` or more.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridhead.llm.common import blocks, mix, quoted, release_memory, shingles, valid, words, written
from gridhead.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: Texts under one leader from which on their differences are looked at in the order of how rare they are, and texts that this order is taken from.
FEW, ORDER_SAMPLE = 48, 200
#: Bytes of that sample, rounds in which groups are split, and centres a round, with the bytes of all but the first and the sampled texts that one takes at least.
SAMPLE_BYTES, ROUNDS, CENTRES, CENTRE_BYTES, LEAST_NEAR = 16_000_000, 4, 8, 16_384, 3
#: Differences that meet in one group of a task, about, and pairs that are looked at at once.
ENTRIES, PAIRS_AT_ONCE, COLUMNS_AT_ONCE = 200_000, 1_000_000, 20_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def cells(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell) pairs ordered by text and cell, and two 64-bit hashes of each text's word sequence (zeros without words).

    A shingle that occurs c times gives c cells. A text of fewer words than `size` is one shingle of all of them.
    """
    doc, word = words(texts)
    count = np.bincount(doc, minlength=len(texts))
    parts = [shingles(doc, word, size)]
    for short in range(1, size):
        at, gram = shingles(doc, word, short)
        use = count[doc[at]] == short
        parts.append((at[use], gram[use]))
    at, gram = (np.concatenate(x) for x in zip(*parts, strict=True))
    owner = doc[at]
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    repeat = np.arange(len(gram)) - np.repeat(first, np.diff(np.append(first, len(gram))))
    cell = mix(gram + repeat.astype(np.uint64) * _STEP)
    order = np.lexsort((cell, owner))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    keys = np.zeros((2, len(texts)), np.uint64)
    for k in range(2):
        if len(doc):
            np.add.at(keys[k], doc, mix(word + (place + 1).astype(np.uint64) * _STEP + np.uint64(k + 1)))
    return owner[order], cell[order], mix(keys * (count > 0))


def _darts(owner: np.ndarray, cell: np.ndarray, limit: np.ndarray, coordinates: int):
    """(text, coordinate, arrival, dart) of all darts that arrive before the limit of their text."""
    out, arrival, k = [], np.zeros(len(cell)), 0
    while len(cell):
        h = mix(cell + np.uint64((2 * k + 1) * int(_STEP) % 2**64))
        arrival = arrival - np.log(((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)
        under = arrival < limit[owner]
        owner, cell, arrival, h = owner[under], cell[under], arrival[under], h[under]
        dart = mix(h + _STEP)
        out.append((owner, ((dart >> np.uint64(32)) % np.uint64(coordinates)).astype(np.int64), arrival, dart))
        k += 1
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0), np.zeros(0, np.uint64)]


def signatures(owner: np.ndarray, cell: np.ndarray, n: int, coordinates: int = COORDINATES) -> np.ndarray:
    """The earliest dart of every coordinate, for n texts; texts without cells stay at zero."""
    found = np.zeros((n, coordinates), np.uint64)
    weight = np.bincount(owner, minlength=n)
    limit = coordinates * (np.log(coordinates) + 2) / np.maximum(weight, 1)
    while len(owner):
        text, coordinate, arrival, dart = _darts(owner, cell, limit, coordinates)
        slot = text * coordinates + coordinate
        order = np.lexsort((arrival, slot))
        slot, dart = slot[order], dart[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        found.ravel()[slot[first]] = dart[first]
        filled = np.bincount(slot[first] // coordinates, minlength=n)
        again = (filled < coordinates)[owner]  # a coordinate without a dart: look further along the rank axis
        owner, cell, limit = owner[again], cell[again], limit * 2
    return found


def bands(found: np.ndarray) -> np.ndarray:
    """A hash of each band of each signature."""
    total = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(found), 1))
    for r in range(ROWS):
        total = mix(total * _STEP + found[:, r::ROWS])
    return total


def _per_text(batches: Iterator[pa.RecordBatch], made) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or "" for t in b.column(1).to_pylist()]
        for cut in blocks([len(t) for t in texts]):
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(cut.start, cut.stop - cut.start)} | made(texts[cut]))


def sketches(docs: DataFrame) -> DataFrame:
    """`doc_id, k1, k2, n, bands` of every row with an id: hashes of its words, its cells' number, its band hashes (of no use without words)."""

    def sketched(texts: list[str]) -> dict:
        owner, cell, keys = cells(texts)
        n = np.bincount(owner, minlength=len(texts))
        band = bands(signatures(owner, cell, len(texts))).astype("<i8")
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(texts) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(band.ravel()))
        return {"k1": keys[0].astype(np.int64), "k2": keys[1].astype(np.int64), "n": n.astype(np.int32), "bands": lists}

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), valid("text").alias("text"))
    return rows.mapInArrow(lambda batches: _per_text(batches, sketched), "doc_id long, k1 long, k2 long, n int, bands array<long>")


def _cell_sets(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """`node, cells` (sorted 64-bit hashes, packed) of the texts in `asked` (node, rep, k1, k2), read again from the rows of `rep`."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            k1, k2 = (b.column(k).to_numpy() for k in (2, 3))
            for cut in blocks([len(t) for t in texts]):
                owner, cell, keys = cells(texts[cut])
                each = np.split(cell, np.searchsorted(owner, np.arange(1, cut.stop - cut.start)))
                same = (keys[0].astype(np.int64) == k1[cut]) & (keys[1].astype(np.int64) == k2[cut])  # another text may have the same id
                found = pa.RecordBatch.from_pydict({"node": b.column(0).slice(cut.start, cut.stop - cut.start), "cells": pa.array([e.tobytes() for e in each], pa.binary())})
                yield found.filter(pa.array(same))

    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), valid("text").alias("text")).join(asked, "rep").select("node", "text", "k1", "k2")
    return written(rows.mapInArrow(listed, "node long, cells binary").dropDuplicates(["node"]), "dup-cells")


def linked(n: Column | np.ndarray, m: Column | np.ndarray, apart: Column | np.ndarray):  # noqa: ANN201
    """Whether sets of n and m cells, of which `apart` are in one of the two only, reach `SIMILARITY`; equality counts, in whole numbers."""
    return 9 * apart <= n + m


def _compared(pairs: DataFrame, sets: DataFrame, differences: bool) -> DataFrame:
    """`u, v, linked` of the pairs: whether their texts' exact weighted Jaccard similarity reaches `SIMILARITY`; their numbers of cells `n` and `m`, and if asked for the cells `apart` (packed) that only one of them has."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, apart, far = [], [], [], []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                only = np.setxor1d(x, y, assume_unique=True)
                n.append(len(x))
                m.append(len(y))
                far.append(len(only))
                apart.append(only.tobytes() if differences else None)
            near = linked(np.array(n, np.int64), np.array(m, np.int64), np.array(far, np.int64))
            yield pa.RecordBatch.from_pydict({"u": b.column(0), "v": b.column(1), "linked": near, "n": pa.array(n, pa.int32()), "m": pa.array(m, pa.int32()), "apart": pa.array(apart, pa.binary())})
            release_memory()

    left, right = (sets.select(F.col("node").alias(k), F.col("cells").alias(f"{k}_cells")) for k in "uv")
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "u_cells", "v_cells")
    return written(both.mapInArrow(compared, "u long, v long, linked boolean, n int, m int, apart binary"), "dup-compared")


def _led(texts: DataFrame) -> DataFrame:
    """The distinct pairs (u, v) of a text and the leaders of the buckets that it is in.

    A bucket has a leader for each two neighbouring doublings of the size, so that any two texts whose sizes allow a
    link have a leader in common that is at most four times as large or small.
    """
    banded = texts.select(F.explode("bands").alias("bucket"), "node", "n")
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(banded.join(sizes, "bucket"), "dup-shared")
    ranked = shared.join(shared.groupBy("node").agg(F.sum("size").alias("rank")), "node")
    doubling = F.floor(F.log2("n")).cast("int")
    sized = written(ranked.select("bucket", "node", "rank", F.explode(F.array(doubling, doubling + 1)).alias("scale")), "dup-ranked")
    # a table of its own, so that the join with it can be split where a bucket is large
    leaders = written(sized.groupBy("bucket", "scale").agg(F.max_by("node", F.struct(F.col("rank"), -F.col("node"))).alias("v")), "dup-leaders")
    return sized.select("bucket", "scale", F.col("node").alias("u")).join(leaders, ["bucket", "scale"]).where("u <> v").select("u", "v").distinct()


def _sampled(rows: DataFrame) -> DataFrame:
    """Of each group (v, round) of more than `FEW` texts at most `ORDER_SAMPLE` of them, of `SAMPLE_BYTES` of differences and one more.

    Only the order in which differences are looked at and the choice of centres depend on this sample, never a result.
    """
    order = Window.partitionBy("v", "round").orderBy(F.xxhash64("u", "round"), "u")
    some = rows.where(F.col("size") > FEW).select("v", "round", "u", "n", "u_in", "apart").withColumn("place", F.row_number().over(order)).where(F.col("place") <= ORDER_SAMPLE)
    before = F.sum(F.length("apart").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("apart")
    return some.withColumn("before", before).where(F.col("before") <= SAMPLE_BYTES)


def _common(rows: DataFrame) -> DataFrame:
    """`v, round, common, times`: the cells that several sampled texts of a group differ in from their leader, with how many (packed)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            common, often = [], []
            for lists in b.column(2).to_pylist():
                cell, times = np.unique(np.frombuffer(b"".join(lists), np.uint64), return_counts=True)
                common.append(cell[times > 2].tobytes())
                often.append(times[times > 2].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_pydict({"v": b.column(0), "round": b.column(1), "common": pa.array(common, pa.binary()), "times": pa.array(often, pa.binary())})

    lists = _sampled(rows).groupBy("v", "round").agg(F.collect_list("apart").alias("lists"))
    return written(lists.mapInArrow(count, "v long, round int, common binary, times binary"), "dup-common")


def distances(lists: list[np.ndarray]) -> np.ndarray:
    """How many cells are in one only of each two of the sorted lists."""
    size = np.array([len(x) for x in lists])
    cell, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), size)
    found, column = np.unique(cell, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(lists), len(lists)))
    for first in range(0, len(found), COLUMNS_AT_ONCE):
        low, high = np.searchsorted(column, [first, first + COLUMNS_AT_ONCE])
        has = np.zeros((len(lists), COLUMNS_AT_ONCE), np.float32)
        has[owner[low:high], column[low:high] - first] = 1
        both += has @ has.T
    return size[:, None] + size[None, :] - 2 * both.astype(np.int64)


def centres(lists: list[np.ndarray]) -> tuple[list[int], bool]:
    """Places of the texts about which a group is split, by their differences from its leader, and whether all of it goes to the first.

    Each takes the texts that are nearer to it than to the leader; the next one is looked for among the others.
    """
    size, far = np.array([len(x) for x in lists]), distances(lists)
    left, out, held = np.ones(len(lists), bool), [], 0
    while len(out) < CENTRES:
        gain = np.where(left[:, None] & left[None, :], np.maximum(size[None, :] - far, 0), 0)
        best = int(gain.sum(1).argmax())
        held += size[best] * 8
        near = left & (far[best] < size)
        if near.sum() < LEAST_NEAR or (out and held > CENTRE_BYTES):
            break
        out.append(best)
        left &= ~near
        if len(out) == 1 and 10 * left.sum() < len(lists):
            return out, True
    return out, False


def _centres(rows: DataFrame) -> DataFrame:
    """`v, c, c_n, c_in, c_apart, moved`: the centres of the groups of many texts that have any, each with its size, component and differences from v."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("v", "c", "c_n", "c_in", "c_apart", "moved")}
            for v, group in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                group.sort(key=lambda t: t["u"])
                at, moved = centres([np.frombuffer(t["apart"], np.uint64) for t in group])
                if at:
                    out["v"].append(v)
                    out["moved"].append(moved)
                    for name, of in (("c", "u"), ("c_n", "n"), ("c_in", "u_in"), ("c_apart", "apart")):
                        out[name].append([group[k][of] for k in at])
            types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.bool_())
            yield pa.RecordBatch.from_pydict({k: pa.array(x, t) for (k, x), t in zip(out.items(), types, strict=True)})
            release_memory()

    lists = _sampled(rows).groupBy("v").agg(F.collect_list(F.struct("u", "n", "u_in", "apart")).alias("texts"))
    return written(lists.mapInArrow(chosen, "v long, c array<long>, c_n array<int>, c_in array<long>, c_apart array<binary>, moved boolean"), "dup-centres")


def _assigned(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """The rows with the centre `to` that each goes to (the leader itself for the rest of a split group, null in a group that is not split).

    With it come its size, component and the text's differences from it: those from the leader that not both have.
    """

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to, to_m, to_in, to_apart, near = [], [], [], [], []
            columns = (b.column(k).to_pylist() for k in ("u", "v", "n", "m", "v_in", "c", "c_n", "c_in", "c_apart", "moved"))
            for own, (u, v, n, m, v_in, c, c_n, c_in, c_apart, moved) in zip(b.column("apart"), zip(*columns, strict=True), strict=True):
                go, hit = (v, m, v_in, None) if c else (None, None, None, None), False
                apart = np.frombuffer(own.as_buffer(), np.uint64) if c else None
                for k, other in enumerate(c_apart or []):
                    only = np.setxor1d(apart, np.frombuffer(other, np.uint64), assume_unique=True)
                    if moved or len(only) < len(apart):
                        go, hit = (c[k], c_n[k], c_in[k], only.tobytes()), u != c[k] and bool(linked(n, c_n[k], len(only)))
                        break
                for x, y in zip((to, to_m, to_in, to_apart), go, strict=True):
                    x.append(y)
                near.append(hit)
            added = {"to": pa.array(to, pa.int64()), "to_m": pa.array(to_m, pa.int32()), "to_in": pa.array(to_in, pa.int64()), "to_apart": pa.array(to_apart, pa.binary()), "near": pa.array(near, pa.bool_())}
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in (*names, "moved")} | added)
            release_memory()

    names = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return written(rows.join(picked, "v", "left").select(*names, "c", "c_n", "c_in", "c_apart", "moved").mapInArrow(assign, f"{schema}, moved boolean, to long, to_m int, to_in long, to_apart binary, near boolean"), "dup-assigned")


_ENTRY = np.dtype([("cell", "<u8"), ("node", "<i8"), ("inside", "<i8"), ("own", "<i8"), ("n", "<i4"), ("d", "<i4"), ("place", "<i4"), ("asks", "?"), ("asked", "?")])


def _needed(d: int, n: int, m: int, asks: bool) -> tuple[int, int]:
    """How many of its d differences from the leader a text of n cells must share with any text that it may be linked to: if it asks, and if it is asked.

    Sets of b and c cells are linked if at most (b + c) / 9 cells are apart. With d and e cells apart from a leader of m
    cells, this takes (9 d + 9 e - b - c) / 18 common ones. As the leader does not link the first (9 d > b + m) and
    c <= m + e, and at most e are common, a least number follows for each text alone.
    """
    over = 9 * d - n - m
    asking = max(1, -(-(over + 8 * -(-over // 10)) // 18)) if asks else d + 1
    return asking, max(1, -(-(9 * d + m + 1 - n) // 18))


def _entries(u: int, inside: int, leader_inside: int, own: int, n: int, m: int, apart: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The differences of a text by which it asks and is asked: those that come first, rare ones before common ones, so that two linked texts have one of these in common."""
    asks = inside != leader_inside
    asking, asked = (len(apart) - k + 1 for k in _needed(len(apart), n, m, asks))
    if max(asking, asked) <= 0:
        return np.zeros(0, _ENTRY)
    if len(common):
        at = np.minimum(np.searchsorted(common, apart), len(common) - 1)
        apart = apart[np.lexsort((apart, np.where(common[at] == apart, times[at], 0)))]
    out = np.zeros(max(asking, asked), _ENTRY)
    out["cell"], out["place"] = apart[: len(out)], np.arange(len(out))
    out["node"], out["inside"], out["own"], out["n"], out["d"] = u, inside, own, n, len(apart)
    out["asks"], out["asked"] = out["place"] < asking, out["place"] < asked
    return out


def met(entries: np.ndarray) -> np.ndarray:
    """The pairs (less, greater) of texts in different components that share an entry's cell, one of them asking, unless size or places rule a link out.

    Texts of one `own` part are passed over: they are of one component, or meet about a centre of their own.
    """
    entries = entries[np.lexsort((entries["own"], entries["cell"]))]
    new_cell = np.concatenate(([False], entries["cell"][1:] != entries["cell"][:-1]))
    new_own = new_cell | np.concatenate(([False], entries["own"][1:] != entries["own"][:-1]))
    cell, own = np.cumsum(new_cell), np.cumsum(new_own)
    asks, asked = np.flatnonzero(entries["asks"]), np.flatnonzero(entries["asked"])
    n, d, place = (entries[k].astype(np.int64) for k in ("n", "d", "place"))
    # four times the differences that a text may have at most to be linked to this one, if they meet here first (and so share nothing before)
    reach = 4 * (d - 2 * place) + n
    asked = asked[reach[asked] >= 4 * d[asks].min(initial=2**40)]
    step = np.floor(np.log(d[asked]) / np.log(1.1))
    out = []
    for among in (asked[step == k] for k in np.unique(step)):
        asking = asks[reach[asks] >= 4 * d[among].min()]
        begin, end = np.searchsorted(cell[among], cell[asking]), np.searchsorted(cell[among], cell[asking], "right")
        # of the texts under a cell, those of the asking one's own part lie together and are passed over
        own_first, own_last = np.searchsorted(own[among], own[asking]), np.searchsorted(own[among], own[asking], "right")
        for low, high in ((begin, own_first), (own_last, end)):
            many = high - low
            cuts = np.searchsorted(np.cumsum(many), np.arange(PAIRS_AT_ONCE, int(many.sum()), PAIRS_AT_ONCE))
            for part in np.split(np.arange(len(asking)), np.unique(cuts)):
                k = many[part]
                x = asking[np.repeat(part, k)]
                y = among[np.repeat(low[part] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
                # linked texts share no more than this where they meet first, and pass there
                most = np.minimum(d[x] - place[x], d[y] - place[y])
                able = (18 * most >= 9 * (d[x] + d[y]) - n[x] - n[y]) & linked(n[x], n[y], np.abs(n[x] - n[y]))
                able &= entries["inside"][x] != entries["inside"][y]
                two = np.stack([entries["node"][x[able]], entries["node"][y[able]]], 1)
                out.append(np.unique(np.sort(two, 1), axis=0))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def _sharing(rows: DataFrame) -> DataFrame:
    """The pairs (u, v) of texts of one group that may be linked though its leader does not link them, from `u, v, round, n, m, apart, u_in, v_in, own, size`.

    A prefix-filtered join: each text lists the differences by which it can be found (`_entries`); the lists of a task's
    texts travel packed, by group and a share of the cells, and meet where the share is.
    """
    share = F.ceil(F.sum(F.length("apart")) / (8 * ENTRIES)).cast("int").alias("shares")
    shares = rows.groupBy("v", "round").agg(share)
    full = rows.join(shares, ["v", "round"])
    if rows.where(F.col("size") > FEW).isEmpty():
        full = full.withColumns({c: F.lit(None).cast("binary") for c in ("common", "times")})
    else:
        full = full.join(_common(rows), ["v", "round"], "left")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[tuple[int, int, int], list[bytes]] = {}
            for u, v, turn, inside, leader_inside, own, n, m, parts, apart, common, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                common, times = np.frombuffer(common or b"", np.uint64), np.frombuffer(times or b"", np.int32)
                found = _entries(u, inside, leader_inside, own, n, m, np.frombuffer(apart, np.uint64), common, times)
                part = (mix(found["cell"]) % np.uint64(parts)).astype(np.int64)
                for k in np.unique(part).tolist():
                    held.setdefault((v, turn, k), []).append(found[part == k].tobytes())
            yield pa.RecordBatch.from_pydict({"v": pa.array([v for v, _, _ in held], pa.int64()), "round": pa.array([r for _, r, _ in held], pa.int32()), "part": pa.array([k for _, _, k in held], pa.int32()), "entries": pa.array([b"".join(e) for e in held.values()], pa.binary())})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting = None, []

        def pairs() -> pa.RecordBatch:
            found = met(np.frombuffer(b"".join(waiting), _ENTRY))
            return pa.RecordBatch.from_pydict({"u": found[:, 0], "v": found[:, 1]})

        for b in batches:
            for *group, entries in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != last and waiting:
                    yield pairs()
                    waiting.clear()
                last = group
                waiting.append(entries)
        if waiting:
            yield pairs()
        release_memory()

    packed = full.select("u", "v", "round", "u_in", "v_in", "own", "n", "m", "shares", "apart", "common", "times").mapInArrow(listed, "v long, round int, part int, entries binary")
    return packed.repartition("v", "round", "part").sortWithinPartitions("v", "round", "part").mapInArrow(meet, "u long, v long").distinct()


def _left_apart(compared: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (u, v) that may be linked though their leader did not join them, from its texts (`compared`) and their components so far; and further links found on the way.

    What many texts have in common, but not with their leader, is a difference by which each would meet each. So groups
    of many are split about centres, a few rounds long: pairs about one centre are looked for by their differences from
    it, in the next round, and pairs of different centres by those from the leader. Whatever is not split is looked for whole.
    """
    of = [joined.select(F.col("node").alias(k), F.col("component").alias(f"{k}_in")) for k in "uv"]
    rows = compared.join(of[0], "u", "left").join(of[1], "v", "left").withColumns({"u_in": F.coalesce("u_in", "u"), "v_in": F.coalesce("v_in", "v")})
    names, found, links = ["u", "v", "n", "m", "apart", "u_in", "v_in"], [], [compared.limit(0).select("u", "v")]
    for k in range(ROUNDS + 1):
        groups = rows.groupBy("v").agg(F.count("*").alias("size"), F.min("u_in").alias("a"), F.max("u_in").alias("b")).where("a < b").select("v", "size")
        rows = written(rows.join(groups, "v").select(*names, "size", F.lit(k).alias("round")), "dup-apart")
        whole = rows.withColumn("own", 2 * F.col("u_in"))
        picked = None if k == ROUNDS or rows.where(F.col("size") > FEW).isEmpty() else _centres(rows)
        if picked is None or picked.isEmpty():
            found.append(whole)
            break
        split = _assigned(rows, picked)
        part = F.when(F.col("to").isNull(), 2 * F.col("u_in")).otherwise(2 * F.col("to") + 1)
        found.append(split.where("NOT coalesce(moved, false)").withColumn("own", part).select(whole.columns))
        links.append(split.where("near").select("u", F.col("to").alias("v")))
        # a text that its new leader links is in its component, whatever that was before
        inside = F.when(F.col("near"), F.col("to_in")).otherwise(F.col("u_in"))
        gone = split.where("to IS NOT NULL AND to <> u")
        rows = gone.select("u", F.col("to").alias("v"), "n", F.col("to_m").alias("m"), F.coalesce("to_apart", "apart").alias("apart"), inside.alias("u_in"), F.col("to_in").alias("v_in")).dropDuplicates(["u", "v"])
    return _sharing(written(functools.reduce(DataFrame.unionByName, found), "dup-searched")), functools.reduce(DataFrame.unionByName, links)


def classes(docs: DataFrame) -> DataFrame:
    """`doc_id, class_id` of every row of `docs` (doc_id, text): the least id of its class of near duplicates.

    Null and empty texts and texts without words are classes of their own; a null id has a null class.
    Rows that share an id are one document, which is in the class of any of its texts (the least, if they differ).
    A very long text is compared whole, like any other; bytes that are no valid UTF-8 count as U+FFFD. Further columns are ignored. An empty table gives an empty result.
    """
    every = written(sketches(docs), "dup-sketches")
    distinct = every.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    texts = written(distinct.withColumn("node", F.monotonically_increasing_id()), "dup-texts")
    led = written(_led(texts), "dup-led")
    asked = led.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = _cell_sets(texts.join(asked, "node", "left_semi").select("node", "rep", "k1", "k2"), docs)
    compared = _compared(led, sets, differences=True)
    joined = written(components(compared.where("linked").select("u", "v"), "dup-components"), "dup-joined")
    apart, more = _left_apart(compared, joined)
    more = more.unionByName(_compared(apart, sets, differences=False).where("linked").select("u", "v"))
    stars = joined.select(F.col("node").alias("u"), F.col("component").alias("v"))
    final = joined if more.isEmpty() else components(stars.unionByName(more), "dup-classes")

    grouped = texts.select("node", "k1", "k2", "rep").join(final, "node")
    least = grouped.groupBy("component").agg(F.min("rep").alias("class_id"))
    # a text without links is in a class with its own copies
    single = texts.join(final, "node", "left_anti").select("k1", "k2", F.col("rep").alias("class_id"))
    classed = written(grouped.join(least, "component").select("k1", "k2", "class_id").unionByName(single), "dup-classed")
    owned = every.where("n > 0").select("doc_id", "k1", "k2").join(classed, ["k1", "k2"]).select("doc_id", "class_id")
    wordless = every.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"))
    found = owned.unionByName(wordless).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, of which the class is their own id: one of each class. Rows with a null id stay.

    Of rows that share such an id, the one with the least text stays. An empty table stays empty.
    """
    found = written(classes(docs).where("doc_id IS NOT NULL"), "dup-found")
    dropped = found.where("class_id <> doc_id").select("doc_id").distinct()
    repeated = not found.groupBy("doc_id").count().where("count > 1").isEmpty()
    columns = quoted(*docs.columns)
    kept = docs.join(dropped, "doc_id", "left_anti").select(columns)
    if not repeated:
        return kept
    first = F.min_by(F.struct(*columns), F.struct(F.col("text"), F.xxhash64(*columns))).alias("row")
    return kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(first).select("row.*").unionByName(kept.where("doc_id IS NULL"))

"""A Merkle manifest of a table and the inclusion proofs of all its rows, by octopus multiproofs.

Every row is a leaf. The leaves of a source, in order, form a tree whose nodes have three children (the last run of a
level may have fewer, even one); the roots of the sources, in order, form the tree on top. All hashes are lower-case
hexadecimal SHA-256 of texts put together.

Trees are built some levels at a time from chunks of consecutive nodes, so no tree passes through one task. For the
proofs, rows are cut into blocks of consecutive leaves. A block's octopus is the least set of nodes that its leaves'
paths need and cannot derive; it is looked up once per block, the nodes that the block's leaves share are derived once,
and each leaf's own proof is read off them where the block is.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridhead.llm.common import partitions, with_key, written

#: Children of a node; levels that one shuffle builds, and the leaves of such a chunk.
ARITY, LEVELS = 3, 6
CHUNK = ARITY**LEVELS
#: Leaves of a block whose proofs are worked out together.
BLOCK = 4096
_ROW_BITS = 33  # of Spark's increasing ids, the part below the partition's number


def leaf_hash(columns: Sequence[Column]) -> Column:
    """The hash of a row: per column `-` for null, else the length in UTF-8 bytes, a colon, and the value as text."""
    texts = [c.cast("string") for c in columns]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def tree_key(source: Column) -> Column:
    """Bytes that are never null and sort as the source does, null first."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string"))).cast("binary")


def placed(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """`rows` (with `tree`) as a table with each row's `place` in its tree from 0 and the tree's `size`; also `piece` and `row`.

    Rows are sorted by ranges, so a large tree is spread over tasks, and so are rows that are equal in all of `order`
    (`rows` must be a table, so that a task that is run again numbers them alike). Only counts per tree and range are
    brought together for the places.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    spread = rows.withColumn("_spread", F.monotonically_increasing_id())
    ordered = spread.repartitionByRange(partitions(rows), *keys, F.col("_spread")).sortWithinPartitions(*keys).drop("_spread")
    kept = written(ordered.withColumn("_at", F.monotonically_increasing_id()), label)
    kept = kept.withColumns({"piece": F.shiftright("_at", _ROW_BITS), "row": F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)}).drop("_at")
    share = kept.groupBy("tree", "piece").agg(F.min("row").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = share.select("tree", "piece", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    return kept.join(share, ["tree", "piece"]).withColumn("place", F.col("row") + F.col("_shift")).drop("_shift")


def _size(level: int) -> Column:
    """Nodes of a tree so many levels up."""
    return F.expr(f"(size + {ARITY**level - 1}) div {ARITY**level}")


def _up(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, ARITY), ""), 256))


def built(leaves: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """All nodes of the trees over `leaves` (tree, place, size, hash), and `tree, root`.

    The nodes come as one table for each `LEVELS` levels: `tree, chunk, size, levels` (the hashes of the chunk's nodes,
    level by level from its lowest one) and `top`. Each table is one shuffle, whose volume is that of its lowest level.
    """
    tables, nodes = [], leaves
    nothing = F.array().cast("array<string>")
    while True:
        chunk = F.expr(f"place div {CHUNK}").alias("chunk")
        frame = nodes.groupBy("tree", "size", chunk).agg(F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("_n"))
        frame = frame.withColumn("_l0", F.transform("_n", lambda n: n["hash"]))
        for k in range(1, LEVELS + 1):
            frame = frame.withColumn(f"_l{k}", F.when(_size(k - 1) > 1, _up(F.col(f"_l{k - 1}"))).otherwise(nothing))
        top = F.coalesce(*(F.get(f"_l{k}", F.lit(0)) for k in range(LEVELS, -1, -1)))
        kept = written(frame.select("tree", "chunk", "size", F.array(*(f"_l{k}" for k in range(LEVELS))).alias("levels"), top.alias("top")), f"{label}-{len(tables)}")
        tables.append(kept)
        more = kept.where(F.col("size") > CHUNK)
        if more.isEmpty():
            break
        nodes = more.select("tree", F.col("chunk").alias("place"), _size(LEVELS).alias("size"), F.col("top").alias("hash"))
    roots = [t.where(F.col("size") <= CHUNK).select("tree", F.col("top").alias("root")) for t in tables]
    return tables, functools.reduce(DataFrame.unionByName, roots)


def missing(places: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per level of a tree with `size` leaves, the places of the nodes that the leaves' paths need and that cannot be derived."""
    have, level = np.unique(places), 0
    while size > 1:
        parents = np.unique(have // ARITY)
        runs = (parents[:, None] * ARITY + np.arange(ARITY)).ravel()
        yield level, np.setdiff1d(runs[runs < size], have, assume_unique=True)
        have, size, level = parents, -(-size // ARITY), level + 1


_WANTED = "piece bigint, block bigint, forest int, tree binary, level int, place bigint"


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (piece, block, parts, n_trees) to the coordinates of the nodes that they lack."""
    kinds = {"piece": pa.int64(), "block": pa.int64(), "forest": pa.int32(), "tree": pa.binary(), "level": pa.int32(), "place": pa.int64()}
    for batch in batches:
        rows: list[tuple] = []
        for piece, block, parts, n_trees in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            asked = [(0, p["tree"], np.array(p["places"], np.int64), p["size"]) for p in parts]
            asked.append((1, b"", np.array([p["top"] for p in parts], np.int64), n_trees))
            for forest, tree, places, size in asked:
                rows += [(piece, block, forest, tree, level, p) for level, lack in missing(places, size) for p in lack.tolist()]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _fetched(wanted: DataFrame, forests: Sequence[list[DataFrame]]) -> DataFrame:
    """The wanted nodes' hashes."""
    width = F.expr(f"CAST(pow({ARITY}, {LEVELS} - level % {LEVELS}) AS BIGINT)")
    wanted = wanted.withColumn("_width", width).withColumns({"step": F.expr(f"level div {LEVELS}"), "chunk": F.expr("place div _width")})
    found = []
    for forest, tables in enumerate(forests):
        for step, nodes in enumerate(tables):
            asked = wanted.where((F.col("forest") == forest) & (F.col("step") == step)).join(nodes.select("tree", "chunk", "levels"), ["tree", "chunk"])
            one = F.get(F.get("levels", F.col("level") % LEVELS), (F.col("place") % F.col("_width")).cast("int"))
            found.append(asked.select("piece", "block", "forest", "tree", "level", "place", one.alias("hash"), F.lit(None).cast("bigint").alias("size")))
    return functools.reduce(DataFrame.unionByName, found)


def _hash(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class _Tree:
    """What a block knows of a tree: its own leaves' hashes and the fetched nodes, and all that follows from them."""

    def __init__(self, own: dict[int, str], size: int, fetched: dict[int, dict[int, str]]):
        self.levels: list[dict[int, str]] = []
        self.sizes: list[int] = []
        while size > 1:
            nodes = own | fetched.get(len(self.levels), {})
            self.levels.append(nodes)
            self.sizes.append(size)
            own = {p: _hash([nodes[i] for i in self.run(p * ARITY, -1)]) for p in {i // ARITY for i in own}}
            size = -(-size // ARITY)
        (self.root,) = own.values()
        self.proof = functools.cache(self._proof)

    def run(self, place: int, level: int) -> range:
        first = place // ARITY * ARITY
        return range(first, min(first + ARITY, self.sizes[level]))

    def _proof(self, place: int, level: int = 0) -> list[str]:
        """The siblings on the way from a node to the root, left to right on each level; shared by all leaves below."""
        if level == len(self.levels):
            return []
        return [self.levels[level][i] for i in self.run(place, level) if i != place] + self.proof(place // ARITY, level + 1)

    def fold(self, value: str, place: int) -> str:
        """The root that follows from another hash at a leaf's place and the leaf's siblings."""
        for level, nodes in enumerate(self.levels):
            value = _hash([value if i == place else nodes[i] for i in self.run(place, level)])
            place //= ARITY
        return value


def _expanded(leaves: pa.Table, known: pa.Table) -> pa.Table:
    """The proofs of a block's leaves, from them and what was fetched for the block."""
    fetched: dict[tuple[int, bytes], dict[int, dict[int, str]]] = {}
    tops, n_trees = {}, 1
    for forest, tree, level, place, node, size in zip(*(known.column(c).to_pylist() for c in ("forest", "tree", "level", "place", "hash", "size")), strict=True):
        if level < 0:
            tops[tree], n_trees = place, size
        else:
            fetched.setdefault((forest, tree), {}).setdefault(level, {})[place] = node
    rows = list(zip(*(leaves.column(c).to_pylist() for c in ("tree", "place", "size", "leaf", "claim")), strict=True))
    own: dict[tuple[bytes, int], dict[int, str]] = {}
    for tree, place, size, leaf, _ in rows:
        own.setdefault((tree, size), {})[place] = leaf
    trees = {tree: _Tree(nodes, size, fetched.get((0, tree), {})) for (tree, size), nodes in own.items()}
    top = _Tree({tops[tree]: t.root for tree, t in trees.items()}, n_trees, fetched.get((1, b""), {}))
    proofs, folded = [], []
    for tree, place, _, leaf, claim in rows:
        proofs.append(trees[tree].proof(place) + top.proof(tops[tree]))
        folded.append(top.root if claim == leaf else top.fold(trees[tree].fold(claim, place), tops[tree]))
    made = [pa.array([trees[r[0]].root for r in rows], pa.string()), pa.array(proofs, pa.list_(pa.string())), pa.array(folded, pa.string())]
    return pa.Table.from_arrays([leaves.column("doc_id"), leaves.column("leaf"), *made], names=["doc_id", "leaf", "subroot", "proof", "folded_root"])


def prove(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """Per document: `doc_id, leaf, subroot, root, proof, folded_root`.

    `leaf` is the hash of doc_id, source, lang, n_chars and text; `subroot` the root of the document's source, `root` that
    of the whole table, and `proof` the siblings on the way up, on each level left to right. `folded_root` is what the
    proof makes of a document that claims the text `claimed` (a column of `docs`; without it, its own): it equals `root`
    only if the text is the one in the table.

    Leaves of a source ascend by doc_id, null first, and of one id by hash; equal rows are leaves of their own. A null
    source is a source, sorted first. A null claim is a null text. An empty table has no proofs and no root. Texts need not
    be valid UTF-8, and further columns, whatever their names, are not read.

    What is shuffled is hashes and ids: texts are read once, and the hash of a very long one is all that leaves its task.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    rows = docs.select(
        tree_key(F.col("source")).alias("tree"),
        "doc_id",
        leaf_hash([*fields, text]).alias("leaf"),
        leaf_hash([*fields, text if claimed is None else claimed]).alias("claim"),
    )
    leaves = placed(written(rows, "merkle-rows"), ["doc_id", "leaf"], "merkle-leaves")
    nodes, subroots = built(leaves.select("tree", "place", "size", F.col("leaf").alias("hash")), "merkle-nodes")
    sources = written(subroots.select(F.lit("").cast("binary").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("hash")), "merkle-sources")
    ranks = placed(sources, ["of"], "merkle-subroots")
    top_nodes, top = built(ranks.select("tree", "place", "size", "hash"), "merkle-top")
    found = top.first()
    root = F.lit(found["root"] if found else None).cast("string")

    blocks = leaves.withColumn("block", F.expr(f"row div {BLOCK}"))
    of_tree = blocks.groupBy("piece", "block", "tree").agg(F.collect_list("place").alias("places"), F.max("size").alias("size"))
    ranked = ranks.select(F.col("of").alias("tree"), F.col("place").alias("top"), F.col("size").alias("n_trees"))
    of_tree = of_tree.join(ranked, "tree")
    parts = of_tree.groupBy("piece", "block").agg(F.collect_list(F.struct("tree", "places", "size", "top")).alias("parts"), F.max("n_trees").alias("n_trees"))
    wanted = written(parts.mapInArrow(_wanted, _WANTED), "merkle-wanted")
    known = _fetched(wanted, [nodes, top_nodes]).unionByName(
        of_tree.select("piece", "block", F.lit(0).alias("forest"), "tree", F.lit(-1).alias("level"), F.col("top").alias("place"), F.lit(None).cast("string").alias("hash"), F.col("n_trees").alias("size"))
    )
    out = with_key(docs, "doc_id", "leaf string, subroot string, proof array<string>, folded_root string")
    each = blocks.select("piece", "block", "tree", "place", "size", "doc_id", "leaf", "claim")
    proofs = each.groupBy("piece", "block").cogroup(known.groupBy("piece", "block")).applyInArrow(_expanded, out)
    return proofs.select("doc_id", "leaf", "subroot", root.alias("root"), "proof", "folded_root")

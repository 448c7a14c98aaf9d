"""Nearest neighbours by inner product, through low-dimensional stable projections and a kd-tree.

Vectors are lengthened by one component so that all have the same norm; the largest inner product is then the
least distance. Gaussian (2-stable) projections to `PROJECTIONS` dimensions keep distances as chi-square variables:
a point at distance r is projected to squared distance r^2 x, with x chi-square distributed. The projected points are
indexed by a kd-tree. Its upper levels, from a bounded sample, cut the rows into cells, and cells into blocks of
about `BLOCK` rows (equal vectors cannot be cut apart, so large cells are dealt out); inside a block the tree goes on.
A query takes leaf after leaf in the order of their projected distance and verifies the points on the original
vectors. It stops when the next leaf is farther than a point as near as its k-th neighbour would be projected, but
for a share of 1 - `CONFIDENCE`.

A first round on the query's own block gives each query a bound, so that the second one visits only the blocks that
the stopping test leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhead.llm.common import hash_bar, hash_rank, written

PROJECTIONS = 8
#: Share of neighbours that the stopping test keeps in expectation, at least.
CONFIDENCE = 0.97
#: Projected rows that the upper levels are made of, about; rows of a block, queries of a task, rows of a leaf.
SAMPLE, BLOCK, QUERIES, LEAF = 20_000, 8192, 4096, 256
#: Cells at most, so that each has some rows of the sample.
CELLS = 512
#: Rounding of scores and distances, as a share of the norms that go into them.
SLACK = 1e-9


def chi_square(p: float, m: int) -> float:
    """The p-quantile of the chi-square distribution with m degrees of freedom (Wilson and Hilferty's approximation)."""
    return m * (1 - 2 / (9 * m) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * m))) ** 3


def usable(vectors: DataFrame) -> DataFrame:
    """`vec_id, v` of the rows that take part: an id, a vector without null or non-finite components that is not zero, and the commonest length."""
    v = F.col("embedding")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & whole & F.exists(v, lambda x: x != 0)).select(F.col("vec_id").cast("long"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


class Projection:
    """The lengthening and projecting of rows and queries."""

    def __init__(self, d: int, norm: float, m: int, seed: int):
        self.d, self.norm = d, norm
        self.r = np.random.default_rng(seed).standard_normal((d + 1, m))

    def rows(self, x: np.ndarray) -> np.ndarray:
        return x @ self.r[:-1] + np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))[:, None] * self.r[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return (q * (self.norm / np.linalg.norm(q, axis=1))[:, None]) @ self.r[:-1]

    def reach(self, q: np.ndarray, score: np.ndarray, quantile: float) -> np.ndarray:
        """Squared projected distance at which the stopping test holds, for the k-th score so far."""
        return quantile * np.maximum(2 * self.norm**2 - 2 * self.norm / np.linalg.norm(q, axis=1) * score, SLACK * self.norm**2)


def _split(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Leaves of a kd-tree: row numbers, cut at the median of the widest dimension down to `size` rows."""
    out, waiting = [], [np.arange(len(points))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part = points[rows]
        order = rows[np.argsort(part[:, np.ptp(part, axis=0).argmax()], kind="stable")]
        waiting += [order[len(order) // 2 :], order[: len(order) // 2]]
    return out


class Cells:
    """The tree's upper levels: (dimension, value) of the inner nodes in heap order; everything below a node's value goes left."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.nodes = depth, []
        parts = [sample]
        for _ in range(depth):
            below = []
            for p in parts:
                k = int(np.ptp(p, axis=0).argmax()) if len(p) else 0
                value = float(np.median(p[:, k])) if len(p) else 0.0
                self.nodes.append((k, value))
                below += [p[p[:, k] < value], p[p[:, k] >= value]]
            parts = below

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        for level in range(self.depth):
            k, value = (np.array(x) for x in zip(*self.nodes[2**level - 1 : 2 ** (level + 1) - 1], strict=True))
            at = 2 * at + (points[np.arange(len(points)), k[at]] >= value[at])
        return at

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each cell's box."""
        low, high = np.full((1, points.shape[1]), -np.inf), np.full((1, points.shape[1]), np.inf)
        for level in range(self.depth):
            nodes = self.nodes[2**level - 1 : 2 ** (level + 1) - 1]
            low, high = np.repeat(low, 2, 0), np.repeat(high, 2, 0)
            for i, (k, value) in enumerate(nodes):
                high[2 * i, k], low[2 * i + 1, k] = min(high[2 * i, k], value), max(low[2 * i + 1, k], value)
        return np.stack([(np.maximum(np.maximum(a - points, points - b), 0) ** 2).sum(1) for a, b in zip(low, high, strict=True)], 1)


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, space: Projection, quantile: float, size: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the block's best rows for each query: at most k, at least as good as its bound. `size`: rows of a leaf."""
    projected, at = space.rows(x), space.queries(q)
    leaves = _split(projected, size)
    slack = SLACK * space.norm * np.linalg.norm(q, axis=1)  # the matrix product may differ by so much from the exact score
    low, high = (np.stack([f(projected[rows], axis=0) for rows in leaves]) for f in (np.min, np.max))
    far = np.stack([(np.maximum(np.maximum(a - at, at - b), 0) ** 2).sum(1) for a, b in zip(low, high, strict=True)], 1)
    turn = np.argsort(far, axis=1, kind="stable")
    best_id, best = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), -np.inf)
    floor = bound.astype(np.float64).copy()
    active = np.arange(len(q))
    for step in range(len(leaves)):
        leaf = turn[active, step]
        go = far[active, leaf] <= space.reach(q[active], floor[active], quantile)  # the stopping test
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        order = np.argsort(leaf, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
            rows, who = leaves[leaf[some[0]]], active[some]
            i, j = np.nonzero((q[who] @ x[rows].T >= (floor - slack)[who][:, None]) & (query_ids[who][:, None] != ids[rows]))
            if not len(i):
                continue
            who, rows = who[i], rows[j]
            score = np.einsum("ij,ij->i", q[who], x[rows])
            for w in np.unique(who):
                mine = who == w
                all_score, all_id = np.concatenate([best[w], score[mine]]), np.concatenate([best_id[w], ids[rows[mine]]])
                top = np.lexsort((all_id, -all_score))[:k]
                best[w], best_id[w] = all_score[top], all_id[top]
                floor[w] = max(floor[w], best[w, -1])
    number, slot = np.nonzero(best > -np.inf)
    return number, best_id[number, slot], best[number, slot]


def search(vectors: DataFrame, k: int = 20, every: int = 20, confidence: float = CONFIDENCE, block: int = BLOCK, queries: int = QUERIES, leaf: int = LEAF) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k best rows found for each row whose id is divisible by `every`, itself left out.

    Ordered by inner product (in double precision), ties by the smaller id; fewer than k rows if there are no more.
    Vectors that are null, zero, of an unusual length or hold null or non-finite components take no part; rows that share
    an id are separate candidates, and the first one by its vector asks. Further columns are ignored. `block`, `queries`
    and `leaf` are the rows of a block, the queries of a task and the rows of a leaf; recall does not depend on them.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors), "ann-rows")
    head = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()
    n, d = head[0], head[1]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    space, quantile = Projection(d, math.sqrt(head[2]), PROJECTIONS, 11), chi_square(confidence, PROJECTIONS)
    depth = max(0, math.ceil(math.log2(min(CELLS, n / block)))) if n > block else 0
    chosen = rows.withColumn("rank", hash_rank("vec_id", "v")).where(F.col("rank") < hash_bar(SAMPLE, n)).dropDuplicates(["rank"]).select("v").limit(2 * SAMPLE)
    sample = np.array([r.v for r in chosen.collect()], np.float64).reshape(-1, d)
    cells = Cells(space.rows(sample), depth)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"vec_id": b.column(0), "v": b.column(1), "cell": pa.array(cells.of(space.rows(_matrix(b.column(1), d))).astype(np.int32))})

    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    points = written(rows.mapInArrow(placed, f"vec_id long, v array<{element}>, cell int"), "ann-points")
    deals = {r["cell"]: math.ceil(r["count"] / block) for r in points.groupBy("cell").count().collect()}  # a row per cell
    per_cell = spark.createDataFrame(sorted(deals.items()), "cell int, deals int")
    blocked = points.join(F.broadcast(per_cell), "cell").withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.col("deals")).cast("int"))
    asking = points.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"), F.min_by("cell", "v").alias("cell"))
    asking = written(asking, "ann-queries")

    def searched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q = (np.stack(list(f.v)).astype(np.float64) for f in (left, right))
        number, ids, score = search_block(left.vec_id.to_numpy(), x, right.vec_id.to_numpy(), q, right.bound.to_numpy(), k, space, quantile, leaf)
        return pd.DataFrame({"query_id": right.vec_id.to_numpy()[number], "vec_id": ids, "score": score})

    def meet(asked: DataFrame) -> DataFrame:
        # a block's rows are copied only where its queries are too many for one task; blocks without any are not moved
        parts = asked.groupBy("cell", "deal").agg(F.ceil(F.count("*") / queries).cast("int").alias("chunks"))
        copies = blocked.join(parts, ["cell", "deal"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("cell", "deal", "chunk", "vec_id", "v")
        dealt = asked.join(parts, ["cell", "deal"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("chunks")).cast("int"))
        by = ("cell", "deal", "chunk")
        return copies.groupBy(*by).cogroup(dealt.select(*by, "vec_id", "v", "bound").groupBy(*by)).applyInPandas(searched, "query_id long, vec_id long, score double")

    # first round: the first block of the query's own cell gives a bound
    first = meet(asking.withColumn("deal", F.lit(0)).withColumn("bound", F.lit(float("-inf"))))
    bounds = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("bound")).where(F.col("n") >= k)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, bound = _matrix(b.column(1), d), b.column(2).to_numpy(zero_copy_only=False)
            i, cell = np.nonzero(cells.distances(space.queries(q)) <= space.reach(q, bound, quantile)[:, None])
            pick = b.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([*pick.columns, pa.array(cell.astype(np.int32))], names=["vec_id", "v", "bound", "cell"])

    bounded = asking.join(bounds, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    visits = bounded.mapInArrow(routed, f"vec_id long, v array<{element}>, bound double, cell int")
    visits = visits.join(F.broadcast(per_cell), "cell").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    found = meet(written(visits, "ann-visits"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

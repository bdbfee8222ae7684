"""Nearest neighbours by low-dimensional stable projections in kd-trees with a chi-square stop.

Vectors are projected on a few Gaussian directions. For two vectors at distance d, the squared projected distance
over d squared follows a chi-square distribution, so once every vector left is farther in the projection than
sqrt(quantile) times the k-th best distance, each is nearer in truth with at most the chance left of the quantile.

A kd-tree over the projections of a bounded sample deals all rows to cells; large cells are salted. A query is
answered in its own cell first; the distance found there says which other cells it must visit. In a cell, a
kd-tree over its rows' projections gives neighbours in order, which are verified until the stop holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from .shared import cut


@dataclass(frozen=True)
class Projection:
    """directions: dimensions of the projection (even); sure: chance at the stop; the rest bounds what a task holds."""

    directions: int = 12
    sure: float = 0.9
    seed: int = 7
    sample: int = 20_000  # vectors that the top tree is fitted on; every row is indexed
    cell_rows: int = 16_384
    most_cells: int = 4096
    block: int = 16_384  # queries searched together in a cell
    leaf: int = 48

    def matrix(self, size: int) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((size, self.directions))

    def quantile(self) -> float:
        """Of the chi-square distribution with ``directions`` degrees of freedom, at ``sure``."""
        low, high = 0.0, 1000.0
        for _ in range(100):
            x = (low + high) / 2
            below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(self.directions // 2))
            low, high = (x, high) if below < self.sure else (low, x)
        return high


@dataclass
class Tree:
    """Splits (dimension or -1, threshold, children, leaf number) and the box of each leaf."""

    dim: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    leaf: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def place(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point."""
        at = np.zeros(len(points), np.int64)
        while True:
            inner = np.flatnonzero(self.dim[at] >= 0)
            if not len(inner):
                return self.leaf[at]
            node = at[inner]
            at[inner] = self.child[node, (points[inner, self.dim[node]] > self.cut[node]).astype(int)]

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point to each leaf's box."""
        off = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (off * off).sum(1)


def grow(points: np.ndarray, leaf: int) -> tuple[Tree, list[np.ndarray]]:
    """A tree that halves the widest dimension down to ``leaf`` points, and the points of each leaf; equal points stay together."""
    dim, cuts, child, leaves, low, high, held = [], [], [], [], [], [], []

    def node(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
        me = len(dim)
        dim.append(-1)
        cuts.append(0.0)
        child.append((me, me))
        leaves.append(-1)
        if len(rows) > leaf:
            spread = np.ptp(points[rows], axis=0)
            d = int(spread.argmax())
            middle = float(np.median(points[rows, d]))
            right = points[rows, d] > middle
            if not right.any():  # over half are equal to the largest
                middle = float(points[rows, d][points[rows, d] < middle].max(initial=-np.inf))
                right = points[rows, d] > middle
            if spread[d] > 0 and right.any() and not right.all():
                dim[me], cuts[me] = d, middle
                lo2, hi2 = lo.copy(), hi.copy()
                lo2[d] = hi2[d] = middle
                child[me] = (node(rows[~right], lo, hi2), node(rows[right], lo2, hi))
                return me
        leaves[me] = len(held)
        held.append(rows)
        low.append(lo)
        high.append(hi)
        return me

    end = np.full(points.shape[1], np.inf)
    node(np.arange(len(points)), -end, end)
    return Tree(np.array(dim), np.array(cuts), np.array(child), np.array(leaves), np.array(low), np.array(high)), held


class Shard:
    """Rows of a cell: distinct vectors with their ids, and a tree over their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, how: Projection) -> None:
        order = np.lexsort((ids, *vectors.T))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(1)
        self.first = np.append(np.flatnonzero(new), len(ids))
        self.ids, vectors = ids, vectors[new]
        points = vectors @ how.matrix(vectors.shape[1])
        self.tree, held = grow(points, how.leaf)
        self.row = np.concatenate(held)  # rows in order of leaves, so that a leaf is a slice
        self.ends = np.cumsum([len(h) for h in held])
        self.starts = self.ends - [len(h) for h in held]
        self.vectors, self.points = vectors[self.row], points[self.row]
        self.stop = how.quantile()

    def search(self, query: int, vector: np.ndarray, point: np.ndarray, k: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest found, without the query's own id; ``reach``: a k-th distance known."""
        gaps = self.tree.gaps(point)
        order = np.argsort(gaps, kind="stable")
        best_ids, best = np.empty(0, np.int64), np.empty(0)
        rows, away, at, step = np.empty(0, np.int64), np.empty(0), 0, 4
        while at < len(order) or len(rows):
            more = order[at : at + step]
            if len(more):
                at, step = at + len(more), min(2 * step, 256)
                new = np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in more])
                rows = np.concatenate([rows, new])
                away = np.concatenate([away, ((self.points[new] - point) ** 2).sum(1)])
            frontier = gaps[order[at]] if at < len(order) else np.inf
            limit = self.stop * reach * reach
            ready = away <= min(frontier, limit)
            if ready.any():
                found = rows[ready]
                off = self.vectors[found]
                off -= vector
                far = np.sqrt(np.einsum("ij,ij->i", off, off))
                near = far <= reach
                if len(best) < k and near.sum() > 4 * k:  # of the first ones only the nearest can count
                    near &= far <= np.partition(far[near], 2 * k)[2 * k]
                each = [self.ids[self.first[i] : self.first[i + 1]] for i in self.row[found[near]]]
                each = [x[x != query][:k] for x in each]  # of equal vectors only the k smallest ids can be among the k nearest
                if each:
                    best_ids = np.concatenate([best_ids, *each])
                    best = np.concatenate([best, np.repeat(far[near], [len(x) for x in each])])
                    keep = np.lexsort((best_ids, best))[:k]
                    best_ids, best = best_ids[keep], best[keep]
                    if len(best) == k:
                        reach = min(reach, float(best[-1]))
            if frontier > self.stop * reach * reach:
                rows, away = rows[~ready], away[~ready]
                left = away <= self.stop * reach * reach
                if not left.any():
                    break
                rows, away = rows[left], away[left]
                at = len(order)
                continue
            rows, away = rows[~ready], away[~ready]
        return best_ids, best


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): vectors that are not null, not zero and have finite components only."""
    rows = vectors.select(vectors[key].alias("vec_id"), vectors[vector].cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding", how: Projection = Projection()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its ``k`` nearest found rows.

    Fewer candidates give fewer rows, none give none. Null, zero and non-finite vectors take no part, and so do those
    whose length is not the table's most common one (of equals, the least). Ties go to the smaller id; rows that repeat
    an id are candidates each, but not for a query of that id. Null ids are candidates for none.
    """
    spark = vectors.sparkSession
    fine = usable(vectors, key, vector).where("vec_id is not null")
    sizes = fine.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    size, total = sizes
    fine = fine.where(F.size("v") == size)
    sample = np.array([r["v"] for r in fine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(how.sample).collect()])
    matrix = how.matrix(size)
    cells = min(how.most_cells, -(-total // how.cell_rows))
    tree, _ = grow(sample @ matrix, -(-len(sample) // cells))
    stop = how.quantile()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(-1, size)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tree.place(x @ matrix)), pa.array([row.tobytes() for row in x], pa.binary())], ["vec_id", "cell", "v"])

    dealt = cut(fine.mapInArrow(deal, "vec_id bigint, cell bigint, v binary"))
    held = {r["cell"]: -(-r["n"] // how.cell_rows) for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    salts = F.element_at(F.create_map(*(F.lit(x) for c in held.items() for x in c)), F.col("cell")).cast("bigint")
    rows = dealt.withColumn("salt", F.pmod(F.xxhash64("vec_id"), salts))

    def visit(asked: DataFrame) -> DataFrame:
        """Answer (query_id, q, reach, cell) in all salts of the cell."""
        wide = asked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
        many = {r["cell"]: -(-r["n"] // how.block) for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        if not many:
            return spark.createDataFrame([], "query_id bigint, vec_id bigint, score double")
        blocks = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for c in many.items() for x in c)), F.col("cell")), F.lit(0)).cast("bigint")
        left = rows.where(blocks > 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        right = wide.withColumn("block", F.pmod(F.xxhash64("query_id"), blocks))

        def answer(near: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            if len(near) and len(queries):
                shard = Shard(near["vec_id"].to_numpy(), np.frombuffer(b"".join(near["v"]), float).reshape(-1, size), how)
                asked = np.frombuffer(b"".join(queries["q"]), float).reshape(-1, size)
                for query, v, p, reach in zip(queries["query_id"], asked, asked @ matrix, queries["reach"], strict=True):
                    ids, far = shard.search(query, v, p, k, reach)
                    out.append((np.full(len(ids), query), ids, far))
            names = ("query_id", "vec_id", "score")
            return pd.DataFrame({n: np.concatenate([o[k] for o in out]) if out else [] for k, n in enumerate(names)})

        by = ("cell", "salt", "block")
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(answer, "query_id bigint, vec_id bigint, score double")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, to = [], []
            for i, (q, reach, home) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                cells_ = np.flatnonzero(tree.gaps(np.frombuffer(q, float) @ matrix) <= stop * reach * reach)
                to.append(cells_[cells_ != home])
                at.append(np.full(len(to[-1]), i))
            if to:
                asked_ = batch.take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([*asked_.columns[:3], pa.array(np.concatenate(to), pa.int64())], ["query_id", "q", "reach", "cell"])

    # a repeated query id asks once, with its smallest vector
    asked = dealt.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "cell")).alias("_q")).select("query_id", F.col("_q.v").alias("q"), F.lit(float("inf")).alias("reach"), F.col("_q.cell").alias("cell"))
    asked = cut(asked)
    near = cut(visit(asked))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    kth = near.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query_id", F.col("score").alias("kth"))
    widened = asked.join(kth, "query_id", "left").select("query_id", "q", F.coalesce("kth", F.lit(float("inf"))).alias("reach"), "cell")
    far = visit(cut(widened.mapInArrow(spread, "query_id bigint, q binary, reach double, cell bigint").where(F.col("cell").isin(*held))))
    return near.union(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

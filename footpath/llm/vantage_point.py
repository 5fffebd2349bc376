"""Approximate nearest neighbours by inner product with vantage-point trees.

Inner products become distances: a candidate x gets one more component, sqrt(m**2 - |x|**2) for m the greatest
norm, a query q gets 0; then |q' - x'|**2 = |q|**2 + m**2 - 2 <q, x>, and the nearest candidate has the
largest product.  Each shard builds a tree: a vantage point parts the rows of its node at the median of their
distances to it; both halves keep their least and greatest distance.  By the triangle inequality
a half with distances lo..hi holds nothing nearer than max(lo - d, d - hi) to a query at distance d
from the vantage point; a leaf's bound is the greatest on its way.  A leaf is skipped if its bound times
``factor`` exceeds the k-th distance found: factor 1 is exact, larger ones skip more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import by_shard, fitted, merged, usable

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8_192, 4_096, 128

#: Pruning factor of the query; recall against brute force is in the README.
FACTOR = 2.0


class VantagePointTree:
    """Tree over the rows of ``x``; leaves hold row numbers."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.x, self.leaf_rows = x, leaf_rows
        self.visited = 0  # rows compared with queries
        self.points: list[int] = []  # row of each inner node's vantage point
        self.leaves: list[np.ndarray] = []
        self.ways: list[list[tuple[int, float, float]]] = []  # of each leaf: (node, lo, hi)
        self.grow(np.arange(len(x)), [])

    def grow(self, rows: np.ndarray, way: list) -> None:
        todo = [(rows, way)]
        while todo:
            rows, way = todo.pop()
            if len(rows) <= self.leaf_rows:
                self.leaves.append(rows)
                self.ways.append(way)
                continue
            point = rows[(len(rows) * 7919 + len(self.points)) % len(rows)]
            d = distances(self.x[rows], self.x[point][None, :])[:, 0]
            node = len(self.points)
            self.points.append(int(point))
            cut = np.argpartition(d, len(d) // 2)
            for side in (cut[: len(d) // 2], cut[len(d) // 2 :]):
                todo.append((rows[side], [*way, (node, float(d[side].min()), float(d[side].max()))]))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Least distance from each query to each leaf's rows by the triangle inequality."""
        out = np.zeros((len(q), len(self.leaves)))
        d = distances(q, self.x[self.points]) if self.points else out
        for i, way in enumerate(self.ways):
            for node, lo, hi in way:
                np.maximum(out[:, i], np.maximum(lo - d[:, node], d[:, node] - hi), out=out[:, i])
        return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, summed in the order of the components; no score depends on a row's place."""
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        out += q[:, j, None] * x[:, j]
    return out


def nearest(tree: VantagePointTree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, factor: float, greatest: float):
    """Scores and ids of each query's k nearest rows found; unused places have score -inf.

    ``x`` and ``q`` are the original vectors, ``tree`` is over the lengthened ones."""
    lengthened = np.hstack([q, np.zeros((len(q), 1))])
    bound = tree.bounds(lengthened)
    score = np.full((len(q), k), -np.inf)
    found = np.full((len(q), k), np.iinfo(np.int64).max)
    base = (q * q).sum(axis=1) + greatest**2

    def visit(which: np.ndarray, leaf: int) -> None:
        rows = tree.leaves[leaf]
        tree.visited += len(which) * len(rows)
        s = products(q[which], x[rows])
        s[ids[rows][None, :] == own[which][:, None]] = -np.inf
        all_s = np.hstack([score[which], s])
        all_i = np.hstack([found[which], np.broadcast_to(ids[rows], s.shape)])
        if all_s.shape[1] > 4 * k:  # keep what isn't below the k-th score, ties included
            worth = s >= score[which][:, -1][:, None]
            if not worth.any():
                return
        order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
        score[which] = np.take_along_axis(all_s, order, axis=1)
        found[which] = np.take_along_axis(all_i, order, axis=1)

    # each query visits its leaves by its own bounds, which rise: once one is too far, all others are
    way = np.argsort(bound, axis=1, kind="stable")
    live = np.arange(len(q))
    for turn in range(len(tree.leaves)):
        leaf = way[live, turn]
        last = score[live, -1]
        far = np.sqrt(np.maximum(base[live] - 2 * np.where(np.isfinite(last), last, 0), 0))
        near = ~np.isfinite(last) | (bound[live, leaf] * factor <= far * (1 + 1e-12))
        live, leaf = live[near], leaf[near]
        if not len(live):
            break
        by = np.argsort(leaf, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            visit(live[part], int(leaf[part[0]]))
    return score, found


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each query's k nearest rows found, by largest inner product in double precision.

    Both tables hold ``vec_id`` and ``v`` (array of double).  Returns ``query_id, rank, vec_id, score``, ties to
    the smaller ``vec_id``.  A candidate with the query's own id is left out.  Every row is in a
    shard's tree; ``factor`` 1 gives exact results.  Shorter vectors count as filled up with zeros, null
    ids take no part, a repeated id is a candidate for each of its rows; empty tables give an empty result.
    """
    norm = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    greatest = float(np.sqrt(norm or 0.0)) * (1 + 1e-12)

    def build(ids: np.ndarray, x: np.ndarray) -> tuple:
        by = np.argsort(ids, kind="stable")
        ids, x = ids[by], x[by]
        extra = np.sqrt(np.maximum(greatest**2 - (x * x).sum(axis=1), 0))
        return ids, x, VantagePointTree(np.hstack([x, extra[:, None]]))

    def ask(index: tuple, own: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, x, tree = index
        score, found = nearest(tree, x, ids, fitted(y, x.shape[1]), own, k, factor, greatest)
        ok = np.isfinite(score)
        return np.repeat(np.arange(len(own)), k).reshape(-1, k)[ok], found[ok], score[ok]

    rows = vectors.where("vec_id is not null").select("vec_id", "v")
    asks = queries.where("vec_id is not null").select("vec_id", "v", F.monotonically_increasing_id().alias("query_row"))
    return merged(by_shard(rows, asks, shard_rows, block_rows, build, ask, "double"), k, "vec_id")


def op5_vantage_point(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector; vectors that are null, zero or have null or non-finite components take no part."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding"), zero=False))
    rows = materialize(rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vectors")
    return search(rows, rows.where("vec_id % 20 = 0"), 20)

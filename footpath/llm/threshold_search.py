"""Exact top-k by inner product with Fagin's threshold algorithm.

A shard of candidates keeps one sorted list of values per dimension.  A query walks all lists in step
from the end that its component favours; candidates met are scored in full by random access.  What has not
been met at a depth scores at most the sum of query component times list value there.  The
walk stops when that bound is below the k-th best score; an equal bound goes on, as a tie may be won by a smaller
id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import by_shard, fitted, merged, usable

#: Candidates of a shard and queries of a block.
SHARD_ROWS, BLOCK_ROWS = 8_192, 4_096


class SortedLists:
    """A shard: vectors by id, and per dimension the rows in order of their value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[by], x[by]
        self.order = np.argsort(self.x, axis=0, kind="stable").T.copy()  # dimension x depth
        self.value = np.take_along_axis(self.x.T, self.order, axis=1)

    def top(self, q: np.ndarray, k: int, own: int | None, first: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best candidates, best first, without the row ``own``."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        if not len(dims):  # every candidate scores 0
            rows = np.arange(min(n, k + 1))
            rows = rows[rows != own][:k] if own is not None else rows[:k]
            return rows, np.zeros(len(rows), self.x.dtype)
        up = q[dims] > 0
        seen = np.zeros(n, bool)
        best, score = np.zeros(0, np.int64), np.zeros(0, self.x.dtype)
        depth, step = 0, first
        while depth < n:
            to = min(n, depth + step)
            high = self.order[dims[up], n - to : n - depth]
            low = self.order[dims[~up], depth:to]
            met = np.zeros(n, bool)
            met[high.ravel()] = True
            met[low.ravel()] = True
            if own is not None:
                met[own] = False
            rows = np.flatnonzero(met & ~seen)
            seen |= met
            best = np.concatenate((best, rows))
            score = np.concatenate((score, self.x[rows] @ q))
            if len(best) > k:
                keep = np.lexsort((best, -score))[:k]
                best, score = best[keep], score[keep]
            at = np.where(up, self.value[dims, n - to], self.value[dims, to - 1])
            if len(best) == k and (at * q[dims]).sum() < score[-1]:
                break
            depth, step = to, step * 2
        keep = np.lexsort((best, -score))
        return best[keep], score[keep]


def exact(x: np.ndarray, q: np.ndarray) -> bool:
    """Whether sums of products are exact in double precision (integer vectors of moderate size)."""
    return not len(x) or not len(q) or float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < 2**53


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each query's k highest inner products among ``vectors``, ties to the smaller ``vec_id``.

    Both tables hold ``vec_id`` and ``v`` (array of whole numbers as double).  Returns ``query_id, rank,
    vec_id, score`` (long).  A candidate with the query's own id is left out.  Fewer candidates give
    fewer rows; shorter vectors count as filled up with zeros.  Rows with a null id take no part.  A
    repeated id is a candidate for each of its rows.  Scores beyond 2**63 are outside the domain.  Empty tables give an
    empty result.
    """

    def build(ids: np.ndarray, x: np.ndarray) -> dict:
        return {"ids": ids, "x": x, float: SortedLists(ids, x)}

    def ask(index: dict, ids: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = fitted(y, index["x"].shape[1])
        kind = float if exact(index["x"], y) else int
        if kind not in index:
            index[kind] = SortedLists(index["ids"], index["x"].astype(np.int64))
        lists, which, found, scores = index[kind], [], [], []
        for i, (one, vector) in enumerate(zip(ids.tolist(), y.astype(lists.x.dtype))):
            a, b = np.searchsorted(lists.ids, [one, one + 1])
            if b - a > 1:  # a repeated id: all its rows are left out
                keep = np.r_[0:a, b : len(lists.ids)]
                part = SortedLists(lists.ids[keep], lists.x[keep])
                rows, score = part.top(vector, k, None)
                own = part.ids[rows]
            else:
                rows, score = lists.top(vector, k, int(a) if b > a else None)
                own = lists.ids[rows]
            which.append(np.full(len(rows), i))
            found.append(own)
            scores.append(score.astype(np.int64))
        return np.concatenate(which), np.concatenate(found), np.concatenate(scores)

    rows = vectors.where("vec_id is not null").select("vec_id", "v")
    asks = queries.where("vec_id is not null").select("vec_id", "v", F.monotonically_increasing_id().alias("query_row"))
    return merged(by_shard(rows, asks, shard_rows, block_rows, build, ask, "long"), k, "vec_id")


def op2_threshold_search(spark, sf_dir: str) -> DataFrame:
    """The five best of every 50th vector; vectors that are null or have null or non-finite components take no part."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding")))
    rows = materialize(rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("v")), "vectors")
    return search(rows, rows.where("vec_id % 50 = 0"), 5)


ORACLE = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""

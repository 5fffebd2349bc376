"""What both searches over vectors share: rows that take part, shards that blocks of queries come to, and the merge of shards."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Files


def usable(vector: Column, zero: bool = True) -> Column:
    """Whether a vector has components, all of them finite; ``zero`` says if it may be zero."""
    ok = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero:
        ok &= F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def blocks(rows: DataFrame, per_block: int) -> int:
    return max(1, -(-rows.count() // per_block))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors of an Arrow list column as rows, filled up with zeros; cut at ``width``, if given."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    own = int(size.max(initial=0))
    if len(flat) == own * len(size):
        out = flat.reshape(len(size), own)
    else:
        out = np.zeros((len(size), own))
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out if width is None else fitted(out, width)


def fitted(x: np.ndarray, width: int) -> np.ndarray:
    """Rows cut or filled up with zeros to ``width``; what is cut meets zeros in inner products."""
    return x[:, :width] if x.shape[1] >= width else np.hstack([x, np.zeros((len(x), width - x.shape[1]))])


def by_shard(candidates: DataFrame, queries: DataFrame, per_shard: int, per_block: int, build: Callable, ask: Callable, kind: str, mapped: bool | None = None) -> DataFrame:
    """``query_id, query_row, vec_id, score`` of ``kind`` that every shard of ``candidates(vec_id, v)`` gives for all ``queries(vec_id, v, query_row)``.

    Each candidate travels once, to its shard, whose index ``build(ids, x)`` makes once.  Queries are written in blocks
    to the shared folder, and every shard reads one block after another: ``ask(index, ids, y)`` gives numbers of the
    block's queries, ids found and scores.  A shard and a block have about ``per_shard`` and ``per_block`` rows whatever the tables' sizes.
    """
    shards, parts = blocks(candidates, per_shard), blocks(queries, per_block)
    files = Files(candidates.sparkSession, "queries", mapped)
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(n)).cast("int")

    def gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
        found = [b for b in batches if b.num_rows]
        return pa.Table.from_batches(found).combine_chunks() if found else None

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gathered(batches)
        if rows is not None:
            y = matrix(rows.column(1).chunk(0))
            name = f"block-{rows.column(3)[0].as_py()}"
            head = np.array([len(y), y.shape[1]], "<i8")
            blob = files.put(name, [head.tobytes(), *(rows.column(i).to_numpy().astype("<i8").tobytes() for i in (0, 2)), y.astype("<f8").tobytes()])
            yield pa.record_batch([pa.array([name]), pa.array([blob], pa.binary())], names=["name", "blob"])

    dealt = queries.select("vec_id", "v", "query_row", deal(parts, 2).alias("part"))
    files.publish(dealt.repartitionById(parts, "part").mapInArrow(put, "name string, blob binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gathered(batches)
        if rows is None:
            return
        index = build(rows.column(0).to_numpy(), matrix(rows.column(1).chunk(0)))
        del rows
        for part in range(parts):
            path = files.local(f"block-{part}")
            if not os.path.exists(path):
                continue
            data = np.memmap(path, np.uint8, "r")
            n, width = data[:16].view("<i8").tolist()
            ids, own = data[16 : 16 + 8 * n].view("<i8"), data[16 + 8 * n : 16 + 16 * n].view("<i8")
            which, found, score = ask(index, np.array(ids), np.array(data[16 + 16 * n :].view("<f8")).reshape(n, width))
            yield pa.record_batch([pa.array(ids[which]), pa.array(own[which]), pa.array(found), pa.array(score)], names=["query_id", "query_row", "vec_id", "score"])

    dealt = candidates.select("vec_id", "v", deal(shards, 1).alias("shard"))
    return dealt.repartitionById(shards, "shard").mapInArrow(run, f"query_id long, query_row long, vec_id long, score {kind}")


def merged(found: DataFrame, k: int, out_id: str) -> DataFrame:
    """The k best of each query's rows ``query_id, vec_id, score`` over all shards, ranked."""
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(out_id), "score")

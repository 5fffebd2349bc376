"""Shared helpers: written intermediate tables, batch slicing, connected components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (tests, local mode) a temporary folder of this process is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="footpath-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], True)
    return f"file://{_LOCAL['dir']}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; cuts the lineage, and
    unlike an executor's cache survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names that none of ``columns`` has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def local_path(path: str) -> str | None:
    """The path for ``open()`` if it is in a file system that every node mounts, else None."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def write_file(path: str, parts: list[bytes]) -> None:
    """Write parts one after another, each filled up to 8 bytes; a reader sees all or nothing."""
    own = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(own, "wb") as f:
        for p in parts:
            f.write(p + b"\0" * (-len(p) % 8))
    os.replace(own, path)


class Files:
    """Files that tasks write and others map, in a folder of the shared store.

    Where the store can be mapped, they are written there.  Where it can't, Spark writes them as rows of a table, and
    executors fetch that table from the store as they fetch other files of the job; the driver doesn't handle them."""

    def __init__(self, spark: SparkSession, name: str, mapped: bool | None = None):
        self.path = new_path(spark, name)
        self.place = local_path(self.path) if mapped is not False else None

    def put(self, name: str, parts: list[bytes]) -> bytes | None:
        """Write a file; returns its bytes where they are to go into the table."""
        if self.place:
            write_file(f"{self.place}/{name}", parts)
            return None
        return b"".join(x + b"\0" * (-len(x) % 8) for x in parts)

    def publish(self, rows: DataFrame) -> None:
        """Run the tasks that give ``rows(name string, blob binary)``."""
        if self.place:
            rows.write.format("noop").mode("overwrite").save()
        else:
            rows.write.parquet(self.path)
            rows.sparkSession.sparkContext.addFile(self.path, recursive=True)

    def local(self, name: str) -> str:
        """Path of a file in a task; there is none if no task wrote it."""
        if self.place:
            return f"{self.place}/{name}"
        folder = SparkFiles.get(os.path.basename(self.path))
        if not os.path.exists(f"{folder}/files/_done"):
            for part in sorted(os.listdir(folder)):
                if part.endswith(".parquet"):
                    for batch in pq.ParquetFile(f"{folder}/{part}").iter_batches(1, columns=["name", "blob"]):
                        for own, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                            write_file(f"{folder}/files/{own}", [blob])
            write_file(f"{folder}/files/_done", [])
        return f"{folder}/files/{name}"


def slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice's ``column`` holds about ``max_bytes``; a longer single row stays whole."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, int(n * max_bytes / max(batch.column(column).nbytes, max_bytes))) if n else 1
        for at in range(0, n, step):
            yield batch.slice(at, step)


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 40) -> DataFrame:
    """Components of the undirected graph ``edges(a, b)`` (long ids): ``node, component`` (smallest id).

    Alternates large-star and small-star steps.  Both need each node's least neighbour only, which is
    aggregated before the shuffle, so a node with very many neighbours is no hot group; the joins
    with it are plain equi-joins that adaptive execution can split.  Each round is written to the
    shared folder.  Rows with a null end and loops are ignored; an empty input gives no rows.
    """
    edges = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        name,
    )
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join below has an exchange of its own on either side, which can be split
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = materialize(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        # small star: every edge now points from the larger to the smaller end
        small_least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(small_least, "a").select(F.col("b").alias("x"), "a", "m")
        edges = materialize(
            small.select(F.col("x").alias("a"), F.col("m").alias("b"))
            .unionByName(small_least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct(),
            name,
        )
        state = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if (state.n, state.x) == before:
            break
        before = (state.n, state.x)
    else:
        raise RuntimeError("connected components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def default_path(path: str | None, name: str) -> str:
    return path if path and os.path.exists(path) else tokenizer_file(name)

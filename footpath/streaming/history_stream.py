"""The history as a stream: traversals arrive, the table of edges is kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import EVENT_SCHEMA, edge_history


def read_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def upsert(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep ``target`` as the table of edges for all that has arrived.

    Running counts are the state; an edge's history never ends, so there is no watermark.  Each
    batch's changed edges are written to a folder of their own (a repeated batch overwrites its own), and ``latest``
    reads the newest row of each edge, so a batch writes what it changed and no more."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    counts = edge_history(events)
    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = spark.read.option("basePath", target).parquet(target)
    best = F.max_by(F.struct("walk_count", "last_walked"), "batch").alias("x")
    return rows.groupBy("edge_start", "edge_end").agg(best).select("edge_start", "edge_end", "x.walk_count", "x.last_walked")

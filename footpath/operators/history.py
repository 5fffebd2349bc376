"""Walk history: an append-only log of traversals, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "edge_start long, edge_end long, walked_at timestamp_ntz, walk_id string"


def keyed(events: DataFrame) -> DataFrame:
    """Traversals with the ends of an edge in order."""
    rest = [c for c in events.columns if c not in ("edge_start", "edge_end")]
    return events.select(F.least("edge_start", "edge_end").alias("edge_start"), F.greatest("edge_start", "edge_end").alias("edge_end"), *rest)


def edge_history(events: DataFrame) -> DataFrame:
    """``edge_start, edge_end, walk_count, last_walked``: every traversal counts, also within one walk."""
    return keyed(events).groupBy("edge_start", "edge_end").agg(F.count("*").alias("walk_count"), F.max("walked_at").alias("last_walked"))


def walked_edges(events: DataFrame) -> DataFrame:
    return keyed(events).select("edge_start", "edge_end").distinct()


def statistics(history: DataFrame) -> DataFrame:
    """One row of totals; of an empty history zeros and nulls.  ``first_walk`` is the earliest of the edges' last walks."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return history.agg(
        F.count("*").alias("unique_edges"),
        zero(F.sum("walk_count")).alias("total_walks"),
        F.coalesce(F.round(F.avg("walk_count"), 2), F.lit(0.0)).alias("avg_walks"),
        zero(F.max("walk_count")).alias("max_walks"),
        F.min("last_walked").alias("first_walk"),
        F.max("last_walked").alias("last_walk"),
    )


def true_first_walk(events: DataFrame) -> DataFrame:
    return events.agg(F.min("walked_at").alias("true_first_walk"))


def look_up(history: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(edge_start, edge_end)``, ends in any order, with ``is_walked`` and ``walk_count`` (0 if never walked)."""
    rows = keyed(wanted).join(history.select("edge_start", "edge_end", "walk_count"), ["edge_start", "edge_end"], "left")
    return rows.select("edge_start", "edge_end", F.col("walk_count").isNotNull().alias("is_walked"), F.coalesce("walk_count", F.lit(0)).alias("walk_count"))


class WalkHistory:
    """A log on disk.  ``record`` appends; nothing is rewritten, so recording costs what is recorded."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(EVENT_SCHEMA).parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], EVENT_SCHEMA)

    def record(self, edges: DataFrame, walk_id: str | None = None, at=None) -> None:
        """Append the traversals ``edges(u, v)`` of one walk, now or at a given time."""
        when = F.localtimestamp() if at is None else F.lit(at)
        rows = edges.select(F.least("u", "v").alias("edge_start"), F.greatest("u", "v").alias("edge_end"), when.cast("timestamp_ntz").alias("walked_at"), F.lit(walk_id).cast("string").alias("walk_id"))
        rows.write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return edge_history(self.events())

    def walked(self) -> DataFrame:
        return walked_edges(self.events())

    def stats(self) -> DataFrame:
        return statistics(self.table())

    def compact(self, into: str) -> None:
        """Write the derived table, one row an edge, elsewhere."""
        self.table().write.mode("overwrite").parquet(into)

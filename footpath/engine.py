"""One object for the usual order of work: build or load a graph, snap, route, record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.directions import instructions
from .operators.history import WalkHistory
from .operators.novelty import novelty_routes
from .operators.paths import Graph, path_edges, shortest_paths
from .operators.snap import nearest


class Engine:
    def __init__(self, spark: SparkSession, graph: Graph, history: WalkHistory | None = None):
        self.spark, self.graph, self.history = spark, graph, history

    def snap(self, points: DataFrame) -> DataFrame:
        """``points(pid, lat, lon)`` -> ``pid, osm_id, metres``."""
        return nearest(points, self.graph.nodes).select("pid", "osm_id", "metres")

    def snap_pairs(self, pairs: DataFrame) -> DataFrame:
        """``pairs(qid, slat, slon, elat, elon)`` -> ``qid, source, target, source_m, target_m``."""
        a = self.snap(pairs.select(F.col("qid").alias("pid"), F.col("slat").alias("lat"), F.col("slon").alias("lon"))).select(F.col("pid").alias("qid"), F.col("osm_id").alias("source"), F.col("metres").alias("source_m"))
        b = self.snap(pairs.select(F.col("qid").alias("pid"), F.col("elat").alias("lat"), F.col("elon").alias("lon"))).select(F.col("pid").alias("qid"), F.col("osm_id").alias("target"), F.col("metres").alias("target_m"))
        return a.join(b, "qid")

    def route(self, pairs: DataFrame, min_novelty: float = 0.3, max_overhead: float = 0.25, profile: str = "novelty", record: bool = False) -> DataFrame:
        """Routes of ``pairs(qid, slat, slon, elat, elon)`` with directions.

        Without any history the shortest path is the answer, with novelty 1 and overhead 0."""
        from .functions.scratch import written

        ends = written(self.snap_pairs(pairs), "ends")
        walked = self.history.walked() if self.history else None
        if walked is None or walked.isEmpty():
            found = shortest_paths(self.graph, ends).select("qid", "found", "path", "distance", F.col("distance").alias("shortest_distance"), F.when(F.col("found"), 1.0).alias("novelty"), F.when(F.col("found"), 0.0).alias("overhead"))
        else:
            found = novelty_routes(self.graph, ends, walked, min_novelty, max_overhead, profile)
        found = written(found, "routes")
        if record and self.history:
            self.history.record(path_edges(found.where("found")).select("u", "v"))
        return found.join(instructions(self.graph, found.where("found")), "qid", "left").join(ends, "qid")

    def stats(self) -> DataFrame:
        if self.history is None:
            raise ValueError("this engine has no history")
        return self.history.stats()

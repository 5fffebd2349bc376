"""Routes as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.paths import path_coordinates

SCHEMA = (
    "distance_m double, shortest_distance_m double, overhead_pct double, novelty_pct double, num_edges bigint, "
    "coordinates array<struct<lat:double,lon:double,node_id:bigint>>, edges array<array<bigint>>"
)


def documents(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``qid`` and the fields of a route's document; edges in the direction of travel.

    ``coordinates`` that routes have (``paths.located``) are taken as they are."""
    rows = routes if "coordinates" in routes.columns else routes.join(path_coordinates(routes, nodes), "qid", "left")
    steps = F.zip_with(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))), lambda u, v: F.array(u, v))
    edges = F.coalesce(steps, F.array()).cast("array<array<bigint>>")
    return rows.select(
        "qid",
        F.round("distance", 1).alias("distance_m"),
        F.round("shortest_distance", 1).alias("shortest_distance_m"),
        F.round(F.col("overhead") * 100, 1).alias("overhead_pct"),
        F.round(F.col("novelty") * 100, 1).alias("novelty_pct"),
        F.size(edges).cast("bigint").alias("num_edges"),
        "coordinates",
        edges.alias("edges"),
    )


def as_text(docs: DataFrame) -> DataFrame:
    return docs.select("qid", F.to_json(F.struct(*(c for c in docs.columns if c != "qid"))).alias("json"))


def write(docs: DataFrame, path: str) -> None:
    docs.drop("qid").write.mode("overwrite").json(path)


def parse(texts: DataFrame) -> DataFrame:
    """``qid, json`` -> the document's fields."""
    return texts.select("qid", F.from_json("json", SCHEMA).alias("d")).select("qid", "d.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def travelled(docs: DataFrame) -> DataFrame:
    """``u, v`` of every edge of the documents, as often as travelled."""
    return docs.select(F.explode("edges").alias("e")).select(F.get("e", F.lit(0)).alias("u"), F.get("e", F.lit(1)).alias("v"))

"""Street maps in XML by Spark's own reader."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ways import tag_map

NODE = "_id long, _lat double, _lon double"
WAY = "_id long, nd array<struct<_ref:long,_VALUE:string>>, tag array<struct<_k:string,_v:string,_VALUE:string>>"


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "node").schema(NODE).load(path)
    return rows.select(F.col("_id").alias("osm_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """``way_seq`` (the way's id), ``node_refs, tags``."""
    rows = spark.read.format("xml").option("rowTag", "way").schema(WAY).load(path)
    tags = F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string,_VALUE:string>>")), lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v")))
    refs = F.coalesce(F.transform("nd", lambda n: n["_ref"]), F.array().cast("array<long>"))
    return rows.select(F.col("_id").alias("way_seq"), refs.alias("node_refs"), tag_map(tags).alias("tags"))


def write(nodes: DataFrame, ways: DataFrame, path: str) -> None:
    """``nodes(osm_id, lat, lon)`` and ``ways(way_seq, node_refs, tags)`` as a folder of XML documents, one element a line."""

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda text: pa.record_batch([pa.array([text])], names=["value"])
        yield line("<osm>")
        for b in batches:
            yield pa.record_batch([b.column(0)], names=["value"])
        yield line("</osm>")

    def quoted(c):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    node = F.format_string('<node id="%d" lat="%s" lon="%s"/>', "osm_id", F.col("lat").cast("string"), F.col("lon").cast("string"))
    refs = F.array_join(F.transform("node_refs", lambda r: F.concat(F.lit('<nd ref="'), r.cast("string"), F.lit('"/>'))), "")
    tags = F.array_join(F.transform(F.map_entries("tags"), lambda t: F.concat(F.lit('<tag k="'), quoted(t["key"]), F.lit('" v="'), quoted(t["value"]), F.lit('"/>'))), "")
    way = F.concat(F.format_string('<way id="%d">', "way_seq"), refs, tags, F.lit("</way>"))
    nodes.select(node.alias("value")).unionByName(ways.select(way.alias("value"))).mapInArrow(document, "value string").write.mode("overwrite").text(path)

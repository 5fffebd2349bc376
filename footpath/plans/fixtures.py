"""Street data derived from the star-schema tables, so that every operator has an input.

Lattice: a part is a node of a grid 50 wide.  Ways: an order is a way, its lines refer to nodes.  Walks: an event is a
traversal of a vertical lattice edge.  Pairs: a supplier is an origin and a destination.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import haversine

WIDTH = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lattice_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("osm_id")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("osm_id"))
    lat = F.lit(37.75) + F.floor(i / WIDTH) * F.lit(0.0009) + ((i * 7919) % 97) * F.lit(0.000001)
    lon = F.lit(-122.45) + (i % WIDTH) * F.lit(0.0011) + ((i * 104729) % 89) * F.lit(0.000001)
    return rows.select("osm_id", lat.alias("lat"), lon.alias("lon"))


def lattice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``u, v, weight`` (double), ``name``, ``highway``."""
    nodes = lattice_nodes(spark, sf_dir)
    i = F.col("osm_id")
    row, col = F.floor(i / WIDTH), i % WIDTH
    row_name = F.when(row % 7 == 3, F.lit("")).otherwise(F.concat(F.lit("Row "), row))
    col_name = F.when(col % 5 == 2, F.lit("")).otherwise(F.concat(F.lit("Col "), col))
    across = nodes.where(col < WIDTH - 1).select(i.alias("u"), (i + 1).alias("v"), row_name.alias("name"), F.when(row % 7 == 3, "footway").otherwise("residential").alias("highway"))
    down = nodes.select(i.alias("u"), (i + WIDTH).alias("v"), col_name.alias("name"), F.when(col % 5 == 2, "steps").otherwise("tertiary").alias("highway"))
    a = nodes.select(i.alias("u"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = nodes.select(i.alias("v"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    pairs = across.unionByName(down).join(a, "u").join(b, "v")
    return pairs.select("u", "v", haversine("lat1", "lon1", "lat2", "lon2").alias("weight"), "name", "highway")


def raw_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``way_seq, node_refs, tags``."""
    line = table(spark, sf_dir, "lineitem")
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    refs = line.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["l_partkey"].cast("long")).alias("node_refs"))
    o = table(spark, sf_dir, "orders")
    kinds = {"1-URGENT": "footway", "2-HIGH": "residential", "3-MEDIUM": "steps", "4-NOT SPECIFIED": "motorway", "5-LOW": ""}
    of = lambda m, c: F.coalesce(F.create_map(*(F.lit(x) for kv in m.items() for x in kv))[F.col(c)], F.lit(""))
    foot = F.element_at(F.array(*map(F.lit, ("yes", "no", "designated", ""))), (F.col("o_custkey") % 4 + 1).cast("int"))
    name = F.when(F.col("o_custkey") % 5 == 0, "").otherwise(F.concat(F.lit("Street "), F.col("o_custkey") % 37))
    tags = F.create_map(F.lit("highway"), of(kinds, "o_orderpriority"), F.lit("access"), of({"F": "private", "P": "no"}, "o_orderstatus"), F.lit("foot"), foot, F.lit("name"), name)
    return o.join(refs, o.o_orderkey == refs.l_orderkey).select(F.col("o_orderkey").cast("long").alias("way_seq"), "node_refs", tags.alias("tags"))


def raw_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("osm_id")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("osm_id"))
    return rows.select("osm_id", (F.lit(37.10) + ((i * 7919) % 1300) * F.lit(0.001)).alias("lat"), (F.lit(-122.70) + ((i * 104729) % 1050) * F.lit(0.001)).alias("lon"))


def walk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edge_start, edge_end, walked_at, walk_id``; one traversal per event."""
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    e = table(spark, sf_dir, "events").crossJoin(F.broadcast(n))  # one row
    a = (F.col("event_id") % (F.col("n") - WIDTH)).cast("long")
    b = a + WIDTH
    odd = F.col("user_id") % 2 == 1
    return e.select(F.when(odd, b).otherwise(a).alias("edge_start"), F.when(odd, a).otherwise(b).alias("edge_end"), F.col("ts").alias("walked_at"), F.col("user_id").cast("string").alias("walk_id"))


def od_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, source, target``."""
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").crossJoin(F.broadcast(n))
    q = F.col("s_suppkey").cast("long")
    return s.select(q.alias("qid"), ((q * 37) % F.col("n")).alias("source"), ((q * 101 + 50) % F.col("n")).alias("target"))


def corner_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, path``: along the source's row to the target's column, then along that to the target."""
    w = F.lit(WIDTH).cast("long")
    # pairs are few bytes, their paths long: pairs are dealt over tasks before paths are made
    p = od_pairs(spark, sf_dir).repartition(16 * spark.sparkContext.defaultParallelism, "qid")
    corner = F.floor(F.col("source") / WIDTH) * w + F.col("target") % w
    step = lambda a, b, size: F.when(b < a, F.lit(-size)).otherwise(F.lit(size)).cast("long")
    first = F.sequence(F.col("source"), corner, step(F.col("source"), corner, 1))
    then = F.sequence(corner, F.col("target"), step(corner, F.col("target"), WIDTH))
    return p.select("qid", F.concat(first, F.slice(then, F.lit(2), F.greatest(F.size(then) - 1, F.lit(0)))).alias("path"))

"""From raw ways and nodes to the walkable street graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.geo import haversine
from ..functions.scratch import written


def tag_map(tags: Column) -> Column:
    """A map of an array of (k, v); of keys that come twice the last one holds."""
    last = F.aggregate(
        tags,
        F.array().cast("array<struct<key:string,value:string>>"),
        lambda acc, t: F.concat(F.filter(acc, lambda x: x["key"] != t["k"]), F.array(F.struct(t["k"].alias("key"), t["v"].alias("value")))),
    )
    return F.map_from_entries(last)


def tag(name: str) -> Column:
    return F.coalesce(F.col("tags")[name], F.lit(""))


def is_walkable() -> Column:
    """By type: tagged, not excluded, and one of the walkable types."""
    kind = tag("highway")
    return (kind != "") & ~kind.isin(*fixed.EXCLUDED) & kind.isin(*fixed.WALKABLE)


def is_open() -> Column:
    """By access: closed ways need a foot tag that opens them; foot=no closes any."""
    return ~(tag("access").isin(*fixed.CLOSED) & ~tag("foot").isin(*fixed.OPENED)) & (tag("foot") != "no")


def walkable_ways(ways: DataFrame) -> DataFrame:
    """``way_seq, node_refs, name, highway`` of the ways that can be walked."""
    return ways.where(is_walkable() & is_open()).select("way_seq", "node_refs", tag("name").alias("name"), tag("highway").alias("highway"))


def needed_nodes(ways: DataFrame) -> DataFrame:
    return ways.select(F.explode("node_refs").alias("osm_id")).distinct()


def inside(bbox: dict | None = fixed.BBOX) -> Column:
    """Both ends of the box belong to it."""
    if bbox is None:
        return F.lit(True)
    return F.col("lat").between(bbox["min_lat"], bbox["max_lat"]) & F.col("lon").between(bbox["min_lon"], bbox["max_lon"])


def graph_nodes(nodes: DataFrame, ways: DataFrame, bbox: dict | None = fixed.BBOX) -> DataFrame:
    """Coordinates of the nodes that ways refer to, inside the box (which is pushed to the scan)."""
    return nodes.where(inside(bbox)).join(needed_nodes(ways), "osm_id", "left_semi")


def segments(ways: DataFrame) -> DataFrame:
    """Consecutive pairs of a way's references: ``way_seq, pos, n1, n2, name, highway``."""
    pairs = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.size("node_refs") - 2, F.lit(0))), lambda i: i < F.size("node_refs") - 1),
        lambda i: F.struct(i.alias("pos"), F.get("node_refs", i).alias("n1"), F.get("node_refs", i + 1).alias("n2")),
    )
    return ways.select("way_seq", F.inline(pairs), "name", "highway").select("way_seq", "pos", "n1", "n2", "name", "highway")


def located(segs: DataFrame, coords: DataFrame) -> DataFrame:
    """Segments with both ends known, and their length in metres."""
    a = coords.select(F.col("osm_id").alias("n1"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = coords.select(F.col("osm_id").alias("n2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return segs.join(a, "n1").join(b, "n2").withColumn("weight", haversine("lat1", "lon1", "lat2", "lon2"))


def edges(segs: DataFrame) -> DataFrame:
    """One edge for each unordered pair: the shortest segment, of equal ones the first in scan order.

    The minimum is combined before the shuffle, so a pair with very many segments is no hot group."""
    u, v = F.least("n1", "n2"), F.greatest("n1", "n2")
    rank = F.struct("weight", "way_seq", "pos")
    best = segs.groupBy(u.alias("u"), v.alias("v")).agg(F.min(F.struct(rank.alias("rank"), "name", "highway")).alias("best"))
    return best.select("u", "v", F.col("best.rank.weight").alias("weight"), "best.name", "best.highway")


def build_graph(ways: DataFrame, nodes: DataFrame, bbox: dict | None = fixed.BBOX) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of the walkable graph; nodes without an edge are left out.

    Walkable ways and their nodes' coordinates are written, as both are read more than once."""
    chosen = written(walkable_ways(ways), "walkable")
    coords = written(graph_nodes(nodes, chosen, bbox), "coordinates")
    found = edges(located(segments(chosen), coords))
    ends = found.select(F.col("u").alias("osm_id")).union(found.select("v")).distinct()
    return coords.join(ends, "osm_id", "left_semi"), found


def adjacency(found: DataFrame) -> DataFrame:
    """Both directions of every edge; a loop gives two rows."""
    rest = [c for c in found.columns if c not in ("u", "v")]
    ways = ((F.col("u"), F.col("v")), (F.col("v"), F.col("u")))
    return found.select(F.inline(F.array(*(F.struct(a.alias("src"), b.alias("dst")) for a, b in ways))), *rest)


def degrees(adj: DataFrame) -> DataFrame:
    return adj.groupBy("src").agg(F.count("*").alias("degree"))


def dense_index(rows: DataFrame, key: str, name: str = "node_idx", parts: int = 64) -> DataFrame:
    """Number rows from 0 in the order of ``key`` without a task that sees them all.

    Rows are cut into ranges; a row's number is that in its range plus the rows of the ranges before,
    of which there are ``parts``.  ``key`` is unique."""
    ranged = rows.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id())
    # the ranges come from a sample; fix them, so that both uses below see the same
    bounds = ranged.groupBy("_part").agg(F.min(key).alias("_low"), F.count("*").alias("_n")).collect()  # parts rows
    bounds.sort(key=lambda r: r["_low"])
    before, starts = 0, []
    for r in bounds:
        starts.append((r["_low"], before))
        before += r["_n"]
    if not starts:
        return rows.withColumn(name, F.lit(0).cast("long"))
    part = F.lit(0)
    for i, (low, _) in enumerate(starts):
        part = F.when(F.col(key) >= low, i).otherwise(part) if i else part
    base = F.element_at(F.array(*(F.lit(b).cast("long") for _, b in starts)), F.col("_part") + 1)
    numbered = rows.withColumn("_part", part)
    inside_part = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return numbered.withColumn(name, base + inside_part).drop("_part")


def csr_offsets(nodes: DataFrame, adj: DataFrame, parts: int = 64) -> DataFrame:
    """``node_idx, csr_offset``: neighbours of all nodes before, and one closing row with their sum.

    A prefix sum in two steps: within ranges of nodes, and over the ranges."""
    numbered = dense_index(nodes.select("osm_id"), "osm_id", parts=parts)
    d = numbered.join(degrees(adj).withColumnRenamed("src", "osm_id"), "osm_id", "left").select("node_idx", F.coalesce("degree", F.lit(0)).alias("degree"))
    n = d.agg(F.count("*").alias("n"), F.sum("degree").alias("all")).first()
    width = max(1, -(-n.n // parts))
    d = d.withColumn("_range", F.floor(F.col("node_idx") / width))
    sums = d.groupBy("_range").agg(F.sum("degree").alias("_sum"))  # parts rows
    ahead = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy("node_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = d.withColumn("_own", F.coalesce(F.sum("degree").over(within), F.lit(0))).join(sums, "_range")
    rows = rows.select("node_idx", (F.col("_own") + F.col("_before")).alias("csr_offset"))
    return rows.unionByName(nodes.sparkSession.createDataFrame([(n.n, n["all"] or 0)], "node_idx long, csr_offset long"))


def adjacency_positions(adj: DataFrame) -> DataFrame:
    """Place of every neighbour in its node's list, by neighbour."""
    return adj.withColumn("slot", F.row_number().over(Window.partitionBy("src").orderBy("dst", "weight")) - 1)


def string_dictionary(rows: DataFrame, column: str) -> DataFrame:
    """Distinct strings with their number: "" first, the rest in code-point order."""
    values = rows.select(F.coalesce(column, F.lit("")).alias("value")).union(rows.sparkSession.createDataFrame([("",)], "value string")).distinct()
    return dense_index(values, "value", "idx", parts=8)

"""Command line: build, route, record, stats, report, sweep."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import fixed
from .functions.geo import parse_latlon, walk_minutes
from .functions.scratch import written
from .operators import report
from .operators.history import WalkHistory
from .operators.paths import Graph, path_edges
from .sources import graph_store, osm_pbf, osm_xml, route_json


class Missing(Exception):
    """A source that isn't there; its text tells which."""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="footpath")
    sub = p.add_subparsers(dest="command", required=True)

    def graph(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("--graph", required=True, help="folder of the graph; built there if it is missing")
        c.add_argument("--map", help="map to build it from (.osm.pbf, or XML)")
        return c

    graph("build", "build the graph from a map")
    r = graph("route", "find a route")
    r.add_argument("--history", required=True)
    r.add_argument("--from", dest="start", required=True, help="lat,lon")
    r.add_argument("--to", dest="end", required=True, help="lat,lon")
    r.add_argument("--min-novelty", type=float, default=0.3)
    r.add_argument("--max-overhead", type=float, default=0.25)
    r.add_argument("--profile", choices=("novelty", "length"), default="novelty")
    r.add_argument("--record", action=argparse.BooleanOptionalAction, default=False)
    r.add_argument("-o", "--output")
    c = sub.add_parser("record", help="record a saved route")
    c.add_argument("--history", required=True)
    c.add_argument("route_file")
    s = sub.add_parser("stats", help="totals of the history")
    s.add_argument("--history", required=True)
    t = graph("report", "the four-phase report over the twenty pairs")
    t.add_argument("-o", "--output", help="folder for the figures of every pair as JSON")
    w = graph("sweep", "longest routes with minutes on top of the shortest path")
    w.add_argument("--from", dest="start", default="{},{}".format(*fixed.SWEEP_PAIR[:2]))
    w.add_argument("--to", dest="end", default="{},{}".format(*fixed.SWEEP_PAIR[2:]))
    return p


def open_graph(spark: SparkSession, folder: str, source: str | None) -> Graph:
    """The graph of a folder; if it isn't there, it is built from a map and saved."""
    if graph_store.fingerprint(spark, folder) is None:
        if not source or not graph_store.exists(spark, source):
            raise Missing(f"neither the graph {folder} nor a map to build it from ({source or 'none given'}) exists")
        reader = osm_pbf if source.endswith(".pbf") else osm_xml
        ways, nodes = written(reader.read_ways(spark, source), "ways"), reader.read_nodes(spark, source)
        graph_store.save(graph_store.built(ways, nodes), folder)
    return graph_store.load(spark, folder)


def points(spark: SparkSession, start: str, end: str):
    read = spark.createDataFrame([(start, end)], "s string, e string").select(parse_latlon(F.col("s")).alias("s"), parse_latlon(F.col("e")).alias("e")).first()
    if read.s is None or read.e is None:
        return None
    return spark.createDataFrame([(0, read.s.lat, read.s.lon, read.e.lat, read.e.lon)], "qid long, slat double, slon double, elat double, elon double")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        return {"build": build, "route": route, "record": record, "stats": stats, "report": run_report, "sweep": sweep}[a.command](spark, a)
    except (Missing, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def build(spark: SparkSession, a) -> int:
    g = open_graph(spark, a.graph, a.map)
    print(f"Graph: {g.number_of_nodes()} nodes, {g.number_of_edges()} edges")
    return 0


def record(spark: SparkSession, a) -> int:
    edges = route_json.travelled(route_json.read(spark, graph_store.require(spark, a.route_file)))
    WalkHistory(spark, a.history).record(edges)
    print(f"Recorded {edges.count()} edges.")
    return 0


def stats(spark: SparkSession, a) -> int:
    r = WalkHistory(spark, a.history).stats().first()
    print(f"Unique edges: {r.unique_edges}\nTotal walks: {r.total_walks}\nAverage walks: {r.avg_walks}\nMost walks: {r.max_walks}\nFirst walk: {r.first_walk or 'N/A'}\nLast walk: {r.last_walk or 'N/A'}")
    return 0


def directions(steps) -> None:
    for i, step in enumerate(steps or [], 1):
        print(f"{i:3d}. {step.instruction} ({step.distance:.0f} m)")


def route(spark: SparkSession, a) -> int:
    graph, history = open_graph(spark, a.graph, a.map), WalkHistory(spark, a.history)
    pair = points(spark, a.start, a.end)
    if pair is None:
        print("coordinates must be lat,lon", file=sys.stderr)
        return 2
    found = Engine(spark, graph, history).route(pair, a.min_novelty, a.max_overhead, a.profile)
    r = found.withColumn("minutes", walk_minutes(F.col("distance"))).first()
    if r is None or not r.found:
        print("no route", file=sys.stderr)
        return 1
    print(f"Start: node {r.source} ({r.source_m:.0f} m away)\nEnd: node {r.target} ({r.target_m:.0f} m away)")
    print(f"Distance: {r.distance:.0f} m (shortest {r.shortest_distance:.0f} m), {r.minutes:.0f} min\nNovelty: {100 * r.novelty:.0f} %  Overhead: {100 * r.overhead:.0f} %")
    directions(r.instructions)
    if a.output:
        route_json.write(route_json.documents(found.where("found"), graph.nodes), a.output)
    if a.record:
        history.record(path_edges(found).select("u", "v"))
    return 0


def run_report(spark: SparkSession, a) -> int:
    graph, routes = open_graph(spark, a.graph, a.map), report.report_routes(spark)
    phases = written(report.four_phases(graph, routes), "phases")
    for r in report.summary(phases).orderBy("phase").collect():  # four rows
        share = f"{r.met_both} of {r.found} meet both limits, " if r.phase > 2 else ""
        print(f"Phase {r.phase}: {r.found} of {r.pairs} found, {r.changed} changed, {share}mean {r.avg_distance or 0:.0f} m, {r.avg_seconds or 0:.2f} s (most {r.max_seconds or 0:.2f} s)")
    ratio = report.ratio_summary(report.distance_ratios(phases, routes)).first()
    if ratio.mean_ratio is not None:
        print(f"Distance to rough distance: mean {ratio.mean_ratio:.2f}, least {ratio.min_ratio:.2f}, most {ratio.max_ratio:.2f}")
    shown = report.first_found(phases).join(routes, "qid")
    for r in Engine(spark, graph).route(shown).join(routes.select("qid", "name"), "qid").orderBy("qid").collect():  # three rows
        print(r.name)
        directions(r.instructions)
    found = [r.issue for r in report.issues(phases).collect()]  # at most one row a kind
    print("\n".join(["Issues:", *found]) if found else "No issues.")
    if a.output:
        report.write_metrics(report.metrics(phases, routes), a.output)
    return 0


def sweep(spark: SparkSession, a) -> int:
    graph, pair = open_graph(spark, a.graph, a.map), points(spark, a.start, a.end)
    if pair is None:
        print("coordinates must be lat,lon", file=sys.stderr)
        return 2
    ends = written(Engine(spark, graph).snap_pairs(pair), "ends")
    rows = report.sweep(graph, ends).orderBy("minutes").collect()  # one row for each of the minutes
    for r in rows:
        print(f"{r.minutes} min more: {r.distance:.0f} m, {r.distance / fixed.REPORT_MPS / 60:.1f} min, {100 * r.overhead:.0f} % longer")
    if not rows:
        print("no route", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

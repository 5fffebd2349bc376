from pyspark.sql import functions as F

from footpath.operators import ways

WAY = "way_seq long, node_refs array<long>, tags map<string,string>"


def test_access(spark):
    cases = [("private", "yes", True), ("private", "", False), ("no", "designated", True), ("no", "no", False), ("", "no", False), ("", "", True), ("private", "permissive", True), ("customers", "", True)]
    rows = spark.createDataFrame([(i, [1, 2], {"highway": "path", "access": a, "foot": f}) for i, (a, f, _) in enumerate(cases)], WAY)
    kept = {r.way_seq for r in ways.walkable_ways(rows).collect()}
    assert kept == {i for i, c in enumerate(cases) if c[2]}


def test_types_and_missing_tags(spark):
    kinds = ["footway", "trunk", "motorway", "motorway_link", "proposed", "", None]
    rows = spark.createDataFrame([(i, [1, 2], {} if k is None else {"highway": k}) for i, k in enumerate(kinds)], WAY)
    assert {r.way_seq for r in ways.walkable_ways(rows).collect()} == {0, 1}


def test_last_of_equal_tags_holds(spark):
    rows = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3")],)], "t array<struct<k:string,v:string>>")
    assert rows.select(ways.tag_map(F.col("t")).alias("m")).first().m == {"a": "3", "b": "2"}


def graph(spark):
    w = spark.createDataFrame([(0, [1, 2, 3], {"highway": "path", "name": "Alpha"}), (1, [2, 1], {"highway": "path", "name": "Beta"}), (2, [3, 3], {"highway": "path"})], WAY)
    n = spark.createDataFrame([(1, 37.5, -122.0), (2, 37.5001, -122.0), (3, 37.5002, -122.0), (4, 37.5, -122.1)], "osm_id long, lat double, lon double")
    return ways.build_graph(w, n)


def test_parallel_segments_and_loops(spark):
    nodes, edges = graph(spark)
    assert {(r.u, r.v, r.name) for r in edges.collect()} == {(1, 2, "Alpha"), (2, 3, "Alpha"), (3, 3, "")}
    assert {r.osm_id for r in nodes.collect()} == {1, 2, 3}
    adj = ways.adjacency(edges)
    assert adj.count() == 6
    assert {r.src: r.degree for r in ways.degrees(adj).collect()} == {1: 1, 2: 2, 3: 3}
    assert [r.csr_offset for r in ways.csr_offsets(nodes, adj, parts=2).orderBy("node_idx").collect()] == [0, 1, 3, 6]


def test_box_has_its_border(spark):
    rows = spark.createDataFrame([(1, 37.20, -122.65), (2, 38.35, -121.70), (3, 37.1999, -122.0)], "osm_id long, lat double, lon double")
    assert {r.osm_id for r in rows.where(ways.inside()).collect()} == {1, 2}
    assert rows.where(ways.inside(None)).count() == 3


def test_node_whose_segments_leave_the_box_is_dropped(spark):
    w = spark.createDataFrame([(0, [1, 2], {"highway": "path"})], WAY)
    n = spark.createDataFrame([(1, 37.5, -122.0), (2, 39.0, -122.0)], "osm_id long, lat double, lon double")
    nodes, edges = ways.build_graph(w, n)
    assert nodes.count() == 0 and edges.count() == 0


def test_short_ways_have_no_segments(spark):
    w = spark.createDataFrame([(0, [1], "", "path"), (1, [], "", "path")], "way_seq long, node_refs array<long>, name string, highway string")
    assert ways.segments(w).count() == 0


def test_dense_index_and_dictionary(spark):
    rows = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)], "k long")
    got = ways.dense_index(rows, "k", parts=7).orderBy("k").collect()
    assert [r.node_idx for r in got] == list(range(1000))
    names = spark.createDataFrame([("b",), ("",), (None,), ("a",), ("b",)], "name string")
    assert {r.value: r.idx for r in ways.string_dictionary(names, "name").collect()} == {"": 0, "a": 1, "b": 2}
    assert ways.dense_index(rows.limit(0), "k").count() == 0

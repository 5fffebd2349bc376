import pytest

from footpath import cli
from footpath.engine import Engine
from footpath.operators.history import WalkHistory
from footpath.operators import snap
from footpath.operators.paths import Graph, shortest_paths
from footpath.sources import csrg, graph_store, osm_xml, route_json

EDGE = "u long, v long, weight double, name string, highway string"


@pytest.fixture
def graph(spark):
    nodes = spark.createDataFrame([(10, 37.75, -122.45), (20, 37.75, -122.449), (30, 37.7509, -122.449)], "osm_id long, lat double, lon double")
    return Graph(nodes, spark.createDataFrame([(10, 20, 88.0, "Ä St", "residential"), (20, 30, 100.0, "", "steps"), (30, 30, 0.0, "Loop", "path")], EDGE))


def rows(g):
    return sorted((r.u, r.v, round(r.weight, 3), r.name, r.highway) for r in g.edges.collect())


def test_binary_round_trip(spark, graph, tmp_path):
    path = str(tmp_path / "g.bin")
    csrg.write(graph, path)
    assert rows(csrg.read(spark, path)) == rows(graph)
    one = str(tmp_path / "one.bin")
    csrg.write(Graph(graph.nodes, graph.edges.drop("name", "highway")), one)
    back = csrg.read(spark, one)
    assert not back.has_names and back.number_of_edges() == 3 and back.nodes.count() == 3
    data = open(path, "rb").read()
    for bad in (b"XXXX" + data[4:], data[:4] + b"\7" + data[5:], data[:60]):
        (tmp_path / "bad.bin").write_bytes(bad)
        with pytest.raises(ValueError):
            csrg.Arrays(str(tmp_path / "bad.bin"))


def test_archive_round_trip(spark, graph, tmp_path):
    csrg.write_npz(graph, str(tmp_path / "g.npz"))
    assert rows(csrg.read_npz(spark, str(tmp_path / "g.npz"))) == rows(graph)


def test_store(spark, graph, tmp_path):
    path = str(tmp_path / "store")
    assert graph_store.fingerprint(spark, path) is None
    graph_store.save(graph, path)
    assert graph_store.fingerprint(spark, path) == "3-3-2"
    assert rows(graph_store.load(spark, path)) == rows(graph)
    with pytest.raises(FileNotFoundError, match="nowhere"):
        graph_store.require(spark, str(tmp_path / "nowhere"))


XML = """<osm>
<node id="1" lat="37.5" lon="-122.0"/><node id="2" lat="37.5001" lon="-122.0"/><node id="3" lat="37.6" lon="-122.1"/>
<way id="7"><nd ref="1"/><nd ref="2"/><tag k="highway" v="path"/><tag k="name" v="A"/><tag k="name" v="B"/></way>
<way id="8"><nd ref="2"/><nd ref="3"/><tag k="highway" v="motorway"/></way>
</osm>"""


def test_xml(spark, tmp_path):
    (tmp_path / "m.osm").write_text(XML)
    path = str(tmp_path / "m.osm")
    ways, nodes = osm_xml.read_ways(spark, path), osm_xml.read_nodes(spark, path)
    assert nodes.count() == 3
    g = graph_store.read_through(spark, ways, nodes, str(tmp_path), "m.osm")
    assert [(r.u, r.v, r.name) for r in g.edges.collect()] == [(1, 2, "B")]
    assert graph_store.read_through(spark, ways.limit(0), nodes, str(tmp_path), "m.osm").number_of_edges() == 1  # from the store
    assert graph_store.read_through(spark, ways.limit(0), nodes, str(tmp_path), "m.osm", None).number_of_edges() == 0  # another box


def test_route_document(spark, graph, tmp_path):
    found = shortest_paths(graph, spark.createDataFrame([(0, 10, 30)], "qid long, source long, target long"))
    docs = route_json.documents(found.selectExpr("qid", "path", "distance", "distance shortest_distance", "1.0D novelty", "0.0D overhead"), graph.nodes)
    route_json.write(docs, str(tmp_path / "r.json"))
    back = route_json.read(spark, str(tmp_path / "r.json"))
    r = back.first()
    assert r.num_edges == 2 and r.edges == [[10, 20], [20, 30]] and r.coordinates[0].node_id == 10 and r.novelty_pct == 100
    assert [tuple(x) for x in route_json.travelled(back).collect()] == [(10, 20), (20, 30)]


def test_engine(spark, graph, tmp_path):
    e = Engine(spark, graph, WalkHistory(spark, str(tmp_path / "log")))
    pair = spark.createDataFrame([(0, 37.7501, -122.4502, 37.751, -122.449)], "qid long, slat double, slon double, elat double, elon double")
    r = e.route(pair, record=True).first()
    assert (r.source, r.target, r.novelty, r.overhead) == (10, 30, 1.0, 0.0) and len(r.instructions) == 3
    assert e.stats().first().unique_edges == 2
    assert e.route(pair).first().novelty == 0.0


def test_command_line(spark, graph, tmp_path, capsys):
    store, log, out = (str(tmp_path / x) for x in ("store", "log", "route"))
    graph_store.save(graph, store)
    ends = ["route", "--graph", store, "--history", log, "--from", "37.75,-122.45", "--to"]
    assert cli.main([*ends, "37.7509,-122.449", "-o", out], spark) == 0
    assert "Head east on Ä St" in capsys.readouterr().out
    assert cli.main(["record", "--history", log, out], spark) == 0
    assert cli.main(["stats", "--history", log], spark) == 0
    assert "Unique edges: 2" in capsys.readouterr().out
    assert cli.main([*ends, "here"], spark) == 2
    assert cli.main(["route", "--graph", str(tmp_path / "no"), "--history", log, "--from", "1,1", "--to", "1,1"], spark) == 1
    assert "neither the graph" in capsys.readouterr().err


def test_index_is_taken_only_for_its_graph(spark, graph, tmp_path):
    path = str(tmp_path / "index")
    assert graph_store.load_index(spark, path, graph) is None
    graph_store.save_index(graph, path)
    index = graph_store.load_index(spark, path, graph)
    points = spark.createDataFrame([(1, 37.75, -122.4501), (2, 10.0, 10.0), (3, None, 1.0)], "pid long, lat double, lon double")
    got = {(r.pid, r["rank"], r.osm_id) for r in snap.nearest_indexed(points, index, 2).collect()}
    assert got == {(r.pid, r["rank"], r.osm_id) for r in snap.nearest(points, graph.nodes, 2).collect()} and len(got) == 4
    assert graph_store.load_index(spark, path, Graph(graph.nodes, graph.edges.limit(2))) is None


def test_files_keep_weights_and_places_whole(spark, tmp_path, monkeypatch):
    from footpath.operators import packed

    monkeypatch.setattr(packed, "RANGE", 7)  # several ranges
    nodes = spark.range(60).selectExpr("id * 3 as osm_id", "37.75D + id * 0.0009D as lat", "-122.45D + id / 7.0D as lon")
    edges = spark.range(59).selectExpr("id * 3 as u", "id * 3 + 3 as v", "id * 0.1D + 0.05D as weight", "if(id % 4 = 0, null, concat('S', id % 5)) as name", "'path' as highway")
    g = Graph(nodes, edges)
    csrg.write(g, str(tmp_path / "g.bin"))
    csrg.write_npz(g, str(tmp_path / "g.npz"))
    expected = sorted((r.u, r.v, r.weight, r.name or "", r.highway) for r in edges.collect())
    for back in (csrg.read(spark, str(tmp_path / "g.bin")), csrg.read_npz(spark, str(tmp_path / "g.npz"))):
        assert sorted((r.u, r.v, r.weight, r.name, r.highway) for r in back.edges.collect()) == expected
        assert sorted(map(tuple, back.nodes.collect())) == sorted(map(tuple, nodes.collect()))
    # what the format itself has is as before
    x = csrg.Arrays(str(tmp_path / "g.bin"))
    assert x._plain["weights"].dtype == "<f4" and x.offsets[-1] == 118 and x.targets[:3].tolist() == [1, 0, 2]


def test_writing_a_file_collects_no_rows(spark, graph, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(type(graph.nodes), "toPandas", lambda self: pytest.fail("collected"))
    csrg.write(graph, str(tmp_path / "g.bin"))

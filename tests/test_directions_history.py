import datetime as dt

from footpath.operators import directions, history
from footpath.operators.history import WalkHistory
from footpath.operators.paths import Graph

EDGE = "u long, v long, weight double, name string, highway string"
T = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]


def graph(spark):
    nodes = spark.createDataFrame([(1, 37.75, -122.45), (2, 37.75, -122.449), (3, 37.75, -122.448), (4, 37.749, -122.448)], "osm_id long, lat double, lon double")
    edges = spark.createDataFrame([(1, 2, 88.0, "Oak St", "residential"), (2, 3, 88.0, "Oak St", "residential"), (3, 4, 111.0, "", "footway")], EDGE)
    return Graph(nodes, edges)


def test_instructions(spark):
    g = graph(spark)
    paths = spark.createDataFrame([(0, [1, 2, 3, 4]), (1, [1])], "qid long, path array<long>")
    rows = directions.instructions(g, paths).collect()
    assert [r.qid for r in rows] == [0]
    steps = rows[0].instructions
    assert [s.instruction for s in steps] == ["Head east on Oak St", "Turn right onto footpath", "Arrive at destination"]
    assert steps[1].street_name is None and abs(steps[1].turn_angle - 90) < 1 and steps[2].distance == 0
    assert abs(sum(s.distance for s in steps) - (2 * 87.9 + 111.2)) < 1
    bare = Graph(g.nodes, g.edges.drop("name", "highway"))
    assert directions.instructions(bare, paths).count() == 0


def test_a_street_called_road_joins_the_nameless(spark):
    nodes = spark.createDataFrame([(i, 37.75, -122.45 + i * 0.001) for i in range(3)], "osm_id long, lat double, lon double")
    edges = spark.createDataFrame([(0, 1, 88.0, "", "residential"), (1, 2, 88.0, "road", "residential")], EDGE)
    runs = directions.street_runs(directions.described_edges(Graph(nodes, edges), spark.createDataFrame([(0, [0, 1, 2])], "qid long, path array<long>"))).collect()
    assert len(runs) == 1 and runs[0].effective_name == "road" and runs[0].street_name is None


def record(h, spark, edges, at):
    h.record(spark.createDataFrame(edges, "u long, v long"), at=at)


def test_history(spark, tmp_path):
    h = WalkHistory(spark, str(tmp_path / "log"))
    r = h.stats().first()
    assert tuple(r) == (0, 0, 0.0, 0, None, None)
    record(h, spark, [(1, 2), (2, 1), (2, 3)], T[0])
    record(h, spark, [(1, 2)], T[1])
    assert {(x.edge_start, x.edge_end, x.walk_count, x.last_walked) for x in h.table().collect()} == {(1, 2, 3, T[1]), (2, 3, 1, T[0])}
    assert tuple(h.stats().first()) == (2, 4, 2.0, 3, T[0], T[1])
    record(h, spark, [(2, 3)], T[2])
    assert tuple(h.stats().first()) == (2, 5, 2.5, 3, T[1], T[2])
    assert history.true_first_walk(h.events()).first()[0] == T[0]
    wanted = spark.createDataFrame([(3, 2), (7, 8)], "edge_start long, edge_end long")
    assert {(x.edge_start, x.is_walked, x.walk_count) for x in history.look_up(h.table(), wanted).collect()} == {(2, True, 2), (7, False, 0)}
    h.compact(str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from footpath.streaming.history_stream import latest, read_events, upsert

    h = WalkHistory(spark, str(tmp_path / "log"))
    for i in range(3):
        record(h, spark, [(1, 2), (2, 3 + i)], T[i])
        upsert(read_events(spark, h.path, 1), str(tmp_path / "table"), str(tmp_path / "offsets")).awaitTermination()
    assert sorted(map(tuple, latest(spark, str(tmp_path / "table")).collect())) == sorted(map(tuple, h.table().collect()))


def test_mapped_runs_are_those_of_windows(spark, monkeypatch):
    """Steps on a mapped graph and by joins are the same, and no step of a path is shuffled on a mapped graph."""
    import random

    from footpath.operators import paths as solvers

    rnd = random.Random(3)
    nodes = spark.createDataFrame([(i, 37.7 + i // 6 * 0.001 + rnd.random() * 1e-5, -122.4 + i % 6 * 0.001) for i in range(36)], "osm_id long, lat double, lon double")
    names = ["Oak St", "", "road", None, "Elm St"]
    edges = [(i, j, 90.0, rnd.choice(names), rnd.choice(["steps", "residential", "", None])) for i in range(36) for j in (i + 1, i + 6) if j < 36 and (j % 6 or j == i + 6)]
    walks = [[rnd.randrange(36)] for _ in range(40)]
    for w in walks:
        for _ in range(rnd.randrange(30)):
            w.append(rnd.choice([j for j in (w[-1] - 1, w[-1] + 1, w[-1] - 6, w[-1] + 6) if 0 <= j < 36]))
    walks += [[], None, [0, 35], [0, 99, 1, 2], [99], [0, 0, 1]]
    g, found = Graph(nodes, spark.createDataFrame(edges, EDGE)), spark.createDataFrame(list(enumerate(walks)), "qid long, path array<long>")
    key = lambda rows: sorted(tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in rows.collect())
    order = ["qid", "step", "instruction", "street_description", "distance", "turn_direction", "turn_angle", "start_lat", "start_lon", "street_name"]
    text = lambda rows: [tuple(str(x) for x in r) for r in key(rows.select(*order[:-1]))]
    streets = lambda rows: {(r.qid, r.step): r.street_name for r in rows.collect()}
    fast, plan = directions.steps(g, found), directions.mapped_runs(g, found)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
    assert len(solvers.path_edges(found).collect()) > fast.count() > 200
    got = text(fast), streets(fast)
    monkeypatch.setattr(solvers, "BROADCAST_EDGES", 0)
    slow = directions.steps(g, found)
    assert got == (text(slow), streets(slow))

"""Vector searches against brute force."""

import numpy as np
from pyspark.sql import functions as F

from footpath.llm import threshold_search, vantage_point
from footpath.llm.vectors import usable


def rows(spark, n=400, width=12, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).round(3)
    x[50:60] = x[0]  # ties
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")


def brute(x, q, own, k):
    s = (x @ q).round(9)
    s[own] = -np.inf
    order = np.lexsort((np.arange(len(x)), -s))[:k]
    return order.tolist()


def test_threshold_search(spark):
    x, df = rows(spark)
    x = np.floor(256 * x)
    df = df.select("vec_id", F.transform("v", lambda c: F.floor(c * 256).cast("double")).alias("v"))
    got = threshold_search.search(df, df.where("vec_id % 50 = 0"), 5, shard_rows=100, block_rows=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for i in range(0, 400, 50):
        want = brute(x, x[i], i, 5)
        assert [by[i][k][0] for k in range(1, 6)] == want and all(by[i][k][1] == int(x[v] @ x[i]) for k, v in enumerate(want, 1))


def test_threshold_stops_early():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5000, 2)).round(3)
    lists = threshold_search.SortedLists(np.arange(5000), x)
    read = []
    lists.x = type("Counted", (), {"__getitem__": lambda _, i: (read.append(np.size(i)), x[i])[1], "dtype": x.dtype, "shape": x.shape})()
    rows_, score = lists.top(np.array([1.0, 1.0]), 5, None)
    assert rows_.tolist() == np.lexsort((np.arange(5000), -(x.sum(axis=1))))[:5].tolist() and sum(read) < 2500


def test_vantage_point_is_exact_at_factor_one(spark):
    x, df = rows(spark, 900)
    for factor, least in ((1.0, 1.0), (vantage_point.FACTOR, 0.9)):
        got = vantage_point.search(df, df.where("vec_id % 20 = 0"), 20, factor, shard_rows=300, block_rows=10).collect()
        by, hits = {}, 0
        for r in got:
            by.setdefault(r.query_id, {})[r["rank"]] = r
        for i in range(0, 900, 20):
            want = brute(x, x[i], i, 20)
            own = [by[i][k].vec_id for k in range(1, 21)]
            hits += len(set(own) & set(want))
            assert all(abs(by[i][k].score - x[by[i][k].vec_id] @ x[i]) < 1e-9 for k in by[i])
        assert hits >= least * 45 * 20


def test_tree_bounds_hold():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(700, 6)), rng.normal(size=(9, 6))
    tree = vantage_point.VantagePointTree(x, 20)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(700))
    bound, d = tree.bounds(q), vantage_point.distances(q, x)
    assert all((d[:, leaf] >= bound[:, i, None] - 1e-9).all() for i, leaf in enumerate(tree.leaves))


def test_special_rows(spark):
    nan, inf = float("nan"), float("inf")
    raw = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.0, 0.0]), (None, [1.0, 1.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0])]
    df = spark.createDataFrame(raw, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    ok = df.where(usable(F.col("embedding")))
    assert {r.vec_id for r in ok.collect()} == {0, 1, 7, 8, None}
    assert {r.vec_id for r in df.where(usable(F.col("embedding"), zero=False)).collect()} == {0, 1, 8, None}
    v = ok.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "rank")
    got = threshold_search.search(v, v.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2), (8, 2), (8, 2), (7, 0)]
    got = threshold_search.search(v, v.where("vec_id = 7"), 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(0, 0), (1, 0)]
    got = vantage_point.search(v, v.where("vec_id = 0"), 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2.0), (8, 2.0)]
    for search in (threshold_search.search, vantage_point.search):
        assert search(v.limit(0), v, 3).count() == 0 and search(v, v.limit(0), 3).count() == 0


def test_unequal_widths_and_a_store_that_cannot_be_mapped(spark):
    from footpath.llm import vectors

    rng = np.random.default_rng(4)
    short, long = rng.integers(-9, 9, (40, 3)).astype(float), rng.integers(-9, 9, (40, 5)).astype(float)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(short)], "vec_id long, v array<double>")
    q = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(long)], "vec_id long, v array<double>")
    for a, b, x, y in ((c, q, short, long[:, :3]), (q, c, long[:, :3], short)):
        for search in (threshold_search.search, vantage_point.search):
            best = {r.query_id: r.score for r in search(a, b, 1, shard_rows=16, block_rows=16).collect()}
            assert sorted(best) == sorted(r.vec_id for r in b.collect()) and sorted(best.values()) == sorted((y @ x.T).max(axis=1).tolist())
    rows = q.withColumn("query_row", F.col("vec_id"))
    count = lambda index, ids, y: (np.arange(len(y)), np.full(len(y), index), y.sum(axis=1))
    got = vectors.by_shard(c, rows, 10, 7, lambda ids, x: len(ids), count, "double", mapped=False)
    assert got.groupBy("query_id").agg(F.sum("vec_id").alias("n")).where("n <> 40").count() == 0 and got.select("query_id").distinct().count() == 40


def test_queries_visit_fewer_leaves():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)] + 0.1 * rng.normal(size=(4000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    seen = []
    for factor in (1.0, vantage_point.FACTOR):
        tree = vantage_point.VantagePointTree(np.hstack([x, np.zeros((4000, 1))]), 64)
        score, found = vantage_point.nearest(tree, x, np.arange(4000), x[:100], np.arange(100), 20, factor, 1.0)
        seen.append(tree.visited)
        hits = sum(len(set(found[i]) & set(np.argsort(-(x @ x[i]), kind="stable")[:21].tolist())) for i in range(100))
        assert hits >= (2000 if factor == 1 else 1900)
    assert seen[1] < seen[0] < 0.5 * 100 * 4000

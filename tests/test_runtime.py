"""Joins with hot keys and scratch tables."""

from pyspark.sql import functions as F

from memlake.runtime import Scratch, checkpoint_root, hot_safe_join


def test_hot_join_is_one_plain_join(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 500}") for i in range(6000)] + [(9000, "missing"), (9001, None)]
    left = spark.createDataFrame(rows, "id long, key string")
    table = left.filter("key <> 'missing'").groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.length("key"))
    for how in ("inner", "left"):
        got = hot_safe_join(left, table, "key", "n", 6000, how).select("id", "v")
        want = left.join(table, "key", how).select("id", "v")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_hot_join_of_empty_tables(spark):
    e = spark.createDataFrame([], "key string, n long, v int")
    assert hot_safe_join(e.select("key"), e, "key", "n", 0).count() == 0


def test_scratch(spark):
    s = Scratch(spark)
    assert s.root.startswith(checkpoint_root(spark))
    assert s.save(spark.range(4), "t").agg(F.sum("id")).first()[0] == 6


def test_hub_of_half_of_all_edges(spark, monkeypatch):
    from memlake import runtime
    from memlake.operators import graph as G

    monkeypatch.setattr(runtime, "MIN_HOT", 10)
    edges = [(0, i) for i in range(1, 3001)] + [(i, i + 1) for i in range(5000, 8000)]
    df = spark.createDataFrame(edges, "a long, b long")
    hot = runtime.hubs(df, "a", len(edges))
    assert {tuple(r) for r in hot.collect()} == {(0, 300)}
    sides = spark.createDataFrame([(0, "x"), (5000, "y")], "a long, v string")
    assert {tuple(r) for r in runtime.salted_join(df, sides, "a", "b", hot).collect()} == {(0, i, "x") for i in range(1, 3001)} | {(5000, 5001, "y")}
    assert runtime.salted_join(df, sides, "a", "b", hot, "left").count() == len(edges)
    got = {r.node: r.component for r in G.components(df.filter("a < 5100")).collect()}
    assert set(got.values()) == {0, 5000} and len(got) == 3001 + 101

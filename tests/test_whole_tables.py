"""Queries over whole tables: no row is left out for its id or its letters."""

from memlake.functions import columns as C
from memlake.queries import all_queries
from memlake.queries.retrieval import Q96
from pyspark.sql import functions as F

MEMORY = "id long, content string, tags string, memory_type string, metadata string, strength double, difficulty double, created_at double, updated_at double, deleted_at double"


def test_store(spark, tmp_path):
    rows = [(600, "Ölçüm sonucu", "a", "note", None, 2.0, 5.0, 1.0, 1.0, 9.0), (700, "lebt noch", "b", "note", None, 2.0, 5.0, 1.0, 1.0, None)]
    mem = spark.createDataFrame(rows, MEMORY).withColumn("content_hash", C.content_hash(F.col("content")))
    mem.write.parquet(f"{tmp_path}/memories.parquet")
    new = [("Ölçüm sonucu", "note", "c", None), ("lebt noch", "note", "c", None), ("größer als vorher", "note", "c", None)]
    spark.createDataFrame(new, "content string, memory_type string, tags string, metadata string").write.parquet(f"{tmp_path}/ingest_queue.parquet")
    got = all_queries()["DML01_store"](spark, str(tmp_path)).agg(F.sum("n"), F.sum("live")).first()
    assert tuple(got) == (3, 3)


def test_rerank(spark, tmp_path):
    spark.createDataFrame([(1,), (300,), (301,)], "id long").write.parquet(f"{tmp_path}/memories.parquet")
    spark.createDataFrame([(300, Q96), (301, [-x for x in Q96])], "rowid long, content_embedding array<float>").write.parquet(f"{tmp_path}/memory_embeddings.parquet")
    got = {tuple(r) for r in all_queries()["VE04_rerank_all"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0.0), (300, 1.0), (301, 0.0)}


def test_pagerank(spark, tmp_path):
    lines = [(1, 1, 1), (1, 51, 2), (2, 51, 1), (2, 101, 3), (3, 1, 1), (1, 1, 2)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = [(f"{a}s", f"{b}p") for a, b, _ in lines]
    edges += [(b, a) for a, b in edges]
    nodes = sorted({a for a, _ in edges})
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(30):
        rank = {v: 0.15 / len(nodes) + 0.85 * sum(rank[a] / sum(x == a for x, _ in edges) for a, b in edges if b == v) for v in nodes}
    got = {r.node: r["rank"] for r in all_queries()["GR04_pagerank"](spark, str(tmp_path)).collect()}
    assert set(got) == set(nodes) and all(abs(got[v] - rank[v]) < 1e-8 for v in nodes)

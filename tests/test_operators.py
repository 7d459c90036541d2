"""Operators without SQL, on hand-made cases and against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.functions import extract as E
from memlake.operators import graph as G
from memlake.operators import metrics as M
from memlake.operators import mutate as D
from memlake.operators import packed as P
from memlake.operators import text as X
from memlake.operators import vector as V
from memlake.schema import MEMORIES, normalize


def best(field, logp=None, unseen=-9.0):
    return P.best_path(P.lattice(field), logp or {}, unseen)


def test_packed_readings():
    assert best('a, "b c";`d`') == ["a", "b c", "d"]
    assert best("“x y” | 'it''s'") == ["x y", "it's"]
    assert best(r'"say \"no\""') == ['say "no"']
    assert best("don't, stop") == ["don", "t", "stop"] and best("'open") == ["open"]
    assert best('"a", ' + "b, " * 90 + '"c"') == ["a", *["b"] * 90, "c"]


def test_packed_frequencies_decide():
    made = P.lattice("x 'y' z w'")
    assert P.readings(made[1])
    assert P.best_path(made, {"y": -1.0, "z": -1.0, "w": -1.0}, -30.0) == ["x", "y", "z", "w"]
    assert P.best_path(made, {"y": -1.0, "z w": -1.0}, -30.0) == ["x", "y", "z w"]
    doubled = P.lattice('"note:the ""old"" ranker"')
    assert P.best_path(doubled, {}, -9.0) == ['note:the "old" ranker']
    assert P.best_path(doubled, {"note:the": 0.0, "old": 0.0, "ranker": 0.0}, -60.0) == ["note:the", "old", "ranker"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab '\"`,;“”\\", max_size=14))
def test_viterbi_is_the_best_path(field):
    logp, unseen = {"a": -1.0, "b": -2.0, "a b": -3.0}, -9.0
    last, edges = P.lattice(field)

    def every(at):
        if at == last:
            yield 0.0, []
        for e in edges:
            if e[0] == at:
                for s, rest in every(e[1]):
                    yield s + e[3] + (logp.get(e[2], unseen) if e[2] else 0.0), ([e[2]] if e[2] else []) + rest

    best = max(s for s, _ in every(0))
    got = P.best_path((last, edges), logp, unseen)
    assert any(abs(s - best) < 1e-9 and v == got for s, v in every(0))


def test_packed_rows_come_from_the_lattice(spark, monkeypatch):
    df = spark.createDataFrame([(1, "x, y"), (2, '"a ""b"" c", d')], "id long, tags string")
    assert {tuple(r) for r in P.split_packed(df).collect()} == {(1, 1, "x"), (1, 2, "y"), (2, 1, 'a "b" c'), (2, 2, "d")}
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "field": ["x, y", '"a b", c']})
    assert [b.column("values").to_pylist() for b in P._parse([batch])] == [[["x", "y"], ["a b", "c"]]]
    monkeypatch.setattr(P, "best_path", lambda *_: ["stub"])
    assert [b.column("values").to_pylist() for b in P._parse([batch])] == [[["stub"], ["stub"]]]


def test_packed_table(spark):
    rows = [(1, "x, y", "a"), (1, "x, y", "a"), (2, None, "a"), (3, "", "a"), (4, "don't, x", "a"), (5, '["p q"]' + "x " * 20000, "a"), (6, " ,; ", "a")]
    df = spark.createDataFrame(rows, "id long, tags string, tag string")
    got = P.split_packed(df).toPandas()
    assert got[got.id == 1].tag.tolist().count("x") == 2
    assert got[got.id == 4].sort_values("tag_pos").tag.tolist() == ["don", "t", "x"]
    assert len(got[got.id == 5]) == 20001 and set(got.id) == {1, 4, 5}
    assert P.split_packed(df.limit(0)).count() == 0


def test_score_properties(spark):
    rows = [("old", 365.0, 0.5, 1.0, 0.5), ("new", 30.0, 0.5, 1.0, 0.5), ("imp", 180.0, 0.9, 1.0, 0.5), ("low", 180.0, 0.5, 1.0, 0.5), ("rel", 365.0, 0.5, 1.0, 0.95), ("day", 1.0, 0.5, 1.0, 0.05), ("dead", 1.0, 0.5, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "k string, days double, imp double, strength double, rel double")
    df = df.withColumn("created_at", C.NOW - F.col("days") * 86400).withColumn("last_accessed_at", F.lit(None).cast("double")).withColumn("metadata", F.to_json(F.struct(F.col("imp").alias("importance_score"))))
    s = {r.k: r.s for r in df.select("k", C.unified_score(F.col("rel")).alias("s")).collect()}
    assert s["new"] > s["old"] and s["imp"] - s["low"] > 0.25 * 0.4 and s["rel"] > s["day"]


@pytest.mark.parametrize("raw,want", [('{"importance_score": 2.0}', 1.0), ('{"importance_score": 1.5}', 0.75), ('{"importance_score": 0.95}', 0.95), ('{"importance_score": true}', 0.5), ('{"importance_score": "0.9"}', 0.5), ("broken", 0.5), (None, 0.5)])
def test_importance_scale(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "metadata string").select(C.importance()).first()[0] == want


def test_collapse():
    v = [1.0, 0.0]
    kept, folded = V.collapse([(1, "a", ("p",), v), (2, "a", ("p",), v), (3, "b", ("p",), v), (4, "a", ("q",), v), (5, "a", ("p",), None)], 10)
    assert kept == [1, 3, 4, 5] and folded == {1: [2]}


def test_greedy_groups():
    assert V.greedy_groups([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99]]) == [0, 0, 2, 2]


def test_hdbscan_blobs():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.05, (12, 2)) for c in ((0, 0), (3, 0), (0, 3))] + [[[10, 10], [-9, 7]]])
    label = V.hdbscan(x, 3)
    assert len({*label[:12]}) == 1 and len({*label[12:24]}) == 1 and len({label[0], label[12], label[24]}) == 3
    assert label[-1] == -1 and label[-2] == -1
    assert V.hdbscan(np.zeros((2, 2))).tolist() == [-1, -1]


@pytest.mark.parametrize("n", [1, 5, 30, 120])
def test_pagerank_is_dense(spark, n):
    rng = np.random.default_rng(n)
    e = [(int(a), int(b)) for a, b in rng.integers(0, n, (3 * n, 2))]
    got = {r.node: r["rank"] for r in G.pagerank(spark.createDataFrame(e, "src long, dst long"), rounds=6).collect()}
    nodes = sorted({x for p in e for x in p})
    at = {v: i for i, v in enumerate(nodes)}
    w = np.zeros((len(nodes),) * 2)
    for a, b in e:
        w[at[b], at[a]] += 1
    out = w.sum(axis=0)
    w = w / np.where(out == 0, 1, out)
    r = np.full(len(nodes), 1 / len(nodes))
    for _ in range(6):
        r = 0.15 / len(nodes) + 0.85 * w @ r
    assert np.allclose([got[v] for v in nodes], r, atol=1e-9)


def test_components_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(1, 60)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.component for r in G.components(spark.createDataFrame(chain + hub + [(7, 7)], "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and {got[1000 + i] for i in range(300)} == {1000}


def test_block_pairs_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 16))
    df = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(x)], "id long, v array<float>")
    got = {(r.a, r.b) for r in V.block_pairs(df, 0.3, 3).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if s[i, j] >= 0.3}


def test_gates(spark):
    rows = ["ok.", "[Decision] x", "We decided to use kafka because it keeps the order of the events.", "lower case start of a sentence that is long enough to keep here", "ends with:", "git log --since 2026 --full 2>&1 | tail -8", ""]
    got = spark.createDataFrame([(r,) for r in rows], "c string").select(E.is_fragment(F.col("c")), E.looks_like_code(F.col("c")), E.type_by_prefix(F.col("c"))).collect()
    assert [r[0] for r in got] == [True, False, False, True, True, True, True]
    assert got[5][1] and not got[2][1] and got[1][2] == "decision"


def test_macro_verbs(spark):
    text = "[M#dec:3] use kafka\n> [M#todo] nothing\n[M#pref] tabs over spaces"
    got = spark.createDataFrame([(text,)], "c string").select(E.macro_verbs(F.col("c"))).first()[0]
    assert [(r.type, r.importance, r.content) for r in got] == [("decision", 2.0, "use kafka"), ("preference", 1.0, "tabs over spaces")]


def test_scrub(spark):
    text = "token = 'abcdefghijklmnop' and Bearer abcdefghijklmnopqrstuvwx and postgres://u:p@h/db"
    got = spark.createDataFrame([(text,)], "c string").select(E.scrub(F.col("c"))).first()[0]
    assert got == "token = '[REDACTED:generic] and [REDACTED:bearer] and [REDACTED:db_uri]"


def test_store_revives_and_inserts(spark):
    base = spark.createDataFrame([(1, "A", None), (2, "B", 5.0)], "id long, content string, deleted_at double").withColumn("content_hash", C.content_hash(F.col("content")))
    base = normalize(base, MEMORIES)
    new = spark.createDataFrame([(" a ", "t", "x", "{}"), ("b", "t", "x", "{}"), ("c", "t", "x", "{}"), ("C", "t", "x", "{}")], "content string, memory_type string, tags string, metadata string")
    got = {r.id: r for r in D.store(base, new).collect()}
    assert len(got) == 3 and got[1].tags is None and got[2].deleted_at is None and got[2].strength == 1.0
    assert max(got) > 2 and got[max(got)].content in ("c", "C")


def test_rewrite_edges(spark):
    e = spark.createDataFrame([("a", "b", 0.5, "related", 1.0), ("c", "b", 0.9, "related", 1.0), ("a", "c", 0.9, "related", 1.0)], "source_hash string, target_hash string, similarity double, relationship_type string, created_at double")
    got = D.rewrite_edges(e, spark.createDataFrame([("c", "a")], "old string, new string")).collect()
    assert [(r.source_hash, r.target_hash, r.similarity) for r in got] == [("a", "b", 0.9)]


def test_rank_metrics(spark):
    res = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("z", "a", 1)], "query string, doc string, rank int")
    rel = spark.createDataFrame([("q", "b"), ("q", "c"), ("z", "x")], "query string, doc string")
    got = {r["query"]: r for r in M.per_query(res, rel, 5).collect()}
    assert got["q"].rr == 0.5 and got["q"].precision == 0.4 and got["q"].recall == 1.0 and got["z"].rr == 0.0
    assert got["q"].ndcg == round((1 / np.log2(3) + 1 / np.log2(4)) / (1 + 1 / np.log2(3)), 6)


def test_empty_search(spark):
    m = normalize(spark.createDataFrame([], MEMORIES), MEMORIES)
    assert X.search(m, "anything").count() == 0

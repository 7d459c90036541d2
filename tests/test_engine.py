"""Engine, files, sessions, consolidation and text functions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.api import Engine
from memlake.functions import columns as C
from memlake.functions.importance import extraction_score, importance_score
from memlake.functions.porter import stem
from memlake.operators import consolidate as K
from memlake.plans import pipelines as P
from memlake.schema import EMBEDDINGS, MEMORIES, normalize
from memlake.sources import files
from memlake.streaming import sessions as Z
from memlake.streaming import usage as U


@pytest.fixture(scope="module")
def engine(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"We decided to use tool{i % 3} because number {i} needs a stable order of things.", "knowledge", "proj:a", json.dumps({"session_id": f"s{i % 2}", "importance_score": 0.5}), 1.77e9 + i, 1.0) for i in range(1, 13)]
    m = spark.createDataFrame(rows, "id long, content string, memory_type string, tags string, metadata string, created_at double, strength double").withColumn("content_hash", C.content_hash(F.col("content")))
    v = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(1, 13)]
    v[1] = (2, v[0][1])
    e = spark.createDataFrame(v, EMBEDDINGS)
    m = normalize(m, MEMORIES).cache()
    h = {r.id: r.content_hash for r in m.select("id", "content_hash").collect()}
    g = spark.createDataFrame([(h[1], h[2], 0.9, "[]", None, 1.0, "related"), (h[2], h[99 % 12], 0.9, "[]", None, 1.0, "supports")], "source_hash string, target_hash string, similarity double, connection_types string, metadata string, created_at double, relationship_type string")
    return Engine(m, e, g)


def test_search_modes(engine):
    assert engine.search("tool1").count() == 4
    assert engine.search().count() == 10
    v = list(engine.embeddings.filter("rowid = 3").first()[1])
    assert engine.search("", "semantic", vec=v).first().id == 3
    assert engine.search("tool2", "exact", limit=2).count() == 2


def test_writes_and_snapshot(engine, spark, tmp_path):
    new = spark.createDataFrame([("ok.", "x", "", None), ("[Decision] keep the token = 'abcdefghijklmnop' rotated", None, "proj:b", None)], "content string, memory_type string, tags string, metadata string")
    stored = engine.store(new)
    row = stored.memories.filter("tags = 'proj:b'").first()
    assert stored.memories.count() == 13 and row.memory_type == "decision" and "REDACTED" in row.content
    assert engine.forget("s1").memories.count() == 6 and engine.forget("s1").embeddings.count() == 6
    one = engine.memories.filter("id = 3").select("content_hash")
    assert engine.delete(one).memories.filter(C.active()).count() == 11
    assert engine.delete(one, hard=True).embeddings.count() == 11
    assert engine.reinforce(engine.memories.filter("id = 3")).memories.filter("strength > 1.1").count() == 1
    version = engine.commit(f"file://{tmp_path}/snap")
    assert files.read_snapshot(spark, f"file://{tmp_path}/snap", "memories", version).count() == 12
    assert files.read_snapshot(spark, f"file://{tmp_path}/snap", "edges").count() == 2


def test_archive_round_trip(engine, spark, tmp_path):
    engine.export(f"file://{tmp_path}/a", "a")
    rows, links = files.read_archive(spark, f"file://{tmp_path}/a")
    assert rows.count() == 12 and links.count() == 2
    assert engine.import_(f"file://{tmp_path}/a").memories.count() == 12
    (tmp_path / "a" / "1" / "zz.txt").write_text("{broken\n")
    with pytest.raises(ValueError):
        files.read_archive(spark, f"file://{tmp_path}/a")


def test_consolidation_keeps_the_older(engine):
    m = engine.memories.withColumn("content", F.when(F.col("id") <= 2, "the very same words of one memory").otherwise(F.col("content")))
    e = Engine(m, engine.embeddings, engine.edges)
    plan = e.consolidate(dry_run=True, dim=8).collect()
    assert [(r.keep_id, r.remove_id) for r in plan] == [(1, 2)]
    after = {r.id: r for r in e.consolidate(dim=8).memories.collect()}
    assert after[2].deleted_at is not None and json.loads(after[2].metadata)["duplicate_of"] == "1" and after[1].deleted_at is None


def test_jsonl_and_transcripts(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": "t", "action": "search", "query_length": 3}\nnot json\n{"ts": "u", "action": "store"}\n')
    assert files.read_jsonl(spark, str(tmp_path / "log.jsonl")).count() == 2
    lines = [
        {"type": "user", "message": {"content": "hello"}},
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "Edit", "input": {}}]}},
        {"type": "summary", "message": {"content": "skip"}},
        {"type": "response_item", "payload": {"role": "assistant", "content": [{"type": "output_text", "text": "yo"}]}},
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n")
    got = [(r.role, r.content, r.tools) for r in files.read_transcripts(spark, str(tmp_path / "t.jsonl")).orderBy("pos").collect()]
    assert got == [("user", "hello", []), ("assistant", "hi", ["Edit"]), ("assistant", "yo", [])]


def test_import_graph(spark):
    rows = [("src/a.py", "import b\nfrom pkg.c import x\nimport os"), ("src/b.py", ""), ("src/c.py", "import a")]
    got = {tuple(r) for r in files.import_graph(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {("src/a.py", "src/b.py"), ("src/a.py", "src/c.py"), ("src/a.py", "os"), ("src/c.py", "src/a.py")}


#: Words and stems from the published description of the algorithm.
STEMS = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "sized": "size", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll"}


def test_porter():
    assert {w: stem(w) for w in STEMS} == STEMS


def test_importance(spark):
    want = {"ok": 0.3, "plain words of a note": 0.5, "see https://x.org/y": 0.7, "we decided it": 0.75, "undecided still": 0.5, "save this for later: x": 0.9, "restore this backup": 0.5, "save this token = 'abcdefghijklmnop'": 0.5, "you must not": 0.5, "unutmayalım bunu": 0.9, "": 0.3}
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in want], "c string").select("c", importance_score(F.col("c"))).collect()}
    assert got == want


def test_extraction_score(spark):
    got = spark.createDataFrame([("we chose kafka instead of redis because of order",), ("short",)], "c string").select(extraction_score(F.col("c"), "decision")).collect()
    assert [r[0] for r in got] == [3, -1]


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    return U.read_events(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)


def test_checkpoint_trigger(spark, tmp_path):
    rows = [("s", 10 * i) for i in range(16)] + [("t", 0), ("t", 5), ("t", 8), ("t", 700)]
    got = {tuple(r) for r in U.run_once(Z.checkpoint_flushes(_stream(spark, tmp_path, rows, "session_id string, sec long")), "x").collect()}
    assert got == {("s", 140, 15), ("t", 700, 3)}


def test_surfacing_limits(spark, tmp_path):
    rows = [("s", i * 20, f"m{i % 4}") for i in range(30)]
    got = sorted(tuple(r) for r in U.run_once(Z.surfacing(_stream(spark, tmp_path, rows, "session_id string, sec long, memory string")), "x").collect())
    assert len({m for *_, m in got}) == len(got) and all(b[1] - a[1] >= 60 for a, b in zip(got, got[1:]))


def test_token_budget(spark, tmp_path):
    from datetime import datetime

    rows = [("s", datetime(2026, 1, 1, 0, i), 4000) for i in range(10)]
    r = U.run_once(U.token_budgets(_stream(spark, tmp_path, rows, "session_id string, ts timestamp, content_length int"), 3500), "x", "update").first()
    assert (r.used, r.granted, r.refused) == (3000, 3, 7)


def test_lexical_contradiction(spark):
    rows = [("the cache of kafka is always enabled", "the cache of kafka is always disabled"), ("port number of kafka is 8080", "port number of kafka is 9090"), ("cats like milk", "dogs like bones")]
    got = spark.createDataFrame(rows, "a string, b string").select(K.lexical_contradiction(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [True, True, False]


def test_trigger_query():
    assert P.trigger_query("file", "/home/x/src/pkg/mod/file.py") == "pkg mod file.py"
    assert P.trigger_query("error", "e" * 300) == "e" * 200

"""Rules on texts and reports, on hand-made cases and against brute force."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.functions import extract as E
from memlake.functions import importance as I
from memlake.functions.porter import stem
from memlake.operators import consolidate as K
from memlake.operators import report as R
from memlake.operators import text as X
from memlake.operators import vector as V

IMPORTANCE = [
    ("", 0.30), ("ok", 0.30), ("tamam", 0.30), ("just some plain text", 0.50), ("we decided to ship on Friday", 0.75), ("şuna karar verdik: cron 60s", 0.75),
    ("contact me at foo@example.com or +905551234567", 0.70), ("see https://example.com/x/B", 0.70), ("remember this: never amend a merged commit", 0.90),
    ("lütfen not al: $0G launchı Mayıs", 0.90), ("hatırla, geçen sefer aynı hatayı yapmıştık", 0.90), ("save this for later: the prod endpoint", 0.90), ("sakla bunu: prod endpoint", 0.90),
    ("I must finish the audit this week", 0.75), ("bunu yapmak zorundayız, gerek var", 0.75), ("the invoice is due Friday", 0.70), ("son tarih Pazartesi, atlamayalım", 0.70),
    ("ping @alice about the rollout", 0.70), ("the budget is 50k for 500 users", 0.70), ("fixed in PR#123", 0.70), ("just chatting about the weather", 0.50),
    ("请把这个记住一下", 0.90), ("我们决定用 postgres", 0.75), ("decidimos usar postgres", 0.75), ("denk dran das morgen zu tun", 0.90),
    ("we'll see how it goes", 0.50), ("we'll see how it goes. We must migrate", 0.75), ("gerek yok", 0.50), ("gerek yok ama zorundayız", 0.75), ("risk yok, bunu yapmalıyız", 0.75), ("yapmamalıyız bunu", 0.50),
    ("we don't really have to do it", 0.50), ("the cost of the decision tree was undecided", 0.75), ("by the end of the book we laughed", 0.50), ("ready by the end of the week", 0.70), ("pazara kadar yürüdük", 0.50), ("cumaya kadar bitir", 0.70),
    ("save this token=abcdefghijklmnop", 0.50), ("I'll see you tomorrow", 0.75), ("restore this backup", 0.50), ("ihtimali var", 0.50), ("gracias", 0.30), ("مهم: تذكّر", 0.90), ("İSTANBUL: UNUTMA", 0.90),
    (None, 0.30), ("  ", 0.30), ("İSTANBUL: unutma", 0.90), ("we'll see how it " + "goes and goes " * 1300, 0.50), ("x" * 20_100 + " remember this", 0.50), ("x" * 20_100 + " token = 'abcdefghijklmnop'", 0.50),
]


def test_importance(spark):
    got = spark.createDataFrame(list(enumerate(c[0] for c in IMPORTANCE)), "k int, c string").select("k", I.importance_score(F.col("c")).alias("s")).collect()
    wrong = [(IMPORTANCE[r.k], r.s) for r in got if abs(r.s - IMPORTANCE[r.k][1]) > 1e-9]
    assert not wrong


@pytest.mark.parametrize("heuristic,secret,supplied,kind,want", [(0.5, False, None, "decision", 0.75), (0.9, False, 1.5, "note", 0.9), (0.5, False, 1.9, "note", 1.9), (0.9, True, 2.0, "decision", 0.5), (0.5, False, float("nan"), "gotcha", 0.7), (0.5, False, 0.4, None, 0.5)])
def test_final_importance(spark, heuristic, secret, supplied, kind, want):
    df = spark.createDataFrame([(heuristic, secret, supplied, kind)], "h double, s boolean, v double, t string")
    assert df.select(I.final_importance(F.col("h"), F.col("s"), F.col("v"), F.col("t"))).first()[0] == want


def test_context_windows(spark):
    text = "a" * 60 + " fixed the first thing here\n" + "b" * 300 + " resolved the second thing\nFIXED the first" + "c" * 20
    got = spark.createDataFrame([(text,), ("# Session Summary ## Decisions Made fixed all of it",), (None,), ("",)], "c string").select(E.context_windows(F.col("c"), E.family("error"))).collect()
    pattern = re.compile("(?i)(?:" + "|".join(E.X.FAMILIES["error"]) + ")")
    want = [text[max(0, m.start() - 50) : max(0, m.start() - 50) + 250].strip() for m in pattern.finditer(text)]
    assert list(got[0][0]) == want and len(want) == 3
    assert got[1][0] == [] and not got[2][0] and not got[3][0]


def test_checkpoint_passages(spark):
    text = "We decided to use kafka for the orders.\nBecause the old queue lost events in May.\nwe DECIDED to use kafka for the orders."
    got = spark.createDataFrame([(text,), ("[Decision] decided to use kafka for the orders",)], "c string").select(E.checkpoint_passages(F.col("c")).alias("p")).collect()
    assert [(r.passage, r.score) for r in got[0].p] == [("decided to use kafka for the orders.", 8), ("Because the old queue lost events in May.", 6)]
    assert got[1].p is None


def test_routes(spark):
    rows = [("what do you remember about redis", "hybrid"), ("tell me about the cache", "keyword"), ("it isn't what she likes", "hybrid"), ("which port", "hybrid"), ("Does Anna prefer tea", "keyword")]
    got = spark.createDataFrame(rows, "q string, want string").select(E.route(F.col("q")).alias("m"), "want").collect()
    assert all(r.m == r.want for r in got)
    weights = spark.createDataFrame([("is it ok",), ("fix the crash",), ("error in src/a.py with config API_KEY",)], "q string").select(E.lexical_weight(F.col("q"))).collect()
    assert [r[0] for r in weights] == [0.7, 0.6, 0.5]


def test_contradictions(spark):
    pairs = [("I use tabs here always", "I use spaces here always", 0.6), ("the port is 8080 for api", "the port is 9090 for api", 1.0), ("never use redis", "use redis", 0.6), ("a b", "c d", 0.0), ("", "", 0.0)]
    got = spark.createDataFrame(pairs, "a string, b string, want double").select(F.round(K.contradiction_score(F.col("a"), F.col("b")), 6).alias("s"), "want").collect()
    assert [r.s for r in got] == [r.want for r in got]


def test_plan_limit_and_breaker(spark):
    acted = spark.createDataFrame([(i, 1000 + i, 0.99, "dedup") for i in range(30)], "a long, b long, cosine double, action string")
    assert K.plan(acted, limit=10).count() == 10
    assert K.plan(acted, breaker=29).count() == 0 and K.plan(acted.limit(0)).count() == 0


def test_refilled_collapse(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 8))
    v = [(i, (base[i % 20] + 1e-3 * rng.normal(size=8)).tolist()) for i in range(200)]
    ranked = spark.createDataFrame([(i, 1.0 - i / 1000) for i in range(200)], "id long, score double")
    mem = spark.createDataFrame([(i, "note", "proj:a") for i in range(200)], "id long, memory_type string, tags string")
    got = {r.id: len(r.folded) for r in K.collapse_ranked(ranked, spark.createDataFrame(v, "id long, v array<double>"), mem, 20).collect()}
    assert got == {i: 9 for i in range(20)}


def test_quality_and_best(spark):
    texts = ["short", "Runs `make` in src/app.py v1.2 because it is quick", "x" * 600]
    got = spark.createDataFrame([(t,) for t in texts], "c string").select(K.quality(F.col("c"), F.lit(1))).collect()
    assert [r[0] for r in got] == [0.25, 1.0 if len(texts[1]) >= 200 else round(0.5 + 0.35 + 0.15, 2) if len(texts[1]) >= 50 else round(0.3 + 0.35 + 0.15, 2), 0.45]
    v = [(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, [0.0, 1.0])]
    c = spark.createDataFrame([("s", i, x) for i, x in v], "s string, id long, v array<double>")
    best = {r.id: r["size"] for r in K.refined(c, "s", spark.createDataFrame([(1, "plain text"), (2, "see src/app.py now"), (3, "other")], "id long, content string")).collect()}
    assert best == {2: 2, 3: 1}


def test_stemmed_search(spark):
    docs = ["caching queries quickly", "cached query", "nothing here", None, ""]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, content string")
    terms = {stem(t) for t in ("cache", "queries")}
    want = {i for i, d in enumerate(docs) if d and terms & {stem(t) for t in d.split()}}
    assert {r.id for r in X.bm25(df, "cache queries", stemmed=True).collect()} == want == {0, 1}


def test_bounds(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 1767225600.0)], "id long, created_at double")
    ids = lambda **b: {r.id for r in df.filter(X.within(**b)).collect()}
    assert ids() == ids(after="soon") == ids(before="2026-13-77") == {1, 2}
    assert ids(after="2026-01-01") == ids(after="2026-01-01T00:00:00+00:00") == ids(after=1767225600.0) == {2} and ids(before=10.0) == {1}


def test_sanitised_words():
    assert X.plain_query('root AND "cause" (x) near: c-- cache') == "root cause cache"


def test_importance_gap(spark):
    rows = [(1, "plain words", "decision", '{"importance_score": 0.9}'), (2, "remember this", "note", '{"importance_score": 0.9}'), (3, "token = 'abcdefghijklmnop'", "note", '{"importance_score": 1.9}'), (4, None, None, None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "id long, content string, memory_type string, metadata string, deleted_at double, valid_until string")
    got = {r.memory_type: (r.rows, r.high_value, r.secret, r.gap, r.generic) for r in R.importance_gap(df).collect()}
    assert got == {"decision": (1, 1, 0, 1, False), "note": (2, 2, 1, 0, True), "general": (1, 0, 0, 0, True)}


def test_percentiles_of_a_hot_key(spark):
    rng = np.random.default_rng(4)
    values = [("hot", float(x)) for x in rng.normal(size=3000)] + [("cold", 1.0), ("cold", 2.0), (None, 5.0), ("hot", float("nan")), ("hot", None)]
    got = {r.k: (r.p50, r.p95, r.p99) for r in R.percentiles(spark.createDataFrame(values, "k string, v double"), "k", "v").collect()}
    for key in ("hot", "cold", None):
        own = sorted(v for k, v in values if k == key and v is not None and not math.isnan(v))
        assert got[key] == tuple(own[min(int(len(own) * p), len(own) - 1)] for p in (0.5, 0.95, 0.99))


def test_pairs_in_many_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist(), "a" if i % 3 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g string")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if i % 3 and j % 3 and x[i] @ x[j] >= 0.4}
    for blocks in (1, 4):
        assert {(r.a, r.b) for r in V.block_pairs(df, 0.4, blocks, ["g"]).collect()} == want
    got = {(r.id, r.neighbor_id) for r in V.neighbours_of(df, df.filter("id < 9"), 2, -1.0, 3, ["g"]).collect()}
    best = lambda i: sorted((j for j in range(90) if j % 3 and j != i), key=lambda j: -(x[i] @ x[j]))[:2]
    assert got == {(i, j) for i in range(9) if i % 3 for j in best(i)}


def test_top_files_of_a_tree(spark, tmp_path):
    from memlake.sources import files

    tree = {"app/main.py": "import core\nimport os\nfrom util import x\n", "app/core.py": "from util import y\n", "app/util.py": "x = 1\n", "web/page.tsx": "import a from './core'\n", "node_modules/z.js": "require('util')", ".hidden/h.py": "import util", "notes.txt": "import util", "alone.py": "y = 2\n"}
    for path, text in tree.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = files.source_tree(spark, str(tmp_path))
    assert {r.path for r in got.collect()} == {"app/main.py", "app/core.py", "app/util.py", "web/page.tsx", "alone.py"}
    assert [r.path for r in files.top_files(got, 2).collect()] == ["app/util.py", "app/core.py"]
    assert files.top_files(got, 2, max_nodes=3).count() == 0 and files.top_files(got.limit(0)).count() == 0

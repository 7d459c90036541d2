"""Alerts, health, contradictions, consolidation, older fusion and other rules, each with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.functions import fixed as FX
from memlake.operators import consolidate as K
from memlake.operators import metrics as M
from memlake.operators import mutate as D
from memlake.operators import report as R
from memlake.operators import text as X
from memlake.operators import vector as V
from memlake.queries import sql as S
from memlake.queries.retrieval import BM25, LIVE_EMB, Q96, TERMS, edges, emb, mem, vectors, vectors64
from memlake.runtime import table
from memlake.schema import NOW

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def usage(s, d):
    return table(s, d, "usage_feedback")


# --- reports ---
add(
    "AG18_alerts",
    lambda s, d: R.alerts(usage(s, d)),
    """WITH u AS (SELECT coalesce(project, 'none') AS project, session_id, action_name AS a, has_metadata, has_tags, empty_result, result_count, latency_ms FROM usage_feedback),
    b AS (SELECT project, count(*) FILTER (a = 'store') AS stores, count(*) FILTER (a = 'search') AS searches, count(*) FILTER (a = 'quality') AS checks, count(*) FILTER (a = 'update') AS updates,
      count(*) FILTER (a = 'store' AND has_metadata) / nullif(count(*) FILTER (a = 'store'), 0) AS scope, count(*) FILTER (a = 'store' AND has_tags) / nullif(count(*) FILTER (a = 'store'), 0) AS tags,
      count(*) FILTER (a = 'search' AND empty_result) / nullif(count(*) FILTER (a = 'search'), 0) AS empty, avg(result_count) FILTER (a = 'search') AS results FROM u GROUP BY 1),
    p AS (SELECT project, count(*) AS sessions, count(*) FILTER (n >= 2) / count(*) AS refined FROM (SELECT project, session_id, count(*) AS n FROM u WHERE a = 'search' AND session_id <> '' GROUP BY 1, 2) GROUP BY 1),
    l AS (SELECT project, v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1] AS p95 FROM (SELECT project, list_sort(list(latency_ms)) AS v FROM u WHERE a = 'hook_retrieval' AND latency_ms > 0 GROUP BY 1)),
    j AS (SELECT * FROM b LEFT JOIN p USING (project) LEFT JOIN l USING (project))
    SELECT project, unnest(list_filter([CASE WHEN stores >= 3 AND scope < 0.5 THEN 'low_scope' END, CASE WHEN stores >= 3 AND tags < 0.5 THEN 'low_project_tags' END, CASE WHEN searches >= 5 AND empty > 0.4 THEN 'many_empty' END,
      CASE WHEN stores >= 10 AND checks = 0 THEN 'no_quality_checks' END, CASE WHEN stores >= 10 AND updates = 0 THEN 'no_updates' END, CASE WHEN sessions >= 5 AND refined > 0.6 THEN 'many_refinements' END,
      CASE WHEN searches >= 5 AND results < 1.5 THEN 'few_results' END, CASE WHEN p95 > 500 THEN 'slow' END], lambda x: x IS NOT NULL)) AS alert FROM j""",
)
_WEEK = f"epoch(ts) >= {NOW - 604800}"
add(
    "CMP10_health_report",
    lambda s, d: R.health(mem(s, d), edges(s, d), emb(s, d), usage(s, d)),
    f"""WITH live AS (SELECT * FROM memories WHERE deleted_at IS NULL), h AS (SELECT content_hash FROM live WHERE content_hash IS NOT NULL),
    a AS (SELECT coalesce(round_even(100.0 * count(*) FILTER ({S.num('updated_at')} < {NOW - 90 * 86400}) / count(*), 1), 0) AS stale_pct FROM live),
    o AS (SELECT count(*) FILTER (source_hash NOT IN (FROM h) OR target_hash NOT IN (FROM h)) AS orphans, round_even(100.0 * count(*) FILTER (source_hash NOT IN (FROM h) OR target_hash NOT IN (FROM h)) / greatest(count(*), 1), 1) AS orphan_pct FROM memory_graph),
    g AS (SELECT count(*) AS duplicate_groups FROM (SELECT substr(content, 1, 100) AS p FROM live GROUP BY 1 HAVING count(*) > 1)),
    w AS (SELECT * FROM usage_feedback WHERE {_WEEK}),
    l AS (SELECT coalesce(v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1], 0) AS p95_ms FROM (SELECT list_sort(list(latency_ms)) AS v FROM w WHERE action_name = 'hook_retrieval' AND latency_ms > 0)),
    e AS (SELECT coalesce(round_even(100.0 * count(*) FILTER (empty_result) / nullif(count(*), 0), 1), 0) AS empty_pct FROM w WHERE action_name = 'search'),
    s AS (SELECT coalesce(round_even(round(100.0 * count(*) FILTER (f = 0) / nullif(count(*), 0), 6), 1), 100.0) AS sufficiency_pct FROM (SELECT action_name, count(*) FILTER (action_name = 'search') OVER (PARTITION BY session_id ORDER BY epoch_ms(ts) // 1000 RANGE BETWEEN CURRENT ROW AND 120 FOLLOWING) AS f FROM w WHERE session_id IS NOT NULL AND (action_name <> 'hook_retrieval' OR result_count > 0)) WHERE action_name = 'hook_retrieval'),
    c AS (SELECT coalesce(round_even(round(100.0 * count(x) / count(*), 6), 1), 0) AS coverage_pct FROM live LEFT JOIN (SELECT DISTINCT m.rowid AS x FROM memory_embeddings m WHERE content_embedding IS NOT NULL) ON x = id),
    d AS (SELECT count(*) FILTER ({S.UNTIL} <= {NOW}) AS dormant FROM live),
    r AS (SELECT * FROM a, o, g, l, e, s, c, d)
    SELECT *, CAST(greatest(0, least(100, round_even(100 - (stale_pct / 100 * 30 + orphan_pct / 100 * 20 + least(duplicate_groups / 20.0, 1.0) * 20 + CASE WHEN p95_ms > 500 THEN 15 ELSE 0 END + CASE WHEN empty_pct > 40 THEN 15 ELSE 0 END), 0))) AS INTEGER) AS score,
      coalesce(nullif(array_to_string(list_filter([CASE WHEN stale_pct > 30 THEN 'stale' END, CASE WHEN orphans > 10 THEN 'orphans' END, CASE WHEN duplicate_groups > 5 THEN 'duplicates' END, CASE WHEN p95_ms > 500 THEN 'latency' END, CASE WHEN empty_pct > 40 THEN 'empty_searches' END,
        CASE WHEN sufficiency_pct < 60 THEN 'insufficient' END, CASE WHEN coverage_pct < 90 THEN 'coverage' END, CASE WHEN dormant > 20 THEN 'dormant' END], lambda x: x IS NOT NULL), ','), ''), 'healthy') AS recommendations FROM r""",
)
add("AG22_importance_gap", lambda s, d: R.importance_gap(mem(s, d)))

# --- search ---
_A, _B = "2025-09-01T00:00:00+00:00", "when it is ready"
add("FLT07_bounds", lambda s, d: mem(s, d).filter(X.within(_A, _B)).select("id", "created_at"), f"SELECT id, created_at FROM memories WHERE created_at >= epoch(TIMESTAMPTZ '{_A}')")
add(
    "TX11_sanitised",
    lambda s, d: mem(s, d).select("id", X.sanitize(F.col("content")).alias("query")),
    r"""SELECT id, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(replace(translate(content, '''";\/(){}*^:', ''), '--', ''), '\b(AND|OR|NOT|NEAR)\b', '', 'gi'), '[\t-\r\x{85}\p{Z}]+'), lambda w: length(w) > 1), lambda w: '"' || w || '"'), ' OR ') AS query FROM memories""",
)
add("SRC04_stemmed_search", lambda s, d: X.bm25(mem(s, d), "caching migrated queries", stemmed=True).select("id", F.round("bm25", 6).alias("bm25"), "matched"))
add(
    "SC10_older_hybrid",
    lambda s, d: X.legacy_hybrid(X.bm25(mem(s, d), TERMS), V.similarities(emb(s, d), Q96).groupBy("id").agg(F.max("cosine").alias("cosine")), 20, 0.6, 0.1).select("id", F.round("score", 6).alias("score")),
    f"""WITH l AS (SELECT * FROM {BM25} ORDER BY bm25 DESC, id LIMIT 60), v AS (SELECT id, max(cosine) AS c FROM {LIVE_EMB} GROUP BY 1),
    a AS (SELECT l.id, 0.6 / (1.0 + bm25) + 0.4 * greatest(coalesce(c, 0), 0) AS score FROM l LEFT JOIN v USING (id)), b AS (SELECT id, 0.4 * c * 0.8 AS score FROM v WHERE c > 0.1 AND id NOT IN (SELECT id FROM l) ORDER BY c DESC, id LIMIT 10)
    SELECT id, round(score, 6) AS score FROM (FROM a UNION ALL FROM b) ORDER BY score DESC, id LIMIT 20""",
)
add("TK10_probes", lambda s, d: X.probes(mem(s, d), 200, 13).select("id"), "SELECT id FROM memories ORDER BY md5(CAST(id AS VARCHAR) || '-13'), id LIMIT 200")
add("TK08_refilled_search", lambda s, d: K.collapse_ranked(V.semantic_search(emb(s, d), [float(x) for x in Q96], 300, 0.0).select("id", F.col("cosine").alias("score")), vectors(s, d), mem(s, d), 30).select("id", F.size("folded").alias("folded")))

# --- vectors ---
_M = f"(SELECT DISTINCT m.id, lower(memory_type) AS type, {S.PROJECT} AS project, content, created_at, content_hash, content_embedding::DOUBLE[] AS v FROM memories m JOIN memory_embeddings e ON e.rowid = m.id WHERE {S.ACTIVE} AND {S.vector('content_embedding', 96)})"
add(
    "VE08_nearest_same_label",
    lambda s, d: V.neighbours_of(vectors64(s, d), vectors64(s, d), 1, -1.0, same=["label"]).select("id", F.col("neighbor_id").alias("near"), F.round("cosine", 6).alias("cosine")),
    f"SELECT id, near, round(c, 6) AS cosine FROM (SELECT a.vec_id AS id, b.vec_id AS near, {S.cosine('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, near) = 1",
)
add(
    "VE20_topic_drift",
    lambda s, d: vectors(s, d).join(mem(s, d).filter(C.active()).select("id", C.project_tag().alias("project"), "created_at").filter("project is not null"), "id").withColumn("prev", F.lag("v").over(Window.partitionBy("project").orderBy("created_at", "id"))).filter("prev is not null").select("id", F.round(C.cosine(F.col("prev"), F.col("v")), 6).alias("drift"), (C.cosine(F.col("prev"), F.col("v")) < 0.55).alias("shift")),
    f"SELECT id, round(c, 6) AS drift, c < 0.55 AS shift FROM (SELECT id, {S.cosine('prev', 'v')} AS c FROM (SELECT id, v, lag(v) OVER (PARTITION BY project ORDER BY created_at, id) AS prev FROM {_M} WHERE project IS NOT NULL) WHERE prev IS NOT NULL)",
)
_W = lambda c: rf"list_filter(regexp_split_to_array({S.low(c)}, '[\t-\r\x{{85}}\p{{Z}}]+'), lambda w: w <> '')"
_DENY = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in K.DENY) + "]"


def _numbers(c: str) -> str:
    for p in K.DATES:
        c = f"regexp_replace({c}, {S.re2(p, False)}, '', 'g')"
    return f"list_sort(list_distinct(regexp_extract_all({c}, {S.re2(K.NUMBER, False)})))"


def _contradiction(a: str, b: str) -> str:
    """The score by words of the texts ``a`` and ``b`` of a row."""
    deny = lambda c: f"list_has_any({_W(c)}, {_DENY})"
    yes = lambda c: S.any_of(S.low(c), K.APPROVE)
    na, nb = _numbers(a), _numbers(b)
    left = lambda c, n: f"list_filter(list_distinct({_W(c)}), lambda w: NOT list_contains({_DENY}, w) AND NOT list_contains({n}, w))"
    swapped = f"NOT contains({a}, chr(10)) AND NOT contains({b}, chr(10)) AND len({_W(a)}) = len({_W(b)}) AND len({_W(a)}) BETWEEN 4 AND 20 AND len(list_filter(range(1, len({_W(a)}) + 1), lambda i: {_W(a)}[i] <> {_W(b)}[i])) = 1"
    return f"least(1.0, CASE WHEN ({deny(a)} AND {yes(b)}) OR ({deny(b)} AND {yes(a)}) THEN 0.4 ELSE 0 END + CASE WHEN {deny(a)} <> {deny(b)} THEN 0.2 ELSE 0 END + CASE WHEN len({na}) > 0 AND len({nb}) > 0 AND {na} <> {nb} AND len(list_intersect({left(a, na)}, {left(b, nb)})) >= 2 THEN 0.7 ELSE 0 END + CASE WHEN {swapped} THEN 0.6 ELSE 0 END)"


add(
    "VE17_lexical_contradictions",
    lambda s, d: (lambda m: table(s, d, "duplicate_sets").groupBy("set_id").agg(F.min("memory_id").alias("a"), F.max("memory_id").alias("b")).filter("a < b").join(m.toDF("a", "ca"), "a").join(m.toDF("b", "cb"), "b").select("set_id", F.round(K.contradiction_score(F.col("ca"), F.col("cb")), 6).alias("score")))(mem(s, d).select("id", "content")),
    f"SELECT set_id, CAST(round({_contradiction('x.content', 'y.content')}, 6) AS DOUBLE) AS score FROM (SELECT set_id, min(memory_id) AS a, max(memory_id) AS b FROM duplicate_sets GROUP BY 1 HAVING min(memory_id) < max(memory_id)) JOIN memories x ON x.id = a JOIN memories y ON y.id = b",
)
_KW = lambda c: rf"list_distinct(list_filter(regexp_split_to_array({S.low(c)}, '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+'), lambda x: x <> ''))"
_LIKE = f"a.type IN ('knowledge', 'learning', 'observation', 'general', 'error_fix', 'preference', 'progress') AND least(length(a.content), length(b.content)) / greatest(length(a.content), length(b.content)) >= 0.5 AND len(list_intersect({_KW('a.content')}, {_KW('b.content')})) >= 0.7 * (len({_KW('a.content')}) + len({_KW('b.content')}) - len(list_intersect({_KW('a.content')}, {_KW('b.content')})))"
_ACTED = f"(SELECT a.id AS a, b.id AS b, {S.cosine('a.v', 'b.v')} AS c, CASE WHEN {S.cosine('a.v', 'b.v')} >= 0.85 AND {_LIKE} THEN 'dedup' WHEN length(a.content) < 30 OR length(b.content) < 30 THEN 'merge_unverified' WHEN {_contradiction('a.content', 'b.content')} >= 0.5 THEN 'contradiction' ELSE 'merge' END AS action FROM {_M} a JOIN {_M} b ON a.id < b.id AND a.type = b.type AND a.project = b.project WHERE {S.cosine('a.v', 'b.v')} >= 0.6)"
# vectors of near-duplicates are less alike in the test data than the engine's thresholds ask
add("VE14_pair_actions", lambda s, d: K.actions(mem(s, d), vectors(s, d), dedup=0.85, merge=0.6).select("a", "b", "action"), f"SELECT a, b, action FROM {_ACTED}")
add(
    "CMP09_consolidation_plan",
    lambda s, d: K.plan(K.actions(mem(s, d), vectors(s, d), dedup=0.85, merge=0.6)),
    f"WITH d AS (SELECT a, b FROM {_ACTED} WHERE action = 'dedup' ORDER BY c DESC, a, b LIMIT 100), p AS (SELECT b AS remove_id, min(a) AS keep_id FROM d GROUP BY 1) SELECT keep_id, remove_id FROM p WHERE keep_id NOT IN (SELECT remove_id FROM p)",
)
add("VE12_greedy_groups", lambda s, d: K.refine(vectors(s, d).join(mem(s, d).select("id", C.project_tag().alias("project")).filter("project is not null"), "id"), "project", 0.8))
add("VE13_refined", lambda s, d: K.refined(vectors(s, d).join(mem(s, d).select("id", C.project_tag().alias("project")).filter("project is not null"), "id"), "project", mem(s, d), 0.8))
add(
    "VE13_quality",
    lambda s, d: mem(s, d).select("id", K.quality(F.col("content"), F.lit(2)).alias("quality")),
    "SELECT id, round(least(1.0, CASE WHEN length(content) < 20 THEN 0.1 WHEN length(content) < 50 THEN 0.3 WHEN length(content) < 200 THEN 0.5 WHEN length(content) < 500 THEN 0.4 ELSE 0.3 END + " + " + ".join(f"CASE WHEN {S.matches('content', p, False)} THEN {n} ELSE 0 END" for p, n in ((K.SPECIFIC[0][0], 0.1), (K.SPECIFIC[1][0], 0.1), (K.SPECIFIC[2][0], 0.05), (K.REASONS, 0.1))) + " + 0.05), 2)::DOUBLE AS quality FROM memories",
)
add(
    "VE18_new_contradictions",
    lambda s, d: K.new_contradictions(vectors(s, d).filter("id % 20 = 0").join(mem(s, d).select("id", "content"), "id").select((-F.col("id")).alias("key"), "content", "v"), vectors(s, d), mem(s, d), 5, 0.5),
    f"""WITH n AS (SELECT DISTINCT m.id, content, deleted_at IS NULL AS live, content_embedding::DOUBLE[] AS v FROM memories m JOIN memory_embeddings e ON e.rowid = m.id WHERE {S.vector('content_embedding', 96)}),
    k AS (SELECT -a.id AS key, b.id, a.content AS x, b.content AS y FROM n a JOIN n b ON b.live WHERE a.id % 20 = 0 AND {S.cosine('a.v', 'b.v')} >= 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {S.cosine('a.v', 'b.v')} DESC, b.id) <= 5)
    SELECT key, id, CAST(round({_contradiction('x', 'y')}, 6) AS DOUBLE) AS score FROM k WHERE round({_contradiction('x', 'y')}, 6) > 0.5""",
)
_TYPED = "(SELECT source_hash AS s, target_hash AS t FROM memory_graph WHERE relationship_type IN ('supports', 'contradicts') UNION SELECT target_hash, source_hash FROM memory_graph WHERE relationship_type IN ('supports', 'contradicts'))"


def _related(s, d):
    """Related edges of every twentieth row to its five nearest at 0.5 and more, but where the ends have a typed edge already."""
    hashes = mem(s, d).filter(C.active() & F.col("content_hash").isNotNull()).select("id", "content_hash")
    rows = vectors(s, d).join(hashes, "id")
    near = V.neighbours_of(rows, rows.filter("id % 20 = 0"), 5, 0.5)
    ends = near.join(hashes.toDF("id", "source_hash"), "id").join(hashes.toDF("neighbor_id", "target_hash"), "neighbor_id").filter("source_hash <> target_hash")
    typed = edges(s, d).filter("relationship_type in ('supports', 'contradicts')").select("source_hash", "target_hash")
    typed = typed.unionByName(typed.select(F.col("target_hash").alias("source_hash"), F.col("source_hash").alias("target_hash"))).distinct()
    return ends.join(typed, ["source_hash", "target_hash"], "left_anti").groupBy("source_hash", "target_hash").agg(F.round(F.max("cosine"), 6).alias("similarity"))


add(
    "GR06_related_edges",
    _related,
    f"SELECT s AS source_hash, t AS target_hash, round(max(c), 6) AS similarity FROM (SELECT a.content_hash AS s, b.content_hash AS t, {S.cosine('a.v', 'b.v')} AS c FROM {_M} a, {_M} b WHERE a.id % 20 = 0 AND a.id <> b.id AND a.content_hash IS NOT NULL AND b.content_hash IS NOT NULL AND {S.cosine('a.v', 'b.v')} >= 0.5 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {S.cosine('a.v', 'b.v')} DESC, b.id) <= 5) WHERE s <> t AND NOT EXISTS (FROM {_TYPED} x WHERE x.s = s AND x.t = t) GROUP BY 1, 2".replace("x.s = s AND x.t = t", "x.s = q.s AND x.t = q.t").replace(") WHERE s <> t AND", ") q WHERE q.s <> q.t AND"),
)

# --- regressions: the share of searches with results by project, the last 90 days against the time before ---
_CUT = NOW - 90 * 86400


def _hit_rate(rows):
    return rows.filter("action_name = 'search' and empty_result is not null").groupBy(F.coalesce("project", F.lit("none")).alias("metric")).agg(F.avg((~F.col("empty_result")).cast("double")).alias("value"))


add(
    "IR09_regressions",
    lambda s, d: M.regressions(_hit_rate(usage(s, d).filter(F.col("ts").cast("double") >= _CUT)), _hit_rate(usage(s, d).filter(F.col("ts").cast("double") < _CUT))).select("metric", F.round("before", 6).alias("before"), F.round("now", 6).alias("now")),
    f"WITH r AS (SELECT coalesce(project, 'none') AS metric, epoch(ts) >= {_CUT} AS late, avg(CASE WHEN empty_result THEN 0.0 ELSE 1.0 END) AS v FROM usage_feedback WHERE action_name = 'search' AND empty_result IS NOT NULL GROUP BY 1, 2) SELECT a.metric, round(a.v, 6) AS before, round(b.v, 6) AS now FROM r a JOIN r b ON a.metric = b.metric AND NOT a.late AND b.late WHERE a.v > 0 AND (a.v - b.v) / a.v > 0.05",
)

# --- merges ---
_PAIR = "(SELECT min(memory_id) AS keep_id, max(memory_id) AS remove_id FROM duplicate_sets GROUP BY set_id HAVING min(memory_id) < max(memory_id))"


def _merged(s, d):
    pairs = table(s, d, "duplicate_sets").groupBy("set_id").agg(F.min("memory_id").alias("keep_id"), F.max("memory_id").alias("remove_id")).select("keep_id", "remove_id")
    rows, links = D.resolve_merge(mem(s, d), edges(s, d), pairs)
    return rows.filter((F.col("updated_at") == NOW) | (F.col("deleted_at") == NOW)).select("id", F.md5("content").alias("text"), F.when(F.col("deleted_at") == NOW, F.lit(None)).otherwise(F.col("content_hash")).alias("content_hash"))


add(
    "DML16_resolved_merges",
    _merged,
    f"""WITH a AS (SELECT keep_id, min(remove_id) AS remove_id FROM {_PAIR} GROUP BY 1), b AS (SELECT min(keep_id) AS keep_id, remove_id FROM a GROUP BY 2), p AS (SELECT * FROM b WHERE keep_id NOT IN (SELECT remove_id FROM b)),
    k AS (SELECT keep_id, remove_id, regexp_replace(x.content, '[\\t-\\r\\x{{85}}\\p{{Z}}]+$', '') || chr(10) || '• [Merged from #' || remove_id || '] ' || {S.strip('y.content')} AS c, y.deleted_at AS gone, y.content AS other, y.content_hash AS oh, y.id FROM p JOIN memories x ON x.id = keep_id JOIN memories y ON y.id = remove_id)
    SELECT keep_id AS id, md5(c) AS text, sha256({S.low(S.strip('c'))}) AS content_hash FROM k UNION ALL SELECT remove_id, md5(other), NULL FROM k WHERE gone IS NULL""",
)

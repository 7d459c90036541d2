"""Further joins, windows, sets, merges and reports of the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.functions import extract as E
from memlake.operators import graph as G
from memlake.operators import mutate as D
from memlake.operators import report as R
from memlake.operators import text as X
from memlake.operators import vector as V
from memlake.queries import sql as S
from memlake.queries.retrieval import BM25, LIVE_EMB, Q96, TERMS, edges, emb, mem
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


def sets(s, d):
    return table(s, d, "duplicate_sets").distinct()


add("JN01_lexical_rows", lambda s, d: X.bm25(mem(s, d), TERMS).join(mem(s, d).filter(C.active()), "id").select("id", "memory_type", "matched"), f"SELECT m.id, memory_type, matched FROM {BM25} b JOIN memories m USING (id) WHERE {S.ACTIVE}")
add("JN02_rows_with_norms", lambda s, d: mem(s, d).filter(C.active()).join(emb(s, d).filter(C.usable_vector(F.col("content_embedding"), 96)).select(F.col("rowid").alias("id"), C.norm(F.col("content_embedding")).alias("n")).distinct(), "id").select("id", F.round("n", 5).alias("norm")), f"SELECT DISTINCT m.id, round(sqrt(list_dot_product(content_embedding::DOUBLE[], content_embedding::DOUBLE[])), 5) AS norm FROM memories m JOIN memory_embeddings e ON e.rowid = m.id WHERE {S.ACTIVE} AND {S.vector('content_embedding', 96)}")
add("JN05_missing_by_type", lambda s, d: mem(s, d).filter(C.active()).join(emb(s, d).select(F.col("rowid").alias("id")).distinct(), "id", "left_anti").groupBy(F.coalesce("memory_type", F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n")), f"SELECT coalesce(memory_type, 'none') AS kind, count(*) AS n FROM memories m LEFT JOIN (SELECT DISTINCT e.rowid AS e FROM memory_embeddings e) ON e = id WHERE {S.ACTIVE} AND e IS NULL GROUP BY 1")
add("JN06_orphan_vectors", lambda s, d: emb(s, d).select(F.col("rowid").alias("id")).distinct().join(mem(s, d).filter(C.active()).select("id"), "id", "left_anti"), f"SELECT DISTINCT e.rowid AS id FROM memory_embeddings e WHERE e.rowid NOT IN (SELECT id FROM memories WHERE {S.ACTIVE})")
add("JN07_rows_of_hits", lambda s, d: mem(s, d).join(X.bm25(mem(s, d), ("kafka",)).select("id"), "id", "left_semi").select("id"), f"SELECT id FROM memories WHERE list_contains({S.tokens('content')}, 'kafka')")
add("JN08_induced_by_project", lambda s, d: G.induced(edges(s, d), mem(s, d).filter(C.has_tag("proj:harborline")).select(F.col("content_hash").alias("hash")).dropna()).select("source_hash", "target_hash"), f"WITH n AS (SELECT content_hash FROM memories WHERE list_contains({S.TAGS}, 'proj:harborline') AND content_hash IS NOT NULL) SELECT source_hash, target_hash FROM memory_graph WHERE source_hash IN (FROM n) AND target_hash IN (FROM n)")
add(
    "WN01_best_of_two_paths",
    lambda s, d: X.fuse(X.bm25(mem(s, d), TERMS).select("id", X.relevance(F.col("bm25")).alias("lexical")), V.semantic_search(emb(s, d), Q96, 200, 0.1).select("id", F.col("cosine").alias("semantic"))).select("id", F.round("relevance", 6).alias("relevance")),
    f"WITH l AS (SELECT id, least(bm25 / 20.0, 1.0) AS l FROM {BM25}), s AS (SELECT id, cosine AS s FROM {LIVE_EMB} WHERE cosine > 0.1 ORDER BY cosine DESC, id LIMIT 200) SELECT coalesce(l.id, s.id) AS id, round(CASE WHEN l IS NOT NULL AND s IS NOT NULL THEN least(1.0, greatest(l, s) + 0.3 * least(l, s)) ELSE coalesce(l, s) END, 6) AS relevance FROM l FULL JOIN s ON l.id = s.id",
)
add(
    "WN02_rank_in_project",
    lambda s, d: mem(s, d).filter(C.active()).select("id", C.project_tag().alias("p"), F.round(C.unified_score(F.lit(0.5)), 6).alias("score")).filter("p is not null").withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("score"), "id"))).filter("k <= 3").select("p", "id", "k"),
    f"SELECT p, id, row_number() OVER (PARTITION BY p ORDER BY score DESC, id) AS k FROM (SELECT id, {S.PROJECT} AS p, round({S.score('0.5')}, 6) AS score FROM memories WHERE {S.ACTIVE}) WHERE p IS NOT NULL QUALIFY k <= 3",
)
add(
    "SET02_candidate_sources",
    lambda s, d: X.exact(mem(s, d), "root cause").select("id", F.lit("exact").alias("source")).unionByName(X.bm25(mem(s, d), ("kafka",)).select("id", F.lit("words").alias("source"))).unionByName(mem(s, d).orderBy(F.desc("created_at"), F.desc("id")).limit(30).select("id", F.lit("recent").alias("source"))).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")),
    f"SELECT id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM (SELECT id, 'exact' AS source FROM memories WHERE content ILIKE '%root cause%' UNION ALL SELECT id, 'words' FROM memories WHERE list_contains({S.tokens('content')}, 'kafka') UNION ALL (SELECT id, 'recent' FROM memories ORDER BY created_at DESC, id DESC LIMIT 30)) GROUP BY 1",
)
_SP = "(SELECT set_id, min(memory_id) AS x, max(memory_id) AS y FROM duplicate_sets GROUP BY 1 HAVING min(memory_id) < max(memory_id))"
add(
    "SET06_jaccard",
    lambda s, d: (lambda m: sets(s, d).groupBy("set_id").agg(F.min("memory_id").alias("x"), F.max("memory_id").alias("y")).filter("x < y").join(m.toDF("x", "tx"), "x").join(m.toDF("y", "ty"), "y").select("set_id", F.round(F.size(F.array_intersect("tx", "ty")) / F.size(F.array_union("tx", "ty")), 6).alias("jaccard")))(mem(s, d).select("id", X.tokens(F.col("content")))),
    f"WITH t AS (SELECT id, {S.tokens('content')} AS t FROM memories) SELECT set_id, round(len(list_intersect(list_distinct(a.t), list_distinct(b.t))) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM {_SP} JOIN t a ON a.id = x JOIN t b ON b.id = y",
)
add(
    "TX14_display_limit",
    lambda s, d: usage(s, d).filter("query_text is not null").select("query_text", F.when(F.lower("query_text").rlike(r"\b(remember|recall|hatırla)\b"), 8).otherwise(5).alias("shown"), F.ceil(F.length("query_text") * 0.25).alias("tokens")).distinct(),
    r"SELECT DISTINCT query_text, CASE WHEN regexp_matches(lower(query_text), '\b(remember|recall|hatırla)\b') THEN 8 ELSE 5 END AS shown, CAST(ceil(length(query_text) * 0.25) AS BIGINT) AS tokens FROM usage_feedback WHERE query_text IS NOT NULL",
)
_SUM = "(CASE WHEN {c} IS NULL THEN 'none' WHEN lower(trim({c})) IN ('', 'unknown', 'none', 'null', 'undefined', 'default') THEN 'unusable' WHEN length({c}) <= 12 THEN 'short' ELSE 'full' END)"
add(
    "AG23_identity_audit",
    lambda s, d: (lambda c: mem(s, d).filter(F.lower("memory_type") == "session_summary").groupBy(F.when(c.isNull(), "none").when(~C.usable_id(c), "unusable").when(F.length(c) <= 12, "short").otherwise("full").alias("identity"), C.active().alias("live")).agg(F.count(F.lit(1)).alias("n")))(C.json_string("session_id")),
    f"SELECT {_SUM.replace('{c}', '(' + S.J + chr(32) + '->>' + chr(32) + chr(39) + '$.session_id' + chr(39) + ')')} AS identity, {S.ACTIVE} AS live, count(*) AS n FROM memories WHERE lower(memory_type) = 'session_summary' GROUP BY 1, 2",
)
add(
    "SC09_summary_richness",
    lambda s, d: mem(s, d).select("id", F.least(1.0 + 0.25 * sum((F.contains("content", F.lit(m)).cast("int") for m in E.SUMMARY_MARKERS), F.lit(0)), F.lit(2.0)).alias("importance")),
    "SELECT id, least(1.0 + 0.25 * (" + " + ".join(f"CAST(contains(content, '{m}') AS INTEGER)" for m in E.SUMMARY_MARKERS) + "), 2.0)::DOUBLE AS importance FROM memories",
)
add(
    "GR10_open_contradictions",
    lambda s, d: (lambda m: edges(s, d).filter("relationship_type = 'contradicts'").join(m.toDF("source_hash", "a"), "source_hash").join(m.toDF("target_hash", "b"), "target_hash").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())(mem(s, d).filter(C.active() & F.col("content_hash").isNotNull()).select("content_hash", "id")),
    f"SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM memory_graph g JOIN memories x ON x.content_hash = source_hash AND x.{S.ACTIVE} JOIN memories y ON y.content_hash = target_hash AND y.{S.ACTIVE} WHERE relationship_type = 'contradicts'",
)
add(
    "DML03_merge_or_insert",
    lambda s, d: (lambda q: D.merge_or_insert(q.select("key", "content_hash"), q.select("key", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("cosine")), mem(s, d)))(table(s, d, "ingest_queue").filter("content_hash is not null").select(F.col("content_hash").alias("key"), "content_hash").distinct()),
    f"SELECT q.key, CASE WHEN g = 0 THEN 'noop' WHEN g = 1 THEN 'revive' ELSE 'insert' END AS action, coalesce(id, -1) AS target_id FROM (SELECT DISTINCT content_hash AS key FROM ingest_queue WHERE content_hash IS NOT NULL) q LEFT JOIN (SELECT content_hash, CASE WHEN {S.LIVE} THEN 0 ELSE 1 END AS g, id FROM memories WHERE content_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY g, id) = 1) m ON m.content_hash = q.key",
)
add(
    "DML14_merged_groups",
    lambda s, d: D.merge_groups(mem(s, d), sets(s, d).select(F.col("set_id").alias("group_id"), F.col("memory_id").alias("id"))).select("group_id", "base_id", "tags", "strength", F.size("merged_from").alias("merged")),
    f"""WITH r AS (SELECT set_id AS group_id, id, {S.STRENGTH} AS st, {S.TAGS} AS t FROM (SELECT DISTINCT set_id, memory_id FROM duplicate_sets) JOIN memories ON id = memory_id WHERE {S.ACTIVE}),
    b AS (SELECT group_id, id AS base_id FROM r QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY st DESC, id) = 1)
    SELECT group_id, base_id, coalesce(array_to_string(list_sort(list_distinct(flatten(list(t)))), ','), '') AS tags, round(least(sum(st), 5.0), 6) AS strength, CAST(count(*) - 1 AS INTEGER) AS merged FROM r JOIN b USING (group_id) GROUP BY 1, 2""",
)
add(
    "DML24_flagged",
    lambda s, d: D.flag_contradictions(edges(s, d), edges(s, d).filter("relationship_type = 'supports'").select("source_hash", "target_hash")).groupBy("relationship_type").agg(F.count(F.lit(1)).alias("n")),
    "WITH p AS (SELECT DISTINCT least(source_hash, target_hash) AS a, greatest(source_hash, target_hash) AS b FROM memory_graph WHERE relationship_type = 'supports' AND source_hash <> target_hash), h AS (SELECT DISTINCT least(source_hash, target_hash) AS a, greatest(source_hash, target_hash) AS b FROM memory_graph WHERE relationship_type = 'contradicts') SELECT relationship_type, count(*) AS n FROM (SELECT relationship_type FROM memory_graph UNION ALL SELECT 'contradicts' FROM p ANTI JOIN h USING (a, b)) GROUP BY 1",
)
add("PI03_scrubbed_metadata", lambda s, d: mem(s, d).select("id", F.coalesce(E.scrub(F.col("metadata")), F.lit("")).alias("metadata")).filter(F.try_parse_json("metadata").isNotNull()).groupBy(F.length("metadata").alias("chars")).agg(F.count(F.lit(1)).alias("n")), "SELECT length(metadata) AS chars, count(*) AS n FROM memories WHERE json_valid(metadata) GROUP BY 1")
add("ST12_rotated_log", lambda s, d: usage(s, d).select(F.unix_micros("logged_at").alias("us"), "action_name").groupBy("us", "action_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("us"), "action_name").limit(500), "SELECT epoch_us(logged_at) AS us, action_name, count(*) AS n FROM usage_feedback GROUP BY 1, 2 ORDER BY us DESC, action_name LIMIT 500")
add(
    "CMP08_proactive_recall",
    lambda s, d: V.semantic_search(emb(s, d), Q96, 3, 0.15, skip=sets(s, d).select(F.col("memory_id").alias("id"))).select("id", F.round("cosine", 6).alias("cosine")),
    f"SELECT id, round(cosine, 6) AS cosine FROM {LIVE_EMB} WHERE cosine > 0.15 AND id NOT IN (SELECT memory_id FROM duplicate_sets) ORDER BY cosine DESC, id LIMIT 3",
)
add(
    "CMP11_quick_health",
    lambda s, d: R.global_counts(mem(s, d), edges(s, d), emb(s, d)).crossJoin(R.stale(mem(s, d), NOW)),
    f"SELECT * FROM (SELECT count(*) FILTER ({S.ACTIVE}) AS active, count(*) FILTER (deleted_at IS NOT NULL) AS deleted FROM memories), (SELECT count(*) AS edges FROM memory_graph), (SELECT count(DISTINCT e.rowid) AS vectors FROM memory_embeddings e), (SELECT count(*) FILTER ({S.num('updated_at')} < {NOW - 90 * 86400}) AS stale_90d, count(*) FILTER (coalesce({S.num('last_accessed_at')}, created_at) < {NOW - 30 * 86400}) AS unread_30d FROM memories WHERE {S.ACTIVE})",
)
add(
    "CMP12_quality_audit",
    lambda s, d: R.coverage(mem(s, d), emb(s, d), NOW).select("percent").crossJoin(G.orphans(edges(s, d), mem(s, d).filter(C.active()).select(F.col("content_hash").alias("hash"))).agg(F.count(F.lit(1)).alias("orphan_edges"))).crossJoin(mem(s, d).agg(F.count(F.when(F.col("metadata").isNotNull() & F.try_parse_json("metadata").isNull(), 1)).alias("broken_metadata"))),
    f"SELECT * FROM (SELECT round(100.0 * count(e) / count(*), 6) AS percent FROM memories LEFT JOIN (SELECT DISTINCT x.rowid AS e FROM memory_embeddings x WHERE content_embedding IS NOT NULL) ON e = id WHERE {S.ACTIVE}), (SELECT count(*) AS orphan_edges FROM memory_graph WHERE source_hash NOT IN (SELECT content_hash FROM memories WHERE {S.ACTIVE} AND content_hash IS NOT NULL) OR target_hash NOT IN (SELECT content_hash FROM memories WHERE {S.ACTIVE} AND content_hash IS NOT NULL)), (SELECT count(*) FILTER (metadata IS NOT NULL AND NOT json_valid(metadata)) AS broken_metadata FROM memories)",
)

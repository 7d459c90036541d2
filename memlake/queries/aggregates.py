"""Aggregations, windows, top-k and set operations (AG, WN, TK, SET) and the reports built of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.operators import report as R
from memlake.queries import sql as S
from memlake.runtime import table
from memlake.schema import NOW

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def mem(s, d):
    return table(s, d, "memories")


def edges(s, d):
    return table(s, d, "memory_graph")


def usage(s, d):
    return table(s, d, "usage_feedback")


def emb(s, d):
    return table(s, d, "memory_embeddings")


add(
    "AG01_global_counts",
    lambda s, d: R.global_counts(mem(s, d), edges(s, d), emb(s, d)),
    f"SELECT * FROM (SELECT count(*) FILTER ({S.ACTIVE}) AS active, count(*) FILTER (deleted_at IS NOT NULL) AS deleted FROM memories), (SELECT count(*) AS edges FROM memory_graph), (SELECT count(DISTINCT e.rowid) AS vectors FROM memory_embeddings e)",
)
add("AG02_by_type", lambda s, d: R.by_type(mem(s, d)), f"SELECT coalesce(memory_type, 'general') AS memory_type, count(*) AS n FROM memories WHERE {S.ACTIVE} GROUP BY 1")
add("AG03_by_edge_type", lambda s, d: edges(s, d).groupBy(F.lower(F.trim("relationship_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n")), "SELECT lower(trim(relationship_type)) AS kind, count(*) AS n FROM memory_graph GROUP BY 1")
add(
    "AG04_quality_stats",
    lambda s, d: R.json_stats(mem(s, d).filter(C.active()), "credibility"),
    f"SELECT count(v) AS n, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS most FROM (SELECT {S.json_number('credibility')} AS v FROM memories WHERE {S.ACTIVE})",
)
add(
    "AG05_hash_lists",
    lambda s, d: mem(s, d).filter(C.active() & F.col("content_hash").isNotNull()).groupBy("memory_type").agg(F.array_join(F.array_sort(F.collect_list(F.substring("content_hash", 1, 8))), ", ").alias("hashes")),
    f"SELECT memory_type, string_agg(substr(content_hash, 1, 8), ', ' ORDER BY substr(content_hash, 1, 8)) AS hashes FROM memories WHERE {S.ACTIVE} AND content_hash IS NOT NULL GROUP BY 1",
)
add(
    "AG06_prefix_duplicates",
    lambda s, d: mem(s, d).filter(C.active()).groupBy(F.substring("content", 1, 100).alias("head")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
    f"SELECT substr(content, 1, 100) AS head, count(*) AS n FROM memories WHERE {S.ACTIVE} GROUP BY 1 HAVING count(*) > 1",
)
add(
    "AG07_strength_histogram",
    lambda s, d: R.histogram(mem(s, d).filter(C.active()), C.number(F.col("strength")), 0.5, 10),
    f"SELECT CAST(b AS INTEGER) AS bin, count(x) AS n FROM range(10) r(b) LEFT JOIN (SELECT least(greatest(CAST(trunc({S.num('strength')} / 0.5) AS BIGINT), 0), 9) AS x FROM memories WHERE {S.ACTIVE} AND {S.num('strength')} IS NOT NULL) ON x = b GROUP BY 1",
)
add("AG08_tag_cloud", lambda s, d: R.tag_cloud(mem(s, d).filter(C.active())), f"SELECT tag, count(*) AS n FROM (SELECT unnest({S.TAGS}) AS tag FROM memories WHERE {S.ACTIVE}) GROUP BY 1 ORDER BY n DESC, tag LIMIT 50")
add(
    "AG09_project_distribution",
    lambda s, d: R.tag_cloud(mem(s, d).filter(C.active()), "proj:", 20),
    f"SELECT tag, count(*) AS n FROM (SELECT unnest({S.TAGS}) AS tag FROM memories WHERE {S.ACTIVE}) WHERE starts_with(tag, 'proj:') GROUP BY 1 ORDER BY n DESC, tag LIMIT 20",
)
add(
    "AG10_topic_projects",
    lambda s, d: R.topic_projects(mem(s, d).filter(C.active())),
    f"SELECT t AS topic, p AS project, count(DISTINCT id) AS n FROM (SELECT id, unnest({S.TAGS}) AS t, {S.PROJECT} AS p FROM memories WHERE {S.ACTIVE}) WHERE starts_with(t, 'topic:') AND p IS NOT NULL GROUP BY 1, 2",
)
add(
    "AG11_daily_activity",
    lambda s, d: usage(s, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "action_name").agg(F.count(F.lit(1)).alias("n")),
    "SELECT strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%d') AS day, action_name, count(*) AS n FROM usage_feedback GROUP BY 1, 2",
)
add(
    "AG12_weekly_growth",
    lambda s, d: R.weekly(mem(s, d), NOW, 4),
    f"SELECT w AS week, count(created_at) AS n, CAST(trunc(avg(count(created_at)) OVER () * 26) AS BIGINT) AS in_26_weeks FROM (SELECT CAST(r AS INTEGER) AS w FROM range(4) t(r)) LEFT JOIN memories ON floor(({NOW} - created_at) / 604800) = w GROUP BY 1",
)
add(
    "AG13_importance_tiers",
    lambda s, d: mem(s, d).groupBy(F.when(C.importance() >= 0.9, "memorable").when(C.importance() >= 0.75, "decision").when(C.importance() >= 0.6, "fact").otherwise("baseline").alias("tier")).agg(F.count(F.lit(1)).alias("n")),
    f"SELECT CASE WHEN {S.IMP} >= 0.9 THEN 'memorable' WHEN {S.IMP} >= 0.75 THEN 'decision' WHEN {S.IMP} >= 0.6 THEN 'fact' ELSE 'baseline' END AS tier, count(*) AS n FROM memories GROUP BY 1",
)
add(
    "AG14_lifecycle",
    lambda s, d: R.lifecycle(mem(s, d), NOW),
    f"SELECT count(*) FILTER ({S.ACTIVE} AND created_at >= {NOW - 604800}) AS fresh, count(*) FILTER ({S.ACTIVE} AND {S.STRENGTH} < 1.0 AND coalesce({S.num('last_accessed_at')}, {S.num('created_at')}) < {NOW - 604800}) AS decayed, count(*) FILTER ({S.ACTIVE} AND {S.UNTIL} <= {NOW}) AS dormant, count(*) FILTER (deleted_at >= {NOW - 604800}) AS deleted FROM memories",
)
add(
    "AG15_stale",
    lambda s, d: R.stale(mem(s, d), NOW),
    f"SELECT count(*) FILTER ({S.num('updated_at')} < {NOW - 90 * 86400}) AS stale_90d, count(*) FILTER (coalesce({S.num('last_accessed_at')}, created_at) < {NOW - 30 * 86400}) AS unread_30d FROM memories WHERE {S.ACTIVE}",
)
add(
    "AG16_latency_percentiles",
    lambda s, d: R.percentiles(usage(s, d).filter("latency_ms >= 0"), "action_name", "latency_ms"),
    "SELECT action_name, l[CAST(least(floor(len(l) * 0.50), len(l) - 1) AS BIGINT) + 1] AS p50, l[CAST(least(floor(len(l) * 0.95), len(l) - 1) AS BIGINT) + 1] AS p95, l[CAST(least(floor(len(l) * 0.99), len(l) - 1) AS BIGINT) + 1] AS p99 FROM (SELECT action_name, list_sort(list(latency_ms)) AS l FROM usage_feedback WHERE latency_ms >= 0 AND NOT isnan(latency_ms) GROUP BY 1)",
)
add(
    "AG17_digest_ratios",
    lambda s, d: R.digest(usage(s, d)),
    """WITH u AS (SELECT coalesce(project, 'none') AS project, session_id, action_name, result_count, empty_result, has_metadata, has_tags, query_text FROM usage_feedback),
    per AS (SELECT project, session_id, count(*) FILTER (action_name = 'search') AS searches FROM u GROUP BY 1, 2),
    ref AS (SELECT project, count(*) FILTER (searches >= 2) AS refined, count(*) FILTER (searches >= 1) AS searching FROM per GROUP BY 1)
    SELECT project, count(*) AS ops, round(avg(CASE WHEN action_name = 'store' THEN CAST(has_metadata AS INTEGER) END), 6) AS metadata_rate, round(avg(CASE WHEN action_name = 'store' THEN CAST(has_tags AS INTEGER) END), 6) AS tag_rate,
      round(avg(CASE WHEN action_name = 'search' THEN CAST(empty_result AS INTEGER) END), 6) AS empty_rate, round(avg(CASE WHEN action_name = 'search' THEN result_count END), 6) AS mean_results,
      round(any_value(refined) / nullif(any_value(searching), 0), 6) AS refinement_rate
    FROM u JOIN ref USING (project) GROUP BY 1""",
)
add(
    "AG17_repeated_queries",
    lambda s, d: usage(s, d).filter("query_text is not null").groupBy(F.lower(C.strip(F.col("query_text"))).alias("query")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2"),
    r"SELECT lower(regexp_replace(query_text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS query, count(*) AS n FROM usage_feedback WHERE query_text IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
)
add(
    "AG20_sufficiency",
    lambda s, d: R.sufficiency(usage(s, d), 120),
    """SELECT count(*) AS retrievals, count(*) FILTER (followed = 0) AS sufficient, round(100.0 * count(*) FILTER (followed = 0) / count(*), 6) AS percent FROM (
    SELECT action_name, count(*) FILTER (action_name = 'search') OVER (PARTITION BY session_id ORDER BY epoch_ms(ts) // 1000 RANGE BETWEEN CURRENT ROW AND 120 FOLLOWING) AS followed FROM usage_feedback WHERE session_id IS NOT NULL) WHERE action_name = 'hook_retrieval'""",
)
add(
    "AG21_status",
    lambda s, d: mem(s, d).filter(C.active()).agg(F.countDistinct(C.project_tag()).alias("projects"), F.round(F.avg(C.number(F.col("strength"))), 6).alias("mean_strength"), F.max("created_at").alias("last_stored")),
    f"SELECT count(DISTINCT {S.PROJECT}) AS projects, round(avg({S.num('strength')}), 6) AS mean_strength, max(created_at) AS last_stored FROM memories WHERE {S.ACTIVE}",
)
add(
    "AG24_vector_coverage",
    lambda s, d: R.coverage(mem(s, d), emb(s, d), NOW),
    f"SELECT count(*) AS rows_active, count(e) AS covered, round(100.0 * count(e) / count(*), 6) AS percent, count(*) FILTER (e IS NULL AND created_at < {NOW - 3600}) AS old_gaps FROM memories LEFT JOIN (SELECT DISTINCT x.rowid AS e FROM memory_embeddings x WHERE content_embedding IS NOT NULL) ON e = id WHERE {S.ACTIVE}",
)
add(
    "AG25_running_tokens",
    lambda s, d: usage(s, d).filter("content_length is not null and session_id is not null").select("session_id", F.unix_micros("ts").alias("us"), F.ceil(F.col("content_length") * 0.25).alias("t")).groupBy("session_id", "us").agg(F.sum("t").alias("t")).select("session_id", "us", F.sum("t").over(Window.partitionBy("session_id").orderBy("us")).alias("used")),
    "SELECT session_id, us, CAST(sum(t) OVER (PARTITION BY session_id ORDER BY us) AS BIGINT) AS used FROM (SELECT session_id, epoch_us(ts) AS us, sum(ceil(content_length * 0.25)) AS t FROM usage_feedback WHERE content_length IS NOT NULL AND session_id IS NOT NULL GROUP BY 1, 2)",
)
add(
    "AG26_corpus_counts",
    lambda s, d: (lambda m: m.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("id"))).groupBy("label", F.when(F.pmod(F.col("k") - 1, F.lit(5)) == 4, "test").otherwise("train").alias("split")).agg(F.count(F.lit(1)).alias("n")))(
        mem(s, d).filter(F.length("content").between(50, 2000)).select("id", F.lower("memory_type").alias("label")).dropna()
    ),
    "SELECT label, CASE WHEN (k - 1) % 5 = 4 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM (SELECT lower(memory_type) AS label, row_number() OVER (PARTITION BY lower(memory_type) ORDER BY id) AS k FROM memories WHERE length(content) BETWEEN 50 AND 2000 AND memory_type IS NOT NULL) GROUP BY 1, 2",
)
add(
    "AG27_session_stats",
    lambda s, d: usage(s, d).filter("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), F.array_join(F.array_sort(F.collect_set("action_name")), ",").alias("actions"), F.count(F.when(F.col("action_name") == "store", 1)).alias("stores"), F.count(F.when(F.col("action_name") == "search", 1)).alias("searches")),
    "SELECT session_id, count(*) AS events, array_to_string(list_sort(list(DISTINCT action_name)), ',') AS actions, count(*) FILTER (action_name = 'store') AS stores, count(*) FILTER (action_name = 'search') AS searches FROM usage_feedback WHERE session_id IS NOT NULL GROUP BY 1",
)
add(
    "AG28_session_midpoint",
    lambda s, d: mem(s, d).withColumn("sid", C.json_string("session_id")).filter("sid is not null").groupBy("sid").agg(F.min("created_at").alias("a"), F.max("created_at").alias("b")).select("sid", F.round((F.col("a") + F.col("b")) / 2, 3).alias("midpoint")),
    f"SELECT sid, round((min(created_at) + max(created_at)) / 2, 3) AS midpoint FROM (SELECT {S.J} ->> '$.session_id' AS sid, created_at FROM memories) WHERE sid IS NOT NULL GROUP BY 1",
)

# --- windows ---
add(
    "WN03_budget_prefix",
    lambda s, d: R.budget_prefix(mem(s, d).filter(C.has_tag("proj:harborline") & C.active()), 4000, F.desc("created_at"), F.asc("id")).select("id", "used_chars"),
    f"SELECT id, CAST(used AS BIGINT) AS used_chars FROM (SELECT id, sum(length(content)) OVER (ORDER BY created_at DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM memories WHERE list_contains({S.TAGS}, 'proj:harborline') AND {S.ACTIVE}) WHERE used <= 4000",
)
add(
    "WN04_first_by_prefix",
    lambda s, d: mem(s, d).filter(C.active()).withColumn("k", F.row_number().over(Window.partitionBy(F.substring("content", 1, 80)).orderBy("id"))).filter("k = 1").orderBy("id").limit(50).select("id"),
    f"SELECT id FROM memories WHERE {S.ACTIVE} QUALIFY row_number() OVER (PARTITION BY substr(content, 1, 80) ORDER BY id) = 1 ORDER BY id LIMIT 50",
)
add(
    "WN05_search_sequence",
    lambda s, d: usage(s, d).filter("action_name = 'search' and session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("searches"), F.max("search_seq").alias("last_seq"), (F.count(F.lit(1)) >= 2).alias("refined")),
    "SELECT session_id, count(*) AS searches, max(search_seq) AS last_seq, count(*) >= 2 AS refined FROM usage_feedback WHERE action_name = 'search' AND session_id IS NOT NULL GROUP BY 1",
)
add(
    "WN06_last_sessions",
    lambda s, d: usage(s, d).filter("project is not null and session_id is not null").groupBy("project", "session_id").agg(F.max(F.unix_micros("ts")).alias("us")).withColumn("k", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("us"), "session_id"))).filter("k <= 5").select("project", "session_id", "k"),
    "SELECT project, session_id, k FROM (SELECT project, session_id, row_number() OVER (PARTITION BY project ORDER BY max(epoch_us(ts)) DESC, session_id) AS k FROM usage_feedback WHERE project IS NOT NULL AND session_id IS NOT NULL GROUP BY 1, 2) WHERE k <= 5",
)
add(
    "WN08_every_fifth",
    lambda s, d: mem(s, d).filter("memory_type is not null").withColumn("k", F.row_number().over(Window.partitionBy("memory_type").orderBy("id"))).filter(F.pmod(F.col("k") - 1, F.lit(5)) == 4).select("id"),
    "SELECT id FROM memories WHERE memory_type IS NOT NULL QUALIFY (row_number() OVER (PARTITION BY memory_type ORDER BY id) - 1) % 5 = 4",
)
add(
    "WN09_canonical_per_session",
    lambda s, d: mem(s, d).filter(F.lower("memory_type") == "session_summary").withColumn("sid", C.json_string("session_id")).filter("sid is not null").withColumn("k", F.row_number().over(Window.partitionBy("sid").orderBy(F.col("deleted_at").isNotNull(), F.desc_nulls_last(C.number(F.col("updated_at"))), F.desc("id")))).filter("k = 1").select("sid", "id"),
    f"SELECT sid, id FROM (SELECT *, {S.J} ->> '$.session_id' AS sid FROM memories WHERE lower(memory_type) = 'session_summary') WHERE sid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sid ORDER BY deleted_at IS NOT NULL, {S.num('updated_at')} DESC NULLS LAST, id DESC) = 1",
)

# --- top-k ---
add(
    "TK01_top_scores",
    lambda s, d: mem(s, d).filter(C.active() & C.unexpired()).select("id", F.round(C.unified_score(F.lit(0.5)), 6).alias("score")).orderBy(F.desc("score"), "id").limit(20),
    f"SELECT id, round({S.score('0.5')}, 6) AS score FROM memories WHERE {S.LIVE} ORDER BY score DESC, id LIMIT 20",
)
add(
    "TK02_importance_strength",
    lambda s, d: mem(s, d).filter(C.active() & C.unexpired()).select("id", F.round(C.importance() * F.coalesce(C.number(F.col("strength")), F.lit(1.0)), 6).alias("rank_value")).orderBy(F.desc("rank_value"), "id").limit(5),
    f"SELECT id, round({S.IMP} * {S.STRENGTH}, 6) AS rank_value FROM memories WHERE {S.LIVE} ORDER BY rank_value DESC, id LIMIT 5",
)
add("TK03_newest", lambda s, d: mem(s, d).filter(C.active()).orderBy(F.desc("created_at"), F.desc("id")).limit(50).select("id"), f"SELECT id FROM memories WHERE {S.ACTIVE} ORDER BY created_at DESC, id DESC LIMIT 50")
add(
    "TK04_latest_per_project",
    lambda s, d: mem(s, d).filter(C.active()).withColumn("p", C.project_tag()).filter("p is not null").groupBy(F.col("p").alias("project")).agg(F.max(F.struct(F.coalesce(C.number(F.col("updated_at")), "created_at").alias("t"), "id")).alias("m")).select("project", "m.id"),
    f"SELECT project, id FROM (SELECT {S.PROJECT} AS project, id, coalesce({S.num('updated_at')}, created_at) AS t FROM memories WHERE {S.ACTIVE}) WHERE project IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project ORDER BY t DESC, id DESC) = 1",
)
add(
    "TK05_page",
    lambda s, d: (lambda m: m.orderBy(F.desc("created_at"), F.desc("id")).offset(40).limit(20).select("id").crossJoin(F.broadcast(m.agg(F.count(F.lit(1)).alias("total")))))(mem(s, d).filter(C.active())),
    f"SELECT id, (SELECT count(*) FROM memories WHERE {S.ACTIVE}) AS total FROM (SELECT id FROM memories WHERE {S.ACTIVE} ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40)",
)
add(
    "TK06_given_order",
    lambda s, d: (lambda ids: mem(s, d).join(F.broadcast(ids), "id").select("id", "pos"))(s.sql("SELECT posexplode(array(90, 11, 45, 7)) AS (pos, id)").select(F.col("id").cast("long").alias("id"), "pos")),
    "SELECT m.id, CAST(p.pos AS INTEGER) AS pos FROM memories m JOIN (VALUES (0, 90), (1, 11), (2, 45), (3, 7)) p(pos, id) USING (id)",
)
add(
    "TK07_resurface",
    lambda s, d: mem(s, d).filter(C.active() & C.unexpired() & (C.importance() >= 0.7)).select("id", C.importance().alias("imp"), "created_at").orderBy(F.desc("imp"), "created_at", "id").limit(50).join(table(s, d, "duplicate_sets").select(F.col("memory_id").alias("id")), "id", "left_anti").orderBy(F.desc("imp"), "created_at", "id").limit(10).select("id"),
    f"SELECT id FROM (SELECT id, {S.IMP} AS imp, created_at FROM memories WHERE {S.LIVE} AND {S.IMP} >= 0.7 ORDER BY imp DESC, created_at, id LIMIT 50) WHERE id NOT IN (SELECT memory_id FROM duplicate_sets) ORDER BY imp DESC, created_at, id LIMIT 10",
)
add(
    "TK09_newest_change",
    lambda s, d: R.changes(mem(s, d), 1767225600.0, 20),
    f"""SELECT id, CASE WHEN deleted_at IS NOT NULL THEN 'deleted' WHEN created_at >= 1767225600.0 THEN 'created' ELSE 'updated' END AS kind FROM (SELECT *, greatest(coalesce({S.num('created_at')}, 0), coalesce({S.num('updated_at')}, 0), coalesce({S.num('deleted_at')}, 0), coalesce({S.num('last_accessed_at')}, 0)) AS t FROM memories) WHERE t > 1767225600.0 AND t <= {NOW} ORDER BY t DESC, id LIMIT 20""",
)

# --- sets ---
add(
    "SET01_neighbours_both_ways",
    lambda s, d: (lambda e: e.select(F.col("source_hash").alias("node"), F.col("target_hash").alias("other")).union(e.select("target_hash", "source_hash")).distinct())(edges(s, d).filter("similarity > 0.95 and not isnan(similarity)")),
    "SELECT source_hash AS node, target_hash AS other FROM memory_graph WHERE similarity > 0.95 AND NOT isnan(similarity) UNION SELECT target_hash, source_hash FROM memory_graph WHERE similarity > 0.95 AND NOT isnan(similarity)",
)
add("SET03_not_in_sets", lambda s, d: mem(s, d).select("id").join(table(s, d, "duplicate_sets").select(F.col("memory_id").alias("id")), "id", "left_anti"), "SELECT id FROM memories WHERE id NOT IN (SELECT memory_id FROM duplicate_sets)")
add("SET04_rowids_without_memory", lambda s, d: emb(s, d).select(F.col("rowid").alias("id")).distinct().exceptAll(mem(s, d).select("id")), "SELECT DISTINCT e.rowid AS id FROM memory_embeddings e WHERE e.rowid NOT IN (SELECT id FROM memories)")
add(
    "SET05_union_of_tags",
    lambda s, d: table(s, d, "duplicate_sets").distinct().join(mem(s, d).select(F.col("id").alias("memory_id"), F.explode(C.tag_array()).alias("t")), "memory_id").groupBy("set_id").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("tags")),
    f"SELECT set_id, array_to_string(list_sort(list(DISTINCT t)), ',') AS tags FROM (SELECT DISTINCT set_id, memory_id FROM duplicate_sets) JOIN (SELECT id, unnest({S.TAGS}) AS t FROM memories) ON id = memory_id GROUP BY 1",
)

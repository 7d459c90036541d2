"""Scans, projections and filters over memories (SRC, PRJ, FLT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import columns as C
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


def emb(s, d):
    return table(s, d, "memory_embeddings")


add("SRC01_active_rows", lambda s, d: mem(s, d).filter(C.active()).select("id", "memory_type"), f"SELECT id, memory_type FROM memories WHERE {S.ACTIVE}")
add(
    "SRC02_rows_with_vectors",
    lambda s, d: mem(s, d).filter(C.active()).select("id").join(emb(s, d).filter(F.size("content_embedding") == 96).select(F.col("rowid").alias("id")).distinct(), "id"),
    f"SELECT m.id FROM memories m WHERE {S.ACTIVE} AND id IN (SELECT e.rowid FROM memory_embeddings e WHERE len(content_embedding) = 96)",
)
add(
    "SRC07_lookup_by_hash",
    lambda s, d: mem(s, d).join(mem(s, d).filter("id = 11").select("content_hash"), "content_hash", "left_semi").select("id", "content_hash"),
    "SELECT id, content_hash FROM memories WHERE content_hash = (SELECT content_hash FROM memories WHERE id = 11)",
)
add(
    "SRC08_prefix_lookup",
    lambda s, d: mem(s, d).filter(F.col("content_hash").startswith("6a")).groupBy(F.substring("content_hash", 1, 4).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.when(F.col("n") == 1, "found").otherwise("ambiguous")),
    "SELECT substr(content_hash, 1, 4) AS prefix, count(*) AS n, CASE WHEN count(*) = 1 THEN 'found' ELSE 'ambiguous' END AS state FROM memories WHERE content_hash LIKE '6a%' GROUP BY 1",
)
add(
    "SRC09_batched_ids",
    lambda s, d: mem(s, d).join(table(s, d, "duplicate_sets").select(F.col("memory_id").alias("id")), "id", "left_semi").select("id", "memory_type", C.number(F.col("strength")).alias("strength")),
    f"SELECT id, memory_type, {S.num('strength')} AS strength FROM memories WHERE id IN (SELECT memory_id FROM duplicate_sets)",
)
add(
    "SRC12_tail",
    lambda s, d: table(s, d, "usage_feedback").select(F.unix_micros("logged_at").alias("at_us"), F.unix_micros("ts").alias("ts_us"), "action_name", "session_id").orderBy(F.desc("at_us"), F.desc("ts_us"), "action_name", "session_id").limit(100),
    "SELECT epoch_us(logged_at) AS at_us, epoch_us(ts) AS ts_us, action_name, session_id FROM usage_feedback ORDER BY at_us DESC, ts_us DESC, action_name NULLS FIRST, session_id NULLS FIRST LIMIT 100",
)
add(
    "SRC17_missing_vectors",
    lambda s, d: mem(s, d).filter(C.active()).select("id").join(emb(s, d).filter("content_embedding is not null").select(F.col("rowid").alias("id")), "id", "left_anti"),
    f"SELECT id FROM memories WHERE {S.ACTIVE} AND id NOT IN (SELECT e.rowid FROM memory_embeddings e WHERE content_embedding IS NOT NULL)",
)
add(
    "SRC18_session_documents",
    lambda s, d: table(s, d, "usage_feedback").filter("query_text is not null").groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("query_text")), "\n").alias("text"), F.count(F.lit(1)).alias("turns")),
    "SELECT session_id, array_to_string(list_sort(list(DISTINCT query_text)), chr(10)) AS text, count(*) AS turns FROM usage_feedback WHERE query_text IS NOT NULL GROUP BY session_id",
)

# --- projections ---
add("PRJ01_display_line", lambda s, d: mem(s, d).select("id", C.display_line().alias("line")), "SELECT id, '[' || coalesce(memory_type, 'general') || '] ' || replace(substr(content, 1, 300), chr(10), ' ') AS line FROM memories")
add(
    "PRJ02_preview",
    lambda s, d: mem(s, d).select("id", C.preview(F.col("content")).alias("preview")),
    "SELECT id, CASE WHEN length(p) > 80 THEN substr(p, 1, 77) || '...' ELSE p END AS preview FROM (SELECT id, trim(replace(replace(content, chr(10), ' '), chr(9), ' '), ' ') AS p FROM memories)",
)
add("PRJ03_trimmed", lambda s, d: mem(s, d).select("id", C.trimmed(F.col("content"), 600).alias("body")), "SELECT id, CASE WHEN length(content) > 600 THEN rtrim(substr(content, 1, 600), ' ') || '…(truncated)' ELSE content END AS body FROM memories")
add("PRJ04_importance", lambda s, d: mem(s, d).select("id", F.round(C.importance(), 6).alias("importance")), f"SELECT id, round({S.IMP}, 6) AS importance FROM memories")
add("PRJ05_age_days", lambda s, d: mem(s, d).select("id", F.round(C.age_days(), 6).alias("age")), f"SELECT id, round({S.AGE}, 6) AS age FROM memories")
add(
    "PRJ06_anchor",
    lambda s, d: mem(s, d).select("id", C.anchor().alias("anchor")),
    f"SELECT id, '[' || coalesce(memory_type, 'general') || '|src:' || coalesce({S.J} ->> '$.source_type', 'unknown') || '|imp:' || format('{{:.2f}}', {S.IMP}) || '|proj:' || coalesce({S.PROJECT}, 'none') || ']' AS anchor FROM memories",
)
add(
    "PRJ07_content_hash",
    lambda s, d: mem(s, d).select("id", C.content_hash(F.col("content")).alias("hash")),
    f"SELECT id, sha256({S.low(S.strip('content'))}) AS hash FROM memories",
)
add("PRJ08_normal_tags", lambda s, d: mem(s, d).select("id", F.array_join(C.tag_array(), ",").alias("tags")), f"SELECT id, array_to_string({S.TAGS}, ',') AS tags FROM memories")
add("PRJ09_project", lambda s, d: mem(s, d).select("id", C.project_tag().alias("project")), f"SELECT id, {S.PROJECT} AS project FROM memories")
add(
    "PRJ10_enforced_tags",
    lambda s, d: mem(s, d).select("id", F.array_join(F.when(~F.exists(C.tag_array(), lambda t: t.startswith("proj:")), F.concat(C.tag_array(), F.array(F.lit("proj:none")))).otherwise(C.tag_array()), ",").alias("tags")),
    f"SELECT id, array_to_string(CASE WHEN len(list_filter({S.TAGS}, lambda x: starts_with(x, 'proj:'))) = 0 THEN list_append({S.TAGS}, 'proj:none') ELSE {S.TAGS} END, ',') AS tags FROM memories",
)
add("PRJ11_minute", lambda s, d: mem(s, d).select("id", F.date_format(F.timestamp_seconds(F.floor("created_at")), "yyyy-MM-dd HH:mm").alias("minute")), "SELECT id, strftime(make_timestamp(CAST(floor(created_at) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M') AS minute FROM memories")
add(
    "PRJ12_git_tags",
    lambda s, d: mem(s, d).select("id", F.explode(C.tag_array()).alias("t")).filter(F.col("t").startswith("git:")).select("id", F.regexp_replace("t", "^git:(?:refs/heads/)?", "").alias("branch")),
    f"SELECT id, regexp_replace(t, '^git:(?:refs/heads/)?', '') AS branch FROM (SELECT id, unnest({S.TAGS}) AS t FROM memories) WHERE t LIKE 'git:%'",
)
add("PRJ13_session_prefix", lambda s, d: table(s, d, "usage_feedback").select(F.substring(F.translate(F.trim("session_id"), "/\\", "__"), 1, 12).alias("sid")).distinct(), "SELECT DISTINCT substr(replace(replace(trim(session_id, ' '), '/', '_'), chr(92), '_'), 1, 12) AS sid FROM usage_feedback")
add(
    "PRJ14_project_candidates",
    lambda s, d: (lambda p: p.select("project", F.posexplode(F.array("project", F.regexp_replace("project", "-[a-z0-9]{6,10}$", ""))).alias("pos", "candidate")).join(p.select(F.col("project").alias("candidate"), F.col("n").alias("hits")), "candidate").groupBy("project").agg(F.min("pos").cast("int").alias("pos")))(
        mem(s, d).select(F.lower(F.regexp_replace(C.project_tag(), "(?i)^proj:", "")).alias("project")).dropna().groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    ),
    f"WITH p AS (SELECT DISTINCT lower(regexp_replace({S.PROJECT}, '(?i)^proj:', '')) AS project FROM memories WHERE {S.PROJECT} IS NOT NULL), c AS (SELECT project, 0 AS pos, project AS candidate FROM p UNION ALL SELECT project, 1, regexp_replace(project, '-[a-z0-9]{{6,10}}$', '') FROM p) SELECT c.project, CAST(min(pos) AS INTEGER) AS pos FROM c JOIN p ON p.project = c.candidate GROUP BY 1",
)
add(
    "PRJ15_usable_session",
    lambda s, d: mem(s, d).select("id", C.usable_id(C.json_string("session_id")).alias("usable")),
    f"SELECT id, coalesce(lower(trim({S.J} ->> '$.session_id')) NOT IN ('', 'unknown', 'none', 'null', 'undefined', 'default'), false) AS usable FROM memories",
)

# --- filters ---
add("FLT01_live", lambda s, d: mem(s, d).filter(C.active() & C.unexpired()).select("id"), f"SELECT id FROM memories WHERE {S.LIVE}")
add("FLT02_substring_tags", lambda s, d: mem(s, d).filter(C.like_tag("proj:amber") & C.like_tag("type:decision")).select("id"), "SELECT id FROM memories WHERE tags ILIKE '%proj:amber%' AND tags ILIKE '%type:decision%'")
add("FLT03_exact_tag", lambda s, d: mem(s, d).filter(C.has_tag("proj:harborline")).select("id"), f"SELECT id FROM memories WHERE list_contains({S.TAGS}, 'proj:harborline')")
add("FLT04_type_exclusion", lambda s, d: mem(s, d).filter(C.type_not_in("session_summary", "progress")).select("id", "memory_type"), "SELECT id, memory_type FROM memories WHERE memory_type IS NULL OR memory_type NOT IN ('session_summary', 'progress')")
add("FLT05_no_summary_tag", lambda s, d: mem(s, d).filter(F.col("tags").isNull() | ~F.col("tags").ilike("%session_summary%")).select("id"), "SELECT id FROM memories WHERE tags IS NULL OR tags NOT ILIKE '%session_summary%'")
add("FLT06_created_range", lambda s, d: mem(s, d).filter(F.col("created_at").between(1740000000.0, 1750000000.0)).select("id"), "SELECT id FROM memories WHERE created_at BETWEEN 1740000000.0 AND 1750000000.0")
add("FLT08_json_equality", lambda s, d: mem(s, d).filter(C.json_string("source_type") == "hook").select("id"), f"SELECT id FROM memories WHERE {S.J} ->> '$.source_type' = 'hook'")
add("FLT09_universal", lambda s, d: mem(s, d).filter(F.col("tags").isNull() | (F.col("tags") == "") | ~F.col("tags").ilike("%proj:%")).select("id"), "SELECT id FROM memories WHERE tags IS NULL OR tags = '' OR tags NOT ILIKE '%proj:%'")
add(
    "FLT11_surfacing",
    lambda s, d: mem(s, d).filter(C.active() & C.unexpired() & (C.number(F.col("strength")) >= 0.5) & (F.col("created_at") <= NOW - 86400)).join(table(s, d, "duplicate_sets").select(F.col("memory_id").alias("id")), "id", "left_anti").orderBy(F.desc(C.importance()), "id").select("id").limit(3),
    f"SELECT id FROM memories WHERE {S.LIVE} AND {S.num('strength')} >= 0.5 AND created_at <= {NOW - 86400} AND id NOT IN (SELECT memory_id FROM duplicate_sets) ORDER BY {S.IMP} DESC, id LIMIT 3",
)
add("FLT18_dimension_guard", lambda s, d: emb(s, d).filter(C.usable_vector(F.col("content_embedding"), 96)).select(F.col("rowid").alias("id")).distinct(), f"SELECT DISTINCT e.rowid AS id FROM memory_embeddings e WHERE {S.vector('content_embedding', 96)}")
add(
    "FLT19_corpus_rows",
    lambda s, d: mem(s, d).filter(F.length("content").between(50, 400) & F.lower("memory_type").isin("decision", "learning", "preference", "error_fix")).select("id", F.lower("memory_type").alias("label")),
    "SELECT id, lower(memory_type) AS label FROM memories WHERE length(content) BETWEEN 50 AND 400 AND lower(memory_type) IN ('decision', 'learning', 'preference', 'error_fix')",
)

"""Mutations, metrics, extraction, redaction and stateful operators (DML, IR, EX, PI, FLT12-16, ST)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.functions import extract as E
from memlake.operators import metrics as M
from memlake.operators import mutate as D
from memlake.operators import vector as V
from memlake.queries import sql as S
from memlake.runtime import Scratch, table
from memlake.schema import NOW
from memlake.streaming import usage as U

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


def queue(s, d):
    return table(s, d, "ingest_queue")


def usage(s, d):
    return table(s, d, "usage_feedback")


_Z = r"'^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'"
add(
    "DML01_store",
    lambda s, d: D.store(mem(s, d), queue(s, d).select("content", "memory_type", "tags", "metadata")).groupBy(F.substring("content_hash", 1, 2).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(C.active(), 1)).alias("live")),
)
add(
    "DML02_upsert_actions",
    lambda s, d: D.revive_or_insert(mem(s, d), queue(s, d)),
    f"SELECT q.content_hash, CASE WHEN live IS NULL THEN 'inserted' WHEN live = 1 THEN 'ignored' ELSE 'revived' END AS action FROM (SELECT DISTINCT content_hash FROM ingest_queue WHERE content_hash IS NOT NULL) q LEFT JOIN (SELECT content_hash, max(CAST({S.ACTIVE} AS INTEGER)) AS live FROM memories GROUP BY 1) m USING (content_hash)",
)
add(
    "DML04_summary_upsert",
    lambda s, d: mem(s, d).filter(F.lower("memory_type") == "session_summary").withColumn("sid", C.json_string("session_id")).filter("sid is not null").select("id", C.content_hash(F.col("content"), F.col("sid")).alias("hash")),
    rf"SELECT id, sha256({S.low(S.strip('content'))} || '|session:' || ({S.J} ->> '$.session_id')) AS hash FROM memories WHERE lower(memory_type) = 'session_summary' AND {S.J} ->> '$.session_id' IS NOT NULL",
)
add(
    "DML05_update",
    lambda s, d: D.update(mem(s, d).filter("content_hash is not null"), queue(s, d).filter("content_hash is not null").groupBy("content_hash").agg(F.min("tags").alias("tags"), F.lit(9.0).alias("strength"))).select("id", F.coalesce("tags", F.lit("")).alias("tags"), F.round(F.coalesce(C.number(F.col("strength")), F.lit(-1.0)), 6).alias("strength")),
    f"SELECT id, coalesce(q.tags, m.tags, '') AS tags, round(coalesce(CASE WHEN q.content_hash IS NOT NULL THEN 5.0 END, {S.num('m.strength')}, -1.0), 6) AS strength FROM memories m LEFT JOIN (SELECT content_hash, min(tags) AS tags FROM ingest_queue WHERE content_hash IS NOT NULL GROUP BY 1) q USING (content_hash) WHERE content_hash IS NOT NULL",
)
add(
    "DML06_soft_delete",
    lambda s, d: D.soft_delete(mem(s, d), queue(s, d).filter("source = 'hook'").select("content_hash")).agg(F.count(F.when(C.active(), 1)).alias("live"), F.count(F.when(F.col("deleted_at") == NOW, 1)).alias("deleted_now")),
    f"SELECT count(*) FILTER ({S.ACTIVE} AND NOT hit) AS live, count(*) FILTER ({S.ACTIVE} AND hit) AS deleted_now FROM (SELECT deleted_at, coalesce(content_hash IN (SELECT content_hash FROM ingest_queue WHERE source = 'hook' AND content_hash IS NOT NULL), false) AS hit FROM memories)",
)
add(
    "DML07_forget_session",
    lambda s, d: mem(s, d).withColumn("sid", C.json_string("session_id")).join(F.broadcast(mem(s, d).select(C.json_string("session_id").alias("sid"), "id").filter("sid is not null").orderBy("id").limit(1).select("sid")), "sid", "left_anti").select("id", D.privatize().alias("tags")),
    f"WITH f AS (SELECT {S.J} ->> '$.session_id' AS sid FROM memories WHERE {S.J} ->> '$.session_id' IS NOT NULL ORDER BY id LIMIT 1) SELECT id, array_to_string(CASE WHEN list_contains(t, 'private') THEN t ELSE list_append(t, 'private') END, ',') AS tags FROM (SELECT id, list_filter({S.TAGS}, lambda x, i: list_position({S.TAGS}, x) = i) AS t, {S.J} ->> '$.session_id' AS sid FROM memories) WHERE sid IS NULL OR sid NOT IN (SELECT sid FROM f)",
)
add(
    "DML08_reinforce",
    lambda s, d: D.reinforce(mem(s, d), table(s, d, "duplicate_sets").select(F.col("memory_id").alias("id"))).select("id", F.round(F.coalesce(C.number(F.col("strength")), F.lit(-1.0)), 6).alias("strength")),
    f"SELECT id, round(CASE WHEN id IN (SELECT memory_id FROM duplicate_sets) THEN least({S.STRENGTH} + 0.2, 5.0) ELSE coalesce({S.num('strength')}, -1.0) END, 6) AS strength FROM memories",
)
_IDLE = f"(({NOW} - coalesce({S.num('last_accessed_at')}, created_at)) / 86400.0)"
_SUBJ = f"({S.ACTIVE} AND (memory_type IS NULL OR memory_type NOT IN ('session_summary', 'pattern', 'association')) AND {S.num('strength')} IS NOT NULL)"
_DEC = f"(CASE WHEN {_SUBJ} AND {_IDLE} > 7 AND strength > 0.3 THEN greatest(round(strength - 0.05, 6), 0.3) ELSE strength END)"
add(
    "DML09_decay",
    lambda s, d: D.decay(mem(s, d)).select("id", F.round(F.coalesce(C.number(F.col("strength")), F.lit(-1.0)), 6).alias("strength"), F.coalesce("valid_until", F.lit("")).alias("valid_until")),
    f"SELECT id, round(coalesce({S.num(_DEC)}, -1.0), 6) AS strength, coalesce(CASE WHEN {_SUBJ} AND {_DEC} <= 0.3 AND {_IDLE} > 60 AND valid_until IS NULL THEN '2026-03-01 00:00:00' ELSE valid_until END, '') AS valid_until FROM memories",
)
add(
    "DML10_ttl",
    lambda s, d: D.stamp_ttl(mem(s, d)).filter(F.lower("memory_type") == "progress").select("id", "valid_until"),
    "SELECT id, coalesce(valid_until, strftime(make_timestamp(CAST(floor(created_at + 14 * 86400.0) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S')) AS valid_until FROM memories WHERE lower(memory_type) = 'progress'",
)
add(
    "DML11_purge",
    lambda s, d: (lambda a, b: a.agg(F.count(F.lit(1)).alias("rows_left")).crossJoin(b.agg(F.count(F.lit(1)).alias("vectors_left"))))(*D.purge(mem(s, d), table(s, d, "memory_embeddings"))),
    f"WITH dead AS (SELECT id FROM memories WHERE deleted_at < {NOW - 90 * 86400}) SELECT (SELECT count(*) FROM memories WHERE id NOT IN (SELECT id FROM dead)) AS rows_left, (SELECT count(*) FROM memory_embeddings e WHERE e.rowid NOT IN (SELECT id FROM dead)) AS vectors_left",
)
add(
    "DML12_quality",
    lambda s, d: mem(s, d).select("id", D.rated_quality(F.pmod("id", F.lit(3)) - 1, F.coalesce(C.json_number("credibility"), F.lit(0.5))).alias("quality")),
    f"SELECT id, round(0.6 * (((id % 3) - 1 + 1) / 2.0) + 0.4 * coalesce({S.json_number('credibility')}, 0.5), 4) AS quality FROM memories",
)
_DUP = "(SELECT min(keep) AS keep_id, id AS remove_id FROM (SELECT s.set_id, s.memory_id AS id, min(s.memory_id) OVER (PARTITION BY set_id) AS keep FROM (SELECT DISTINCT set_id, memory_id FROM duplicate_sets) s) WHERE id <> keep GROUP BY id)"


def _set_pairs(s, d):
    t = table(s, d, "duplicate_sets").distinct()
    return t.withColumn("a", F.min("memory_id").over(Window.partitionBy("set_id"))).select("a", F.col("memory_id").alias("b")).filter("a <> b")


add("DML13_dedup_plan", lambda s, d: D.dedup_plan(_set_pairs(s, d)), f"SELECT keep_id, remove_id FROM {_DUP} WHERE keep_id NOT IN (SELECT remove_id FROM {_DUP})")
add(
    "DML15_rewritten_edges",
    lambda s, d: (lambda m: D.rewrite_edges(edges(s, d), m))(
        (lambda p, h: p.join(h.toDF("remove_id", "old"), "remove_id").join(h.toDF("keep_id", "new"), "keep_id").filter("old <> new").groupBy("old").agg(F.min("new").alias("new")))(D.dedup_plan(_set_pairs(s, d)), mem(s, d).filter("content_hash is not null").select("id", "content_hash"))
    ).select("source_hash", "target_hash"),
    f"WITH p AS (SELECT keep_id, remove_id FROM {_DUP} WHERE keep_id NOT IN (SELECT remove_id FROM {_DUP})), m AS (SELECT a.content_hash AS old, min(b.content_hash) AS new FROM p JOIN memories a ON a.id = remove_id JOIN memories b ON b.id = keep_id WHERE a.content_hash IS NOT NULL AND b.content_hash IS NOT NULL AND a.content_hash <> b.content_hash GROUP BY 1) SELECT DISTINCT coalesce(x.new, source_hash) AS source_hash, coalesce(y.new, target_hash) AS target_hash FROM memory_graph g LEFT JOIN m x ON x.old = source_hash LEFT JOIN m y ON y.old = target_hash WHERE coalesce(x.new, source_hash) <> coalesce(y.new, target_hash)",
)
add(
    "DML17_edge_precedence",
    lambda s, d: D.merge_edges(edges(s, d).filter("relationship_type <> 'contradicts'"), edges(s, d).filter("relationship_type = 'contradicts'")).select("source_hash", "target_hash", F.when(F.col("relationship_type").isin("contradicts", "supports"), "strong").otherwise("weak").alias("kind")),
    "SELECT source_hash, target_hash, CASE WHEN bool_or(relationship_type IN ('contradicts', 'supports')) THEN 'strong' ELSE 'weak' END AS kind FROM memory_graph WHERE relationship_type IS NOT NULL GROUP BY 1, 2",
)
add(
    "DML18_vector_upsert",
    lambda s, d: queue(s, d).select("content_hash").distinct().join(mem(s, d).filter(C.active()).select("content_hash", "id"), "content_hash").join(table(s, d, "memory_embeddings").select(F.col("rowid").alias("id")).distinct(), "id", "left_anti").select("id"),
    f"SELECT id FROM memories WHERE {S.ACTIVE} AND content_hash IN (SELECT content_hash FROM ingest_queue WHERE content_hash IS NOT NULL) AND id NOT IN (SELECT e.rowid FROM memory_embeddings e)",
)
add(
    "DML19_export_rows",
    lambda s, d: (lambda m: m.select(F.lit("memory").alias("kind"), F.col("content_hash").alias("a"), F.lit("").alias("b")).unionByName(edges(s, d).join(m.select(F.col("content_hash").alias("source_hash")).distinct(), "source_hash", "left_semi").join(m.select(F.col("content_hash").alias("target_hash")).distinct(), "target_hash", "left_semi").select(F.lit("edge").alias("kind"), F.col("source_hash").alias("a"), F.col("target_hash").alias("b"))))(
        mem(s, d).filter(C.active() & C.has_tag("proj:harborline") & F.col("content_hash").isNotNull())
    ),
    f"WITH m AS (SELECT content_hash FROM memories WHERE {S.ACTIVE} AND list_contains({S.TAGS}, 'proj:harborline') AND content_hash IS NOT NULL) SELECT 'memory' AS kind, content_hash AS a, '' AS b FROM m UNION ALL SELECT 'edge', source_hash, target_hash FROM memory_graph WHERE source_hash IN (SELECT content_hash FROM m) AND target_hash IN (SELECT content_hash FROM m)",
)
add(
    "DML23_pruned_edges",
    lambda s, d: D.prune_contradictions(edges(s, d), 0.6).groupBy("relationship_type").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT relationship_type, count(*) AS n FROM memory_graph WHERE NOT (relationship_type = 'contradicts' AND coalesce({S.num('similarity')}, 0) < 0.6) GROUP BY 1",
)
add(
    "DML25_progress_rows",
    lambda s, d: usage(s, d).filter("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("action_name") == "store", 1)).alias("stored")).filter("calls >= 3").select("session_id", F.concat(F.lit("[Progress] "), F.col("calls").cast("string"), F.lit(" calls, "), F.col("stored").cast("string"), F.lit(" stored")).alias("content")),
    "SELECT session_id, '[Progress] ' || count(*) || ' calls, ' || count(*) FILTER (action_name = 'store') || ' stored' AS content FROM usage_feedback WHERE session_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3",
)
add(
    "DML26_summary_dedup",
    lambda s, d: mem(s, d).filter(C.active() & (F.lower("memory_type") == "session_summary")).withColumn("sid", F.substring(C.json_string("session_id"), 1, 12)).filter("sid is not null").withColumn("k", F.row_number().over(Window.partitionBy("sid").orderBy(F.desc_nulls_last(C.number(F.col("updated_at"))), F.desc("id")))).select("id", F.when(F.col("k") == 1, "keep").otherwise("remove").alias("plan")),
    f"SELECT id, CASE WHEN row_number() OVER (PARTITION BY sid ORDER BY u DESC NULLS LAST, id DESC) = 1 THEN 'keep' ELSE 'remove' END AS plan FROM (SELECT id, substr({S.J} ->> '$.session_id', 1, 12) AS sid, {S.num('updated_at')} AS u FROM memories WHERE {S.ACTIVE} AND lower(memory_type) = 'session_summary') WHERE sid IS NOT NULL",
)
add(
    "DML27_metadata_repair",
    lambda s, d: mem(s, d).select(F.when(F.col("metadata").isNull(), "null").when(F.try_parse_json("metadata").isNotNull(), "json").when(D.repair_metadata(F.col("metadata")) == "{}", "lost").otherwise("legacy").alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n")),
    r"""SELECT CASE WHEN metadata IS NULL THEN 'null' WHEN json_valid(metadata) THEN 'json' WHEN regexp_full_match(trim(metadata, ' '), '[\w.-]+\s*:\s*[^,:{}"]*(,\s*[\w.-]+\s*:\s*[^,:{}"]*)*') THEN 'legacy' ELSE 'lost' END AS state, count(*) AS n FROM memories GROUP BY 1""",
)
add(
    "DML27_fsrs_seed",
    lambda s, d: mem(s, d).select("id", *[F.round(c, 3).alias(n) for n, c in D.seed_fsrs().items()]),
    f"SELECT id, round({NOW} + 86400 * greatest({S.STRENGTH}, 0.5), 3) AS due, CAST(CASE WHEN a >= 20 THEN 3 WHEN a >= 10 THEN 4 WHEN a >= 3 THEN 5 ELSE 6 END AS DOUBLE) AS difficulty FROM (SELECT id, strength, coalesce({S.json_number('access_count')}, 0) AS a FROM memories)",
)

# --- metrics ---


def _results(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return V.neighbours_of(e, e.filter("id % 20 = 0"), 10, -1.0, 4).select(F.col("id").alias("query"), F.col("neighbor_id").alias("doc"), "rank")


def _relevant(s, d):
    e = table(s, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "label")
    return e.join(q, "label").filter("vec_id <> query").select("query", F.col("vec_id").alias("doc"))


_E = "(SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_RES = f"res AS MATERIALIZED (SELECT a.id AS query, b.id AS doc, row_number() OVER (PARTITION BY a.id ORDER BY {S.cosine('a.v', 'b.v')} DESC, b.id) AS rank, a.label = b.label AS hit FROM {_E} a, {_E} b WHERE a.id % 20 = 0 AND a.id <> b.id QUALIFY rank <= 10), rel AS (SELECT a.vec_id AS query, count(*) AS n FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1)"
_PERQ = f"WITH {_RES}, g AS (SELECT query, min(rank) FILTER (hit) AS first, sum(CASE WHEN hit THEN 1.0 / log2(rank + 1.0) END) AS dcg, count(*) FILTER (hit) AS hits FROM res GROUP BY 1) SELECT query, round(coalesce(1.0 / first, 0), 6) AS rr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, CAST(least(n, 10) AS BIGINT) + 1), lambda i: 1.0 / log2(i + 1.0))), 6) AS ndcg, round(hits / 10.0, 6) AS precision, round(hits / n, 6) AS recall FROM rel JOIN g USING (query)"
add("IR01_per_query", lambda s, d: M.per_query(_results(s, d), _relevant(s, d), 10), _PERQ)
add("IR08_means", lambda s, d: M.per_query(_results(s, d), _relevant(s, d), 10).agg(*[F.round(F.avg(c), 5).alias(c) for c in ("rr", "ndcg", "precision", "recall")]), f"SELECT round(avg(rr), 5) AS rr, round(avg(ndcg), 5) AS ndcg, round(avg(precision), 5) AS precision, round(avg(recall), 5) AS recall FROM ({_PERQ})")
# an article stands between characters that are no part of a word; the second pass takes those that share one
_WORDLESS = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
_ARTICLE = rf"'(^|{_WORDLESS})(?:a|an|the|and)({_WORDLESS}|$)', '\1 \2', 'g'"
_BARE = r"regexp_replace(replace({c}, ',', ''), '[!-/:-@\[-`{-~]', '', 'g')"
norm = lambda c: rf"trim(regexp_replace(regexp_replace(regexp_replace({_BARE.replace('{c}', S.low(c))}, {_ARTICLE}), {_ARTICLE}), '[\t-\r\x{{85}}\p{{Z}}]+', ' ', 'g'), ' ')"
add("IR05_normal_answer", lambda s, d: usage(s, d).filter("query_text is not null").select(M.normalize_answer(F.col("query_text")).alias("answer")).distinct(), rf"SELECT DISTINCT {norm('query_text')} AS answer FROM usage_feedback WHERE query_text IS NOT NULL")


def _answer_pairs(s, d):
    m = mem(s, d)
    return table(s, d, "duplicate_sets").groupBy("set_id").agg(F.min("memory_id").alias("x"), F.max("memory_id").alias("y")).filter("x < y").join(m.select(F.col("id").alias("x"), F.col("content").alias("cx")), "x").join(m.select(F.col("id").alias("y"), F.col("content").alias("cy")), "y")


_AP = r"(SELECT set_id, a.content AS cx, b.content AS cy FROM (SELECT set_id, min(memory_id) AS x, max(memory_id) AS y FROM duplicate_sets GROUP BY 1 HAVING min(memory_id) < max(memory_id)) JOIN memories a ON a.id = x JOIN memories b ON b.id = y)"
add(
    "IR06_token_f1",
    lambda s, d: _answer_pairs(s, d).select("set_id", F.round(M.token_f1(F.col("cx"), F.col("cy")), 6).alias("f1")),
    f"WITH t AS (SELECT set_id, string_split({norm('cx')}, ' ') AS p, string_split({norm('cy')}, ' ') AS t FROM {_AP}), c AS (SELECT *, list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(t, lambda x: x = w))))) AS common FROM t) SELECT set_id, round(CASE WHEN common = 0 THEN 0 ELSE 2.0 * common / (len(p) + len(t)) END, 6) AS f1 FROM c",
)
add(
    "IR07_has_answer",
    lambda s, d: _answer_pairs(s, d).select("set_id", M.has_answer(F.col("cx"), F.col("cy")).alias("found")),
    f"SELECT set_id, contains({norm('cx')}, {norm('cy')}) OR len(list_filter(string_split({norm('cy')}, ' '), lambda w: NOT list_contains(string_split({norm('cx')}, ' '), w))) = 0 AS found FROM {_AP}",
)

# --- redaction ---
_lit = lambda p: p.replace("'", "''")
_scrub = "content"
for _label, _p, _keep in E.SECRETS:
    _scrub = f"regexp_replace({_scrub}, '{_lit(_p)}', '{chr(92) + '1' if _keep else ''}[REDACTED:{_label}]', 'g')"
add("PI01_scrubbed", lambda s, d: mem(s, d).select("id", E.scrub(F.concat(F.lit("token = 'abcdefghijklmnop' "), "content")).alias("clean")), f"SELECT id, {_scrub.replace('content', chr(39) + 'token = ' + chr(39) * 2 + 'abcdefghijklmnop' + chr(39) * 2 + ' ' + chr(39) + ' || content', 1)} AS clean FROM memories")
add("PI02_secrets", lambda s, d: mem(s, d).select("id", E.is_secret(F.col("content")).alias("secret")), "SELECT id, " + " OR ".join(f"regexp_matches(content, '{_lit(p)}')" for _, p, _ in E.SECRETS) + " OR contains(content, '[REDACTED:') AS secret FROM memories")

# --- state ---
add(
    "ST04_every_20th_turn",
    lambda s, d: usage(s, d).filter("session_id is not null").select("session_id", F.unix_micros("ts").alias("us")).distinct().withColumn("turn", F.row_number().over(Window.partitionBy("session_id").orderBy("us"))).filter("turn % 20 = 0"),
    "SELECT session_id, us, turn FROM (SELECT session_id, us, row_number() OVER (PARTITION BY session_id ORDER BY us) AS turn FROM (SELECT DISTINCT session_id, epoch_us(ts) AS us FROM usage_feedback WHERE session_id IS NOT NULL)) WHERE turn % 20 = 0",
)
add(
    "ST07_working_set",
    lambda s, d: usage(s, d).filter("session_id is not null and memory_hash is not null").groupBy("session_id", "memory_hash").agg(F.max(F.unix_micros("ts")).alias("us")).withColumn("k", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("us"), "memory_hash"))).filter("k <= 20").select("session_id", "memory_hash", "k"),
    "SELECT session_id, memory_hash, k FROM (SELECT session_id, memory_hash, row_number() OVER (PARTITION BY session_id ORDER BY max(epoch_us(ts)) DESC, memory_hash) AS k FROM usage_feedback WHERE session_id IS NOT NULL AND memory_hash IS NOT NULL GROUP BY 1, 2) WHERE k <= 20",
)
add(
    "ST09_rate_limit",
    lambda s, d: usage(s, d).select("action_name", F.unix_seconds("ts").alias("sec")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("action_name").orderBy("sec").rangeBetween(-60, 0))).groupBy("action_name").agg(F.max("n").alias("peak"), F.count(F.when(F.col("n") > 60, 1)).alias("refused")),
    "SELECT action_name, max(n) AS peak, count(*) FILTER (n > 60) AS refused FROM (SELECT action_name, count(*) OVER (PARTITION BY action_name ORDER BY epoch_ms(ts) // 1000 RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n FROM usage_feedback) GROUP BY 1",
)


def _stream(s, d):
    return U.read_events(s, f"{d}/usage_feedback.parquet", table(s, d, "usage_feedback").schema)


def _ingested(s, d):
    scratch = Scratch(s)
    q = U.ingest(U.read_events(s, f"{d}/ingest_queue.parquet", queue(s, d).schema), f"{scratch.root}/target", f"{scratch.root}/checkpoint")
    q.awaitTermination()
    return s.read.parquet(f"{scratch.root}/target").select("content_hash")


add("ST01_stream_ingest", _ingested, f"SELECT DISTINCT sha256({S.low(S.strip('content'))}) AS content_hash FROM ingest_queue WHERE content IS NOT NULL")
add("ST05_token_budgets", lambda s, d: U.run_once(U.token_budgets(_stream(s, d)), "budgets", "update").groupBy("session_id").agg(F.max(F.struct("batch", "used", "granted", "refused")).alias("m")).select("session_id", "m.used", "m.granted", "m.refused"), "SELECT session_id, CAST(sum(ceil(content_length * 0.25)) AS BIGINT) AS used, count(*) AS granted, CAST(0 AS BIGINT) AS refused FROM usage_feedback WHERE session_id IS NOT NULL AND content_length IS NOT NULL GROUP BY 1 HAVING sum(ceil(content_length * 0.25)) <= 80000")
add("ST20_windowed_usage", lambda s, d: U.run_once(U.windowed_counts(_stream(s, d), "1 day"), "windows"))

"""Text retrieval, scoring, vectors, graph and joins (TX, SC, VE, GR, JN) and the searches composed of them (CMP)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.operators import graph as G
from memlake.operators import report as R
from memlake.operators import text as X
from memlake.operators import vector as V
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


def edges(s, d):
    return table(s, d, "memory_graph")


def vectors(s, d):
    """Usable vectors as (id, v), each row once."""
    return emb(s, d).filter(C.usable_vector(F.col("content_embedding"), 96)).select(F.col("rowid").alias("id"), F.col("content_embedding").alias("v")).dropDuplicates(["id"])


#: A fixed query vector: 64 alternating numbers for the embeddings table, 96 for the memories' vectors.
Q64 = [((k * 37) % 19 - 9) / 10.0 for k in range(64)]
Q96 = [((k * 37) % 19 - 9) / 10.0 for k in range(96)]
L64 = "[" + ", ".join(map(str, Q64)) + "]::DOUBLE[]"
L96 = "[" + ", ".join(map(str, Q96)) + "]::DOUBLE[]"
COS64 = S.cosine("embedding::DOUBLE[]", L64)
COS96 = S.cosine("content_embedding::DOUBLE[]", L96)
LIVE_EMB = f"(SELECT DISTINCT e.rowid AS id, {COS96} AS cosine FROM memory_embeddings e WHERE {S.vector('content_embedding', 96)})"

# --- text ---
TERMS = ("kafka", "timeout", "gradle", "decided")
_T = ", ".join(f"'{t}'" for t in TERMS)
BM25 = f"""(WITH docs AS (SELECT id, {S.tokens('content')} AS ts FROM memories), st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM docs),
 hit AS (SELECT id, len(ts) AS dl, term, len(list_filter(ts, lambda x: x = term)) AS tf FROM docs, (SELECT unnest([{_T}]) AS term)), h AS (SELECT * FROM hit WHERE tf > 0), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
 SELECT id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25, count(*) AS matched FROM h JOIN f USING (term), st GROUP BY id)"""
add("TX01_bm25", lambda s, d: X.bm25(mem(s, d), TERMS).select("id", F.round("bm25", 6).alias("bm25"), "matched"), f"SELECT id, round(bm25, 6) AS bm25, matched FROM {BM25}")
add(
    "TX02_substring_bm25",
    lambda s, d: X.substring_bm25(mem(s, d), "scheduling").select("id", F.round("bm25", 6).alias("bm25")),
    """WITH r AS (SELECT id, (length(lower(content)) - length(replace(lower(content), 'scheduling', ''))) / 10.0 AS tf, greatest(length(lower(content)) - 2, 0) AS dl FROM memories), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (tf > 0) AS df FROM r)
    SELECT id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS bm25 FROM r, st WHERE tf > 0""",
)
add(
    "TX03_phrase_or_words",
    lambda s, d: X.bm25(mem(s, d), ("root", "cause")).join(mem(s, d).select("id", F.lower("content").contains("root cause").alias("phrase")), "id").select("id", F.round(X.relevance(F.col("bm25"), F.col("phrase")), 6).alias("relevance")),
    "SELECT id, round(least(bm25 / 20.0, 1.0) + CASE WHEN contains(lower(content), 'root cause') THEN 0.1 ELSE 0 END, 6) AS relevance FROM memories JOIN " + BM25.replace(_T, "'root', 'cause'") + " b USING (id)",
)
add("TX04_relevance", lambda s, d: X.bm25(mem(s, d), TERMS).select("id", F.round(X.relevance(F.col("bm25")), 6).alias("relevance")), f"SELECT id, round(least(bm25 / 20.0, 1.0), 6) AS relevance FROM {BM25}")
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
KEYS = f"list_filter({S.tokens('query_text')}, lambda x: length(x) >= 3 AND x NOT IN ({_STOP}))[1:10]"
add(
    "TX05_keywords",
    lambda s, d: table(s, d, "usage_feedback").filter("query_text is not null").select("query_text", F.array_join(X.keywords(F.col("query_text")), " ").alias("keys")).distinct(),
    f"SELECT DISTINCT query_text, array_to_string({KEYS}, ' ') AS keys FROM usage_feedback WHERE query_text IS NOT NULL",
)
_ALIAS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.ALIASES.items())
add(
    "TX06_aliases",
    lambda s, d: table(s, d, "usage_feedback").filter("query_text is not null").select("query_text", F.array_join(F.array_sort(X.expand(X.keywords(F.col("query_text"), least=2))), " ").alias("keys")).distinct(),
    f"SELECT DISTINCT query_text, array_to_string(list_sort(list_distinct(flatten(list_transform({KEYS.replace('>= 3', '>= 2')}, lambda x: list_concat([x], coalesce(CASE x {_ALIAS} END, [])))))), ' ') AS keys FROM usage_feedback WHERE query_text IS NOT NULL",
)
add("TX07_relaxed_and", lambda s, d: X.relaxed(X.bm25(mem(s, d), TERMS), 4).select("id", "matched"), f"SELECT id, matched FROM {BM25} WHERE matched >= 3")
add("TX08_near", lambda s, d: X.near(mem(s, d), "redis", "after", 2), f"SELECT id FROM (SELECT id, {S.tokens('content')} AS ts FROM memories) WHERE len(list_filter(range(1, len(ts) + 1), lambda i: ts[i] = 'redis' AND list_contains(ts[greatest(i - 3, 1):i + 3], 'after'))) > 0")
add("TX09_exact", lambda s, d: X.exact(mem(s, d).filter(C.active()), "root cause"), f"SELECT id, CAST(0.9 AS DOUBLE) AS lexical FROM memories WHERE {S.ACTIVE} AND content ILIKE '%root cause%'")
add("TX16_tokenizer", lambda s, d: mem(s, d).select("id", F.size(X.tokens(F.col("content"))).alias("n"), F.size(F.array_distinct(X.tokens(F.col("content")))).alias("n_distinct")), f"SELECT id, CAST(len({S.tokens('content')}) AS INTEGER) AS n, CAST(len(list_distinct({S.tokens('content')})) AS INTEGER) AS n_distinct FROM memories")

# --- scores ---
add("SC01_unified_score", lambda s, d: mem(s, d).select("id", F.round(C.unified_score(F.lit(0.9)), 6).alias("score")), f"SELECT id, round({S.score('0.9')}, 6) AS score FROM memories")
add("SC04_review", lambda s, d: mem(s, d).select("id", F.round(F.least(F.coalesce(C.number(F.col("strength")), F.lit(1.0)) + 0.2, F.lit(5.0)), 6).alias("strength"), F.round(NOW + 86400 * F.greatest(F.lit(1.0), F.coalesce(C.number(F.col("strength")), F.lit(1.0))), 3).alias("due")), f"SELECT id, round(least({S.STRENGTH} + 0.2, 5.0), 6) AS strength, round({NOW} + 86400 * greatest(1.0, {S.STRENGTH}), 3) AS due FROM memories")
add("SC05_retention", lambda s, d: mem(s, d).filter(C.number(F.col("strength")) > 0).select("id", F.round(C.retention(C.age_days(), F.col("strength")), 6).alias("retention")), f"SELECT id, round(1.0 / (1.0 + {S.AGE} / (9.0 * strength)), 6) AS retention FROM memories WHERE {S.num('strength')} > 0")
_R = f"(CASE WHEN {S.STRENGTH} <= 0 THEN 0.0 ELSE 1.0 / (1.0 + {S.AGE} / (9.0 * {S.STRENGTH})) END)"
add(
    "SC06_fsrs",
    lambda s, d: mem(s, d).withColumn("st", F.greatest(F.coalesce(C.number(F.col("strength")), F.lit(1.0)), F.lit(0.1))).withColumn("r", C.retrievability(F.col("st"), C.age_days())).select(
        "id", F.round(C.stability_after_recall(F.col("st"), F.coalesce(C.number(F.col("difficulty")), F.lit(5.0)), F.col("r")), 6).alias("recalled"), F.round(C.stability_after_forget(F.coalesce(C.number(F.col("difficulty")), F.lit(5.0)), F.col("r")), 6).alias("forgotten"), F.round(C.next_interval(F.col("st")), 6).alias("next_days")
    ),
    f"""WITH a AS (SELECT id, greatest({S.STRENGTH}, 0.1) AS st, coalesce({S.num('difficulty')}, 5.0) AS dd, {S.AGE} AS days FROM memories), b AS (SELECT *, 1.0 / (1.0 + days / (9.0 * st)) AS r FROM a),
    c AS (SELECT *, greatest(0.1, least(1.0 + exp(1.49) * (11.0 - dd) * (exp(0.94 * (1.0 - r)) - 1.0), 50.0)) AS one FROM b)
    SELECT id, round(greatest(st * 0.1, least(st * (1.0 + exp(1.49) * (11.0 - dd) * pow(st, -0.14) * (exp(0.94 * (1.0 - r)) - 1.0)), 50.0)), 6) AS recalled,
      round(greatest(0.1, 2.18 * pow(dd, -0.05) * (pow(one + 1.0, 0.34) - 1.0) * exp(1.26 * (1.0 - r))), 6) AS forgotten, round(9.0 * st * (1.0 / 0.9 - 1.0), 6) AS next_days FROM c""",
)
_SPEC = [(r"[/\\][\w.-]+\.\w+", 100), (r"v?\d+\.\d+", 80), (r"`[^`]+`", 60), (r"(?i)\b(?:npm|pip|brew|cargo|docker|git|kubectl|yarn|bun|python|node)\b", 50), (r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", 40)]
add(
    "SC08_specificity",
    lambda s, d: mem(s, d).select("id", sum((F.col("content").rlike(p).cast("int") * w for p, w in _SPEC), F.length("content")).alias("specificity")),
    "SELECT id, CAST(length(content) + " + " + ".join(f"CAST(regexp_matches(content, '{p}') AS INTEGER) * {w}" for p, w in _SPEC) + " AS INTEGER) AS specificity FROM memories",
)
_PRIO = {"decision": 10, "error_fix": 9, "learning": 8, "preference": 8, "knowledge": 7, "observation": 6, "progress": 5}
add(
    "SC11_priority",
    lambda s, d: mem(s, d).select("id", F.coalesce(F.create_map(*[F.lit(x) for kv in _PRIO.items() for x in kv])[F.lower("memory_type")], F.lit(2)).alias("priority")),
    "SELECT id, CAST(CASE lower(memory_type) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _PRIO.items()) + " ELSE 2 END AS INTEGER) AS priority FROM memories",
)

# --- vectors ---
add("VE01_semantic_search", lambda s, d: V.semantic_search(emb(s, d), Q96, 10, 0.1, mem(s, d).filter(C.active() & C.unexpired() & C.type_not_in("session_summary", "progress"))).select("id", F.round("cosine", 6).alias("cosine")), f"SELECT id, round(cosine, 6) AS cosine FROM {LIVE_EMB} WHERE cosine > 0.1 AND id IN (SELECT id FROM memories WHERE {S.LIVE} AND (memory_type IS NULL OR memory_type NOT IN ('session_summary', 'progress'))) ORDER BY cosine DESC, id LIMIT 10")
add("VE03_recall", lambda s, d: V.semantic_search(emb(s, d), Q96, 5, 0.1, mem(s, d).filter(C.active() & C.like_tag("proj:")), table(s, d, "duplicate_sets").select(F.col("memory_id").alias("id"))).select("id", F.round("cosine", 6).alias("cosine")), f"SELECT id, round(cosine, 6) AS cosine FROM {LIVE_EMB} WHERE cosine > 0.1 AND id IN (SELECT id FROM memories WHERE {S.ACTIVE} AND tags ILIKE '%proj:%') AND id NOT IN (SELECT memory_id FROM duplicate_sets) ORDER BY cosine DESC, id LIMIT 5")
add("VE04_rerank", lambda s, d: V.rerank(mem(s, d).filter("id <= 200").select("id"), emb(s, d), Q96).select("id", F.round("score", 6).alias("score")), f"SELECT m.id, round(greatest(coalesce(cosine, 0.0), 0.0), 6) AS score FROM memories m LEFT JOIN {LIVE_EMB} v ON v.id = m.id WHERE m.id <= 200")
# the whole table; VE04_rerank's SQL holds it to 200 ids
add("VE04_rerank_all", lambda s, d: V.rerank(mem(s, d).select("id"), emb(s, d), Q96).select("id", F.round("score", 6).alias("score")))
_E64 = "(SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


def vectors64(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


add(
    "VE05_neighbours",
    lambda s, d: V.neighbours_of(vectors64(s, d), vectors64(s, d).filter("id % 20 = 0"), 5, 0.2).select("id", "neighbor_id", F.round("cosine", 6).alias("cosine")),
    f"SELECT id, neighbor_id, round(c, 6) AS cosine FROM (SELECT a.id, b.id AS neighbor_id, {S.cosine('a.v', 'b.v')} AS c FROM {_E64} a, {_E64} b WHERE a.id % 20 = 0 AND a.id <> b.id) WHERE c >= 0.2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, neighbor_id) <= 5",
)
_PAIRS = f"(SELECT a.id AS a, b.id AS b, {S.cosine('a.v', 'b.v')} AS c FROM {_E64} a, {_E64} b WHERE a.id < b.id)"
add("VE_pairs", lambda s, d: V.block_pairs(vectors64(s, d), 0.35).select("a", "b", F.round("cosine", 6).alias("cosine")), f"SELECT a, b, round(c, 6) AS cosine FROM {_PAIRS} WHERE c >= 0.35")
add(
    "VE06_clusters",
    lambda s, d: (lambda c: c.join(c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3"), "component").select("node", "component"))(G.components(V.block_pairs(vectors64(s, d), 0.4).select("a", "b"))),
    f"WITH RECURSIVE p AS MATERIALIZED (SELECT a, b FROM {_PAIRS} WHERE c >= 0.4), e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p), r(node, other) AS (SELECT a, b FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a), k AS (SELECT node, least(node, min(other)) AS component FROM r GROUP BY 1) SELECT node, component FROM k WHERE component IN (SELECT component FROM k GROUP BY 1 HAVING count(*) >= 3)",
)
add(
    "VE09_unit_vectors",
    lambda s, d: vectors(s, d).select("id", F.round(F.element_at(F.transform("v", lambda x: x.cast("double") / C.norm(F.col("v"))), 1), 6).alias("first")),
    f"SELECT DISTINCT e.rowid AS id, round(content_embedding[1]::DOUBLE / sqrt(list_dot_product(content_embedding::DOUBLE[], content_embedding::DOUBLE[])), 6) AS first FROM memory_embeddings e WHERE {S.vector('content_embedding', 96)}",
)

# --- graph and joins ---
_GOOD = "similarity IS NOT NULL AND NOT isnan(similarity)"
_SEEDS = "(SELECT content_hash AS hash FROM memories WHERE content_hash IS NOT NULL ORDER BY id LIMIT 40)"
_BOTH = "(SELECT source_hash AS node, target_hash AS other, similarity, relationship_type FROM memory_graph UNION ALL SELECT target_hash, source_hash, similarity, relationship_type FROM memory_graph WHERE source_hash <> target_hash)"


def seeds(s, d):
    return mem(s, d).filter("content_hash is not null").orderBy("id").limit(40).select(F.col("content_hash").alias("hash"))


def nodes(s, d):
    return mem(s, d).filter(C.active()).select(F.col("content_hash").alias("hash"))


add("GR01_expansion", lambda s, d: G.expand(edges(s, d), seeds(s, d), 20), f"SELECT hash, max(similarity) AS similarity FROM (SELECT other AS hash, similarity FROM {_BOTH} WHERE relationship_type IN ('related', 'supports') AND {_GOOD} AND similarity > 0.6 AND node IN (SELECT hash FROM {_SEEDS})) WHERE hash NOT IN (SELECT hash FROM {_SEEDS}) GROUP BY 1 ORDER BY similarity DESC, hash LIMIT 20")
add("GR02_node_edges", lambda s, d: G.undirected(edges(s, d)).filter("similarity is not null and not isnan(similarity)").groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.max("similarity").alias("strongest")), f"SELECT node, count(*) AS degree, max(similarity) AS strongest FROM {_BOTH} WHERE {_GOOD} GROUP BY 1")
add(
    "GR03_components",
    lambda s, d: (lambda e: G.components(e.select(F.col("source_hash").alias("a"), F.col("target_hash").alias("b"))))(edges(s, d).filter("relationship_type = 'supports' and similarity >= 0.8 and not isnan(similarity)")),
    f"WITH RECURSIVE p AS MATERIALIZED (SELECT source_hash AS a, target_hash AS b FROM memory_graph WHERE relationship_type = 'supports' AND {_GOOD} AND similarity >= 0.8 AND source_hash <> target_hash), e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p), r(node, other) AS (SELECT a, b FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a) SELECT node, least(node, min(other)) AS component FROM r GROUP BY 1",
)
_LINES = "(SELECT CAST(l_suppkey AS VARCHAR) || 's' AS sup, CAST(l_partkey AS VARCHAR) || 'p' AS part FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL)"
_PR_E = f"(SELECT sup AS src, part AS dst FROM {_LINES} UNION ALL SELECT part, sup FROM {_LINES})"


def _trade(s, d):
    """Every supplier and every part, linked both ways by each line."""
    l = table(s, d, "lineitem").dropna(subset=["l_suppkey", "l_partkey"])  # noqa: E741
    sup, part = F.concat(F.col("l_suppkey").cast("string"), F.lit("s")), F.concat(F.col("l_partkey").cast("string"), F.lit("p"))
    return l.select(sup.alias("src"), part.alias("dst")).unionByName(l.select(part.alias("src"), sup.alias("dst")))


def _pagerank_sql(rounds: int) -> str:
    parts = [f"e AS MATERIALIZED {_PR_E}", "deg AS (SELECT src, count(*) AS d FROM e GROUP BY 1)", "w AS MATERIALIZED (SELECT e.src, dst, count(*) / any_value(d) AS w FROM e JOIN deg USING (src) GROUP BY 1, 2)", "v AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e)", "k AS (SELECT count(*) AS n FROM v)", "r0 AS (SELECT node, 1.0 / n AS r FROM v, k)"]
    for i in range(1, rounds + 1):
        parts.append(f"g{i} AS (SELECT dst AS node, sum(w * r) AS got FROM w JOIN r{i - 1} ON r{i - 1}.node = src GROUP BY 1), r{i} AS MATERIALIZED (SELECT v.node, 0.15 / n + 0.85 * coalesce(got, 0) AS r FROM v LEFT JOIN g{i} USING (node), k)")
    return "WITH " + ", ".join(parts) + f" SELECT node, round(r, 8) AS rank FROM r{rounds}"


add("GR04_pagerank", lambda s, d: G.pagerank(_trade(s, d)).select("node", F.round("rank", 8).alias("rank")), _pagerank_sql(30))
add(
    "GR07_edge_exists",
    lambda s, d: G.pairs(edges(s, d).filter("relationship_type = 'related'")).join(G.pairs(edges(s, d).filter("relationship_type = 'contradicts'")), ["a", "b"], "left_semi"),
    "SELECT DISTINCT least(source_hash, target_hash) AS a, greatest(source_hash, target_hash) AS b FROM memory_graph WHERE relationship_type = 'related' AND source_hash <> target_hash INTERSECT SELECT least(source_hash, target_hash), greatest(source_hash, target_hash) FROM memory_graph WHERE relationship_type = 'contradicts'",
)
_NODES = f"(SELECT content_hash AS hash FROM memories WHERE {S.ACTIVE} AND content_hash IS NOT NULL)"
add("GR08_orphans", lambda s, d: G.orphans(edges(s, d), nodes(s, d)).select("source_hash", "target_hash", "relationship_type"), f"SELECT source_hash, target_hash, relationship_type FROM memory_graph WHERE source_hash NOT IN (SELECT hash FROM {_NODES}) OR target_hash NOT IN (SELECT hash FROM {_NODES})")
add(
    "GR09_graph_payload",
    lambda s, d: G.induced(edges(s, d), mem(s, d).filter(C.active() & F.col("content_hash").isNotNull()).orderBy(F.desc("created_at"), F.desc("id")).limit(500).select(F.col("content_hash").alias("hash"))).select("source_hash", "target_hash", "relationship_type"),
    f"WITH n AS (SELECT content_hash AS hash FROM memories WHERE {S.ACTIVE} AND content_hash IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 500) SELECT source_hash, target_hash, relationship_type FROM memory_graph WHERE source_hash IN (SELECT hash FROM n) AND target_hash IN (SELECT hash FROM n)",
)
add("GR11_pair_dedup", lambda s, d: G.pairs(edges(s, d)), "SELECT DISTINCT least(source_hash, target_hash) AS a, greatest(source_hash, target_hash) AS b FROM memory_graph WHERE source_hash <> target_hash")
add(
    "JN03_live_edges",
    lambda s, d: (lambda m: edges(s, d).join(m.toDF("source_hash", "source_id"), "source_hash").join(m.toDF("target_hash", "target_id"), "target_hash").select("source_id", "target_id", "relationship_type"))(mem(s, d).filter(C.active() & F.col("content_hash").isNotNull()).select("content_hash", "id")),
    f"SELECT a.id AS source_id, b.id AS target_id, g.relationship_type FROM memory_graph g JOIN memories a ON a.content_hash = g.source_hash AND a.{S.ACTIVE} JOIN memories b ON b.content_hash = g.target_hash AND b.{S.ACTIVE}",
)
add(
    "JN04_contradictions",
    lambda s, d: (lambda m: edges(s, d).filter("relationship_type = 'contradicts'").join(m.toDF("source_hash", "source_id"), "source_hash", "left").join(m.toDF("target_hash", "target_id"), "target_hash", "left").select("source_hash", "target_hash", F.coalesce("source_id", F.lit(-1)).alias("source_id"), F.coalesce("target_id", F.lit(-1)).alias("target_id")))(mem(s, d).filter("content_hash is not null").select("content_hash", "id")),
    "SELECT source_hash, target_hash, coalesce(a.id, -1) AS source_id, coalesce(b.id, -1) AS target_id FROM memory_graph g LEFT JOIN memories a ON a.content_hash = g.source_hash LEFT JOIN memories b ON b.content_hash = g.target_hash WHERE relationship_type = 'contradicts'",
)
add(
    "JN12_followed_within",
    lambda s, d: table(s, d, "usage_feedback").filter("session_id is not null").withColumn("sec", F.unix_seconds("ts")).withColumn("n", F.count(F.when(F.col("action_name") == "search", 1)).over(Window.partitionBy("session_id").orderBy("sec").rangeBetween(0, 7200))).groupBy("session_id").agg(F.sum("n").alias("followed")),
    "SELECT session_id, CAST(sum(n) AS BIGINT) AS followed FROM (SELECT session_id, count(*) FILTER (action_name = 'search') OVER (PARTITION BY session_id ORDER BY epoch_ms(ts) // 1000 RANGE BETWEEN CURRENT ROW AND 7200 FOLLOWING) AS n FROM usage_feedback WHERE session_id IS NOT NULL) GROUP BY 1",
)
add(
    "JN13_follows",
    lambda s, d: mem(s, d).filter(F.lower("memory_type") == "session_summary").withColumn("p", C.project_tag()).filter("p is not null").select("id", F.lag("id").over(Window.partitionBy("p").orderBy("created_at", "id")).alias("previous")).filter("previous is not null"),
    f"SELECT id, previous FROM (SELECT id, lag(id) OVER (PARTITION BY p ORDER BY created_at, id) AS previous FROM (SELECT id, created_at, {S.PROJECT} AS p FROM memories WHERE lower(memory_type) = 'session_summary') WHERE p IS NOT NULL) WHERE previous IS NOT NULL",
)
add(
    "JN14_paired_calls",
    lambda s, d: table(s, d, "usage_feedback").filter("memory_hash is not null").groupBy("memory_hash").agg(F.coalesce(F.min(F.when(F.col("action_name") == "store", F.unix_micros("ts"))), F.lit(-1)).alias("stored_us"), F.coalesce(F.max(F.when(F.col("action_name") == "update", F.unix_micros("ts"))), F.lit(-1)).alias("updated_us")),
    "SELECT memory_hash, coalesce(min(epoch_us(ts)) FILTER (action_name = 'store'), -1) AS stored_us, coalesce(max(epoch_us(ts)) FILTER (action_name = 'update'), -1) AS updated_us FROM usage_feedback WHERE memory_hash IS NOT NULL GROUP BY 1",
)
_ENDS = r"(SELECT DISTINCT lower(regexp_replace(h, '^\s+|\s+$', '', 'g')) AS h FROM (SELECT source_hash AS h FROM memory_graph UNION ALL SELECT target_hash FROM memory_graph))"
add(
    "JN15_prefix_resolution",
    lambda s, d: (lambda h: h.filter(F.length("h") == 12).join(h.filter(F.length("h") == 64).select(F.col("h").alias("full"), F.substring("h", 1, 12).alias("p")), F.col("h") == F.col("p")).groupBy("h").agg(F.min("full").alias("full"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("h", "full"))(
        edges(s, d).select(F.explode(F.array("source_hash", "target_hash")).alias("h")).select(F.lower(C.strip(F.col("h"))).alias("h")).distinct()
    ),
    f"SELECT s.h, min(f.h) AS \"full\" FROM {_ENDS} s JOIN {_ENDS} f ON length(s.h) = 12 AND length(f.h) = 64 AND substr(f.h, 1, 12) = s.h GROUP BY 1 HAVING count(*) = 1",
)

# --- composed ---
_SEARCH = f"""WITH live AS (SELECT * FROM memories WHERE {S.LIVE}), docs AS (SELECT id, {S.tokens('content')} AS ts FROM live), st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM docs),
 h AS (SELECT * FROM (SELECT id, len(ts) AS dl, term, len(list_filter(ts, lambda x: x = term)) AS tf FROM docs, (SELECT unnest(['root', 'cause']) AS term)) WHERE tf > 0), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
 lex AS (SELECT id, least(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) / 20.0, 1.0) AS l FROM h JOIN f USING (term), st GROUP BY id UNION ALL SELECT id, 0.9 FROM live WHERE content ILIKE '%root cause%'),
 l AS (SELECT id, max(l) AS l FROM lex GROUP BY 1), s AS (SELECT id, cosine AS s FROM {LIVE_EMB} WHERE cosine > 0.1 ORDER BY cosine DESC, id LIMIT 100),
 r AS (SELECT coalesce(l.id, s.id) AS id, CASE WHEN l IS NOT NULL AND s IS NOT NULL THEN least(1.0, greatest(l, s) + 0.3 * least(l, s)) ELSE coalesce(l, s) END AS relevance FROM l FULL JOIN s ON l.id = s.id)
 SELECT id, memory_type, round(relevance, 6) AS relevance, round({S.score('relevance')}, 6) AS score FROM live JOIN r USING (id) ORDER BY score DESC, id LIMIT 10"""
add("CMP01_hybrid_search", lambda s, d: X.search(mem(s, d), "root cause", V.semantic_search(emb(s, d), Q96, 100, 0.1).select("id", F.col("cosine").alias("semantic"))), _SEARCH)
add(
    "CMP02_session_context",
    lambda s, d: (lambda m: m.filter(C.has_tag("proj:harborline")).select(F.lit("project").alias("section"), "id", F.round(C.importance() * F.coalesce(C.number(F.col("strength")), F.lit(1.0)), 6).alias("v")).orderBy(F.desc("v"), "id").limit(3).unionByName(
        m.filter(F.col("tags").isNull() | ~F.col("tags").ilike("%proj:%")).select(F.lit("universal").alias("section"), "id", F.round(C.importance() * F.coalesce(C.number(F.col("strength")), F.lit(1.0)), 6).alias("v")).orderBy(F.desc("v"), "id").limit(2)
    ).unionByName(m.filter(F.lower("memory_type") == "session_summary").select(F.lit("summary").alias("section"), "id", F.round(F.coalesce(C.number(F.col("updated_at")), "created_at"), 3).alias("v")).orderBy(F.desc("v"), "id").limit(1)))(mem(s, d).filter(C.active() & C.unexpired())),
    f"""WITH m AS (SELECT *, round({S.IMP} * {S.STRENGTH}, 6) AS r FROM memories WHERE {S.LIVE})
    SELECT * FROM (SELECT 'project' AS section, id, r AS v FROM m WHERE list_contains({S.TAGS}, 'proj:harborline') ORDER BY v DESC, id LIMIT 3) UNION ALL SELECT * FROM (SELECT 'universal', id, r AS v FROM m WHERE tags IS NULL OR tags NOT ILIKE '%proj:%' ORDER BY v DESC, id LIMIT 2) UNION ALL SELECT * FROM (SELECT 'summary', id, round(coalesce({S.num('updated_at')}, created_at), 3) AS v FROM m WHERE lower(memory_type) = 'session_summary' ORDER BY v DESC, id LIMIT 1)""",
)
add(
    "CMP06_subagent_recall",
    lambda s, d: (lambda hits, words: hits.unionByName(words.join(F.broadcast(hits.agg(F.count(F.lit(1)).alias("n"))), F.col("n") == 0).select("id")))(
        V.semantic_search(emb(s, d), Q96, 4, 0.45).select("id"), X.bm25(mem(s, d).filter(C.active()), TERMS).orderBy(F.desc(F.round("bm25", 6)), "id").limit(4).select("id")
    ),
    f"WITH h AS (SELECT id FROM {LIVE_EMB} WHERE cosine > 0.45 ORDER BY cosine DESC, id LIMIT 4), w AS (SELECT id FROM " + BM25.replace("FROM memories)", f"FROM memories WHERE {S.ACTIVE})", 1) + " ORDER BY round(bm25, 6) DESC, id LIMIT 4) SELECT id FROM h UNION ALL SELECT id FROM w WHERE (SELECT count(*) FROM h) = 0",
)

"""Importance, extraction, consolidation, sessions and composed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.functions.porter import stem_all
from memlake.operators import consolidate as K
from memlake.operators import report as R
from memlake.operators import text as X
from memlake.operators import vector as V
from memlake.plans import pipelines as P
from memlake.queries import sql as S
from memlake.queries.retrieval import LIVE_EMB, Q96, edges, emb, mem, vectors, vectors64
from memlake.runtime import table
from memlake.streaming import sessions as Z
from memlake.streaming import usage as U

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def events(s, d):
    return Z.memory_events(U.read_events(s, f"{d}/usage_feedback.parquet", table(s, d, "usage_feedback").schema))


W96 = f"round({S.IMP} * {S.STRENGTH}, 6)"
add("EX11_digest", lambda s, d: P.session_digest(mem(s, d).filter(C.has_tag("proj:harborline")).select(F.col("id").alias("pos"), "content")))
add("TX17_stemmed_postings", lambda s, d: mem(s, d).select("id", F.explode(stem_all(X.tokens(F.col("content")))).alias("term")).groupBy("term").agg(F.countDistinct("id").alias("df")))
add("VE10_collapsed_hits", lambda s, d: K.collapse_ranked(V.semantic_search(emb(s, d), Q96, 60, 0.0).select("id", F.col("cosine").alias("score")), vectors(s, d), mem(s, d), 10))
add("VE11_density_clusters", lambda s, d: K.clusters(vectors64(s, d).withColumn("g", F.col("label").cast("string")), "g").select("id", "g", "cluster"))
add(
    "VE21_overlap_at_5",
    lambda s, d: (lambda full, new: full.join(new.select("id", "neighbor_id"), ["id", "neighbor_id"], "left_semi").groupBy("id").agg((F.count(F.lit(1)) / 5).alias("overlap")))(
        V.neighbours_of(vectors64(s, d), vectors64(s, d).filter("id % 20 = 0"), 5, -1.0), V.neighbours_of(vectors64(s, d).orderBy(F.desc("id")).limit(300), vectors64(s, d).filter("id % 20 = 0"), 5, -1.0)
    ),
    f"WITH n AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), w AS (SELECT * FROM n ORDER BY id DESC LIMIT 300), a AS (SELECT a.id, b.id AS o FROM n a, n b WHERE a.id % 20 = 0 AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {S.cosine('a.v', 'b.v')} DESC, b.id) <= 5), c AS (SELECT a.id, b.id AS o FROM n a, w b WHERE a.id % 20 = 0 AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {S.cosine('a.v', 'b.v')} DESC, b.id) <= 5) SELECT id, count(*) / 5 AS overlap FROM a JOIN c USING (id, o) GROUP BY 1",
)
add(
    "FLT17_near_duplicate_rule",
    lambda s, d: (lambda m: (lambda x, y: table(s, d, "duplicate_sets").groupBy("set_id").agg(F.min("memory_id").alias("a"), F.max("memory_id").alias("b")).filter("a < b").join(x, F.col("a") == F.col("x_id")).join(y, F.col("b") == F.col("y_id")).select("set_id", F.coalesce(K.near_duplicate(), F.lit(False)).alias("same")))(*[m.select(*[F.col(c).alias(f"{p}_{c}") for c in m.columns]) for p in "xy"]))(
        mem(s, d).select("id", "content", F.lower("memory_type").alias("type"), C.project_tag().alias("project"))
    ),
    rf"""WITH m AS (SELECT id, content, lower(memory_type) AS type, {S.PROJECT} AS project, list_distinct(list_filter(regexp_split_to_array({S.low('content')}, '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+'), lambda x: x <> '')) AS w FROM memories), p AS (SELECT set_id, min(memory_id) AS a, max(memory_id) AS b FROM duplicate_sets GROUP BY 1 HAVING min(memory_id) < max(memory_id))
    SELECT set_id, coalesce(x.type IN ('knowledge', 'learning', 'observation', 'general', 'error_fix', 'preference', 'progress') AND x.type = y.type AND x.project = y.project AND least(length(x.content), length(y.content)) / greatest(length(x.content), length(y.content)) >= 0.5 AND len(list_intersect(x.w, y.w)) >= 0.7 * (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))), false) AS same FROM p JOIN m x ON x.id = a JOIN m y ON y.id = b""",
)
add(
    "VE19_classifier_accuracy",
    lambda s, d: _classifier(s, d),
)


def _classifier(s, d):
    """Logistic regression over vectors with balanced weights; accuracy on every fifth row, which isn't fitted."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = vectors64(s, d).select("id", array_to_vector(C.doubles(F.col("v"))).alias("features"), F.col("label").cast("double").alias("label"))
    fit = rows.filter("id % 5 <> 4")
    weights = fit.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    fit = fit.join(F.broadcast(weights), "label").withColumn("w", 1.0 / F.col("n"))
    model = LogisticRegression(weightCol="w", maxIter=40, regParam=0.01).fit(fit)
    return model.transform(rows.filter("id % 5 = 4")).agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


add("CMP03_project_context", lambda s, d: P.project_context(mem(s, d), "harborline"), f"SELECT id, substr(content, 1, 300) AS content FROM memories WHERE {S.LIVE} AND list_contains({S.TAGS}, 'proj:harborline') ORDER BY {W96} DESC, id LIMIT 3")
add(
    "CMP04_prefetch",
    lambda s, d: P.prefetch(mem(s, d), "harborline", 10),
    f"SELECT id, {W96} AS w FROM memories WHERE {S.LIVE} AND (list_contains({S.TAGS}, 'proj:harborline') OR list_contains({S.tokens('content')}, 'harborline')) ORDER BY w DESC, id LIMIT 10",
)
add("CMP05_prompt_retrieval", lambda s, d: P.prompt_retrieval(mem(s, d), emb(s, d), edges(s, d), "root cause kafka between", Q96))
_UP = "(SELECT memory_id FROM duplicate_sets)"
add(
    "CMP07_surface",
    lambda s, d: P.surface(mem(s, d), emb(s, d), Q96, table(s, d, "duplicate_sets").select(F.col("memory_id").alias("id")), 3, 0.1).select("id", F.round("cosine", 6).alias("cosine")),
    f"SELECT id, round(cosine, 6) AS cosine FROM {LIVE_EMB} WHERE cosine > 0.1 AND id IN (SELECT id FROM memories WHERE {S.LIVE} AND {S.STRENGTH} >= 0.5 AND created_at <= 1772236800.0) AND id NOT IN {_UP} ORDER BY cosine DESC, id LIMIT 3",
)
add("CMP13_intake", lambda s, d: P.intake(table(s, d, "ingest_queue").select("content", "memory_type", "tags", "metadata")).groupBy("memory_type", "importance").agg(F.count(F.lit(1)).alias("n")))
add("ST02_checkpoint_flushes", lambda s, d: U.run_once(Z.checkpoint_flushes(U.read_events(s, f"{d}/usage_feedback.parquet", table(s, d, "usage_feedback").schema).filter("session_id is not null").select("session_id", F.unix_seconds("ts").alias("sec"))), "flushes"))
add("ST03_surfaced", lambda s, d: U.run_once(Z.surfacing(events(s, d)), "shown"))
add("ST06_ledgers", lambda s, d: U.run_once(Z.lru_ledger(events(s, d)), "ledgers", "update").select("session_id", F.size("ids").alias("n")))

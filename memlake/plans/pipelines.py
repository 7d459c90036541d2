"""Composed operators: what users call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.functions import extract as E
from memlake.functions import fixed as FX
from memlake.functions.importance import extraction_score, importance_score
from memlake.operators import graph as G
from memlake.operators import mutate as D
from memlake.operators import text as X
from memlake.operators import vector as V



def weight() -> Column:
    return F.round(C.importance() * F.coalesce(C.number(F.col("strength")), F.lit(1.0)), 6)


def project_context(memories: DataFrame, project: str, chars: int = 300, now: float = C.NOW) -> DataFrame:
    """(id, content): the three weightiest rows of a project, cut; no reinforcement."""
    rows = memories.filter(C.active() & C.unexpired(now) & C.has_tag(f"proj:{project}"))
    return rows.withColumn("w", weight()).orderBy(F.desc("w"), "id").limit(3).select("id", F.substring("content", 1, chars).alias("content"))


def prefetch(memories: DataFrame, project: str, k: int = 3, now: float = C.NOW) -> DataFrame:
    """(id, w): rows with the project's tag or words of its name, the weightiest first."""
    live = memories.filter(C.active() & C.unexpired(now))
    words = X.bm25(live, project).select("id")
    named = live.filter(C.has_tag(f"proj:{project}")).select("id").unionByName(words).distinct()
    return live.join(named, "id", "left_semi").select("id", weight().alias("w")).orderBy(F.desc("w"), "id").limit(k)


def prompt_retrieval(memories: DataFrame, vectors: DataFrame, edges: DataFrame, prompt: str, query, k: int = 5, now: float = C.NOW) -> DataFrame:
    """(id, source, score): lexical hits by relaxed AND, then vector recall of others, all reranked by cosine; then a hop along the graph.

    The sequential fusion: lexical first, semantic appended, rerank of both.
    """
    live = memories.filter(C.active() & C.unexpired(now) & C.type_not_in("session_summary", "progress"))
    terms = X.query_tokens(prompt)
    lexical = X.relaxed(X.bm25(live, terms), len(terms)).join(live, "id").withColumn("s", F.round(C.unified_score(X.relevance(F.col("bm25")), now), 6)).orderBy(F.desc("s"), "id").limit(3 * k)
    semantic = V.semantic_search(vectors, query, 2 * k, 0.1, allowed=live, skip=lexical)
    found = lexical.select("id", F.lit("lexical").alias("source")).unionByName(semantic.select("id", F.lit("semantic").alias("source")))
    ranked = V.rerank(found.select("id"), vectors, query).join(found, "id").select("id", "source", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    seeds = ranked.join(live, "id").filter("content_hash is not null").orderBy(F.desc("score"), "id").limit(3).select(F.col("content_hash").alias("hash"))
    hop = G.expand(edges, seeds, 2).join(live.select(F.col("content_hash").alias("hash"), "id"), "hash").select("id", F.lit("graph").alias("source"), F.round("similarity", 6).alias("score"))
    return ranked.unionByName(hop.join(ranked.select("id"), "id", "left_anti"))


def surface(memories: DataFrame, vectors: DataFrame, query, shown: DataFrame, k: int = 3, floor: float = 0.80, now: float = C.NOW) -> DataFrame:
    """(id, cosine): proactive hits: near, strong enough, a day old, live, not shown yet."""
    ok = memories.filter(C.active() & C.unexpired(now) & (F.coalesce(C.number(F.col("strength")), F.lit(1.0)) >= 0.5) & (F.col("created_at") <= now - C.DAY))
    return V.semantic_search(vectors, query, k, floor, allowed=ok, skip=shown)


def trigger_query(kind: str, context: str) -> str:
    """The query of a trigger: the last three telling parts of a path, else the first 200 characters."""
    if kind == "file":
        return " ".join([p for p in context.split("/") if p and p not in ("src", "lib", "home", "users", "index")][-3:])
    return context[:200]


def session_digest(messages: DataFrame, budget: int = 8000) -> DataFrame:
    """(category, passage) of messages (pos, content): first matching family in order of priority, first of equal heads, within a budget."""
    order = list(FX.FAMILIES)
    kind = F.lit(None).cast("string")
    for name in reversed(order):
        kind = F.when(F.col("content").rlike(E.family(name)), name).otherwise(kind)
    rows = messages.withColumn("category", kind).filter("category is not null")
    passage = F.lit(None).cast("string")
    for name in order:
        passage = F.when(F.col("category") == name, E.windows(F.col("content"), E.family(name))).otherwise(passage)
    rows = rows.withColumn("passage", passage).withColumn("head", F.substring(F.lower("passage"), 1, 80))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("category"))
    first = rows.groupBy("head").agg(F.min_by(F.struct(rank.alias("rank"), "pos", "category", "passage"), "pos").alias("m")).select("m.*")
    # passages of one length take the budget in order; no more than the budget's characters can be in it
    top = first.filter("passage <> ''").orderBy("rank", "pos").limit(budget)
    used = F.sum(F.length("passage")).over(Window.orderBy("rank", "pos").rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("used", used).filter(F.col("used") <= budget).select("category", "passage")


def section_memories(summaries: DataFrame, limit: int = 5) -> DataFrame:
    """(id, section, header, pos, bullet): of the first ``limit`` bullets of more than 15 characters under each ``## header`` the actionable ones; a bold label of a bullet stays as plain text."""
    parts = F.split("content", r"(?md)^## ")
    rows = summaries.select("id", F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).alias("section", "s"))
    plain = lambda b: F.regexp_replace(F.regexp_replace(b, r"^[- ]+", ""), r"^\*\*(.+?)\*\*:\s*", "$1: ")
    bullets = F.filter(F.transform(F.regexp_extract_all("s", F.lit(r"(?md)^[ \t]*- (.*)$"), F.lit(1)), plain), lambda b: F.length(b) > 15)
    rows = rows.select("id", "section", F.trim(F.substring_index("s", "\n", 1)).alias("header"), F.posexplode(F.slice(bullets, 1, limit)).alias("pos", "bullet"))
    return rows.filter(E.actionable(F.col("bullet")))


def intake(incoming: DataFrame) -> DataFrame:
    """What storing does to rows before the merge: fragments go, secrets are masked, type by label, importance by the text."""
    rows = incoming.filter(~E.is_fragment(F.col("content")))
    clean = rows.withColumn("content", E.scrub(F.col("content")))
    clean = clean.withColumn("memory_type", F.coalesce(E.type_by_prefix(F.col("content")), "memory_type", F.lit("general")))
    return clean.withColumn("importance", importance_score(F.col("content")))


def extraction(messages: DataFrame) -> DataFrame:
    """(id, category, passage, score): the first passage of each message family in each text, with its extraction score."""
    found = [F.when(F.col("content").rlike(E.family(n)), F.struct(F.lit(n).alias("category"), E.windows(F.col("content"), E.family(n)).alias("passage"))) for n in FX.MESSAGE_FAMILIES]
    rows = messages.select("id", F.explode(F.array_compact(F.array(*found))).alias("x")).select("id", "x.category", "x.passage")
    score = F.lit(0)
    for n in FX.MESSAGE_FAMILIES:
        score = F.when(F.col("category") == n, extraction_score(F.col("passage"), n)).otherwise(score)
    return rows.withColumn("score", score)


def store(memories: DataFrame, incoming: DataFrame, now: float = C.NOW) -> DataFrame:
    rows = intake(incoming)
    meta = F.to_json(F.struct(F.col("importance").alias("importance_score")))
    return D.store(memories, rows.withColumn("metadata", F.coalesce(F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata")), meta)).drop("importance"), now)

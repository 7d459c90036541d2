"""Consolidation: clusters of a project's vectors, pair actions, a bounded plan, and its application."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.functions import fixed as X
from memlake.operators import mutate as D
from memlake.operators import vector as V

DEDUP, MERGE, LENGTH_RATIO, JACCARD, RUN_LIMIT, BREAKER, SHORT, CONTRADICTS = 0.97, 0.80, 0.5, 0.7, 100, 1000, 30, 0.5


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)[^\w]+"), lambda t: t != ""))


def near_duplicate(allowed=("knowledge", "learning", "observation", "general", "error_fix", "preference", "progress")) -> Column:
    """The rule for a pair (x_, y_ columns): allowed equal type, equal project, like length, like words."""
    a, b = words(F.col("x_content")), words(F.col("y_content"))
    shared = F.size(F.array_intersect(a, b))
    ratio = F.least(F.length("x_content"), F.length("y_content")) / F.greatest(F.length("x_content"), F.length("y_content"))
    return F.col("x_type").isin(*allowed) & (F.col("x_type") == F.col("y_type")) & (F.col("x_project") == F.col("y_project")) & (ratio >= LENGTH_RATIO) & (shared >= JACCARD * (F.size(a) + F.size(b) - shared))


def actions(memories: DataFrame, vectors: DataFrame, blocks: int | None = None, dedup: float = DEDUP, merge: float = MERGE, verify: bool = True) -> DataFrame:
    """(a, b, cosine, action) of pairs of one type and project at or above the cosine of a merge.

    dedup: above its cosine and by the rule of near-duplicates. Of the others
    those with a short text stay merge_unverified (all do without ``verify``),
    those that contradict each other by their words are contradiction, and the
    rest merge.
    """
    m = memories.filter(C.active()).select("id", "content", F.lower("memory_type").alias("type"), C.project_tag().alias("project"))
    rows = vectors.join(m.select("id", "type", "project"), "id")
    pairs = V.block_pairs(rows, merge, blocks, ["type", "project"])
    x, y = (m.select(*[F.col(c).alias(f"{p}_{c}") for c in m.columns]) for p in "xy")
    j = pairs.join(x, pairs.a == F.col("x_id")).join(y, pairs.b == F.col("y_id"))
    short = (F.length("x_content") < SHORT) | (F.length("y_content") < SHORT) | F.lit(not verify)
    contradicts = contradiction_score(F.col("x_content"), F.col("y_content")) >= CONTRADICTS
    action = F.when((F.col("cosine") >= dedup) & near_duplicate(), "dedup").when(short, "merge_unverified").when(contradicts, "contradiction").otherwise("merge")
    return j.select("a", "b", "cosine", action.alias("action"))


def plan(acted: DataFrame, limit: int = RUN_LIMIT, breaker: int = BREAKER) -> DataFrame:
    """(keep_id, remove_id) of at most ``limit`` deduplications of a run, the most similar pairs first; the rest is left to the next run.

    A run that finds more than ``breaker`` rows to remove plans nothing, as so many point to a fault.
    """
    found = acted.filter("action = 'dedup'")
    if found.agg(F.countDistinct(F.greatest("a", "b"))).first()[0] > breaker:
        return D.dedup_plan(found.limit(0))
    return D.dedup_plan(found.orderBy(F.desc("cosine"), "a", "b").limit(limit))


def apply_plan(memories: DataFrame, planned: DataFrame, now: float = C.NOW) -> DataFrame:
    """Kept rows get the union of tags in order; removed rows are soft-deleted with ``duplicate_of``."""
    gone = planned.select(F.col("remove_id").alias("id"), "keep_id")
    extra = memories.join(gone, "id").groupBy("keep_id").agg(F.flatten(F.collect_list(C.tag_array())).alias("more")).withColumnRenamed("keep_id", "id")
    out = memories.join(gone, "id", "left").join(extra, "id", "left")
    tags = F.when(F.col("more").isNotNull(), F.array_join(F.array_distinct(F.concat(C.tag_array(), "more")), ",")).otherwise(F.col("tags"))
    meta = F.when(F.col("keep_id").isNotNull(), F.to_json(F.map_concat(F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), F.create_map(F.lit("duplicate_of"), F.col("keep_id").cast("string"))))).otherwise(F.col("metadata"))
    return out.withColumns({"tags": tags, "metadata": meta, "deleted_at": F.when(F.col("keep_id").isNotNull() & C.active(), now).otherwise(F.col("deleted_at"))}).select(*memories.columns)


def clusters(vectors: DataFrame, group: str, min_size: int = 3) -> DataFrame:
    """(id, group, cluster) by density, noise left out. A group is clustered in one task: its time grows with the square of its rows, its memory with the rows."""
    kind = vectors.schema[group].dataType.simpleString()

    def run(t):
        t = t.sort_by("id")
        label = V.hdbscan(V._units(t.column("v")), min_size)
        at = pa.array(np.flatnonzero(label >= 0))
        return pa.table({"id": t.column("id").take(at), group: t.column(group).take(at), "cluster": pa.array(label[label >= 0], pa.int64())})

    return vectors.select("id", group, "v").filter(F.col(group).isNotNull()).groupBy(group).applyInArrow(run, f"id long, {group} {kind}, cluster long")


#: The deepest pool that a search is refilled from.
REFILL = 300


def collapse_ranked(ranked: DataFrame, vectors: DataFrame, memories: DataFrame, limit: int, threshold: float = 0.95, pool: int | None = None) -> DataFrame:
    """(id, folded) of a query's ranked hits (id, score): near-duplicates folded into the better hit, freed places refilled.

    The pool is ten times the limit, REFILL at most, at once: since hits fold
    in rank order, this gives what a shallow pool with a refill gives.
    """
    top = ranked.orderBy(F.desc("score"), "id").limit(pool or min(10 * limit, REFILL))
    rows = top.join(memories.select("id", "memory_type", F.filter(C.tag_array(), lambda t: t.startswith("proj:")).alias("projects")), "id").join(vectors.select("id", "v"), "id", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        kept, folded = V.collapse([(r.id, r.memory_type, tuple(sorted(r.projects)), r.v) for r in pdf.itertuples()], limit, threshold)
        return pd.DataFrame({"id": kept, "folded": [folded.get(k, []) for k in kept]})

    return rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "id long, folded array<long>")


#: Signs of a specific text and their points; reasons (fixed values).
SPECIFIC = ((r"[/\\][\w.-]+\.\w+", 100), (r"v?\d+\.\d+", 80), (r"`[^`]+`", 60), (r"(?i)\b(?:npm|pip|brew|cargo|docker|git|kubectl|yarn|bun|python|node)\b", 50), (r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", 40))
REASONS = r"(?i)\bbecause\b|\bdue to\b|\bçünkü\b|\bnedeniyle\b"


def specificity(c: Column) -> Column:
    return sum((c.rlike(X.as_is(p)).cast("int") * n for p, n in SPECIFIC), F.length(c))


def quality(c: Column, size: Column) -> Column:
    """0 to 1: length, concrete signs and reasons; candidates that stand alone, or by two, score higher."""
    n, has = F.length(c), lambda p: c.rlike(X.as_is(p))
    by_length = F.when(n < 20, 0.1).when(n < 50, 0.3).when(n < 200, 0.5).when(n < 500, 0.4).otherwise(0.3)
    signs = F.when(has(SPECIFIC[0][0]), 0.1).otherwise(0.0) + F.when(has(SPECIFIC[1][0]), 0.1).otherwise(0.0) + F.when(has(SPECIFIC[2][0]), 0.05).otherwise(0.0) + F.when(has(REASONS), 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), by_length + signs + F.when(size == 1, 0.15).when(size == 2, 0.05).otherwise(0.0)), 2)


def refine(candidates: DataFrame, session: str, threshold: float = 0.85) -> DataFrame:
    """(session, id, group, size): candidates (session, id, v) of each session grouped greedily in order of id; a session's candidates are few."""
    kind = candidates.schema[session].dataType.simpleString()

    def run(t):
        t = t.sort_by("id")
        first = t.column("id").to_numpy()[V.greedy_groups(V._units(t.column("v")), threshold)]
        _, back, n = np.unique(first, return_inverse=True, return_counts=True)
        return pa.table({session: t.column(session), "id": t.column("id"), "group": pa.array(first, pa.int64()), "size": pa.array(n[back], pa.int64())})

    return candidates.select(session, "id", "v").groupBy(session).applyInArrow(run, f"{session} {kind}, id long, group long, size long")


def refined(candidates: DataFrame, session: str, texts: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(session, id, quality, size): the most specific candidate (texts: id, content) of each group, with its quality."""
    rows = refine(candidates, session, threshold).join(texts.select("id", F.col("content").alias("__text")), "id").withColumn("__s", specificity(F.col("__text")))
    best = rows.groupBy(session, "group", "size").agg(F.max(F.struct("__s", (-F.col("id")).alias("i"), "__text")).alias("__m"))
    return best.select(session, (-F.col("__m.i")).alias("id"), quality(F.col("__m.__text"), F.col("size")).alias("quality"), "size")


# --- fixed values: words that deny and words that approve --------------------
DENY = (
    "not", "never", "don't", "doesn't", "didn't", "won't", "can't", "isn't", "aren't", "wasn't", "weren't", "no", "none", "nobody", "nothing", "nowhere", "neither", "nor", "hate", "avoid", "refuse",
    "don’t", "doesn’t", "didn’t", "won’t", "can’t", "isn’t", "aren’t", "wasn’t", "weren’t", "değil", "asla", "hiçbir", "yok", "olmaz", "yapma", "yapmaz",
)
APPROVE = ("prefer", "like", "love", "use", "always", "choose", "want", "enjoy", "recommend", "best", "should", "must", "correct", "tercih", "sev", "kullan", "her zaman", "doğru", "iyi")
#: Dates and times, which are no numbers to compare.
DATES = (r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", r"\b\d{1,2}:\d{2}(?::\d{2})?\b")
NUMBER = r"\b\d+(?:\.\d+)?\b"


def _told(c: Column) -> Column:
    """A struct of the words in order, the distinct numbers and the signs of a text."""
    low = F.lower(c)
    bare = c
    for p in DATES:
        bare = F.regexp_replace(bare, X.as_is(p), "")
    yes = F.lit(False)
    for w in APPROVE:
        yes = yes | F.contains(low, F.lit(w))
    words_ = F.filter(F.split(low, r"(?U)\s+"), lambda w: w != "")
    numbers = F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(X.as_is(NUMBER)), F.lit(0))))
    return F.struct(words_.alias("w"), numbers.alias("n"), yes.alias("yes"), F.arrays_overlap(words_, F.array(*map(F.lit, DENY))).alias("no"), F.contains(c, F.lit("\n")).alias("lines"))


def contradiction_score(a: Column, b: Column) -> Column:
    """0 to 1, by words alone: opposite polarity (0.4, and 0.2 if one side only denies), other numbers among at least two shared words (0.7), one word replaced in a line of 4 to 20 (0.6)."""

    def score(r):
        x, y = r["a"], r["b"]
        polar = F.when((x["no"] & y["yes"]) | (y["no"] & x["yes"]), 0.4).otherwise(0.0) + F.when(x["no"] != y["no"], 0.2).otherwise(0.0)
        deny = F.array(*map(F.lit, DENY))
        shared = F.array_except(F.array_intersect(F.array_except(x["w"], x["n"]), F.array_except(y["w"], y["n"])), deny)
        other = F.when((F.size(x["n"]) > 0) & (F.size(y["n"]) > 0) & (x["n"] != y["n"]) & (F.size(shared) >= 2), 0.7).otherwise(0.0)
        differing = F.size(F.filter(F.zip_with(x["w"], y["w"], lambda p, q: p != q), lambda d: d))
        swapped = F.when(~x["lines"] & ~y["lines"] & (F.size(x["w"]) == F.size(y["w"])) & F.size(x["w"]).between(4, 20) & (differing == 1), 0.6).otherwise(0.0)
        return F.least(F.lit(1.0), polar + other + swapped)

    return F.transform(F.array(F.struct(_told(a).alias("a"), _told(b).alias("b"))), score)[0]


def lexical_contradiction(a: Column, b: Column, threshold: float = CONTRADICTS) -> Column:
    return contradiction_score(a, b) >= threshold


def new_contradictions(incoming: DataFrame, vectors: DataFrame, memories: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(key, id, score): stored rows among the ``k`` nearest of each incoming one (key, content, v) that its words contradict."""
    asked = incoming.select(F.col("key").alias("id"), "v")
    stored = vectors.join(memories.filter(C.active()).select("id"), "id", "left_semi")
    near = V.neighbours_of(stored, asked, k, 0.0).select(F.col("id").alias("key"), F.col("neighbor_id").alias("id"))
    both = near.join(incoming.select("key", F.col("content").alias("new")), "key").join(memories.select("id", "content"), "id")
    return both.withColumn("score", F.round(contradiction_score(F.col("new"), F.col("content")), 6)).filter(F.col("score") > threshold).select("key", "id", "score")

"""Reports: counts, histograms, percentiles, digests, alerts, coverage, the health score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.functions import fixed as FX
from memlake.operators.text import budget_prefix  # noqa: F401
from memlake.runtime import Scratch

WEEK = 604800.0


def global_counts(memories: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row; each table is read once."""
    m = memories.agg(F.count(F.when(C.active(), 1)).alias("active"), F.count(F.when(~C.active(), 1)).alias("deleted"))
    return m.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(vectors.agg(F.countDistinct("rowid").alias("vectors")))


def by_type(memories: DataFrame) -> DataFrame:
    return memories.filter(C.active()).groupBy(F.coalesce("memory_type", F.lit("general")).alias("memory_type")).agg(F.count(F.lit(1)).alias("n"))


def json_stats(memories: DataFrame, key: str) -> DataFrame:
    v = C.json_number(key)
    return memories.agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))


def histogram(df: DataFrame, value: Column, width: float, bins: int) -> DataFrame:
    """(bin, n) for every bin, the outer ones open."""
    at = F.least(F.greatest((value / width).cast("int"), F.lit(0)), F.lit(bins - 1))
    counts = df.filter(value.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("c", F.lit(0)).alias("n"))


def tag_cloud(memories: DataFrame, prefix: str = "", k: int = 50) -> DataFrame:
    tags = memories.select(F.explode(C.tag_array()).alias("tag")).filter(F.col("tag").startswith(prefix))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def topic_projects(memories: DataFrame) -> DataFrame:
    rows = memories.select("id", F.explode(C.tag_array()).alias("topic"), C.project_tag().alias("project"))
    return rows.filter(F.col("topic").startswith("topic:") & F.col("project").isNotNull()).groupBy("topic", "project").agg(F.countDistinct("id").alias("n"))


def weekly(memories: DataFrame, now: float, weeks: int) -> DataFrame:
    counts = memories.groupBy(F.floor((F.lit(now) - F.col("created_at")) / WEEK).cast("int").alias("week")).agg(F.count(F.lit(1)).alias("c"))
    every = memories.sparkSession.range(weeks).select(F.col("id").cast("int").alias("week"))
    rows = every.join(counts, "week", "left").select("week", F.coalesce("c", F.lit(0)).alias("n"))
    return rows.crossJoin(F.broadcast(rows.agg((F.avg("n") * 26).cast("long").alias("in_26_weeks"))))


def lifecycle(memories: DataFrame, now: float) -> DataFrame:
    """Live rows made this week; live rows below strength 1 and idle for a week; live rows past their validity; rows deleted this week."""
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    idle = F.coalesce(C.number(F.col("last_accessed_at")), C.number(F.col("created_at"))) < now - WEEK
    return memories.agg(
        n(C.active() & (F.col("created_at") >= now - WEEK), "fresh"),
        n(C.active() & (F.coalesce(C.number(F.col("strength")), F.lit(1.0)) < 1.0) & idle, "decayed"),
        n(C.active() & (C.valid_until().cast("double") <= now), "dormant"),
        n(F.col("deleted_at") >= now - WEEK, "deleted"),
    )


def stale(memories: DataFrame, now: float) -> DataFrame:
    return memories.filter(C.active()).agg(
        F.count(F.when(C.number(F.col("updated_at")) < now - 90 * C.DAY, 1)).alias("stale_90d"),
        F.count(F.when(F.coalesce(C.number(F.col("last_accessed_at")), "created_at") < now - 30 * C.DAY, 1)).alias("unread_30d"),
    )


def percentiles(df: DataFrame, key: str, value: str, at=(0.50, 0.95, 0.99)) -> DataFrame:
    """Exact: the value at index min(floor(n p), n - 1) in rising order.

    Equal values are counted first; the distinct values are cut into ranges
    over all keys, and each range ranks its own values from the number of
    those in the ranges before, so no key is gathered in one place.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("c")).repartitionByRange(key, value)
    counts = scratch.save(counts.withColumn("part", F.spark_partition_id()), "counts")
    # as many rows as keys and ranges together
    parts = counts.groupBy(key, "part").agg(F.sum("c").alias("m"))
    before = F.sum("m").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("n", F.sum("m").over(Window.partitionBy(key)))
    k2, p2 = F.col(key).alias("__key"), F.col("part").alias("__part")
    ranked = counts.join(parts.select(k2, p2, "before", "n"), F.col(key).eqNullSafe(F.col("__key")) & (F.col("part") == F.col("__part")))
    ranked = ranked.withColumn("hi", F.col("before") + F.sum("c").over(Window.partitionBy(key, "part").orderBy(value)))
    pick = lambda p: F.min(F.when(F.col("hi") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col(value)))
    return ranked.groupBy(key).agg(*[pick(p).alias(f"p{round(p * 100)}") for p in at])


def digest(usage: DataFrame) -> DataFrame:
    """Per project: share of stores with metadata and tags, of empty searches and of refined sessions, mean results."""
    u = usage.withColumn("project", F.coalesce("project", F.lit("none")))
    act = lambda a, v: F.round(F.avg(F.when(F.col("action_name") == a, v)), 6)
    base = u.groupBy("project").agg(
        F.count(F.lit(1)).alias("ops"),
        act("store", F.col("has_metadata").cast("int")).alias("metadata_rate"),
        act("store", F.col("has_tags").cast("int")).alias("tag_rate"),
        act("search", F.col("empty_result").cast("int")).alias("empty_rate"),
        act("search", F.col("result_count")).alias("mean_results"),
    )
    per = u.groupBy("project", "session_id").agg(F.count(F.when(F.col("action_name") == "search", 1)).alias("n"))
    refined = per.groupBy("project").agg(F.round(F.try_divide(F.count(F.when(F.col("n") >= 2, 1)), F.count(F.when(F.col("n") >= 1, 1))), 6).alias("refinement_rate"))
    return base.join(refined, "project")


def alerts(usage: DataFrame) -> DataFrame:
    """(project, alert): the eight threshold rules; the flags for metadata and tags stand for scope and project tags where a log has no others."""
    u = usage.withColumn("project", F.coalesce("project", F.lit("none")))
    is_ = lambda a: F.col("action_name") == a
    n = lambda a, name: F.count(F.when(is_(a), 1)).alias(name)
    share = lambda a, c: F.avg(F.when(is_(a), F.coalesce(F.col(c).cast("int"), F.lit(0))))
    base = u.groupBy("project").agg(n("store", "stores"), n("search", "searches"), n("quality", "checks"), n("update", "updates"), share("store", "has_metadata").alias("scope"), share("store", "has_tags").alias("tags"), share("search", "empty_result").alias("empty"), F.avg(F.when(is_("search"), F.col("result_count"))).alias("results"))
    per = u.filter(is_("search") & (F.coalesce("session_id", F.lit("")) != "")).groupBy("project", "session_id").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("project").agg(F.count(F.lit(1)).alias("sessions"), F.avg((F.col("n") >= 2).cast("int")).alias("refined"))
    slow = percentiles(u.filter(is_("hook_retrieval") & (F.col("latency_ms") > 0)), "project", "latency_ms", (0.95,))
    j = base.join(per, "project", "left").join(slow, "project", "left")
    rules = {
        "low_scope": (F.col("stores") >= 3) & (F.col("scope") < 0.5),
        "low_project_tags": (F.col("stores") >= 3) & (F.col("tags") < 0.5),
        "many_empty": (F.col("searches") >= 5) & (F.col("empty") > 0.4),
        "no_quality_checks": (F.col("stores") >= 10) & (F.col("checks") == 0),
        "no_updates": (F.col("stores") >= 10) & (F.col("updates") == 0),
        "many_refinements": (F.col("sessions") >= 5) & (F.col("refined") > 0.6),
        "few_results": (F.col("searches") >= 5) & (F.col("results") < 1.5),
        "slow": F.col("p95") > 500,
    }
    return j.select("project", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("alert"))


def sufficiency(usage: DataFrame, seconds: int = 120) -> DataFrame:
    """Share of retrievals that no search of the same session follows in time."""
    w = Window.partitionBy("session_id").orderBy("sec").rangeBetween(Window.currentRow, seconds)
    rows = usage.filter("session_id is not null").select("session_id", "action_name", F.unix_seconds("ts").alias("sec"))
    rows = rows.withColumn("followed", F.count(F.when(F.col("action_name") == "search", 1)).over(w)).filter("action_name = 'hook_retrieval'")
    n, ok = F.count(F.lit(1)), F.count(F.when(F.col("followed") == 0, 1))
    return rows.agg(n.alias("retrievals"), ok.alias("sufficient"), F.round(100.0 * ok / n, 6).alias("percent"))


def coverage(memories: DataFrame, vectors: DataFrame, now: float) -> DataFrame:
    have = vectors.filter("content_embedding is not null").select(F.col("rowid").alias("id")).distinct().withColumn("e", F.lit(True))
    rows = memories.filter(C.active()).select("id", "created_at").join(have, "id", "left")
    n, e = F.count(F.lit(1)), F.count("e")
    return rows.agg(n.alias("rows_active"), e.alias("covered"), F.round(100.0 * e / n, 6).alias("percent"), F.count(F.when(F.col("e").isNull() & (F.col("created_at") < now - 3600), 1)).alias("old_gaps"))


def changes(memories: DataFrame, since: float, k: int = 20, until: float = C.NOW) -> DataFrame:
    """The newest changes: (id, kind)."""
    t = F.greatest(*[F.coalesce(C.number(F.col(c)), F.lit(0.0)) for c in ("created_at", "updated_at", "deleted_at", "last_accessed_at")])
    rows = memories.withColumn("t", t).filter((F.col("t") > since) & (F.col("t") <= until)).orderBy(F.desc("t"), "id").limit(k)
    return rows.select("id", F.when(F.col("deleted_at").isNotNull(), "deleted").when(F.col("created_at") >= since, "created").otherwise("updated").alias("kind"))


def health_score(stale_pct: Column, orphan_pct: Column, duplicate_groups: Column, p95_ms: Column, empty_pct: Column) -> Column:
    """100 less up to 30 for stale rows, 20 for orphan edges, 20 for duplicate groups (from 20 of them on), 15 for a p95 above 500 ms and 15 for more than 40 % empty searches."""
    fall = stale_pct / 100 * 30 + orphan_pct / 100 * 20 + F.least(duplicate_groups / 20.0, F.lit(1.0)) * 20
    fall = fall + F.when(p95_ms > 500, 15).otherwise(0) + F.when(empty_pct > 40, 15).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(100 - fall, 0).cast("int")))


def health(memories: DataFrame, edges: DataFrame, vectors: DataFrame, usage: DataFrame, now: float = C.NOW) -> DataFrame:
    """One row of the health report: its measures, the score and the recommendations that apply. Use is that of the last week."""
    from memlake.operators.graph import orphans

    live = memories.filter(C.active())
    week = usage.filter(F.col("ts").cast("double") >= now - WEEK)
    perf = percentiles(week.filter("action_name = 'hook_retrieval' and latency_ms > 0").withColumn("one", F.lit(1)), "one", "latency_ms").agg(F.coalesce(F.max("p95"), F.lit(0.0)).alias("p95_ms"))
    empty = week.filter("action_name = 'search'").agg(F.coalesce(F.bround(100.0 * F.avg(F.coalesce(F.col("empty_result").cast("int"), F.lit(0))), 1), F.lit(0.0)).alias("empty_pct"))
    enough = sufficiency(week.filter("action_name <> 'hook_retrieval' or result_count > 0")).select(F.coalesce(F.bround("percent", 1), F.lit(100.0)).alias("sufficiency_pct"))
    old = live.agg(F.count(F.when(C.number(F.col("updated_at")) < now - 90 * C.DAY, 1)).alias("stale"), F.count(F.lit(1)).alias("rows"))
    old = old.select(F.coalesce(F.bround(F.try_divide(100.0 * F.col("stale"), F.col("rows")), 1), F.lit(0.0)).alias("stale_pct"))
    dup = live.groupBy(F.substring("content", 1, 100)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("duplicate_groups"))
    bad = orphans(edges, live.select(F.col("content_hash").alias("hash"))).agg(F.count(F.lit(1)).alias("orphans")).crossJoin(edges.agg(F.count(F.lit(1)).alias("n")))
    bad = bad.select("orphans", F.bround(100.0 * F.col("orphans") / F.greatest("n", F.lit(1)), 1).alias("orphan_pct"))
    cover = coverage(memories, vectors, now).select(F.coalesce(F.bround("percent", 1), F.lit(0.0)).alias("coverage_pct"))
    dormant = lifecycle(memories, now).select("dormant")
    # one row each
    row = old.crossJoin(bad).crossJoin(dup).crossJoin(perf).crossJoin(empty).crossJoin(enough).crossJoin(cover).crossJoin(dormant)
    row = row.withColumn("score", health_score(*[F.col(c) for c in ("stale_pct", "orphan_pct", "duplicate_groups", "p95_ms", "empty_pct")]))
    rules = {"stale": "stale_pct > 30", "orphans": "orphans > 10", "duplicates": "duplicate_groups > 5", "latency": "p95_ms > 500", "empty_searches": "empty_pct > 40", "insufficient": "sufficiency_pct < 60", "coverage": "coverage_pct < 90", "dormant": "dormant > 20"}
    told = F.array_join(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in rules.items()])), ",")
    return row.withColumn("recommendations", F.when(told == "", "healthy").otherwise(told))


def importance_gap(memories: DataFrame, high: float = 0.75, now: float = C.NOW) -> DataFrame:
    """(memory_type, rows, high_value, secret, gap, generic): live rows of a high stored importance for whose text no signal of importance fires, by type.

    Rows with a secret are held down on purpose and are no gap; generic types
    say nothing about importance themselves.
    """
    from memlake.functions.extract import is_secret
    from memlake.functions.importance import importance_score

    text = F.coalesce("content", F.lit(""))
    rows = memories.filter(C.active() & C.unexpired(now)).select(
        F.coalesce(F.when(F.col("memory_type") != "", F.col("memory_type")), C.json_string("type"), F.lit("general")).alias("memory_type"),
        (C.importance() >= high).alias("high"), is_secret(text).alias("secret"), importance_score(text).alias("score"),
    )
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    out = rows.groupBy("memory_type").agg(F.count(F.lit(1)).alias("rows"), n(F.col("high"), "high_value"), n(F.col("high") & F.col("secret"), "secret"), n(F.col("high") & ~F.col("secret") & (F.col("score") < FX.FACT), "gap"))
    return out.withColumn("generic", F.col("memory_type").isin(*FX.GENERIC_TYPES))

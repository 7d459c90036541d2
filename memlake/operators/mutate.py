"""Mutations as functions from tables to tables; a snapshot is written by the caller (see sources.snapshots)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.operators.vector import collapse  # noqa: F401

def revive_or_insert(memories: DataFrame, incoming: DataFrame, now: float = C.NOW) -> DataFrame:
    """(content_hash, action) of each distinct incoming hash: ignored (live copy), revived (deleted copy) or inserted."""
    new = incoming.filter("content_hash is not null").select("content_hash").distinct()
    have = memories.filter("content_hash is not null").groupBy("content_hash").agg(F.max(C.active().cast("int")).alias("live"))
    return new.join(have, "content_hash", "left").select("content_hash", F.when(F.col("live").isNull(), "inserted").when(F.col("live") == 1, "ignored").otherwise("revived").alias("action"))


def store(memories: DataFrame, incoming: DataFrame, now: float = C.NOW) -> DataFrame:
    """The table after storing (content, memory_type, tags, metadata) rows.

    Exact hashes are deduplicated, within the batch too (first by content);
    live copies are kept as they are, deleted ones revived with strength 1.
    """
    first = F.row_number().over(Window.partitionBy("content_hash").orderBy("content"))
    new = incoming.withColumn("content_hash", C.content_hash(F.col("content"))).withColumn("k", first).filter("k = 1").drop("k")
    hit = new.select("content_hash", F.col("tags").alias("n_tags"), F.col("memory_type").alias("n_type"), F.col("metadata").alias("n_meta"), F.lit(True).alias("hit"))
    kept = memories.join(hit, "content_hash", "left")
    revive = F.col("hit") & ~C.active()
    pick = lambda a, b: F.when(revive, F.coalesce(b, a)).otherwise(a)
    kept = kept.withColumns({"tags": pick(F.col("tags"), F.col("n_tags")), "memory_type": pick(F.col("memory_type"), F.col("n_type")), "metadata": pick(F.col("metadata"), F.col("n_meta")), "strength": F.when(revive, 1.0).otherwise(F.col("strength")), "updated_at": F.when(revive, now).otherwise(F.col("updated_at")), "deleted_at": F.when(revive, F.lit(None).cast("double")).otherwise(F.col("deleted_at"))})
    kept = kept.drop("n_tags", "n_type", "n_meta", "hit").select(*memories.columns)
    fresh = new.join(memories.select("content_hash"), "content_hash", "left_anti")
    top = memories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    # rising ids in the order of hashes, with gaps: a range shuffle, no single partition
    fresh = fresh.repartitionByRange("content_hash").sortWithinPartitions("content_hash").withColumn("k", F.monotonically_increasing_id()).crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + 1 + F.col("k"))
    values = {"created_at": F.lit(now), "updated_at": F.lit(now), "strength": F.lit(1.0), "difficulty": F.lit(5.0)}
    typed = [(F.col(f.name) if f.name in fresh.columns else values.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in memories.schema]
    return kept.unionByName(fresh.select(*typed))


def update(memories: DataFrame, changes: DataFrame, now: float = C.NOW) -> DataFrame:
    """Partial update by content_hash: tags, memory_type and strength of ``changes`` where not null, strength clamped to [0.3, 5]; ids and hashes stay."""
    n = changes.select("content_hash", *[F.col(c).alias(f"n_{c}") if c in changes.columns else F.lit(None).alias(f"n_{c}") for c in ("tags", "memory_type", "strength")], F.lit(True).alias("hit"))
    j = memories.join(n, "content_hash", "left")
    clamp = F.when(F.col("n_strength").isNotNull(), F.least(F.greatest(F.col("n_strength").cast("double"), F.lit(0.3)), F.lit(5.0)))
    return j.withColumns({"tags": F.coalesce("n_tags", "tags"), "memory_type": F.coalesce("n_memory_type", "memory_type"), "strength": F.coalesce(clamp, "strength"), "updated_at": F.when(F.col("hit"), now).otherwise(F.col("updated_at"))}).select(*memories.columns)


def soft_delete(memories: DataFrame, hashes: DataFrame, now: float = C.NOW) -> DataFrame:
    h = hashes.select("content_hash").distinct().withColumn("hit", F.lit(True))
    return memories.join(h, "content_hash", "left").withColumn("deleted_at", F.when(F.col("hit") & C.active(), now).otherwise(F.col("deleted_at"))).select(*memories.columns)


def forget_session(memories: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, ids removed): rows of the session by metadata or tag."""
    mine = F.coalesce(C.json_string("session_id") == session, F.lit(False)) | F.array_contains(C.tag_array(), f"session:{session}")
    return memories.filter(~mine), memories.filter(mine).select("id")


def privatize() -> Column:
    """Tags with ``private`` added once."""
    return F.array_join(F.array_union(C.tag_array(), F.array(F.lit("private"))), ",")


def reinforce(memories: DataFrame, hits: DataFrame, now: float = C.NOW) -> DataFrame:
    h = hits.select("id").distinct().withColumn("hit", F.lit(True))
    s = F.least(F.coalesce(C.number(F.col("strength")), F.lit(1.0)) + 0.2, F.lit(5.0))
    return memories.join(h, "id", "left").withColumns({"strength": F.when(F.col("hit"), s).otherwise(F.col("strength")), "last_accessed_at": F.when(F.col("hit"), now).otherwise(F.col("last_accessed_at"))}).select(*memories.columns)


def idle_days(now: float) -> Column:
    return (F.lit(now) - F.coalesce(C.number(F.col("last_accessed_at")), "created_at")) / C.DAY


def decay(memories: DataFrame, now: float = C.NOW) -> DataFrame:
    """0.05 off rows idle for a week, down to 0.3; then dormant (expired now) at the floor after sixty days."""
    subject = C.active() & C.type_not_in("session_summary", "pattern", "association") & F.col("strength").isNotNull() & ~F.isnan("strength")
    s = F.when(subject & (idle_days(now) > 7) & (F.col("strength") > 0.3), F.greatest(F.round(F.col("strength") - 0.05, 6), F.lit(0.3))).otherwise(F.col("strength"))
    out = memories.withColumn("strength", s)
    dormant = subject & (F.col("strength") <= 0.3) & (idle_days(now) > 60) & F.col("valid_until").isNull()
    stamp = F.date_format(F.timestamp_seconds(F.lit(now)), "yyyy-MM-dd HH:mm:ss")
    return out.withColumn("valid_until", F.when(dormant, stamp).otherwise(F.col("valid_until")))


def stamp_ttl(memories: DataFrame, kind: str = "progress", days: int = 14) -> DataFrame:
    end = F.date_format(F.timestamp_seconds(F.floor(F.col("created_at") + days * C.DAY)), "yyyy-MM-dd HH:mm:ss")
    return memories.withColumn("valid_until", F.when((F.lower("memory_type") == kind) & F.col("valid_until").isNull(), end).otherwise(F.col("valid_until")))


def purge(memories: DataFrame, vectors: DataFrame, days: int = 90, now: float = C.NOW) -> tuple[DataFrame, DataFrame]:
    """Both tables without tombstones older than ``days``; vectors go with their rows."""
    dead = memories.filter(F.col("deleted_at") < now - days * C.DAY).select("id")
    return memories.join(dead, "id", "left_anti"), vectors.join(dead.withColumnRenamed("id", "rowid"), "rowid", "left_anti")


def rated_quality(rating: Column, existing: Column) -> Column:
    """0.6 of the rating (-1, 0, 1 as 0, 0.5, 1) and 0.4 of the present quality, four places."""
    return F.bround(0.6 * ((rating + 1) / 2) + 0.4 * existing, 4)


def rewrite_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ends moved from old to new hashes (columns old, new); self edges go, of edges with the same ends the strongest stays."""
    s = mapping.select(F.col("old").alias("source_hash"), F.col("new").alias("s"))
    t = mapping.select(F.col("old").alias("target_hash"), F.col("new").alias("t"))
    moved = edges.join(s, "source_hash", "left").join(t, "target_hash", "left")
    moved = moved.withColumns({"source_hash": F.coalesce("s", "source_hash"), "target_hash": F.coalesce("t", "target_hash")}).drop("s", "t").filter("source_hash <> target_hash")
    return first_by(moved, ["source_hash", "target_hash"], F.desc_nulls_last(C.number(F.col("similarity"))), F.col("relationship_type"), F.col("created_at"))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert edges: contradicts and supports replace a related edge of the same ends, else the old one stays."""
    rank = lambda k: F.when(F.col("relationship_type").isin("contradicts", "supports"), 0).otherwise(1) * 2 + k
    both = old.withColumn("__r", rank(0)).unionByName(new.withColumn("__r", rank(1)))
    return first_by(both, ["source_hash", "target_hash"], F.col("__r"), F.desc_nulls_last(C.number(F.col("similarity"))), F.col("relationship_type"), F.col("created_at")).drop("__r")


def prune_contradictions(edges: DataFrame, floor: float) -> DataFrame:
    return edges.filter(~((F.col("relationship_type") == "contradicts") & (F.coalesce(C.number(F.col("similarity")), F.lit(0.0)) < floor)))


def dedup_plan(pairs: DataFrame) -> DataFrame:
    """(keep_id, remove_id): of each pair (a, b) the older row stays; a removed row keeps no other."""
    plan = pairs.select(F.least("a", "b").alias("keep_id"), F.greatest("a", "b").alias("remove_id")).groupBy("remove_id").agg(F.min("keep_id").alias("keep_id"))
    gone = plan.select(F.col("remove_id").alias("keep_id"))
    return plan.join(gone, "keep_id", "left_anti").select("keep_id", "remove_id")


def repair_metadata(c: Column) -> Column:
    """Valid JSON as it is, the legacy ``k:v, k:v`` form as an object of strings, all else as an empty object."""
    legacy = F.trim(c).rlike(r"^[\w.-]+\s*:\s*[^,:{}\"]*(,\s*[\w.-]+\s*:\s*[^,:{}\"]*)*$")
    pairs = F.transform(F.split(c, ","), lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.regexp_replace(p, r"^[^:]*:", "")).alias("value")))
    return F.when(F.try_parse_json(c).isNotNull(), c).when(legacy, F.to_json(F.map_from_entries(F.array_distinct(pairs)))).otherwise(F.lit("{}"))


def seed_fsrs(now: float = C.NOW) -> dict[str, Column]:
    """Due date from the strength, difficulty from the number of reads."""
    s = F.coalesce(C.number(F.col("strength")), F.lit(1.0))
    reads = F.coalesce(C.json_number("access_count"), F.lit(0.0))
    return {"due": F.lit(now) + C.DAY * F.greatest(s, F.lit(0.5)), "difficulty": F.when(reads >= 20, 3.0).when(reads >= 10, 4.0).when(reads >= 3, 5.0).otherwise(6.0)}


def merge_groups(memories: DataFrame, groups: DataFrame, now: float = C.NOW) -> DataFrame:
    """(group_id, base_id, content, tags, strength, merged_from): each group of rows (group_id, id) merged into its strongest.

    Lines of the others that the base hasn't are appended in order of id, tags
    are the sorted union, strengths add up to at most 5. Lines are
    deduplicated on the JVM side, before a group's text is put together.
    """
    rows = groups.select("group_id", "id").distinct().join(memories.filter(C.active()), "id").withColumn("st", F.coalesce(C.number(F.col("strength")), F.lit(1.0)))
    base = rows.groupBy("group_id").agg(F.max(F.struct("st", (-F.col("id")).alias("i"))).alias("m"), F.sum("st").alias("total"), F.sort_array(F.collect_set("id")).alias("ids"))
    base = base.select("group_id", (-F.col("m.i")).alias("base_id"), F.round(F.least("total", F.lit(5.0)), 6).alias("strength"), "ids")
    lines = rows.join(base.select("group_id", "base_id"), "group_id").select("group_id", "id", (F.col("id") != F.col("base_id")).alias("later"), F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    once = F.row_number().over(Window.partitionBy("group_id", F.trim("line")).orderBy("later", "id", "pos"))
    kept = lines.withColumn("k", once).filter("k = 1 or not later").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("later", "id", "pos", "line"))).alias("l"))
    tags = rows.select("group_id", F.explode_outer(C.tag_array()).alias("t")).groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("tags"))
    out = base.join(kept, "group_id").join(tags, "group_id")
    return out.select("group_id", "base_id", F.array_join(F.col("l.line"), "\n").alias("content"), "tags", "strength", F.array_except("ids", F.array("base_id")).alias("merged_from"))


def flag_contradictions(edges: DataFrame, pairs: DataFrame, now: float = C.NOW) -> DataFrame:
    """Edges with a ``contradicts`` edge for each pair (source_hash, target_hash) that has none in either direction."""
    have = edges.filter("relationship_type = 'contradicts'").select(F.least("source_hash", "target_hash").alias("a"), F.greatest("source_hash", "target_hash").alias("b")).distinct()
    new = pairs.select("source_hash", "target_hash", F.least("source_hash", "target_hash").alias("a"), F.greatest("source_hash", "target_hash").alias("b")).filter("a <> b").dropDuplicates(["a", "b"])
    new = new.join(have, ["a", "b"], "left_anti")
    typed = {"source_hash": F.col("source_hash"), "target_hash": F.col("target_hash"), "relationship_type": F.lit("contradicts"), "created_at": F.lit(now), "connection_types": F.lit("[]")}
    return edges.unionByName(new.select(*[typed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in edges.schema]))


def merge_or_insert(incoming: DataFrame, near: DataFrame, memories: DataFrame, threshold: float = 0.85, now: float = C.NOW) -> DataFrame:
    """(key, action, target_id) of incoming rows (key, content_hash) with their nearest stored row (key, id, cosine): exact copies first, then a merge above the threshold, else an insert."""
    same = memories.filter("content_hash is not null").groupBy("content_hash").agg(F.min(F.struct(F.when(C.active() & C.unexpired(now), 0).otherwise(1).alias("gone"), "id")).alias("m"))
    j = incoming.join(same, "content_hash", "left").join(near, "key", "left")
    action = F.when(F.col("m.gone") == 0, "noop").when(F.col("m.gone") == 1, "revive").when(F.col("cosine") > threshold, "merge").otherwise("insert")
    return j.select("key", action.alias("action"), F.coalesce(F.col("m.id"), F.when(F.col("cosine") > threshold, F.col("id")), F.lit(-1)).alias("target_id"))


def resolve_merge(memories: DataFrame, edges: DataFrame, pairs: DataFrame, now: float = C.NOW) -> tuple[DataFrame, DataFrame]:
    """(memories, edges) after merging each pair (keep_id, remove_id): the kept row gets the other's text under a mark and a new hash, the other is soft-deleted, and edges of both move to the new hash.

    A row is kept or removed in one pair only (the one of least ids).
    """
    one = first_by(first_by(pairs.filter("keep_id <> remove_id"), ["keep_id"], F.col("remove_id")), ["remove_id"], F.col("keep_id"))
    one = one.join(one.select(F.col("remove_id").alias("keep_id")), "keep_id", "left_anti")
    other = memories.select(F.col("id").alias("remove_id"), F.col("content").alias("__text"), F.col("content_hash").alias("__hash"))
    joined = one.join(other, "remove_id").withColumnRenamed("keep_id", "id")
    text = F.concat(F.regexp_replace("content", r"(?U)\s+$", ""), F.lit("\n• [Merged from #"), F.col("remove_id").cast("string"), F.lit("] "), C.strip(F.col("__text")))
    rows = memories.join(joined, "id", "left").join(joined.select(F.col("remove_id").alias("id"), F.lit(True).alias("__gone")), "id", "left")
    merged = F.col("remove_id").isNotNull()
    new = F.when(merged, C.content_hash(text))
    rows = rows.withColumn("__new", new)
    moved = rows.filter("remove_id is not null").select(F.explode(F.array("content_hash", "__hash")).alias("old"), F.col("__new").alias("new")).filter("old is not null")
    moved = moved.groupBy("old").agg(F.min("new").alias("new"))
    out = rows.withColumns({
        "content": F.when(merged, text).otherwise(F.col("content")), "content_hash": F.coalesce("__new", "content_hash"),
        "updated_at": F.when(merged, F.lit(now)).otherwise(F.col("updated_at")), "deleted_at": F.when(F.col("__gone") & C.active(), F.lit(now)).otherwise(F.col("deleted_at")),
    })
    return out.select(*memories.columns), rewrite_edges(edges, moved)

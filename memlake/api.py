"""The engine: one object over a set of tables, with the calls that users of a memory service make.

Reads are pure; writes return new tables, and ``commit`` makes them a snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.operators import consolidate, mutate, report, text, vector
from memlake.plans import pipelines
from memlake.sources import files


class Encoder(Protocol):
    """Plug-in for text vectors; none comes with the engine."""

    def __call__(self, text: str) -> Sequence[float]: ...


class Engine:
    def __init__(self, memories: DataFrame, embeddings: DataFrame, edges: DataFrame, usage: DataFrame | None = None, encoder: Encoder | None = None, now: float = C.NOW):
        self.memories, self.embeddings, self.edges, self.usage, self.encoder, self.now = memories, embeddings, edges, usage, encoder, now

    @classmethod
    def open(cls, spark: SparkSession, sf_dir: str, **options) -> Engine:
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        return cls(read("memories"), read("memory_embeddings"), read("memory_graph"), read("usage_feedback"), **options)

    def _vector(self, query: str, vec: Sequence[float] | None) -> Sequence[float] | None:
        return vec if vec is not None else self.encoder(query) if self.encoder and query else None

    # --- reads ---
    def search(self, query: str = "", mode: str = "hybrid", tags: Sequence[str] = (), limit: int = 10, after: float | str | None = None, before: float | str | None = None, vec: Sequence[float] | None = None, stemmed: bool = False, max_response_chars: int | None = None) -> DataFrame:
        """Hybrid, semantic or exact search; without a query the newest rows at relevance 0.5. With ``max_response_chars`` the best hits whose contents fit."""
        if max_response_chars is not None:
            hits = self.search(query, mode, tags, limit, after, before, vec, stemmed)
            return text.budget_prefix(hits.join(self.memories.select("id", "content"), "id"), max_response_chars, F.desc("score"), F.col("id")).drop("content")
        v = self._vector(query, vec) if mode != "exact" else None
        semantic = vector.semantic_search(self.embeddings, v, 6 * limit, 0.3).select("id", F.col("cosine").alias("semantic")) if v is not None else None
        if not query and semantic is None:
            rows = self.memories.filter(C.active() & C.unexpired(self.now)).orderBy(F.desc("created_at"), F.desc("id")).limit(3 * limit)
            return rows.withColumn("relevance", F.lit(0.5)).withColumn("score", F.round(C.unified_score(F.lit(0.5), self.now), 6)).select("id", "memory_type", "relevance", "score").orderBy(F.desc("score"), "id").limit(limit)
        rows = self.memories.limit(0) if mode == "semantic" and semantic is None else self.memories
        if mode == "semantic":
            live = rows.filter(C.active() & C.unexpired(self.now))
            out = live.join(semantic, "id").withColumn("score", F.round(C.unified_score(F.col("semantic"), self.now), 6)) if semantic is not None else live.withColumn("semantic", F.lit(0.0)).withColumn("score", F.lit(0.0))
            return out.select("id", "memory_type", F.round("semantic", 6).alias("relevance"), "score").orderBy(F.desc("score"), "id").limit(limit)
        return text.search(rows, query, semantic, tags, limit, after, before, self.now, stemmed)

    def recall(self, vec: Sequence[float], limit: int = 5, threshold: float = 0.55, skip: DataFrame | None = None) -> DataFrame:
        return vector.semantic_search(self.embeddings, vec, limit, threshold, self.memories.filter(C.active() & C.unexpired(self.now)), skip)

    def neighbours(self, ids: DataFrame, k: int = 5, floor: float = 0.5, dim: int = 96) -> DataFrame:
        v = self.embeddings.filter(C.usable_vector(F.col("content_embedding"), dim)).select(F.col("rowid").alias("id"), F.col("content_embedding").alias("v")).dropDuplicates(["id"])
        return vector.neighbours_of(v, v.join(ids.select("id"), "id", "left_semi"), k, floor)

    def context(self, project: str) -> DataFrame:
        return pipelines.project_context(self.memories, project, now=self.now)

    def surface(self, vec: Sequence[float], shown: DataFrame, k: int = 3) -> DataFrame:
        return pipelines.surface(self.memories, self.embeddings, vec, shown, k, now=self.now)

    def stats(self) -> DataFrame:
        return report.global_counts(self.memories, self.edges, self.embeddings)

    def health(self) -> DataFrame:
        return report.health(self.memories, self.edges, self.embeddings, self.usage)

    # --- writes: each returns an engine over new tables ---
    def _with(self, **tables) -> Engine:
        return Engine(**{"memories": self.memories, "embeddings": self.embeddings, "edges": self.edges, "usage": self.usage, "encoder": self.encoder, "now": self.now} | tables)

    def store(self, rows: DataFrame) -> Engine:
        return self._with(memories=pipelines.store(self.memories, rows, self.now))

    def update(self, changes: DataFrame) -> Engine:
        return self._with(memories=mutate.update(self.memories, changes, self.now))

    def delete(self, hashes: DataFrame, hard: bool = False) -> Engine:
        if not hard:
            return self._with(memories=mutate.soft_delete(self.memories, hashes, self.now))
        gone = self.memories.join(hashes.select("content_hash"), "content_hash", "left_semi").select("id")
        return self._with(memories=self.memories.join(gone, "id", "left_anti"), embeddings=self.embeddings.join(gone.withColumnRenamed("id", "rowid"), "rowid", "left_anti"))

    def forget(self, session: str) -> Engine:
        left, gone = mutate.forget_session(self.memories, session)
        return self._with(memories=left, embeddings=self.embeddings.join(gone.withColumnRenamed("id", "rowid"), "rowid", "left_anti"))

    def reinforce(self, hits: DataFrame) -> Engine:
        return self._with(memories=mutate.reinforce(self.memories, hits, self.now))

    def decay(self) -> Engine:
        return self._with(memories=mutate.decay(self.memories, self.now))

    def consolidate(self, dry_run: bool = False, limit: int = consolidate.RUN_LIMIT, dim: int = 96):
        """The plan (keep_id, remove_id); without ``dry_run`` the engine after it."""
        v = self.embeddings.filter(C.usable_vector(F.col("content_embedding"), dim)).select(F.col("rowid").alias("id"), F.col("content_embedding").alias("v")).dropDuplicates(["id"])
        planned = consolidate.plan(consolidate.actions(self.memories, v), limit)
        return planned if dry_run else self._with(memories=consolidate.apply_plan(self.memories, planned, self.now))

    def export(self, path: str, project: str | None = None) -> None:
        rows = self.memories.filter(C.active())
        files.write_archive(rows.filter(C.has_tag(f"proj:{project}")) if project else rows, self.edges, path)

    def import_(self, path: str) -> Engine:
        rows, links = files.read_archive(self.memories.sparkSession, path)
        new = rows.select("content", "memory_type", "tags", "metadata")
        edges = mutate.merge_edges(self.edges, links.select(*[F.col(c).cast(self.edges.schema[c].dataType) for c in self.edges.columns]))
        return self._with(memories=mutate.store(self.memories, new, self.now), edges=edges)

    def commit(self, root: str) -> int:
        return files.write_snapshot({"memories": self.memories, "embeddings": self.embeddings, "edges": self.edges}, root)

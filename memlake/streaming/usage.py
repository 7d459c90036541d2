"""Structured Streaming: durable ingest, windowed usage, per-session budgets and topic counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlake.functions import columns as C
from memlake.runtime import Scratch


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """A stream over a folder of Parquet files, or over a single file by way of its folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def ingest(queue: DataFrame, target: str, checkpoint: str, hash_col: str = "content_hash"):
    """At-least-once ingest of queued records: each batch appends the hashes that the target hasn't yet. Replays write nothing twice."""
    spark = queue.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        new = batch.withColumn("content_hash", C.content_hash(F.col("content"))).filter(F.col("content").isNotNull()).dropDuplicates(["content_hash"])
        try:
            have = spark.read.parquet(target).select("content_hash")
            new = new.join(have, "content_hash", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(target)

    return queue.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "3 days") -> DataFrame:
    """Events and mean latency by project and time window; rows later than the watermark are dropped (an extension of ours)."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = events.withWatermark("ts", late).groupBy(w.alias("w"), F.coalesce("project", F.lit("none")).alias("project"))
    return counted.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))).alias("latency")).select(F.col("w.start").alias("start"), "project", "n", "latency")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "3 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("session_id", F.col("w.start").alias("start"), "n")


def _budget(ceiling: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, granted, refused = state.get if state.exists else (0, 0, 0)
        for pdf in batches:
            for n in pdf.sort_values(["us", "tokens"]).tokens:
                if used + int(n) <= ceiling:
                    used, granted = used + int(n), granted + 1
                else:
                    refused += 1
        state.update((used, granted, refused))
        yield pd.DataFrame({"session_id": [key[0]], "used": [used], "granted": [granted], "refused": [refused]})

    return step


def token_budgets(events: DataFrame, ceiling: int = 80_000) -> DataFrame:
    """Per session: tokens granted up to the ceiling, requests granted and refused; state survives between batches."""
    rows = events.filter("session_id is not null and content_length is not null").select("session_id", F.unix_micros("ts").alias("us"), F.ceil(F.col("content_length") * 0.25).cast("long").alias("tokens"))
    return rows.groupBy("session_id").applyInPandasWithState(_budget(ceiling), "session_id string, used long, granted long, refused long", "used long, granted long, refused long", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a stream over all that is available into a table of the shared folder."""
    scratch = Scratch(stream.sparkSession)
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{scratch.root}/{name}").option("checkpointLocation", f"{scratch.root}/{name}-checkpoint").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{scratch.root}/{name}-checkpoint").trigger(availableNow=True).foreachBatch(lambda b, k: b.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"{scratch.root}/{name}")).start()
    q.awaitTermination()
    spark = stream.sparkSession
    schema = stream.schema if mode == "append" else stream.withColumn("batch", F.lit(0)).schema
    return spark.read.schema(schema).parquet(f"{scratch.root}/{name}")

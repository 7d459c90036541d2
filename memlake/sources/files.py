"""File sources and sinks: JSON lines, archives, snapshots, transcripts, source trees."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.runtime import Scratch
from memlake.schema import EVENT, MEMORIES, normalize

MEMORY_FIELDS = ("content", "content_hash", "memory_type", "tags", "metadata", "created_at", "created_at_iso", "updated_at", "updated_at_iso", "strength", "last_accessed_at", "valid_until")
EDGE_FIELDS = ("source_hash", "target_hash", "similarity", "connection_types", "relationship_type", "created_at", "metadata")
ARCHIVE = "_type string, schema string, count long, content string, content_hash string, memory_type string, tags string, metadata string, created_at double, created_at_iso string, updated_at double, updated_at_iso string, strength double, last_accessed_at double, valid_until string, source_hash string, target_hash string, similarity double, connection_types string, relationship_type string, _corrupt_record string"


def read_jsonl(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """Event lines with a given schema; lines that can't be parsed are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def tail(lines: DataFrame, n: int, order: str) -> DataFrame:
    return lines.orderBy(F.desc(order)).limit(n)


def write_archive(memories: DataFrame, edges: DataFrame, path: str, schema: str = "1") -> None:
    """Gzipped JSON lines: a manifest, the memories, the edges with both ends among them. Files of the folder sort in that order."""
    ends = memories.select("content_hash").dropna().distinct()
    inner = edges.join(ends.withColumnRenamed("content_hash", "source_hash"), "source_hash", "left_semi").join(ends.withColumnRenamed("content_hash", "target_hash"), "target_hash", "left_semi")
    head = memories.agg(F.count(F.lit(1)).alias("count")).select(F.to_json(F.struct(F.lit("manifest").alias("_type"), F.lit(schema).alias("schema"), "count")).alias("value"))
    rows = memories.select(F.to_json(F.struct(F.lit("memory").alias("_type"), *MEMORY_FIELDS)).alias("value"))
    links = inner.select(F.to_json(F.struct(F.lit("edge").alias("_type"), *EDGE_FIELDS)).alias("value"))
    for k, part in enumerate((head, rows, links)):
        part.write.mode("overwrite").option("compression", "gzip").text(f"{path}/{k}")


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(memories, edges) of an archive; a single line that can't be parsed, or a count that differs, stops the import."""
    lines = spark.read.schema(ARCHIVE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", "true").json(path)
    # the whole schema is read, as a line's fault shows in any of its fields
    n = lambda c: F.count(F.when(c, 1))
    lines = Scratch(spark).save(lines, "lines")
    bad, told, have = lines.agg(n(F.col("_corrupt_record").isNotNull()), F.max(F.when(F.col("_type") == "manifest", F.col("count"))), n(F.col("_type") == "memory")).first()
    if bad or told != have:
        raise ValueError(f"archive {path}: {bad} unreadable lines, {have} memories of {told}")
    return lines.filter("_type = 'memory'").select(*MEMORY_FIELDS), lines.filter("_type = 'edge'").select(*EDGE_FIELDS)


def write_snapshot(tables: dict[str, DataFrame], root: str, version: int | None = None) -> int:
    """A new immutable version of all tables; it counts once its marker is written."""
    spark = next(iter(tables.values())).sparkSession
    version = version if version is not None else int(time.time() * 1000)
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/v{version}/{name}")
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version


def read_snapshot(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the newest (or a given) complete version."""
    if version is None:
        version = spark.read.parquet(f"{root}/versions").agg(F.max("version")).first()[0]
    df = spark.read.parquet(f"{root}/v{version}/{name}")
    return normalize(df, MEMORIES) if name == "memories" else df


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, role, content, tools) of line-based transcripts in two dialects, told apart by their keys; other lines are skipped.

    One dialect has ``{"type": user|assistant, "message": {"content": text or blocks}}``,
    the other ``{"type": ..., "payload": {"role", "content": blocks}}``.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), F.try_parse_json("value").alias("j"))
    get = lambda p, t="string": F.try_variant_get("j", p, t)
    body = F.coalesce(get("$.message.content"), get("$.payload.content"))
    blocks = F.coalesce(get("$.message.content", "array<variant>"), get("$.payload.content", "array<variant>"))
    text = F.array_join(F.array_compact(F.transform(blocks, lambda b: F.when(F.try_variant_get(b, "$.type", "string").isin("text", "output_text", "input_text"), F.try_variant_get(b, "$.text", "string")))), "\n")
    tools = F.array_compact(F.transform(blocks, lambda b: F.when(F.try_variant_get(b, "$.type", "string") == "tool_use", F.try_variant_get(b, "$.name", "string"))))
    role = F.coalesce(get("$.payload.role"), F.when(get("$.type").isin("human", "user"), "user").when(get("$.type") == "assistant", "assistant"))
    rows = lines.select("file", "pos", role.alias("role"), F.when(blocks.isNotNull(), text).otherwise(body).alias("content"), F.coalesce(tools, F.array().cast("array<string>")).alias("tools"))
    return rows.filter(F.col("role").isNotNull() & (F.trim("content") != "") | (F.size("tools") > 0))


#: Import statements by file ending (fixed values).
IMPORTS = {"py": r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", "js": r"(?:from\s+|require\()\s*['\"]([^'\"]+)['\"]()", "ts": r"(?:from\s+|require\()\s*['\"]([^'\"]+)['\"]()"}
IMPORTS |= {"jsx": IMPORTS["js"], "tsx": IMPORTS["ts"]}


#: Endings and folders of a source tree, standard modules, and the characters read of a file (fixed values).
SOURCE_ENDINGS, SKIPPED_FOLDERS = ("py", "ts", "tsx", "js", "jsx"), (".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build")
STANDARD, READ_CHARS, MAX_NODES = ("os", "sys", "json", "re", "time", "math", "io", "subprocess"), 60_000, 20_000


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the source files under a folder, hidden and generated folders aside; the first 60,000 characters of a text. Empty files have no row."""
    globbed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SOURCE_ENDINGS) + "}").load(root)
    rel = F.regexp_replace(F.substring_index(F.col("path"), root.rstrip("/"), -1), "^/+", "")
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    rows = globbed.select(rel.alias("path"), F.substring(F.col("content").cast("string"), 1, READ_CHARS).alias("text"))
    return rows.filter(~F.exists(folders, lambda d: d.isin(*SKIPPED_FOLDERS) | d.startswith(".")))


def top_files(files: DataFrame, n: int = 5, max_nodes: int = MAX_NODES) -> DataFrame:
    """(path, rank): the ``n`` files of a tree (path, text) that imports lead to most, by PageRank; no rows above ``max_nodes`` files (0: no bound).

    Files without links have the least rank, so a tree without imports gives
    its first files by name.
    """
    from memlake.operators.graph import pagerank

    empty = files.sparkSession.createDataFrame([], "path string, rank double")
    count = files.count()
    if not count or 0 < max_nodes < count:
        return empty
    links = import_graph(files).join(files.select(F.col("path").alias("dst")), "dst", "left_semi")
    ranked = pagerank(links.select("src", "dst"), nodes=files.select(F.col("path").alias("node")))
    return ranked.select(F.col("node").alias("path"), "rank").orderBy(F.desc("rank"), "path").limit(n)


def import_graph(files: DataFrame) -> DataFrame:
    """(src, dst) of source files (path, text): each imported module resolved to the first file of its base name, unresolved ones as they are."""
    ending = F.substring_index("path", ".", -1)
    mods = F.array().cast("array<string>")
    for ext, p in IMPORTS.items():
        got = F.concat(F.regexp_extract_all("text", F.lit(p), F.lit(1)), F.regexp_extract_all("text", F.lit(p), F.lit(2)))
        mods = F.when(ending == ext, F.filter(got, lambda m: m != "")).otherwise(mods)
    rows = files.select("path", F.explode(F.array_distinct(mods)).alias("module"))
    rows = rows.filter(~F.col("module").isin(*STANDARD)).withColumn("name", F.regexp_replace(F.regexp_extract("module", r"([^./]+)(?:\.[jt]s)?$", 1), "^$", "?"))
    targets = files.groupBy(F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("name")).agg(F.min("path").alias("target"))
    return rows.join(targets, "name", "left").select(F.col("path").alias("src"), F.coalesce("target", "module").alias("dst")).filter("src <> dst")

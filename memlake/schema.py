"""Tables of the memory model, and normalisation of older or partial ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: End of the snapshot, used where the reference takes the clock.
NOW = 1772323200.0

MEMORIES = T.StructType(
    [T.StructField("id", T.LongType(), False)]
    + [T.StructField(c, T.StringType()) for c in ("content", "content_hash", "memory_type", "tags", "metadata")]
    + [T.StructField(c, T.DoubleType()) for c in ("created_at", "updated_at")]
    + [T.StructField(c, T.StringType()) for c in ("created_at_iso", "updated_at_iso")]
    + [T.StructField(c, T.DoubleType()) for c in ("deleted_at", "strength", "last_accessed_at")]
    + [T.StructField("valid_until", T.StringType()), T.StructField("difficulty", T.DoubleType()), T.StructField("due_date", T.StringType())]
)
EMBEDDINGS = T.StructType([T.StructField("rowid", T.LongType(), False), T.StructField("content_embedding", T.ArrayType(T.FloatType()))])
EDGES = T.StructType(
    [T.StructField("source_hash", T.StringType()), T.StructField("target_hash", T.StringType()), T.StructField("similarity", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in ("connection_types", "metadata")]
    + [T.StructField("created_at", T.DoubleType()), T.StructField("relationship_type", T.StringType())]
)
EVENT = "ts string, action string, type string, project string, session string, query_text string, query_length int, result_count int, search_seq int, empty_result boolean, latency_ms double, content_length int, has_metadata boolean, has_tags boolean, memory_hash string"


def normalize(df: DataFrame, schema: T.StructType = MEMORIES) -> DataFrame:
    """The columns of ``schema`` in order: missing ones as nulls, others cast; further columns are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])

"""Problem 5: duplicates hidden by formatting differences.

Byte-identical rows are collapsed first, with counts, on the JVM side; only
the distinct survivors are canonicalised (Python, Arrow batches); survivors
are grouped again on the key of their full canonical text, summing counts.

Defined results: a null text counts as an empty one, and all texts without a
letter or digit are copies of each other; repeated ids count once; an empty
table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm import canon
from memlake.runtime import Scratch, hot_safe_join


SCHEMA = "raw binary, n long, first_id long, seq_key binary, field_key binary"


def _canonical(extra=None):
    def run(batches):
        for b in batches:
            texts = b.column("content").to_pylist()
            runs = [canon.runs(t or "") for t in texts]
            ks = [canon.keys(t, r) for t, r in zip(texts, runs)]
            columns = {"raw": b.column("raw"), "n": b.column("n"), "first_id": b.column("first_id")}
            columns |= {"seq_key": pa.array([k[0] for k in ks], pa.binary()), "field_key": pa.array([k[1] for k in ks], pa.binary())}
            if extra:
                columns |= extra(texts, runs)
            yield pa.RecordBatch.from_pydict(columns)

    return run


def copy_classes(df: DataFrame, id_col: str = "id", text_col: str = "content", extra=None, extra_schema: str = "") -> tuple[DataFrame, DataFrame, int, Scratch]:
    """(rows: id, raw), (survivors: raw, n, keep_id, copies) of the copy relation.

    ``extra`` maps a list of texts and their runs to more Arrow columns, made in
    the same pass and found in the scratch table ``canonical``.
    """
    scratch = Scratch(df.sparkSession)
    base = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    rows = base.select("id", F.unhex(F.md5("content")).alias("raw"))
    survivors = base.select(F.unhex(F.md5("content")).alias("raw"), "content", "id").groupBy("raw", "content").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    canonical = scratch.save(survivors.mapInArrow(_canonical(extra), SCHEMA + extra_schema), "canonical")
    # a text in an unreadable notation joins the labelled texts with the same runs
    by_seq = canonical.groupBy("seq_key").agg(F.min("field_key").alias("f"), F.min("first_id").alias("first_id"), F.sum("n").alias("n"))
    by_seq = by_seq.withColumn("key", F.coalesce("f", "seq_key"))
    by_key = by_seq.groupBy("key").agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("copies"))
    seq_keep = by_seq.select("seq_key", "key").join(by_key, "key").select("seq_key", "keep_id", "copies")
    table = scratch.save(canonical.select("raw", "n", "seq_key").join(seq_keep, "seq_key").select("raw", "n", "keep_id", "copies"), "classes")
    total = table.agg(F.sum("n")).first()[0] or 0
    return rows, table, total, scratch


def copies(df: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(keep_id, copy_id): each record that is a copy, with the smallest id of its copies."""
    rows, classes, total, _ = copy_classes(df, id_col, text_col)
    found = hot_safe_join(rows, classes.filter(F.col("copies") > 1).drop("copies"), "raw", "n", total)
    return found.filter(F.col("id") != F.col("keep_id")).select("keep_id", F.col("id").alias("copy_id")).distinct()


def copy_counts(df: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(keep_id, copies): one row for each record that survives, with the number of its copies, itself included."""
    _, classes, _, _ = copy_classes(df, id_col, text_col)
    return classes.groupBy("keep_id").agg(F.first("copies").alias("copies"))

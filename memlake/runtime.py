"""Scratch tables in the shared folder, and joins that survive hot keys.

Everything that cuts lineage goes through :class:`Scratch`: Parquet tables
under ``spark.checkpoint.dir``, which every executor can read, so a lost
executor costs a re-read and nothing else.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, else the context's checkpoint directory; a temporary folder only where both are unset on a local master (tests)."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.memlake.scratch", None)
    if not root and context._jsc.sc().getCheckpointDir().isDefined():
        root = context._jsc.sc().getCheckpointDir().get()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="memlake-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.memlake.scratch", root)
    return root.rstrip("/")


_MADE: list[Scratch] = []


def _clean() -> None:
    """At the end of the driver: results may be read until then."""
    for s in _MADE:
        try:
            s.drop("")
        except Exception:  # noqa: BLE001  the session may be gone, and its tables with it
            return


class Scratch:
    """Named Parquet tables of one operator run, removed when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/memlake-{uuid.uuid4().hex}"
        if not _MADE:
            atexit.register(_clean)
        _MADE.append(self)

    def save(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


#: A key is hot when it holds more than one in HOT_SHARE rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def hot_safe_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``table`` (unique ``key``, with the number of rows of each in ``count``).

    The at most ``HOT_SHARE`` keys that hold more than ``total / HOT_SHARE``
    rows each are broadcast, so no task receives a hot key's rows; all others
    take the shuffle join. ``how`` is inner or left; the result is the same as
    of one plain join.
    """
    limit = max(1, total // HOT_SHARE)
    hot = table.filter(F.col(count) > limit).drop(count)
    cold = table.filter(F.col(count) <= limit).drop(count)
    mark = F.broadcast(hot.select(key).withColumn("__hot", F.lit(True)))
    tagged = rows.join(mark, key, "left")
    a = tagged.filter(F.col("__hot")).drop("__hot").join(F.broadcast(hot), key, "inner")
    b = tagged.filter(F.col("__hot").isNull()).drop("__hot").join(cold, key, how)
    return a.unionByName(b)


#: Keys of fewer rows than this are never hot.
MIN_HOT = 10_000


def hubs(rows: DataFrame, key: str, total: int) -> DataFrame:
    """(key, __copies): the at most ``HOT_SHARE`` hot keys of ``rows``, with the number of tasks to share each."""
    limit = max(MIN_HOT, total // HOT_SHARE)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__copies"))


def salted_join(rows: DataFrame, table: DataFrame, key: str, by: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``table`` (unique ``key``), the rows of each key of ``hot`` (see ``hubs``) shared out by the hash of ``by``.

    Either side is used once, so chains of such joins stay linear plans.
    """
    copies = F.coalesce("__copies", F.lit(1))
    a = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), copies).cast("int")).drop("__copies")
    b = table.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__copies")
    return a.join(b, [key, "__salt"], how).drop("__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Problem 3: consolidating pairwise matches into groups by low-diameter decomposition.

Each level: every vertex draws an exponential shift, clusters grow from the
vertices with the largest shifts along the edges (a vertex joins the cluster
that reaches it first: the least of distance minus shift), clusters are
contracted to super-vertices, and the next level works on the edges between
clusters. Assignments are composed from the last level back. Growth is cut
after STEPS rounds, which never joins unconnected vertices and only leaves
more for the next level.

Every level is a few jobs over tables in the shared scratch folder; the driver
sees only whether edges are left.

Defined results: self edges, nulls and NaN similarities link nothing; repeated
rows and both directions of an edge count once; hashes that are neither 64 hex
digits nor a 12-digit prefix of exactly one known hash link nothing; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.runtime import HOT_SHARE, MIN_HOT, Scratch, hot_safe_join, salted_join

BETA, STEPS = 0.15, 4
#: Short hashes up to this many (12 bytes each) are broadcast to find their full forms; more take a shuffle join.
MAX_BROADCAST_SHORT = 200_000


def _shift(v: Column, level: int) -> Column:
    u = (F.pmod(F.xxhash64(v, F.lit(level)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / BETA


def hubs_of(counts: DataFrame, key: str, n: str) -> DataFrame:
    """(key, __copies) of the keys that hold more than one in HOT_SHARE of all rows, from the rows of each key."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    limit = max(MIN_HOT, total // HOT_SHARE)
    return counts.filter(F.col(n) > limit).select(key, F.ceil(F.col(n) / limit).cast("int").alias("__copies"))


def _decompose(edges: DataFrame, level: int, scratch: Scratch) -> DataFrame:
    """(v, c): the cluster, named by one of its vertices, of every vertex of ``edges``.

    A vertex keeps its label by a link to itself, so each step uses the labels
    of the one before once and the steps of a level are one linear plan. The
    links of a hub are shared out over several tasks.
    """
    pair = lambda v, to, w: F.struct(v.alias("v"), to.alias("to"), F.lit(w).alias("w"))
    ends = edges.select(F.explode(F.array(pair(F.col("a"), F.col("b"), 1), pair(F.col("b"), F.col("a"), 1))).alias("e")).select("e.*")
    degree = scratch.save(ends.groupBy("v").agg(F.count(F.lit(1)).alias("n")), f"degree{level}")
    hot = scratch.save(hubs_of(degree, "v", "n"), f"hubs{level}")
    links = scratch.save(ends.unionByName(degree.select("v", F.col("v").alias("to"), F.lit(0).alias("w"))), f"links{level}")
    label = degree.select("v", (-_shift(F.col("v"), level)).alias("d"), F.col("v").alias("c"))
    for _ in range(STEPS):
        sent = salted_join(links, label, "v", "to", hot).select(F.col("to").alias("v"), (F.col("d") + F.col("w")).alias("d"), "c")
        label = sent.groupBy("v").agg(F.min("d").alias("d"), F.min_by("c", "d").alias("c"))
    return scratch.save(label.select("v", "c"), f"map{level}")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(v, root): for every vertex of ``edges`` (a, b longs) the representative of its connected component."""
    scratch = scratch or Scratch(edges.sparkSession)
    left = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = scratch.save(left, "edges0")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        k = len(maps)
        cluster = _decompose(left, k, scratch)
        maps.append(cluster)
        hot = scratch.spark.read.schema("v long, __copies int").parquet(f"{scratch.root}/hubs{k}")
        a, b = (cluster.select(F.col("v").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
        cut = salted_join(left, a, "a", "b", hot.withColumnRenamed("v", "a"))
        cut = salted_join(cut, b, "b", "a", hot.withColumnRenamed("v", "b")).filter("ca <> cb")
        left = scratch.save(cut.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), f"edges{k + 1}")
        scratch.drop(f"edges{k}", f"links{k}", f"degree{k}")
    if not maps:
        return left.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = maps[-1].select("v", F.col("c").alias("root"))
    for k in range(len(maps) - 2, -1, -1):
        above = out.select(F.col("v").alias("c"), "root")
        # a cluster may hold most vertices
        members = maps[k].groupBy("c").agg(F.count(F.lit(1)).alias("n"))
        out = salted_join(maps[k], above, "c", "v", hubs_of(members, "c", "n"), "left").select("v", F.coalesce("root", "c").alias("root"))
    return scratch.save(out, "roots")


def clean_hash(c: Column) -> Column:
    """Lower case, without outer white space and any ``sha256:`` prefix; null unless 64 or 12 hex digits."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)^sha256:\s*", "")
    return F.when(bare.rlike("^([0-9a-f]{64}|[0-9a-f]{12})$"), bare)


def link_groups(graph: DataFrame, known: DataFrame, known_col: str = "content_hash", types=("related", "supports"), min_similarity: float = 0.80) -> DataFrame:
    """(content_hash, group_hash): one row for each hash in a group of two or more, with the group's smallest hash."""
    scratch = Scratch(graph.sparkSession)
    kind = F.lower(F.regexp_replace("relationship_type", r"(?U)^\s+|\s+$", ""))
    linking = kind.isin(*types) & (F.col("similarity") >= min_similarity) & ~F.isnan("similarity")
    links = graph.filter(linking).select(clean_hash(F.col("source_hash")).alias("s"), clean_hash(F.col("target_hash")).alias("t"))
    links = scratch.save(links.filter("s is not null and t is not null").distinct(), "pairs")
    ends = scratch.save(links.select(F.explode(F.array("s", "t")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")), "ends")
    hot = scratch.save(hubs_of(ends, "h", "n"), "hot")
    short = scratch.save(ends.filter(F.length("h") == 12).select("h"), "short")
    n = short.count()
    names = ends.filter(F.length("h") == 64).select("h", F.col("h").alias("full"))
    if n:
        universe = known.select(clean_hash(F.col(known_col)).alias("full")).unionByName(graph.select(F.explode(F.array(clean_hash(F.col("source_hash")), clean_hash(F.col("target_hash")))).alias("full")))
        universe = universe.filter(F.length("full") == 64).withColumn("h", F.substring("full", 1, 12))
        completed = universe.join(F.broadcast(short) if n <= MAX_BROADCAST_SHORT else short, "h")
        completed = completed.groupBy("h").agg(F.min("full").alias("full"), F.max("full").alias("other")).filter("full = other").drop("other")
        names = names.unionByName(scratch.save(completed, "completed"))
    # order-preserving ids: the smallest id of a group is its smallest hash
    ids = names.select("full").distinct().repartitionByRange("full").sortWithinPartitions("full").withColumn("v", F.monotonically_increasing_id())
    ids = scratch.save(ids, "ids")
    names = scratch.save(names.join(ids, "full").select("h", "v"), "names")
    a, b = (names.select(F.col("h").alias(x), F.col("v").alias(y)) for x, y in (("s", "a"), ("t", "b")))
    numbered = salted_join(links, a, "s", "t", hot.withColumnRenamed("h", "s"))
    numbered = salted_join(numbered, b, "t", "s", hot.withColumnRenamed("h", "t"))
    roots = components(numbered.select("a", "b"), scratch)
    least = roots.groupBy("root").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n"))
    total = ids.count()
    first = ids.select(F.col("v").alias("least"), F.col("full").alias("group_hash"))
    heads = scratch.save(least.join(first, "least").select("root", "group_hash", "n"), "heads")
    grouped = hot_safe_join(roots, heads, "root", "n", total)
    return grouped.join(ids, "v").select(F.col("full").alias("content_hash"), "group_hash")

"""Graph operators: expansion, induced subgraphs, orphans, components, PageRank, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.runtime import Scratch, hubs, salted_join


def undirected(edges: DataFrame) -> DataFrame:
    """(node, other, similarity, relationship_type): each edge seen from both ends, self edges once."""
    out = edges.select(F.col("source_hash").alias("node"), F.col("target_hash").alias("other"), "similarity", "relationship_type")
    back = edges.filter("source_hash <> target_hash").select(F.col("target_hash").alias("node"), F.col("source_hash").alias("other"), "similarity", "relationship_type")
    return out.unionByName(back)


def expand(edges: DataFrame, seeds: DataFrame, k: int = 2, floor: float = 0.6, types=("related", "supports")) -> DataFrame:
    """(hash, similarity): one hop from the seeds (column hash) both ways, seeds aside, the k best."""
    near = undirected(edges).filter(F.col("relationship_type").isin(*types) & (F.col("similarity") > floor) & ~F.isnan("similarity"))
    near = near.join(seeds.select(F.col("hash").alias("node")).distinct(), "node", "left_semi").select(F.col("other").alias("hash"), "similarity")
    near = near.join(seeds.select("hash").distinct(), "hash", "left_anti").groupBy("hash").agg(F.max("similarity").alias("similarity"))
    return near.orderBy(F.desc("similarity"), "hash").limit(k)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (column hash)."""
    n = nodes.select("hash").distinct()
    return edges.join(n.withColumnRenamed("hash", "source_hash"), "source_hash", "left_semi").join(n.withColumnRenamed("hash", "target_hash"), "target_hash", "left_semi")


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that no node (column hash, nulls aside) has."""
    n = nodes.select("hash").dropna().distinct().withColumn("found", F.lit(True))
    s = n.select(F.col("hash").alias("source_hash"), F.col("found").alias("s"))
    t = n.select(F.col("hash").alias("target_hash"), F.col("found").alias("t"))
    return edges.join(s, "source_hash", "left").join(t, "target_hash", "left").filter("s is null or t is null").drop("s", "t")


def pairs(edges: DataFrame) -> DataFrame:
    """Distinct pairs of ends, direction aside."""
    return edges.select(F.least("source_hash", "target_hash").alias("a"), F.greatest("source_hash", "target_hash").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over (a, b) edges, by rounds of least labels and pointer jumping over saved tables."""
    scratch = Scratch(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = scratch.save(both, "both")
    labels = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels0")
    hot = scratch.save(hubs(both, "a", both.count()), "hubs")
    n, k = labels.count(), 0
    while True:
        sent = salted_join(both, labels.withColumnRenamed("node", "a"), "a", "b", hot).groupBy("b").agg(F.min("component").alias("m"))
        hooked = labels.join(sent.withColumnRenamed("b", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        k += 1
        hooked = scratch.save(hooked, f"hooked{k}")
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("further"))
        # a component may hold most nodes
        large = scratch.save(hubs(hooked, "component", n), f"large{k}")
        after = scratch.save(salted_join(hooked, jump, "component", "node", large).select("node", "old", F.col("further").alias("component")), f"labels{k}")
        changed = after.filter("old <> component").limit(1).count()
        labels = after.select("node", "component")
        scratch.drop(f"labels{k - 1}", f"hooked{k}", f"large{k}")
        if not changed:
            return labels


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 30, save_every: int = 5, nodes: DataFrame | None = None) -> DataFrame:
    """(node, rank) over (src, dst) edges: repeated edges accumulate, the rank of nodes without outgoing edges is lost. ``nodes`` may name more nodes than the edges do.

    Ranks pass through one linear plan, cut by a saved table every ``save_every`` rounds.
    """
    scratch = Scratch(edges.sparkSession)
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    links = scratch.save(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).join(out, "src").select("src", "dst", (F.col("n") / F.col("deg")).alias("w")), "links")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    nodes = scratch.save((ends if nodes is None else ends.unionByName(nodes.select("node"))).distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    hot = scratch.save(hubs(links, "src", links.count()), "hubs")
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for k in range(1, rounds + 1):
        given = salted_join(links, rank.withColumnRenamed("node", "src"), "src", "dst", hot).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("rank")).alias("got"))
        rank = nodes.join(given, "node", "left").select("node", (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % save_every == 0 and k < rounds:
            rank = scratch.save(rank, f"rank{k}")
    return rank

"""Vector operators: exact search, recall, reranking, neighbours, collapse, grouping, clustering."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import columns as C


def literal(vector: Sequence[float]):
    return F.array(*[F.lit(float(x)) for x in vector])


def similarities(emb: DataFrame, query: Sequence[float], id_col: str = "rowid", vector_col: str = "content_embedding") -> DataFrame:
    """(id, cosine) of every usable vector of the query's length; map-only, on the JVM side."""
    ok = emb.filter(C.usable_vector(F.col(vector_col), len(query)))
    return ok.select(F.col(id_col).alias("id"), C.cosine(F.col(vector_col), literal(query)).alias("cosine"))


def semantic_search(emb: DataFrame, query: Sequence[float], k: int = 10, floor: float = 0.3, allowed: DataFrame | None = None, skip: DataFrame | None = None, **cols) -> DataFrame:
    """(id, cosine), top k above the floor; filters go below the top-k."""
    hits = similarities(emb, query, **cols).filter(F.col("cosine") > floor).groupBy("id").agg(F.max("cosine").alias("cosine"))
    if allowed is not None:
        hits = hits.join(allowed.select("id"), "id", "left_semi")
    if skip is not None:
        hits = hits.join(skip.select("id"), "id", "left_anti")
    return hits.orderBy(F.desc("cosine"), "id").limit(k)


def rerank(ids: DataFrame, emb: DataFrame, query: Sequence[float], **cols) -> DataFrame:
    """(id, score) for every given id: no usable vector and negative cosines count 0."""
    s = similarities(emb, query, **cols).groupBy("id").agg(F.max("cosine").alias("cosine"))
    return ids.join(s, "id", "left").select("id", F.greatest(F.coalesce("cosine", F.lit(0.0)), F.lit(0.0)).alias("score"))


#: Rows of a block: two of them and their product fit a task.
BLOCK = 4096


def _blocks(vectors: DataFrame, blocks: int | None) -> int:
    return blocks or max(1, -(-vectors.count() // BLOCK))


def _units(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    x = np.asarray(values.flatten(), dtype=np.float64).reshape(len(values), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _groups(t: pa.Table, keys: list[str]) -> np.ndarray:
    """A number for each row, equal where the keys are."""
    if not keys:
        return np.zeros(t.num_rows, int)
    seen: dict = {}
    return np.array([seen.setdefault(k, len(seen)) for k in zip(*[t.column(k).to_pylist() for k in keys])], int)


def block_pairs(vectors: DataFrame, floor: float, blocks: int | None = None, same: Sequence[str] = ()) -> DataFrame:
    """(a, b, cosine), a < b, of all pairs with cosine >= floor, exact: a grid of block pairs, each one matrix product.

    ``vectors`` has id, v and the columns of ``same``, which must be equal in a
    pair (nulls are equal to nothing). The number of blocks follows from the
    rows, so a task holds two blocks of about BLOCK rows at any size; the work
    is n^2 / 2, as that of any exact answer.
    """
    keys = list(same)
    rows = vectors.dropna(subset=keys) if keys else vectors
    blocks = _blocks(rows, blocks)
    rows = rows.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("id", "v", *keys, "c", F.least("c", "m").alias("lo"), F.greatest("c", "m").alias("hi"))

    def compare(key, t):
        lo, hi = (k.as_py() for k in key)
        ids, c, x, group = t.column("id").to_numpy(), t.column("c").to_numpy(), _units(t.column("v")), _groups(t, keys)
        order = np.argsort(group, kind="stable")
        a, b, s = [], [], []
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            left, right = own[c[own] == lo], own[c[own] == hi]
            for at in range(0, len(left), 2048):
                part = left[at : at + 2048]
                cos = x[part] @ x[right].T
                i, j = np.nonzero(cos >= floor)
                u, w = ids[part[i]], ids[right[j]]
                keep = u != w if lo != hi else u < w
                a.append(np.minimum(u, w)[keep])
                b.append(np.maximum(u, w)[keep])
                s.append(cos[i, j][keep])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"a": join(a, pa.int64()), "b": join(b, pa.int64()), "cosine": join(s, pa.float64())})

    return rows.groupBy("lo", "hi").applyInArrow(compare, "a long, b long, cosine double")


def neighbours_of(vectors: DataFrame, queries: DataFrame, k: int, floor: float, blocks: int | None = None, same: Sequence[str] = ()) -> DataFrame:
    """(id, neighbor_id, cosine, rank): exact top k of each query row among all vectors (with equal ``same`` columns), itself aside.

    Queries meet the vectors in blocks; each block keeps k candidates a query,
    so what is shuffled is queries * blocks * k rows.
    """
    keys = list(same)
    blocks = _blocks(vectors, blocks)
    q = queries.select("id", "v", *keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("q", F.lit(True))
    rows = vectors.select("id", "v", *keys).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("q", F.lit(False))
    # the queries of a block in parts, so that a task's memory doesn't grow with them
    parts = max(1, -(-queries.count() // BLOCK))
    q = q.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    both = q.unionByName(rows)

    def search(t):
        ids, asks, x, group = t.column("id").to_numpy(), np.asarray(t.column("q")), _units(t.column("v")), _groups(t, keys)
        order = np.argsort(group, kind="stable")
        out = []
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            qs, xs = own[asks[own]], own[~asks[own]]
            xs = xs[np.argsort(ids[xs], kind="stable")]
            for at in range(0, len(qs) if len(xs) else 0, 512):
                part = qs[at : at + 512]
                cos = x[part] @ x[xs].T
                cos[ids[part][:, None] == ids[xs]] = -np.inf
                top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
                i = np.repeat(np.arange(len(part)), top.shape[1])
                j = top.ravel()
                keep = cos[i, j] >= floor
                out.append((ids[part][i][keep], ids[xs][j][keep], cos[i, j][keep]))
        cols = [np.concatenate(c) if out else [] for c in zip(*out)] if out else [[], [], []]
        return pa.table({"id": pa.array(cols[0], pa.int64()), "neighbor_id": pa.array(cols[1], pa.int64()), "cosine": pa.array(cols[2], pa.float64())})

    found = both.dropna(subset=keys).groupBy("block", "part").applyInArrow(search, "id long, neighbor_id long, cosine double") if keys else both.groupBy("block", "part").applyInArrow(search, "id long, neighbor_id long, cosine double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbor_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def collapse(ranked: list[tuple], limit: int, threshold: float = 0.95) -> tuple[list, dict]:
    """Greedy near-duplicate collapse in rank order of (id, type, projects, vector): kept ids, and {kept: folded ids}.

    A row folds into the first kept one of its type and projects whose cosine
    reaches the threshold; rows without a vector are always kept.
    """
    kept, folded = [], {}
    for rid, kind, projects, v in ranked:
        x = None if v is None or not np.any(v) else np.asarray(v, float) / np.linalg.norm(v)
        home = next((k for k in kept if x is not None and k[3] is not None and k[1] == kind and k[2] == projects and len(k[3]) == len(x) and float(k[3] @ x) >= threshold), None)
        if home:
            folded.setdefault(home[0], []).append(rid)
        elif len(kept) < limit:
            kept.append((rid, kind, projects, x))
    return [k[0] for k in kept], folded


def greedy_groups(vectors: np.ndarray, threshold: float = 0.85) -> list[int]:
    """The group of each row in order: the first unassigned row seeds a group of all unassigned rows near it."""
    x = np.asarray(vectors, float)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    group = np.full(len(x), -1)
    for i in range(len(x)):
        if group[i] < 0:
            group[(group < 0) & (x @ x[i] >= threshold)] = i
            group[i] = i
    return group.tolist()


def hdbscan(x: np.ndarray, min_size: int = 3) -> np.ndarray:
    """Density clusters of the rows of a bounded group (-1: noise): mutual reachability, spanning tree, condensed tree, excess of mass."""
    x = np.asarray(x, float)
    n = len(x)
    if n < min_size:
        return np.full(n, -1)
    square = (x * x).sum(axis=1)

    def distances(rows) -> np.ndarray:
        return np.sqrt(np.maximum(square[rows][:, None] + square - 2 * (x[rows] @ x.T), 0))

    # distances are made row by row, so memory grows with the rows and not with their square
    nth = min(min_size - 1, n - 1)
    core = np.concatenate([np.partition(distances(np.arange(at, min(at + 512, n))), nth, axis=1)[:, nth] for at in range(0, n, 512)])
    # Prim's spanning tree of the mutual reachability
    inside, best, link = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    edges, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        reach = np.maximum(distances(np.array([at]))[0], np.maximum(core, core[at]))
        closer = ~inside & (reach < best)
        best[closer], link[closer] = reach[closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[at], link[at], at))
    edges.sort()
    # single linkage: nodes n.. join two trees at a distance
    parent, size, children, height = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), {}, {}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (w, a, b) in enumerate(edges):
        a, b, new = root(a), root(b), n + k
        parent[a] = parent[b] = new
        size[new], children[new], height[new] = size[a] + size[b], (a, b), w

    def leaves(node):
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += children[v]
        return out

    # condensed tree: (stability, points, child clusters) of each cluster
    def grow(node, birth):
        stability, cluster_children, points = 0.0, [], leaves(node)
        while True:
            if node < n:
                break
            lam = 1 / max(height[node], 1e-12)
            a, b = children[node]
            big = [c for c in (a, b) if size[c] >= min_size]
            if len(big) == 2:
                stability += size[node] * (lam - birth)
                cluster_children = [grow(c, lam) for c in big]
                break
            stability += (size[node] - (size[big[0]] if big else 0)) * (lam - birth)
            if not big:
                break
            node = big[0]
        below = sum(c[0] for c in cluster_children)
        if cluster_children and below > stability:
            return below, [p for c in cluster_children for p in c[1]]
        return stability, [points]

    top = 2 * n - 2
    # the root itself is no cluster
    node, parts = top, []
    while node >= n:
        lam = 1 / max(height[node], 1e-12)
        big = [c for c in children[node] if size[c] >= min_size]
        if len(big) == 2:
            parts = [p for c in big for p in grow(c, lam)[1]]
            break
        if not big:
            break
        node = big[0]
    label = np.full(n, -1)
    for k, p in enumerate(sorted(parts, key=min)):
        label[p] = k
    return label

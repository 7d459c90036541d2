"""Problem 1: the most similar vectors for every vector, by NN-descent.

The neighbour graph is seeded from random cells: each table draws random
directions, a vector falls in the cell of the direction nearest to it, and
the vectors of a cell are compared in blocks (8-bit codes). NN-descent then
improves it by joins of neighbours of neighbours: in each round every vector
joins the local joins of PIVOTS members of its neighbour list (itself
included), the best-connected first and the next ones in the next round, so
vectors that share a neighbour meet and are compared at half precision. Rounds
go on until no more than CHANGED of the pairs found are new (LEAST_ROUNDS at
least, ROUNDS at most).
Lists are merged on the JVM side.

Cells and local joins above MAX_BLOCK rows are split again by the nearest of
further random directions, seen from the mean of the block, level by level, so
a cell that holds a third of all rows stays linear and its near rows stay
together. Only rows that no direction tells apart are cut into random chunks.
Rows with the very same vector are searched once, by their smallest id, and
share its list: they are each other's nearest neighbours.

Defined results: unusable vectors (null, another length, a null or non-finite
number, all zero) have no rows; a repeated rowid counts once, with the vector
of the least digest if it comes with several; ties go to the smaller id; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.runtime import Scratch, hot_safe_join

TABLES, CELL, MAX_BLOCK = 8, 2048, 8192
SPARE, PIVOTS, FLOOR = 3, 2, 0.70
#: A large block is split at most FAN ways a level, LEVELS deep. Rounds end, after two, when so small a share of the pairs found is new.
FAN, LEVELS, LEAST_ROUNDS, ROUNDS, CHANGED = 64, 32, 2, 9, 0.005
#: Lists of rows to leave out (24 bytes a row) and of large blocks are broadcast up to this many rows, else joined by shuffle.
MAX_BROADCAST = 200_000


def usable(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, float32 matrix) of the usable vectors of a batch (columns rowid, v)."""
    column = batch.column("v")
    if not isinstance(column, pa.ListArray):
        column = column.cast(pa.list_(pa.float32()))
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero((lengths == dim) & ~np.asarray(batch.column("rowid").is_null()))
    if not len(at):
        return at, np.empty((0, dim), np.float32)
    values = column.values.cast(pa.float32()).to_numpy(zero_copy_only=False)
    starts = np.asarray(column.offsets)[:-1][at]
    x = values[starts[:, None] + np.arange(dim)]
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[good], np.ascontiguousarray(x[good])


def _digests(x: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(r.tobytes(), digest_size=12).digest() for r in x + np.float32(0)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _cells(x: np.ndarray, count: int, dim: int) -> np.ndarray:
    """[rows, TABLES]: the cell of each vector in each table, by nearest random direction (two sets of them beyond 1024 cells)."""
    out = np.zeros((len(x), TABLES), np.int64)
    first = min(count, 1024)
    second = math.ceil(count / first)
    for t in range(TABLES):
        rng = np.random.default_rng(1000 + t)
        out[:, t] = (x @ rng.standard_normal((dim, first)).astype(np.float32)).argmax(axis=1)
        if second > 1:
            out[:, t] = out[:, t] * second + (x @ rng.standard_normal((dim, second)).astype(np.float32)).argmax(axis=1)
        out[:, t] |= t << 40
    return out


def _keys(dim, cells):
    def run(batches):
        for b in batches:
            at, x = usable(b, dim)
            blocks = _cells(_unit(x), cells, dim) if len(x) else np.empty((0, TABLES), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * TABLES), pa.array(blocks.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("rowid").take(pa.array(at)), pa.array(_digests(x), pa.binary()), lists], names=["rowid", "h", "blocks"])

    return run


def _codes(dim, half: bool):
    def run(batches):
        for b in batches:
            at, x = usable(b, dim)
            u = _unit(x) if len(x) else x
            if half:
                v = [r.tobytes() for r in u.astype(np.float16)]
            else:
                scale = np.abs(u).max(axis=1, keepdims=True) if len(u) else np.ones((0, 1))
                v = [r.tobytes() for r in np.rint(u / scale * 127).astype(np.int8)]
            yield pa.RecordBatch.from_arrays([b.column("rowid").take(pa.array(at)), pa.array(_digests(x), pa.binary()), pa.array(v, pa.binary())], names=["rowid", "h", "v"])

    return run


def _compare(ids: np.ndarray, x: np.ndarray, k: int, floor: float, decimals: int):
    """For each row of a block its up to k most similar others: (rows, list lengths, others, negative similarities)."""
    if len(ids) > 1:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        if (ids[1:] == ids[:-1]).any():
            first = np.concatenate([[True], ids[1:] != ids[:-1]])
            ids, x = ids[first], x[first]
    us, ns, vs, ss = [], [], [], []
    for at in range(0, len(ids), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -1
        if floor > 0 or len(ids) <= 2 * k:
            r, c = np.nonzero(s >= floor)
        else:
            # without a telling floor: the best k of each row before any sorting
            c = np.argpartition(-s, k, axis=1)[:, :k].ravel()
            r = np.repeat(np.arange(len(s)), k)
            r, c = r[s[r, c] >= floor], c[s[r, c] >= floor]
        if not len(r):
            continue
        val = s[r, c]
        # columns are in rising order of id, and the sort is stable
        order = np.lexsort((-val, r)) if floor > 0 else np.lexsort((ids[c], -val, r))
        r, c, val = r[order], c[order], val[order]
        count = np.bincount(r, minlength=len(s))
        if count.max() > k:
            keep = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count) < k
            c, val, count = c[keep], val[keep], np.minimum(count, k)
        has = count > 0
        us.append(ids[at : at + len(s)][has])
        ns.append(count[has])
        vs.append(ids[c])
        ss.append(-np.round(np.minimum(val, 1), decimals))
    return us, ns, vs, ss


def _lists(found) -> pa.RecordBatch:
    """One batch (u, near) of the results of many blocks."""
    found = list(found)
    us, ns, vs, ss = ([a for f in found for a in f[k]] for k in range(4))
    n = np.concatenate(ns) if ns else np.empty(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(ss).astype(np.float32) if ss else [], pa.float32()), pa.array(np.concatenate(vs) if vs else [], pa.int64())], names=["d", "v"])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us) if us else [], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pairs)], names=["u", "near"])


def _sweep(dim, half: bool, k: int, floor: float):
    """Rows sorted by (block, chunk) to lists: blocks are taken as they end, many to an Arrow batch (local joins are mostly of a few rows)."""

    def run(batches):
        kept: list = []
        for b in batches:
            if not b.num_rows:
                continue
            code = np.frombuffer(b"".join(b.column("v").to_pylist()), np.float16 if half else np.int8).reshape(-1, dim)
            rows = (b.column("rowid").to_numpy(), b.column("block").to_numpy(), b.column("chunk").to_numpy(), code)
            if kept:
                rows = tuple(np.concatenate([a, c]) for a, c in zip(kept, rows))
            ids, block, chunk, code = rows
            ends = np.flatnonzero((block[1:] != block[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            last = int(ends[-1]) if len(ends) else 0
            yield _lists(_blocks_of(ids[:last], code[:last], ends, k, floor, half))
            kept = [a[last:] for a in rows]
        if kept:
            ids, _, _, code = kept
            yield _lists(_blocks_of(ids, code, np.array([len(ids)]), k, floor, half))

    return run


def _blocks_of(ids, code, ends, k, floor, half):
    x = code.astype(np.float32)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] if len(x) else 1
    start = 0
    for end in ends:
        if end - start > 1:
            yield _compare(ids[start:end], x[start:end], k, floor, 6 if half else 5)
        start = end


def _joined(rows: DataFrame, dim: int, half: bool, k: int, floor: float) -> DataFrame:
    return rows.select("rowid", "block", "chunk", "v").repartition("block", "chunk").sortWithinPartitions("block", "chunk").mapInArrow(_sweep(dim, half, k, floor), NEAR)


NEAR = "u long, near array<struct<d:float,v:long>>"


def _bounded(df: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """A saved table, broadcast if small enough."""
    df = scratch.save(df, name)
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def _matrix(codes: pa.Array, dim: int, half: bool) -> np.ndarray:
    """Unit vectors of codes."""
    x = np.frombuffer(b"".join(codes.to_pylist()), np.float16 if half else np.int8).reshape(-1, dim).astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _split(block: np.ndarray, codes: pa.Array, plan: list, dim: int, half: bool) -> np.ndarray:
    """The block of each row after the levels of ``plan``: (level, sorted blocks, ways, means)."""
    block, at, x = block.copy(), np.arange(len(block)), None
    for level, ids, ways, means in plan:
        k = np.minimum(np.searchsorted(ids, block[at]), len(ids) - 1)
        hit = ids[k] == block[at]
        at, k = at[hit], k[hit]
        if not len(at):
            break
        x = _matrix(codes.take(pa.array(at)), dim, half) if x is None else x[hit]
        part = block[at] >> 40
        for t in np.unique(part):
            own = np.flatnonzero(part == t)
            rng = np.random.default_rng([int(t) & 0xFFFFFFFF, level, 77])
            scores = (x[own] - means[k[own]]) @ rng.standard_normal((dim, FAN)).astype(np.float32)
            scores[np.arange(FAN) >= ways[k[own]][:, None]] = -np.inf
            child = block[at[own]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (scores.argmax(axis=1).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
            block[at[own]] = t << 40 | (child >> np.uint64(24)).astype(np.int64)
    return block


def _sums(plan: list, wanted: np.ndarray, dim: int, half: bool):
    """Number and sum of the vectors of each block that the last level of ``plan`` makes of the blocks ``wanted`` (of these blocks themselves without a level)."""

    def run(batches):
        total: dict = {}
        for b in batches:
            codes = b.column("v")
            parent = _split(b.column("block").to_numpy(), codes, plan[:-1], dim, half)
            at = np.flatnonzero(np.isin(parent, wanted))
            if not len(at):
                continue
            codes, parent = codes.take(pa.array(at)), parent[at]
            block = _split(parent, codes, plan[-1:], dim, half)
            order = np.argsort(block, kind="stable")
            block, start, n = np.unique(block[order], return_index=True, return_counts=True)
            s = np.add.reduceat(_matrix(codes, dim, half)[order].astype(np.float64), start)
            for i, p, m, v in zip(block.tolist(), parent[order][start].tolist(), n.tolist(), s):
                old = total.get(i, (p, 0, 0.0))
                total[i] = (p, old[1] + m, old[2] + v)
        rows = [(i, p, n, s.tolist()) for i, (p, n, s) in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())))], names=["block", "parent", "n", "s"])

    return run


def _added(t: pa.Table) -> pa.Table:
    s = np.sum(np.array(t.column("s").to_pylist()), axis=0)
    return pa.table({"block": t.column("block")[:1], "parent": t.column("parent")[:1], "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "s": pa.array([s.tolist()], pa.list_(pa.float64()))})


def _plan(spread: DataFrame, large: dict[int, int], dim: int, half: bool) -> tuple[list, dict[int, int]]:
    """The levels of splits, and the large blocks that no direction splits any more."""
    plan: list = []
    stuck: dict[int, int] = {}
    schema = "block long, parent long, n long, s array<double>"
    while large:
        sums = spread.mapInArrow(_sums(plan, np.array(sorted(large), np.int64), dim, half), schema)
        got = sums.groupBy("block").applyInArrow(_added, schema).filter(F.col("n") > MAX_BLOCK).orderBy("block").collect()
        if plan:
            stuck |= {r.block: r.n for r in got if r.n == large[r.parent] or len(plan) == LEVELS}
        got = [r for r in got if r.block not in stuck]
        large = {r.block: r.n for r in got}
        if got:
            n = np.array([r.n for r in got])
            plan.append((len(plan), np.array([r.block for r in got], np.int64), np.clip(-(-n // CELL), 2, FAN), (np.array([r.s for r in got]) / n[:, None]).astype(np.float32)))
    return plan, stuck


def _blocks(spread: DataFrame, sizes: DataFrame, dim: int, half: bool) -> DataFrame:
    """The rows (rowid, v, block) with large blocks split, and their chunk."""
    spread = spread.select("rowid", "v", "block")
    large = {r[0]: r[1] for r in sizes.filter(F.col("count") > MAX_BLOCK).select("block", "count").collect()}
    if not large:
        return spread.withColumn("chunk", F.lit(0))
    plan, stuck = _plan(spread, large, dim, half)
    whole = np.array(sorted(stuck), np.int64)
    parts = np.array([-(-stuck[i] // MAX_BLOCK) for i in whole.tolist()], np.int64)

    def split(batches):
        for b in batches:
            block = _split(b.column("block").to_numpy(), b.column("v"), plan, dim, half)
            chunk = np.zeros(len(block), np.int32)
            if len(whole):
                k = np.minimum(np.searchsorted(whole, block), len(whole) - 1)
                at = np.flatnonzero(whole[k] == block)
                mixed = (b.column("rowid").to_numpy()[at] ^ block[at]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                chunk[at] = mixed.astype(np.int64) % parts[k[at]]
            yield pa.RecordBatch.from_arrays([b.column("rowid"), b.column("v"), pa.array(block), pa.array(chunk)], names=["rowid", "v", "block", "chunk"])

    return spread.mapInArrow(split, "rowid long, v binary, block long, chunk int")


def _merge(lists: DataFrame, k: int) -> DataFrame:
    return lists.groupBy("u").agg(F.slice(F.array_distinct(F.array_sort(F.flatten(F.collect_list("near")))), 1, k).alias("near"))


class _Vectors:
    """The usable vectors of a table, each distinct one once (by its smallest id), and the classes of equal ones."""

    def __init__(self, df: DataFrame, dim: int, id_col: str, vector_col: str, scratch: Scratch):
        self.dim, self.scratch = dim, scratch
        self.source = df.select(F.col(id_col).cast("long").alias("rowid"), F.col(vector_col).alias("v"))
        self.cells = max(1, math.ceil(df.count() / CELL))
        keys = self.source.mapInArrow(_keys(dim, self.cells), "rowid long, h binary, blocks array<long>")
        keys = keys.groupBy("rowid").agg(F.min(F.struct("h", "blocks")).alias("m"), F.max("h").alias("other")).select("rowid", "m.h", "m.blocks", "other")
        keys = scratch.save(keys, "keys")
        classes = scratch.save(keys.groupBy("h").agg(F.min("rowid").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "classes")
        self.total = classes.agg(F.sum("n")).first()[0] or 0
        self.twins = self.left_out = self.conflicts = None
        if self.total:
            twins = hot_safe_join(keys.select("rowid", "h"), classes.withColumn("m", F.col("n")), "h", "n", self.total).withColumnRenamed("m", "n")
            self.twins = scratch.save(twins.select("rowid", "rep", "n"), "twins")
            self.left_out = _bounded(self.twins.filter("rowid <> rep").select("rowid"), "left_out", scratch)
        conflicts = keys.filter("h <> other").select("rowid", F.col("h").alias("right"))
        if not conflicts.isEmpty():
            self.conflicts = _bounded(conflicts, "conflicts", scratch)
        searched = keys.select("rowid", "blocks")
        if self.left_out is not None:
            searched = searched.join(self.left_out, "rowid", "left_anti")
        self.sizes = searched.select(F.explode("blocks").alias("block")).groupBy("block").count()

    def _own(self, rows: DataFrame) -> DataFrame:
        if self.conflicts is not None:
            rows = rows.join(self.conflicts, "rowid", "left").filter("right is null or h = right").drop("right")
        return rows if self.left_out is None else rows.join(self.left_out, "rowid", "left_anti")

    def codes(self) -> DataFrame:
        """(rowid, v) at half precision."""
        return self._own(self.source.mapInArrow(_codes(self.dim, True), "rowid long, h binary, v binary")).drop("h")

    def spread(self) -> DataFrame:
        """(rowid, h, v, block): 8-bit codes in every cell."""
        return self._own(self.source.mapInArrow(_spread(self.dim, self.cells), "rowid long, h binary, v binary, block long"))


def _descend(vectors: _Vectors, k: int, size: int, floor: float, min_similarity: float, rounds: int) -> DataFrame:
    """(u, near): the neighbour graph by NN-descent, lists of ``size`` at ``floor`` and more."""
    dim, scratch = vectors.dim, vectors.scratch
    seeded = _joined(_blocks(vectors.spread(), vectors.sizes, dim, False), dim, False, size, floor - 0.02)
    graph = scratch.save(_merge(seeded, size), "graph0")
    for r in range(rounds):
        edges = graph.select("u", F.explode("near.v").alias("v"))
        degree = edges.groupBy("v").agg(F.count(F.lit(1)).alias("deg"))
        lists = edges.unionByName(graph.select("u", F.col("u").alias("v"))).join(degree, "v", "left").groupBy("u").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.coalesce("deg", F.lit(0))).alias("d"), "v"))), r * PIVOTS % (size + 1) + 1, PIVOTS).alias("p"))
        joins = scratch.save(lists.select(F.col("u").alias("rowid"), F.explode("p.v").alias("block")), f"joins{r}")
        # a hash join: the lists are far smaller than the vectors, which then needn't be sorted
        met = vectors.codes().join(joins.hint("shuffle_hash"), "rowid")
        local = _joined(_blocks(met, joins.groupBy("block").count(), dim, True), dim, True, size, floor)
        # a pair met at half precision replaces the value of the 8-bit codes
        fine = local.select("u", F.explode("near").alias("e")).select("u", "e.v", "e.d", F.lit(1).alias("fine"))
        coarse = graph.select("u", F.explode("near").alias("e")).select("u", "e.v", "e.d", F.lit(0).alias("fine"))
        best = fine.unionByName(coarse).groupBy("u", "v").agg(F.max(F.struct("fine", "d")).alias("m"), F.min("fine").alias("new")).select("u", F.struct("m.d", "v", "new").alias("e"))
        graph = scratch.save(best.groupBy("u").agg(F.slice(F.array_sort(F.collect_list("e")), 1, size).alias("near")), f"graph{r + 1}")
        scratch.drop(f"graph{r}", f"joins{r}")
        first = graph.select(F.explode(F.slice("near", 1, k)).alias("e")).filter(F.col("e.d") <= -min_similarity)
        new, all_pairs = first.agg(F.coalesce(F.sum("e.new"), F.lit(0)), F.count(F.lit(1))).first()
        if r + 1 >= LEAST_ROUNDS and new <= CHANGED * all_pairs:
            break
    return graph


def neighbours(df: DataFrame, k: int = 5, min_similarity: float = 0.80, dim: int = 96, id_col: str = "rowid", vector_col: str = "content_embedding", rounds: int = ROUNDS) -> DataFrame:
    """(rowid, neighbor_rowid): the up to k most similar other rows of cosine similarity of at least ``min_similarity``."""
    vectors = _Vectors(df, dim, id_col, vector_col, Scratch(df.sparkSession))
    graph = _descend(vectors, k, k + SPARE, min(FLOOR, min_similarity), min_similarity, rounds)
    found = graph.select("u", F.explode("near").alias("e")).select("u", "e.v", "e.d").filter(F.col("d") <= -min_similarity)
    if vectors.twins is not None:
        found = _with_twins(found, vectors, k)
    rank = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))
    return found.withColumn("r", rank).filter(F.col("r") <= k).select(F.col("u").alias("rowid"), F.col("v").alias("neighbor_rowid"))


def _spread(dim, cells):
    def run(batches):
        codes = _codes(dim, False)
        for b in batches:
            at, x = usable(b, dim)
            if not len(x):
                continue
            coded = next(codes([b]))
            take = pa.array(np.repeat(np.arange(len(x)), TABLES))
            yield pa.RecordBatch.from_arrays([c.take(take) for c in coded.columns] + [pa.array(_cells(_unit(x), cells, dim).ravel())], names=["rowid", "h", "v", "block"])

    return run


def _few(vectors: _Vectors, k: int) -> DataFrame:
    """(v, member): the k + 1 smallest members of each class of equal vectors, which are enough for any k places."""
    few = vectors.twins.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("rowid"))).filter(F.col("r") <= k + 1)
    return vectors.scratch.save(few.select(F.col("rep").alias("v"), F.col("rowid").alias("member")), "few")


def _with_twins(found: DataFrame, vectors: _Vectors, k: int) -> DataFrame:
    """Lists of representatives to lists of all rows."""
    twins, few = vectors.twins, _few(vectors, k)
    wide = found.join(few, "v", "left").select("u", F.coalesce("member", "v").alias("v"), "d")
    own = few.select(F.col("v").alias("u"), F.col("member").alias("v"), F.lit(-1.0).cast("float").alias("d"))
    lists = wide.unionByName(own).groupBy("u").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "v"))), 1, k + 1).alias("near"))
    heads = twins.groupBy("rep").agg(F.first("n").alias("n")).withColumnRenamed("rep", "u").join(lists, "u")
    members = hot_safe_join(twins.select("rowid", F.col("rep").alias("u")), heads, "u", "n", vectors.total)
    alone = lists.join(twins.select(F.col("rep").alias("u")).distinct(), "u", "left_anti")
    both = members.select(F.col("rowid").alias("u"), "near").unionByName(alone)
    return both.select("u", F.explode("near").alias("e")).select("u", "e.v", "e.d").filter("u <> v")


def graph_search(df: DataFrame, queries: DataFrame, k: int = 5, dim: int = 96, id_col: str = "rowid", vector_col: str = "content_embedding", entries: int = 16384, beam: int = 32, hops: int = 5, min_similarity: float = 0.80, rounds: int = LEAST_ROUNDS) -> DataFrame:
    """(rowid, neighbor_rowid, similarity): the k most similar stored vectors of at least ``min_similarity`` of each query vector, by greedy graph search.

    The graph is that of NN-descent over the distinct vectors of ``df``,
    without a floor and with the links of both directions. A query starts at
    its nearest of ``entries`` distinct vectors (a sample by hash, of fixed
    size), and in each hop a Spark join fetches the lists of its ``beam`` best
    vectors so far; their vectors are joined by id and compared. Equal vectors
    stand in an answer by their smallest ids; the query's own id is left out.
    """
    scratch = Scratch(df.sparkSession)
    vectors = _Vectors(df, dim, id_col, vector_col, scratch)
    near = _descend(vectors, k, k + SPARE, -0.999, -0.999, rounds).select("u", F.transform("near", lambda e: F.struct(e["d"].alias("d"), e["v"].alias("v"))).alias("near"))
    back = near.select("u", F.explode("near").alias("e")).select(F.col("e.v").alias("u"), F.array(F.struct(F.col("e.d").alias("d"), F.col("u").alias("v"))).alias("near"))
    # a row that many others have in their lists links back to the nearest of them
    graph = scratch.save(_merge(near.unionByName(back), 2 * (k + SPARE)), "links")
    coded = scratch.save(vectors.codes(), "coded")
    q = queries.select(F.col(id_col).cast("long").alias("rowid"), F.col(vector_col).alias("v")).mapInArrow(_codes(dim, True), "rowid long, h binary, v binary")
    q = scratch.save(q.groupBy("rowid").agg(F.min(F.struct("h", "v")).alias("m")).select("rowid", F.col("m.v").alias("q")), "queries")
    start = coded.orderBy(F.xxhash64("rowid"), "rowid").limit(entries).collect()
    ids = np.array([r[0] for r in start], np.int64)
    x = np.stack([np.frombuffer(r[1], np.float16) for r in start]).astype(np.float32) if start else np.empty((0, dim), np.float32)

    def enter(batches):
        for b in batches:
            qs = np.frombuffer(b"".join(b.column("q").to_pylist()), np.float16).reshape(-1, dim).astype(np.float32)
            m = min(16, len(x))
            # few queries at a time, as each is compared with all entries
            best = [np.argpartition(-(qs[at : at + 256] @ x.T), m - 1, axis=1)[:, :m] for at in range(0, len(qs) if m else 0, 256)]
            best = np.concatenate(best) if best else np.empty((len(qs), 0), int)
            yield pa.RecordBatch.from_pydict({"rowid": pa.array(np.repeat(b.column("rowid").to_numpy(), best.shape[1]), pa.int64()), "c": pa.array(ids[best.ravel()] if best.size else [], pa.int64())})

    pool = _scored(q.mapInArrow(enter, "rowid long, c long").distinct(), q, coded, dim)
    for h in range(hops):
        pool = scratch.save(pool, f"pool{h}")
        scratch.drop(*([f"pool{h - 1}"] if h else []))
        best = pool.withColumn("r", F.row_number().over(Window.partitionBy("rowid").orderBy(F.desc("s"), "c"))).filter(F.col("r") <= beam)
        reach = best.join(graph.withColumnRenamed("u", "c"), "c").select("rowid", F.explode("near.v").alias("c")).distinct()
        new = _scored(reach.join(pool.select("rowid", "c"), ["rowid", "c"], "left_anti"), q, coded, dim)
        # what isn't among the best so far can't be answered nor expanded
        both = pool.unionByName(new).withColumn("r", F.row_number().over(Window.partitionBy("rowid").orderBy(F.desc("s"), "c")))
        pool = both.filter(F.col("r") <= 4 * beam).drop("r")
    found = pool.filter(F.col("s") >= min_similarity)
    if vectors.twins is not None:
        found = found.join(_few(vectors, k).withColumnRenamed("v", "c"), "c", "left").select("rowid", F.coalesce("member", "c").alias("c"), "s")
    rank = F.row_number().over(Window.partitionBy("rowid").orderBy(F.desc("s"), "c"))
    found = found.filter(F.col("rowid") != F.col("c")).withColumn("r", rank).filter(F.col("r") <= k)
    return found.select("rowid", F.col("c").alias("neighbor_rowid"), F.round("s", 5).alias("similarity"))


def _scored(pairs: DataFrame, q: DataFrame, coded: DataFrame, dim: int) -> DataFrame:
    def compare(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float16).reshape(-1, dim).astype(np.float32) for c in ("q", "v"))
            yield pa.RecordBatch.from_arrays([b.column("rowid"), b.column("c"), pa.array((x * y).sum(axis=1).astype(np.float64))], names=["rowid", "c", "s"])

    joined = pairs.join(q, "rowid").join(coded.select(F.col("rowid").alias("c"), "v"), "c").select("rowid", "c", "q", "v")
    return joined.mapInArrow(compare, "rowid long, c long, s double")

"""Problem 9: filling fixed-capacity containers, by Karmarkar-Karp multiway differencing.

Items are dealt by a hash into blocks of about BLOCK items. In a block the
least number of windows that could hold the items is tried: every item starts
as a partial partition of its own, the two partial partitions with the largest
imbalances are merged with opposing orders (largest window of the one with the
smallest of the other) until one is left. Windows that are full to at least
the mean are closed, the items of the rest are dealt and differenced again,
and the window count rises whenever the capacity stays exceeded. Blocks are
independent tasks of bounded size.

Defined results: texts without tokens have no rows; a text above the capacity
is split into full containers and a rest, which is an item like the others;
equal sizes and repeated ids are fine; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, BLOCK, PART, PATIENCE = 1024, 4096, 12, 12
#: So many parts are differenced side by side; few items are dealt in up to so many ways at once.
SIDE_BY_SIDE, WAYS = 64, 12


def differencing(sizes: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """[parts, items]: the window (0 .. windows - 1) of each item of each part, by multiway differencing.

    ``sizes`` is [parts, items], padded with zeros; the parts go through their
    merges side by side. Windows that a part doesn't have are loaded so that
    no item goes there.
    """
    parts, n = sizes.shape
    k = int(windows.max())
    rows = np.arange(parts)
    # nodes: the items first, then one for each merge; sums in falling order
    sums = np.zeros((parts, n, k), np.int64)
    sums[:, :, 0] = sizes
    imbalance, node = sizes.astype(np.int64), np.tile(np.arange(n), (parts, 1))
    merges = []
    base, barred = rows[:, None] * k, np.arange(k) >= windows[:, None]
    # the least loaded window of one with the most loaded one of the other, among the windows the part has
    order = (windows[:, None] - 1 - np.arange(k)) % k + base
    for m in range(n - 1):
        i = imbalance.argmax(axis=1)
        imbalance[rows, i] = -1
        j = imbalance.argmax(axis=1)
        s = sums[rows, i] + sums[rows, j].ravel()[order]
        s[barred] = -1
        by = np.argsort(-s, axis=1, kind="stable") + base
        s = s.ravel()[by]
        s -= s[rows, windows - 1][:, None]
        s[barred] = 0
        merges.append((node[rows, i], node[rows, j], by))
        sums[rows, i], imbalance[rows, i], node[rows, i] = s, s[:, 0], n + m
        imbalance[rows, j] = -1
    place = np.zeros((parts, 2 * n - 1, k), np.int16)
    place[:, -1] = np.arange(k)
    back = np.empty(parts * k, np.int16)
    turned = np.empty(parts * k, np.int16)
    for m in range(n - 2, -1, -1):
        a, b, by = merges[m]
        back[by] = place[:, n + m]
        place[rows, a] = back.reshape(parts, k)
        turned[order] = back.reshape(parts, k)
        place[rows, b] = turned.reshape(parts, k)
    return place[:, :n, 0].astype(np.int64)


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A valid window of each item (each at most ``capacity``).

    Windows that come out between the mean load and the capacity are closed;
    the items of all others are dealt anew and differenced again. Few items
    are dealt in several ways at once, of which the windows that share no item
    are closed. Where a few rounds close nothing, the window count of the rest
    rises.
    """
    rng = np.random.default_rng(7)
    window = np.full(len(sizes), -1, np.int64)
    rest, closed, extra, idle = np.arange(len(sizes)), 0, 0, 0
    while len(rest):
        n, total = len(rest), int(sizes[rest].sum())
        k = max(1, math.ceil(total / capacity), int((sizes[rest] * 2 > capacity).sum())) + extra
        parts = max(1, k // PART)
        ways = max(1, min(WAYS, SIDE_BY_SIDE // parts))
        deal = np.concatenate([rng.permutation(n) % parts + parts * way for way in range(ways)])
        order = np.argsort(deal, kind="stable")
        item = order % n
        count = np.bincount(deal, minlength=parts * ways)
        row, column = deal[order], np.arange(n * ways) - np.repeat(np.cumsum(count) - count, count)
        dealt = np.zeros((parts * ways, int(count.max())), np.int64)
        dealt[row, column] = sizes[rest[item]]
        wanted = np.maximum(1, np.ceil(dealt.sum(axis=1) * k / total - 1e-9).astype(np.int64)) if parts > 1 else np.full(ways, k)
        width = int(wanted.max())
        at = row * width + differencing(dealt, wanted)[row, column]
        load = np.bincount(at, weights=sizes[rest[item]], minlength=parts * ways * width)
        good = (load <= capacity) & (load * k >= total) & (load > 0)
        if parts == 1:
            fits = load.reshape(ways, width).max(axis=1) <= capacity
            if fits.any():
                good = (load > 0) & np.repeat(np.arange(ways) == fits.argmax(), width)
        taken = np.zeros(n, bool)
        for way in range(ways):
            own = slice(way * n, way * n + n)
            free = good.copy()
            free[at[own][taken[item[own]]]] = False
            take = free[at[own]]
            if take.any():
                names, back = np.unique(at[own][take], return_inverse=True)
                window[rest[item[own][take]]] = closed + back
                taken[item[own][take]] = True
                closed += len(names)
        idle = 0 if taken.any() else idle + ways
        rest = rest[~taken]
        if idle >= PATIENCE:
            extra, idle = extra + 1, 0
    return window


def _pack(capacity: int):
    def run(key, t):
        t = t.sort_by([("n", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = t.column("n").to_numpy().astype(np.int64)
        names = pa.array([f"{key[0].as_py()}-{w}" for w in pack(sizes, capacity)], pa.string())
        return pa.table({"doc_id": t.column("doc_id"), "piece": t.column("piece"), "n_tokens": t.column("n"), "container_id": names})

    return run


def fill(items: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, n_tokens, container_id): every item, or every piece of an item above the capacity, in a container."""
    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("doc_id"), F.col(size_col).cast("int").alias("size")).filter("size > 0")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(1), F.ceil(F.col("size") / capacity).cast("int"))))
    pieces = pieces.withColumn("n", F.least(F.lit(capacity), F.col("size") - (F.col("piece") - 1) * capacity)).drop("size")
    full = pieces.filter(F.col("n") == capacity).select("doc_id", "piece", F.col("n").alias("n_tokens"), F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container_id"))
    rest = pieces.filter(F.col("n") < capacity)
    blocks = max(1, round(rest.count() / BLOCK))
    # the rows are few and the work is not: a given number of partitions isn't merged by adaptive execution
    packed = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks))).repartition(min(blocks, 10_000), "block").groupBy("block").applyInArrow(_pack(capacity), f"doc_id {kind}, piece int, n_tokens int, container_id string")
    return full.unionByName(packed)

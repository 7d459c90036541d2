"""Problem 4: near-duplicate records with small edits, by multi-index hashing.

Every distinct word set gets a fingerprint of SYMBOLS one-byte symbols
(MinHash: a symbol of two sets of Jaccard similarity J is equal with
probability J, else by chance). The fingerprint is cut into disjoint segments
of ``segment_length`` symbols, one table each. In every table the Hamming ball
of radius 1 around a row's segment is enumerated, as the keys that leave one
symbol out, so two rows meet in a table if their segments differ in at most
one symbol. Rows that meet are compared by the low bits of all symbols first;
for the pairs that are left the complete distance of the fingerprints is
verified, and then the words exactly.

A longer segment tells more rows apart and is met less often, so the length
grows with the logarithm of the rows, and the number of tables with the
length: a pair at the threshold is missed by all tables with probability MISS
at most, at every size. A key that holds more than MAX_BLOCK rows is cut into
chunks that meet in pairs, so no task holds an unbounded block and no pair is
lost; a sample tells which keys these are, and decides nothing but this split.

Defined results: null and empty texts have no words and no pairs; texts with
the same words that aren't copies in the sense of problem 5 are pairs of
similarity 1; repeated ids count once; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.canon import RUN
from memlake.llm.format_copies import copy_classes
from memlake.runtime import Scratch, hubs, salted_join

#: SHORTEST segments do for FEW rows; each tenfold of these adds a symbol.
SYMBOLS, SHORTEST, FEW, MISS = 128, 4, 1_000_000, 1e-3
#: The low bits of so many symbols go with every key, and the logarithm of the number of words to this base in one byte.
LOW, SIZE_BASE = 120, 1.05
MAX_BLOCK, SAMPLE, MAX_BROADCAST = 16384, 32, 200_000
#: Pairs compared at a time, rows of a large group at a time, and the least rows of such a group.
PAIRS, TALL, WIDE = 65536, 64, 64
_RNG = np.random.default_rng(20260301)
_A = (_RNG.integers(0, 2**32, SYMBOLS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 2**32, SYMBOLS, dtype=np.uint64).astype(np.uint32)


class _Hashes(dict):
    """Word to 32-bit hash (a run that is no word to none), forgetting all when it has grown large."""

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        self[word] = h = None if len(word) < 2 else int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")
        return h


def words(text: str | None) -> set[str]:
    return {w for w in RUN.findall((text or "").lower()) if len(w) >= 2}


def fingerprints(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[lists, SYMBOLS] bytes: the MinHash symbols of each (non-empty) token list."""
    out = np.empty((len(starts), SYMBOLS), np.uint8)
    for j in range(SYMBOLS):
        least = np.minimum.reduceat(tokens * _A[j] + _B[j], starts)
        # the least values are small: their bits are mixed before eight are taken
        out[:, j] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def _extra():
    cache = _Hashes()

    def run(texts, runs):
        # the runs of ASCII are known, in lower case
        sets = [set(map(cache.__getitem__, r if t is not None and t.isascii() else words(t))) for t, r in zip(texts, runs)]
        for s in sets:
            s.discard(None)
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.fromiter(itertools.chain.from_iterable(sets), np.uint64, n.sum())
        # the hashes of each text in order
        flat = np.sort(np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(32), n) | flat).astype(np.uint32)
        offsets = np.concatenate([[0], np.cumsum(n)])
        raw, ends = memoryview(flat.tobytes()), (4 * offsets).tolist()
        return {
            "set_key": pa.array([hashlib.blake2b(raw[s:e], digest_size=16).digest() if s < e else None for s, e in itertools.pairwise(ends)], pa.binary()),
            "words": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int32))),
        }

    return run


def _fingerprinted(batches):
    """(rep, words) with their fingerprints; no list is empty."""
    for b in batches:
        if b.num_rows:
            lists = b.column("words")
            n = np.asarray(lists.value_lengths())
            fp = fingerprints(np.asarray(lists.flatten()).view(np.uint32), np.cumsum(n) - n)
            yield pa.RecordBatch.from_arrays([b.column("rep"), lists, pa.array([r.tobytes() for r in fp], pa.binary())], names=["rep", "words", "fp"])


def segment_length(rows: int) -> int:
    return SHORTEST + max(0, math.ceil(math.log10(max(1, rows) / FEW)))


def tables(length: int, threshold: float) -> int:
    """As many tables as miss a pair at the threshold with probability MISS at most."""
    met = threshold**length + length * (1 - threshold) * threshold ** (length - 1)
    return max(1, math.ceil(math.log(MISS) / math.log(1 - met)))


def segments(length: int, count: int) -> list[np.ndarray]:
    """The symbols of each table: disjoint as far as the fingerprint goes, then further drawings from it."""
    out: list[np.ndarray] = []
    rng = np.random.default_rng(7)
    while len(out) < count:
        order = np.arange(SYMBOLS) if not out else rng.permutation(SYMBOLS)
        out += [order[k : k + length] for k in range(0, SYMBOLS - length + 1, length)]
    return out[:count]


def max_distance(threshold: float, n: int = SYMBOLS, chance: float = 1 / 256, deviations: float = 3.5) -> int:
    """Largest distance of ``n`` symbols kept: ``deviations`` standard deviations above the mean at the threshold."""
    p = (1 - threshold) * (1 - chance)
    return math.ceil(n * p + deviations * math.sqrt(n * p * (1 - p)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _keys(length: int, count: int):
    """(key, rep, s0, s1, own): the keys of the ball of radius 1 in each table, with the low bits of the fingerprint, the size of the set, and the symbol left out and 1 (0 where it is the first)."""
    parts = segments(length, count)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            fp = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(-1, SYMBOLS)
            low = np.packbits(fp & 1, axis=1, bitorder="little")
            low[:, LOW // 8] = np.minimum(255, np.log(np.maximum(1, b.column("n").to_numpy())) / math.log(SIZE_BASE)).astype(np.uint8)
            low = low.view("<u8")
            keys = np.empty((len(fp), count, length), np.uint64)
            own = np.zeros((len(fp), count, length), np.int16)
            for t, symbols in enumerate(parts):
                seg = fp[:, symbols].astype(np.uint64)
                for left_out in range(length):
                    key = np.full(len(fp), t * length + left_out + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    for k in range(length):
                        if k != left_out:
                            key = _mixed(key + seg[:, k] + np.uint64(1))
                    keys[:, t, left_out] = key
                    if left_out:
                        own[:, t, left_out] = fp[:, symbols[left_out]].astype(np.int16) + 1
            each = count * length
            at = pa.array(np.repeat(np.arange(len(fp)), each))
            sketch = [pa.array(np.repeat(low[:, k], each).view(np.int64)) for k in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), b.column("rep").take(at), *sketch, pa.array(own.reshape(-1))], names=["key", "rep", "s0", "s1", "own"])

    return run


def _close_pairs(key, part, rep, sketch, own, chunk, limit, spread):
    """(a, b) within the groups of sorted rows of equal key and part whose low bits differ in at most ``limit`` and whose size bytes in at most ``spread``.

    Rows whose segments are equal meet at every key of a table, and count at
    the one that leaves out the first symbol alone.
    """
    size = (sketch[1] >> np.uint64(LOW - 64)).astype(np.int16)
    head, tail = sketch[0], sketch[1] & np.uint64((1 << LOW - 64) - 1)
    new = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
    starts, ends = np.append(0, new), np.append(new, len(key))

    def met(i, j):
        # rows of two chunks meet here, those of one chunk in its own task
        keep = (np.abs(size[i] - size[j]) <= spread) & ((own[i] == 0) | (own[i] != own[j])) & ((part[i] == 0) | (chunk[i] != chunk[j]))
        a, b = rep[i[keep]], rep[j[keep]]
        return np.minimum(a, b), np.maximum(a, b)

    # small groups side by side
    n = ends - starts
    small = n < WIDE
    count = np.repeat(ends, n) - np.arange(len(key)) - 1
    rows = np.flatnonzero(np.repeat(small, n) & (count > 0))
    count = count[rows]
    cum = np.cumsum(count)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(cum, (cum[at - 1] if at else 0) + PAIRS, "right")))
        c = count[at:to]
        i = np.repeat(rows[at:to], c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        at = to
        keep = np.flatnonzero(np.bitwise_count(head[i] ^ head[j]) + np.bitwise_count(tail[i] ^ tail[j]) <= limit)
        yield met(i[keep], j[keep])
    # large ones by size, rows against those that aren't too large for them
    for s, e in zip(starts[~small].tolist(), ends[~small].tolist()):
        order = s + np.argsort(size[s:e], kind="stable")
        x, y, z = head[order], tail[order], size[order]
        far = np.searchsorted(z, z + spread, "right").tolist()
        for at in range(0, e - s, TALL):
            to = min(at + TALL, e - s)
            for left in range(at, far[to - 1], PAIRS // TALL):
                right = min(left + PAIRS // TALL, far[to - 1])
                differ = np.bitwise_count(x[at:to, None] ^ x[left:right])
                differ += np.bitwise_count(y[at:to, None] ^ y[left:right])
                i, j = np.divmod(np.flatnonzero(differ <= limit), right - left)
                i, j = i + at, j + left
                later = i < j
                yield met(order[i[later]], order[j[later]])


def _meet(limit: int, spread: int):
    """Rows sorted by key (and part, where keys are cut) to close pairs, groups taken as they end."""

    def run(batches):
        kept: tuple | None = None
        for b in batches:
            if not b.num_rows:
                continue
            whole = np.zeros(b.num_rows, np.int32)
            rows = tuple(b.column(c).to_numpy() if c in b.schema.names else whole for c in ("key", "part", "rep", "s0", "s1", "own", "chunk"))
            if kept:
                rows = tuple(np.concatenate([x, y]) for x, y in zip(kept, rows))
            key, part = rows[0], rows[1]
            last = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1 if (key[0], part[0]) != (key[-1], part[-1]) else 0
            yield from _batch(tuple(x[:last] for x in rows), limit, spread)
            kept = tuple(x[last:] for x in rows)
        if kept:
            yield from _batch(kept, limit, spread)

    return run


def _batch(rows, limit, spread):
    key, part, rep, s0, s1, own, chunk = rows
    if not len(key):
        return
    some, n = [], 0

    def made():
        a, b = (np.concatenate(x) for x in zip(*some))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for pairs in _close_pairs(key, part, rep, (s0.view(np.uint64), s1.view(np.uint64)), own, chunk, limit, spread):
        if len(pairs[0]):
            some.append(pairs)
            n += len(pairs[0])
        if n >= 1_000_000:
            yield made()
            some, n = [], 0
    if n:
        yield made()


def candidates(reps: DataFrame, rows: int, threshold: float) -> DataFrame:
    """(a, b), a < b, each once: rows of (rep, fp, n words) that multi-index hashing finds, by the low bits of their fingerprints and their sizes, which can't differ by more than the threshold."""
    length = segment_length(rows)
    schema = "key long, rep long, s0 long, s1 long, own short"
    make = _keys(length, tables(length, threshold))
    spread = reps.select("rep", "fp", "n").mapInArrow(make, schema)
    sample = reps.select("rep", "fp", "n").filter(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(SAMPLE)) == 0).mapInArrow(make, schema)
    large = sample.groupBy("key").count().filter(F.col("count") * SAMPLE * 2 > MAX_BLOCK)
    large = large.select("key", F.ceil(F.col("count") * SAMPLE * 2 / MAX_BLOCK).cast("int").alias("parts")).filter("parts > 1")
    large = Scratch(reps.sparkSession).save(large, "large") if rows > MAX_BLOCK else None
    n = large.count() if large is not None else 0
    if n:
        spread = spread.join(F.broadcast(large) if n <= MAX_BROADCAST else large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        spread = spread.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        # chunk c meets every other chunk in the part (min, max) and its own rows in part 0 of a key of its own
        spread = spread.withColumn("meet", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        lo, hi = F.least("chunk", "meet"), F.greatest("chunk", "meet")
        same = F.col("chunk") == F.col("meet")
        key = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", lo, hi))
        spread = spread.select(key.alias("key"), F.when(same, 0).otherwise(1).alias("part"), "rep", "s0", "s1", "own", "chunk")
    limit = max_distance(threshold, LOW, 0.5, 3.0)
    met = spread.repartition("key").sortWithinPartitions("key", *(["part"] if n else [])).mapInArrow(_meet(limit, math.ceil(-math.log(threshold) / math.log(SIZE_BASE))), "a long, b long")
    return met.distinct()


def _distance(batches):
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SYMBOLS) for c in ("fa", "fb"))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array((x != y).sum(axis=1), pa.int32())], names=["a", "b", "distance"])


def near_classes(df: DataFrame, threshold: float = 0.70, id_col: str = "id", text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """(pairs: a, b, a <= b; members: rep, keep_id, id): near-duplicate word sets by their representatives, and the rows of each.

    A pair of a set with itself stands for rows of the same words that aren't
    copies of each other.
    """
    rows, classes, total, scratch = copy_classes(df, id_col, text_col, _extra(), ", set_key binary, words array<int>")
    spark = df.sparkSession
    canonical = spark.read.parquet(f"{scratch.root}/canonical").filter(F.col("set_key").isNotNull())
    sets = canonical.groupBy("set_key").agg(F.min("first_id").alias("rep"))
    linked = scratch.save(canonical.select("raw", "set_key").join(sets, "set_key").join(classes.select("raw", "keep_id", "n"), "raw").select("raw", "rep", "keep_id", "n"), "linked")
    reps = canonical.withColumnRenamed("first_id", "rep").join(sets.select("rep"), "rep", "left_semi").select("rep", "words")
    reps = scratch.save(reps.mapInArrow(_fingerprinted, "rep long, words array<int>, fp binary"), "reps")
    found = scratch.save(candidates(reps.withColumn("n", F.size("words")), reps.count(), threshold), "candidates")
    a, b = (reps.select(F.col("rep").alias(x), F.col("fp").alias(f"f{x}"), F.col("words").alias(f"w{x}")) for x in "ab")
    far = found.join(a.drop("wa"), "a").join(b.drop("wb"), "b").mapInArrow(_distance, "a long, b long, distance int")
    near = scratch.save(far.filter(F.col("distance") <= max_distance(threshold)).select("a", "b"), "near")
    checked = near.join(a.drop("fa"), "a").join(b.drop("fb"), "b").withColumn("shared", F.size(F.array_intersect("wa", "wb")))
    checked = checked.filter(F.col("shared") >= threshold * (F.size("wa") + F.size("wb") - F.col("shared")) - 1e-9).select("a", "b")
    mixed = linked.groupBy("rep").agg(F.min("keep_id").alias("x"), F.max("keep_id").alias("y")).filter("x < y").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    pairs = scratch.save(checked.unionByName(mixed), "pairs")
    touched = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    members = linked.join(touched, "rep", "left_semi")
    # a text may stand in many rows
    hot = scratch.save(hubs(rows, "raw", total), "hot")
    members = salted_join(rows, members.select("raw", "rep", "keep_id"), "raw", "id", hot).select("rep", "keep_id", "id").distinct()
    return pairs, scratch.save(members, "members")


def near_duplicates(df: DataFrame, threshold: float = 0.70, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs whose word sets have Jaccard similarity of at least ``threshold`` and that aren't copies."""
    pairs, members = near_classes(df, threshold, id_col, text_col)
    hot = hubs(members, "rep", members.count())
    left = members.select(F.col("rep").alias("a"), F.col("keep_id").alias("ka"), F.col("id").alias("ia"))
    right = members.select(F.col("rep").alias("b"), F.col("keep_id").alias("kb"), F.col("id").alias("ib"))
    out = salted_join(left, pairs, "a", "ia", hot.withColumnRenamed("rep", "a"))
    out = salted_join(right, out, "b", "ib", hot.withColumnRenamed("rep", "b"))
    out = out.filter((F.col("ka") != F.col("kb")) & ((F.col("a") != F.col("b")) | (F.col("ia") < F.col("ib"))))
    return out.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))

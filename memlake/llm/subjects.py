"""Problem 10: the subjects of each document, by averaged word and subword embeddings with independent logistic outputs.

A word's vector is the mean of the vectors of its hashed features (the word
and its character n-grams); a document's is the mean of its words' vectors,
weighted by smooth inverse frequency over the whole corpus; each subject has
a logistic output of its own. Training is full-batch gradient descent with one
Adam state: in each of STEPS steps the SHARDS partitions of the labelled
documents compute their gradients from the common parameters, the driver sums
them and takes the step (parameters are BUCKETS * DIM floats, whatever the
input). Every document is then scored.

Labels may number up to MAX_LABELED documents (the documented bound of the
fitting sample, chosen by hash); corpus statistics cover all documents. More
than MAX_SUBJECTS subjects are refused.

Defined results: null, empty and blank texts and texts without words have no
subjects; labels of unknown subjects or of documents that are gone are
ignored, case and white space aside; repeated labels count once; without any
label there are no results.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.runtime import Scratch

BUCKETS, DIM, SHARDS, STEPS, RATE, DECAY, SCALE = 1 << 15, 24, 4, 24, 0.05, 1e-6, 4.0
MAX_LABELED, MAX_SUBJECTS, SMOOTH, COUNTERS, THRESHOLD = 40_000, 1000, 3e-4, 1 << 18, 0.2
#: Runs of letters of any script and length that stand free, not inside paths, names and calls of code.
WORD = re.compile(r"(?<![\w/.])[^\W\d_]+(?![\w/(]|\.\w)")


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


def features(word: str) -> list[int]:
    w = f"<{word}>"
    out = {_hash(w) % BUCKETS}
    for n in (3, 4, 5, 6):
        out.update(_hash(w[i : i + n]) % BUCKETS for i in range(len(w) - n + 1))
    return sorted(out)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower().replace("i̇", "i"))


class Corpus:
    """Documents as flat arrays: distinct words with their features, and the words of each document."""

    def __init__(self, texts: list[str], frequency: np.ndarray):
        vocab: dict[str, int] = {}
        tokens, lengths = [], []
        for t in texts:
            ws = words(t)
            tokens += [vocab.setdefault(w, len(vocab)) for w in ws]
            lengths.append(len(ws))
        feats = [features(w) for w in vocab]
        self.feat = np.array([f for fs in feats for f in fs], np.int64)
        self.feat_n = np.array([len(f) for f in feats], np.int64)
        p = frequency[[_hash(w) % COUNTERS for w in vocab]] if vocab else np.empty(0)
        self.weight = SMOOTH / (SMOOTH + p)
        doc = np.repeat(np.arange(len(texts)), lengths)
        tokens = np.array(tokens, np.int64)
        # each distinct word of a document once, with its weight times its number
        key, n = np.unique(doc * max(1, len(vocab)) + tokens, return_counts=True)
        self.doc, self.word = key // max(1, len(vocab)), key % max(1, len(vocab))
        self.w = self.weight[self.word] * n
        total = np.bincount(self.doc, weights=self.w, minlength=len(texts)) if len(key) else np.zeros(len(texts))
        self.empty = total == 0
        self.w = (self.w / np.where(total == 0, 1, total)[self.doc]).astype(np.float32)
        self.n = len(texts)
        self.doc, self.word, self.feat = self.doc.astype(np.int32), self.word.astype(np.int32), self.feat.astype(np.int32)

    def vectors(self, table: np.ndarray) -> np.ndarray:
        if not len(self.feat):
            return np.zeros((self.n, table.shape[1]), np.float32)
        starts = np.concatenate([[0], np.cumsum(self.feat_n)[:-1]])
        self.word_vec = np.add.reduceat(table[self.feat], starts, axis=0) / self.feat_n[:, None].astype(np.float32)
        return _sum_sorted(self.doc, self.word_vec[self.word] * self.w[:, None], self.n)

    def sorted(self) -> Corpus:
        """With the orders that gradients are summed in."""
        self.by_word, self.by_feat = (np.argsort(x, kind="stable").astype(np.int32) for x in (self.word, self.feat))
        return self

    def gradient(self, d_doc: np.ndarray) -> np.ndarray:
        per_word = (d_doc[self.doc] * self.w[:, None])[self.by_word]
        d_word = _sum_sorted(self.word[self.by_word], per_word, len(self.feat_n)) / self.feat_n[:, None].astype(np.float32)
        owner = np.repeat(np.arange(len(self.feat_n)), self.feat_n)[self.by_feat]
        return _sum_sorted(self.feat[self.by_feat], d_word[owner], BUCKETS)


def _sum_sorted(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each index; equal indexes stand together."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(index):
        starts = np.flatnonzero(np.diff(index, prepend=-1))
        out[index[starts]] = np.add.reduceat(rows, starts, axis=0)
    return out


def initial(outputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(10)
    return tuple(x.astype(np.float32) for x in (rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.3, (DIM, outputs)), np.full(outputs, -2.0)))


def gradients(corpus: Corpus, y: np.ndarray, params) -> list[np.ndarray]:
    """Sums over the documents of the gradients of the logistic losses."""
    table, out, bias = params
    v = corpus.vectors(table) * SCALE
    e = 1 / (1 + np.exp(-(v @ out + bias))) - y
    return [corpus.gradient(e @ out.T * SCALE), v.T @ e, e.sum(axis=0)]


class Adam:
    """Parameters and their moments, moved by mean gradients at a falling rate."""

    def __init__(self, params, steps: int = STEPS):
        self.params, self.steps, self.t = params, steps, 0
        self.moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]

    def step(self, grads) -> None:
        rate = RATE * (1 - 0.5 * self.t / self.steps)
        self.t += 1
        for p, g, (m, v), decay in zip(self.params, grads, self.moments, (DECAY, DECAY, 0.0)):
            g = g + decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-9)


def predict(corpus: Corpus, params) -> np.ndarray:
    table, out, bias = params
    p = 1 / (1 + np.exp(-(corpus.vectors(table) * SCALE @ out + bias)))
    p[corpus.empty] = 0
    return p


def _count(batches):
    counts = np.zeros(COUNTERS, np.int64)
    for b in batches:
        hashed = [_hash(w) % COUNTERS for t in b.column("text").to_pylist() for w in words(t)]
        counts += np.bincount(np.array(hashed, np.int64), minlength=COUNTERS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"counter": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})


def _pack(params, kind=np.float32) -> bytes:
    return b"".join(p.astype(kind).tobytes() for p in params)


def _unpack(raw: bytes, outputs: int, kind=np.float32):
    flat = np.frombuffer(raw, kind).astype(np.float32)
    a, b = BUCKETS * DIM, BUCKETS * DIM + DIM * outputs
    return flat[:a].reshape(BUCKETS, DIM), flat[a:b].reshape(DIM, outputs), flat[b:]


def _prepared(frequency, m: int):
    """A shard's documents as one row: its arrays, made once and read in every step."""

    def run(t):
        _, freq = frequency.value
        y = np.zeros((t.num_rows, m), bool)
        for i, ys in enumerate(t.column("ys").to_pylist()):
            y[i, ys] = True
        corpus = Corpus(t.column("text").to_pylist(), freq)
        raw = pickle.dumps((corpus.sorted(), y), protocol=5)
        return pa.table({"n": pa.array([t.num_rows], pa.int64()), "raw": pa.array([raw], pa.binary())})

    return run


def _sums(shared, m: int):
    """The gradients of the shards of a partition, added up."""

    def run(batches):
        params, total = _unpack(shared.value, m), None
        for b in batches:
            for raw in b.column("raw").to_pylist():
                corpus, y = pickle.loads(raw)
                g = gradients(corpus, y.astype(np.float32), params)
                total = g if total is None else [p + q for p, q in zip(total, g)]
        if total is not None:
            # at half precision, as the driver gets them in every step
            yield pa.RecordBatch.from_pydict({"g": pa.array([_pack(total, np.float16)], pa.binary())})

    return run


def fit(docs: DataFrame, labels: DataFrame, subjects: list[str], steps: int = STEPS):
    """(parameters, word frequencies): trained on labels (doc_id, subject) of docs (doc_id, text); None without labels."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    frequency = np.zeros(COUNTERS)
    # at most COUNTERS rows, whatever the input
    for r in docs.filter("text is not null").select("text").mapInArrow(_count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).collect():
        frequency[r[0]] = r[1]
    frequency /= max(1.0, frequency.sum())
    names = F.create_map(*[x for k, s in enumerate(subjects) for x in (F.lit(s.strip().lower()), F.lit(k))])
    known = labels.select("doc_id", names[F.lower(F.trim("subject"))].alias("k")).dropna().groupBy("doc_id").agg(F.collect_set("k").alias("ys"))
    rows = known.join(docs.filter(F.length("text") > 0).select("doc_id", "text"), "doc_id")
    n = known.count()
    if not n:
        return None
    if n > MAX_LABELED:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * MAX_LABELED / n))
    sample = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SHARDS)).cast("int"))
    m = len(subjects)
    model = Adam(list(initial(m)))
    shared = spark.sparkContext.broadcast((None, frequency))
    shards = scratch.save(sample.repartition(SHARDS, "shard").groupBy("shard").applyInArrow(_prepared(shared, m), "n long, raw binary"), "shards", "snappy")
    total = shards.agg(F.sum("n")).first()[0]
    shared.destroy()
    if not total:
        return model.params, frequency
    for _ in range(steps):
        common = spark.sparkContext.broadcast(_pack(model.params))
        # SHARDS rows at most, of as many floats as there are parameters
        grads = None
        for r in shards.mapInArrow(_sums(common, m), "g binary").collect():
            part = _unpack(r[0], m, np.float16)
            grads = part if grads is None else [p + q for p, q in zip(grads, part)]
        model.step([g / np.float32(total) for g in grads])
        common.destroy()
    return model.params, frequency


def classify(docs: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject): every document with each subject that it is about."""
    spark = docs.sparkSession
    listed = areas.filter("subject is not null").groupBy("subject").agg(F.min("subject_id").alias("k"))
    if listed.count() > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    subjects = [r[0] for r in listed.orderBy("k", "subject").collect()]
    docs = docs.select("doc_id", "text")
    model = fit(docs, labels, subjects) if subjects else None
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.limit(0).select("doc_id", F.lit("").alias("subject"))
    shared = spark.sparkContext.broadcast((_pack(model[0]), model[1]))

    def score(batches):
        raw, freq = shared.value
        params = _unpack(raw, len(subjects))
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                p = predict(Corpus(b.column("text").to_pylist(), freq), params)
                i, k = np.nonzero(p >= THRESHOLD)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(i)), pa.array([subjects[x] for x in k], pa.string())], names=["doc_id", "subject"])

    return docs.filter(F.length("text") > 0).mapInArrow(score, f"doc_id {kind}, subject string")

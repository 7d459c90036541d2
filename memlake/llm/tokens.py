"""Problem 8: encoding of a corpus with a public byte-level BPE tokenizer.

Texts are split into words on the JVM side and kept in chunks of documents,
each with its distinct words once and the number of the word at every
position. Each distinct word of the corpus is encoded once; the words of a
chunk fetch their ids by a join (a word stands once in a chunk, however often
it occurs), and ids are laid out by position. Words that stand in more than
one in a thousand of these rows are broadcast (there can be no more than a
thousand), the rest take a shuffle join. Decoding is a join of ids with the
tokenizer's pieces (as many as the vocabulary has).

Defined results: empty and null texts give the empty list; blank texts are
encoded as they are; rows with a repeated id stay apart; spellings of special
tokens are ordinary text; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from memlake.runtime import Scratch, hot_safe_join

TOKENIZERS = os.environ.get("MEMLAKE_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k.json"
#: The word pattern of byte-level BPE (fixed value of the format), with Unicode white space as Java names it.
WORD = r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
#: Documents are kept in chunks of about so many words, a row each; a task holds so many chunks.
CHUNK, CHUNKS_A_TASK = 1 << 17, 64


@functools.lru_cache(4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _encode(path: str):
    def run(batches):
        t = _tokenizer(path)
        for b in batches:
            got = t.encode_batch(b.column("word").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array([g.ids for g in got], pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return run


def _codes(path: str, kind: pa.DataType):
    """Chunks of documents as one row each: their distinct words, and the number of the word at each position.

    Texts with characters that are newer than the JVM's tables come whole and
    are split by the tokenizer itself.
    """

    def run(batches):
        chunk, t = TaskContext.get().partitionId() << 32, _tokenizer(path)
        for b in batches:
            words = b.column("words")
            if b.column("strange").null_count < b.num_rows:
                split = lambda s: [s[x:y] for _, (x, y) in t.pre_tokenizer.pre_tokenize_str(s)]
                words = pa.array([w if s is None else split(s) for w, s in zip(words.to_pylist(), b.column("strange").to_pylist())], pa.list_(pa.string()))
            lengths = np.asarray(words.value_lengths().fill_null(0)).astype(np.int64)
            ends = np.cumsum(lengths)
            flat = words.flatten()
            cuts = np.flatnonzero(np.diff((ends - lengths) // CHUNK, prepend=-1)).tolist() + [b.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                own = flat.slice(int(ends[at] - lengths[at]), int(lengths[at:to].sum())).dictionary_encode()
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                docs = b.column("doc_id").slice(at, to - at).cast(kind)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), one(own.dictionary), one(docs), one(pa.array(lengths[at:to], pa.int32())), one(own.indices.cast(pa.int32()))], names=["chunk", "words", "docs", "lengths", "codes"])
                chunk += 1

    return run


def _assembled(counts: bool):
    """Chunks with their dictionaries to documents: the ids, or their number, by position."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                docs, lengths, codes = b.column("docs")[i].values, np.asarray(b.column("lengths")[i].values), np.asarray(b.column("codes")[i].values)
                ends = np.concatenate([[0], np.cumsum(lengths)])
                if b.column("ids")[i].is_valid:
                    code, value = b.column("ids")[i].values.flatten()
                else:
                    code, value = pa.array([], pa.int32()), pa.array([], pa.int32() if counts else pa.list_(pa.int32()))
                n = np.zeros(len(code), np.int64)
                n[np.asarray(code)] = np.asarray(value if counts else value.value_lengths())
                each = n[codes]
                offsets = np.concatenate([[0], np.cumsum(each)])[ends]
                if counts:
                    yield pa.RecordBatch.from_arrays([docs, pa.array(np.diff(offsets), pa.int32())], names=["doc_id", "n_tokens"])
                    continue
                length = np.asarray(value.value_lengths())
                start = np.zeros(len(code), np.int64)
                start[np.asarray(code)] = np.cumsum(length) - length
                at = np.repeat(start[codes] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                flat = np.asarray(value.flatten())[at] if len(at) else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([docs, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))], names=["doc_id", "ids"])

    return run


def _by_words(df: DataFrame, path: str | None, id_col: str, text_col: str, counts: bool) -> DataFrame:
    path = path or f"{TOKENIZERS}/{NAME}"
    spark = df.sparkSession
    scratch = Scratch(spark)
    # unassigned in this JVM: maybe a letter of a later Unicode version
    strange = F.col("text").rlike(r"[\p{Cn}]")
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    split = docs.select("doc_id", F.when(~strange, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"), F.when(strange, F.col("text")).alias("strange"))
    field = docs.schema["doc_id"].dataType
    kind = field.simpleString()
    coded = split.mapInArrow(_codes(path, to_arrow_type(field)), f"chunk long, words array<string>, docs array<{kind}>, lengths array<int>, codes array<int>")
    coded = scratch.save(coded, "coded")
    chunks = coded.count()
    asked = coded.select("chunk", F.posexplode("words").alias("code", "word"))
    table = scratch.save(asked.groupBy("word").agg(F.count(F.lit(1)).alias("n")).mapInArrow(_encode(path), "word string, n long, ids array<int>"), "table")
    total = table.agg(F.sum("n")).first()[0] or 0
    if counts:
        table = table.withColumn("ids", F.size("ids"))
    known = hot_safe_join(asked, table, "word", "n", total)
    tasks = max(1, min(chunks, spark.sparkContext.defaultParallelism), -(-chunks // CHUNKS_A_TASK))
    known = known.repartition(tasks, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("code", "ids")).alias("ids"))
    whole = coded.drop("words").repartition(tasks, "chunk").join(known, "chunk", "left")
    return whole.mapInArrow(_assembled(counts), f"doc_id {kind}, " + ("n_tokens int" if counts else "ids array<int>"))


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each text, without special tokens."""
    return _by_words(df, path, id_col, text_col, False)


def token_counts(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of each text that has tokens."""
    return _by_words(df, path, id_col, text_col, True).filter("n_tokens > 0")


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(token, piece): the bytes of each id, as hex."""
    path = path or f"{TOKENIZERS}/{NAME}"
    # the byte alphabet of byte-level BPE: printable bytes stand for themselves, the rest follow from 256 on
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    to_byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
    model = json.load(open(path, encoding="utf-8"))
    special = {t["content"] for t in model.get("added_tokens", [])}
    rows = [(i, (p.encode().hex() if p in special else bytes(to_byte[c] for c in p).hex())) for p, i in model["model"]["vocab"].items()]
    return spark.createDataFrame(pa.table({"token": pa.array([r[0] for r in rows], pa.int32()), "piece": pa.array([r[1] for r in rows])}))


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text): texts back from ids."""
    rows = encoded.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), "ids").select("row", "doc_id", F.posexplode_outer("ids").alias("pos", "token"))
    joined = rows.join(F.broadcast(pieces(encoded.sparkSession, path)), "token", "left")
    lists = joined.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("w"))
    return lists.select("doc_id", F.unhex(F.array_join(F.col("w.piece"), "")).cast("string").alias("text"))

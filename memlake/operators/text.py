"""Text retrieval: tokens, postings, BM25 over words and substrings, fusion, hybrid search."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.functions.porter import stem, stem_all
from memlake.schema import NOW

K1, B, FLOOR_IDF = 1.2, 0.75, 1e-6
#: Words that carry no search meaning, English and Turkish (fixed values, a subset suffices for prompts of a few words).
STOPWORDS = tuple("the a an is are was were be been and or of to in on for with that this it as at by from how what when where which who why can could should would do does did have has had will not you your our we bir ve ile bu şu için ne nasıl mi mı da de gibi çok daha var yok".split())
#: Abbreviations and what they stand for (fixed values).
ALIASES = {
    "db": ["database"], "k8s": ["kubernetes"], "js": ["javascript"], "ts": ["typescript"], "py": ["python"], "api": ["endpoint", "route"], "ui": ["interface", "frontend"],
    "fe": ["frontend"], "be": ["backend"], "ci": ["pipeline"], "env": ["environment"], "deps": ["dependencies"], "auth": ["authentication"], "config": ["configuration"],
}
TOKEN_SPLIT = "[^a-z0-9]+"


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(c), TOKEN_SPLIT), lambda t: t != "")


def keywords(c: Column, limit: int = 10, least: int = 3) -> Column:
    """The first words of a prompt that are long enough and no stop words."""
    return F.slice(F.filter(tokens(c), lambda t: (F.length(t) >= least) & ~t.isin(*STOPWORDS)), 1, limit)


def expand(c: Column) -> Column:
    """Each keyword with its aliases, in order, without repetition."""
    table = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(c, lambda t: F.concat(F.array(t), F.coalesce(table[t], F.array().cast("array<string>"))))))


def query_tokens(text: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.split(TOKEN_SPLIT, text.lower()) if t))


#: Characters and words that mean something to a query language (fixed values).
UNSAFE, OPERATORS = "'\";\\/(){}*^:", r"(?i)\b(AND|OR|NOT|NEAR)\b"


def sanitize(c: Column) -> Column:
    """A query of quoted words joined by OR, without operators, their characters, and single letters."""
    safe = F.replace(F.translate(c, UNSAFE, ""), F.lit("--"), F.lit(""))
    parts = F.filter(F.split(F.regexp_replace(safe, OPERATORS, ""), r"(?U)\s+"), lambda w: F.length(w) > 1)
    return F.array_join(F.transform(parts, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def plain_query(text: str) -> str:
    """The words of a query that ``sanitize`` keeps."""
    safe = text.translate({ord(ch): None for ch in UNSAFE}).replace("--", "")
    return " ".join(w for w in re.sub(OPERATORS, "", safe).split() if len(w) > 1)


def postings(df: DataFrame, id_col: str = "id", text_col: str = "content", terms: Sequence[str] | None = None, stemmed: bool = False) -> DataFrame:
    """(term, id, tf, dl): with ``terms``, only those; the document length counts all tokens."""
    words = stem_all(tokens(F.col(text_col))) if stemmed else tokens(F.col(text_col))
    rows = df.select(F.col(id_col).alias("id"), words.alias("ts")).withColumn("dl", F.size("ts"))
    if terms is not None:
        rows = rows.withColumn("ts", F.filter("ts", lambda t: t.isin(*terms)))
    return rows.select("id", "dl", F.explode("ts").alias("term")).groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(df: DataFrame, query: str | Sequence[str], id_col: str = "id", text_col: str = "content", stemmed: bool = False) -> DataFrame:
    """(id, bm25, matched): documents with any of the query's terms, or of their stems. Only those terms are shuffled; corpus counts are one pass."""
    terms = query_tokens(query) if isinstance(query, str) else list(query)
    if stemmed:
        terms = list(dict.fromkeys(map(stem, terms)))
    stats = df.select(F.size(tokens(F.col(text_col))).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    hits = postings(df, id_col, text_col, terms, stemmed)
    df_t = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # as many rows as the query has terms, and one
    scored = hits.join(F.broadcast(df_t), "term").crossJoin(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(FLOOR_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("id").agg(F.sum(part).alias("bm25"), F.count(F.lit(1)).alias("matched"))


def relaxed(scored: DataFrame, n_terms: int) -> DataFrame:
    """Four terms and more: all but one must match; three: all; fewer: any."""
    need = n_terms - 1 if n_terms >= 4 else n_terms if n_terms == 3 else 1
    return scored.filter(F.col("matched") >= need)


def substring_bm25(df: DataFrame, needle: str, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, bm25): over a substring of at least three characters; occurrences don't overlap, lengths count trigrams."""
    low = F.lower(F.col(text_col))
    q = needle.lower()
    tf = (F.length(low) - F.length(F.replace(low, F.lit(q), F.lit("")))) / len(q)
    rows = df.select(F.col(id_col).alias("id"), tf.alias("tf"), F.greatest(F.length(low) - 2, F.lit(0)).alias("dl"))
    stats = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"), F.sum((F.col("tf") > 0).cast("int")).alias("df"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(FLOOR_IDF))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.filter("tf > 0").crossJoin(F.broadcast(stats)).select("id", score.alias("bm25"))


def relevance(score: Column, phrase: Column | None = None) -> Column:
    r = F.least(score / 20.0, F.lit(1.0))
    return r if phrase is None else r + F.when(phrase, 0.1).otherwise(0.0)


def exact(df: DataFrame, needle: str) -> DataFrame:
    """(id, lexical 0.9) of rows whose content contains the text, ASCII case aside."""
    return df.filter(F.col("content").ilike(f"%{needle}%")).select("id", F.lit(0.9).alias("lexical"))


def near(df: DataFrame, a: str, b: str, distance: int = 2) -> DataFrame:
    """(id): both words within ``distance`` words of each other, by token positions."""
    at = F.filter(F.transform(tokens(F.col("content")), lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].isin(a, b))
    pair = F.exists("at", lambda x: (x["t"] == a) & F.exists("at", lambda y: (y["t"] == b) & (F.abs(x["i"] - y["i"]) <= distance + 1)))
    return df.select("id", at.alias("at")).filter(pair).select("id")


def fuse(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """(id, relevance): best score of each path; found by both, the better plus 0.3 of the other, up to 1."""
    both = lexical.select("id", F.col("lexical").alias("l"), F.lit(None).cast("double").alias("s")).unionByName(semantic.select("id", F.lit(None).cast("double").alias("l"), F.col("semantic").alias("s")))
    one = both.groupBy("id").agg(F.max("l").alias("l"), F.max("s").alias("s"))
    hi, lo = F.greatest("l", "s"), F.least("l", "s")
    return one.select("id", F.when(F.col("l").isNotNull() & F.col("s").isNotNull(), F.least(F.lit(1.0), hi + 0.3 * lo)).otherwise(hi).alias("relevance"))


def budget_prefix(ranked: DataFrame, cap: int, *order: Column) -> DataFrame:
    """The longest prefix of a (small, ranked) result whose contents fit in ``cap`` characters."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used_chars", F.sum(F.length("content")).over(w)).filter(F.col("used_chars") <= cap)


def within(after: float | str | None = None, before: float | str | None = None) -> Column:
    """Rows created within the bounds, in seconds or as text; a bound that can't be read is ignored."""
    read = lambda b: F.try_to_timestamp(F.lit(b)).cast("double") if isinstance(b, str) else F.lit(b).cast("double")
    return F.coalesce(F.col("created_at") >= read(after), F.lit(True) if after is None or isinstance(after, str) else F.lit(False)) & F.coalesce(F.col("created_at") <= read(before), F.lit(True) if before is None or isinstance(before, str) else F.lit(False))


def legacy_hybrid(lexical: DataFrame, semantic: DataFrame, k: int = 5, lexical_weight: float = 0.7, floor: float = 0.3) -> DataFrame:
    """(id, score): the older fusion of (id, bm25) and (id, cosine). Lexical hits, three times k, score their weight over 1 + bm25 and the cosine's; of the rest the nearest k // 2 above the floor count 0.8 of their cosine's share."""
    w = 1.0 - lexical_weight
    words = lexical.orderBy(F.desc("bm25"), "id").limit(3 * k)
    near = semantic.select("id", "cosine")
    first = words.join(near, "id", "left").select("id", (lexical_weight / (1.0 + F.abs("bm25")) + w * F.greatest(F.coalesce("cosine", F.lit(0.0)), F.lit(0.0))).alias("score"))
    rest = near.join(words.select("id"), "id", "left_anti").filter(F.col("cosine") > floor).orderBy(F.desc("cosine"), "id").limit(max(1, k // 2)).select("id", (w * F.col("cosine") * 0.8).alias("score"))
    return first.unionByName(rest).orderBy(F.desc("score"), "id").limit(k)


def probes(rows: DataFrame, k: int = 200, seed: int = 13, id_col: str = "id") -> DataFrame:
    """``k`` rows drawn by a hash of id and seed, the same at every run."""
    return rows.withColumn("__h", F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed))))).orderBy("__h", id_col).limit(k).drop("__h")


def search(memories: DataFrame, query: str, semantic: DataFrame | None = None, tags: Sequence[str] = (), limit: int = 10, after: float | str | None = None, before: float | str | None = None, now: float = NOW, stemmed: bool = False) -> DataFrame:
    """The flagship: filters, lexical and vector candidates, fusion, four-factor score, top k. Pure: reinforcement is a step of its own."""
    rows = memories.filter(C.active() & C.unexpired(now))
    for t in tags:
        rows = rows.filter(C.like_tag(t))
    rows = rows.filter(within(after, before))
    words = bm25(rows, plain_query(query), stemmed=stemmed).select("id", relevance(F.col("bm25")).alias("lexical"))
    lexical = words.unionByName(exact(rows, query))
    fused = fuse(lexical, semantic if semantic is not None else lexical.limit(0).select("id", F.col("lexical").alias("semantic")))
    scored = rows.join(fused, "id").withColumn("score", F.round(C.unified_score(F.col("relevance"), now), 6))
    return scored.select("id", "memory_type", F.round("relevance", 6).alias("relevance"), "score").orderBy(F.desc("score"), "id").limit(limit)

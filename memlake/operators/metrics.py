"""Retrieval-quality metrics over (query, rank, doc) results and (query, doc) relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(results: DataFrame, relevant: DataFrame) -> DataFrame:
    return results.join(relevant.select("query", "doc").distinct().withColumn("hit", F.lit(1)), ["query", "doc"], "left").fillna({"hit": 0})


def per_query(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query, rr, ndcg, precision, recall) for every query that has relevant documents."""
    truth = relevant.groupBy("query").agg(F.countDistinct("doc").alias("n"))
    top = F.col("rank") <= k
    got = judged(results, relevant).groupBy("query").agg(
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when((F.col("hit") == 1) & top, 1.0 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.count(F.when((F.col("hit") == 1) & top, 1)).alias("hits"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    zero = F.lit(0.0)
    return truth.join(got, "query", "left").select(
        "query",
        F.round(F.coalesce(1.0 / F.col("first"), zero), 6).alias("rr"),
        F.round(F.coalesce(F.col("dcg"), zero) / ideal, 6).alias("ndcg"),
        F.round(F.coalesce("hits", F.lit(0)) / k, 6).alias("precision"),
        F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall"),
    )


def normalize_answer(c: Column) -> Column:
    """Lower case, without commas, articles, punctuation and extra white space."""
    c = F.regexp_replace(F.lower(c), ",", "")
    c = F.regexp_replace(c, r"[!-/:-@\[-`{-~]", "")
    c = F.regexp_replace(c, r"(?U)\b(a|an|the|and)\b", " ")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def token_f1(prediction: Column, truth: Column) -> Column:
    """Multiset token F1 of two normalised answers."""
    p, t = (F.filter(F.split(normalize_answer(c), " "), lambda x: x != "") for c in (prediction, truth))
    # the word lists are arguments of a lambda, so that they are made once
    pair = F.array(F.struct(p.alias("p"), t.alias("t")))
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    common = lambda r: F.aggregate(F.array_distinct(r["p"]), F.lit(0), lambda s, w: s + F.least(count(r["p"], w), count(r["t"], w)))
    return F.transform(pair, lambda r: F.coalesce(F.try_divide(2.0 * common(r), F.size(r["p"]) + F.size(r["t"])), F.lit(0.0)))[0]


def has_answer(text: Column, answer: Column) -> Column:
    a, b = normalize_answer(text), normalize_answer(answer)
    return F.contains(a, b) | (F.size(F.array_except(F.split(b, " "), F.split(a, " "))) == 0)


def regressions(current: DataFrame, baseline: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Metrics (metric, value) that fell by more than the relative threshold."""
    j = current.withColumnRenamed("value", "now").join(baseline.withColumnRenamed("value", "before"), "metric")
    return j.filter((F.col("before") > 0) & ((F.col("before") - F.col("now")) / F.col("before") > threshold))

"""Retrieval: vector, full-text and hybrid search over DataFrames.

Nulls: rows without a vector or text are not found. Equal scores go by the smaller id; of rows that
repeat an id each counts, but for fused and merged lists, which have one row an id. Empty tables give
no rows. Extra columns are kept where a function returns its rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import scoring
from recollect.operators.closest import closest
from recollect.sources.settled import settled


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return scoring.clamp(scoring.cosine(a, b))
    if metric == "dot":
        return scoring.clamp(scoring.dot(a, b))
    if metric == "l2":
        return 1 / (1 + scoring.squared_distance(a, b))
    raise ValueError(metric)


def vector_search(rows: DataFrame, query: list[float], k: int, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest to ``query`` among those that ``where`` keeps, with ``score``; ties by
    id. The filter reaches the scan, and each task sends on ``k`` rows at most."""
    kept = rows if where is None else rows.where(where)
    vector = F.array(*[F.lit(float(x)) for x in query])
    return kept.where(F.col("embedding").isNotNull()).withColumn("score", similarity(F.col("embedding"), vector, metric)).orderBy(F.desc("score"), "id").limit(k)


def vector_search_many(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", block: int = 10_000) -> DataFrame:
    """query_id, id, score, rank: the k nearest other rows of each query. Queries (query_id, query) are
    a stated set; they are broadcast against all rows in blocks of about ``block``, and each task sends
    on ``k`` rows a query at most."""
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(metric)
    near = closest(rows, queries, k, metric, True, block)
    return top_per(near.withColumn("score", 1 / (1 + F.col("score"))) if metric == "l2" else near, "query_id", k)


def top_per(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The k best rows of each key, ranked from 1."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score of the documents that hold a term. Texts are read once: lengths and term counts are
    written, and only texts that contain a term are searched for it."""
    low = docs.select("id", F.lower("text").alias("t"))
    tf = [F.when(F.contains("t", F.lit(t)), F.regexp_count("t", F.lit(rf"(?<![\p{{L}}\p{{N}}])\Q{t}\E(?![\p{{L}}\p{{N}}])"))).otherwise(0) for t in terms]
    tokens = settled(low.select("id", F.regexp_count("t", F.lit(r"[\p{L}\p{N}]++")).alias("len"), *[x.alias(f"tf{i}") for i, x in enumerate(tf)]), "bm25")
    stats = tokens.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]).first()
    norm = k1 * (1 - b + b * F.col("len") / F.lit(float(stats["avg"] or 1)))
    parts = [F.lit(math.log(1 + (stats["n"] - (stats[f"df{i}"] or 0) + 0.5) / ((stats[f"df{i}"] or 0) + 0.5))) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + norm) for i in range(len(terms))]
    any_term = reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(terms))])
    return tokens.where(any_term).select("id", reduce(lambda x, y: x + y, parts).alias("score"))


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, k: int = 60) -> DataFrame:
    """id, score of two result lists (id, score): 1/(rank + k) summed with ranks from 0; a document
    absent from a list ranks after both lists' rows."""
    place = lambda df, name: df.select("id", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).alias(name))
    sizes = a.agg(F.count("*").alias("x")).crossJoin(b.agg(F.count("*").alias("y"))).select((F.col("x") + F.col("y")).alias("absent"))
    joined = place(a, "ra").join(place(b, "rb"), "id", "full_outer").crossJoin(F.broadcast(sizes))
    return joined.select("id", (1 / (F.coalesce("ra", "absent") + k) + 1 / (F.coalesce("rb", "absent") + k)).alias("score"))


def linear_combination(a: DataFrame, b: DataFrame, alpha: float = 0.5) -> DataFrame:
    """id, score: min-max normalised scores of two lists, weighted; absent counts 0, a list of equal
    scores counts 1."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy()
        low, high = F.min("score").over(w), F.max("score").over(w)
        return df.select("id", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)).alias(name))

    joined = scaled(a, "sa").join(scaled(b, "sb"), "id", "full_outer")
    return joined.select("id", (alpha * F.coalesce("sa", F.lit(0.0)) + (1 - alpha) * F.coalesce("sb", F.lit(0.0))).alias("score"))


def max_sim(query: Column, doc: Column) -> Column:
    """Late interaction of two arrays of vectors: for each query vector its best cosine, summed."""
    return F.aggregate(query, F.lit(0.0), lambda s, q: s + F.array_max(F.transform(doc, lambda d: scoring.cosine(q, d))))


def merge(lists: list[DataFrame]) -> DataFrame:
    """One row per id of several result lists (same columns), the one with the highest score."""
    both = reduce(DataFrame.unionByName, lists)
    w = Window.partitionBy("id").orderBy(F.desc("score"))
    return both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def dual_pass(rows: DataFrame, query: list[float], k: int, inside: Column, boost: float = 1.25) -> DataFrame:
    """A broad search of at most min(2k, 256) and one inside a window whose scores are raised; the
    raised score wins where both found a row."""
    broad = vector_search(rows, query, min(2 * k, 256)).withColumn("boosted", F.lit(0))
    window = vector_search(rows, query, k, where=inside).withColumn("score", F.col("score") * boost).withColumn("boosted", F.lit(1))
    w = Window.partitionBy("id").orderBy(F.desc("boosted"))
    return broad.unionByName(window).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").orderBy(F.desc("score"), "id").limit(k)


def inhibit(ranked: DataFrame, near: float = 0.95, gap: float = 0.02, before: int = 20) -> DataFrame:
    """Halve the score of a row that ranks within ``before`` places after a near equal one. Works on a
    result list (id, score), which a limit keeps small."""
    w = Window.orderBy(F.desc("score"), "id")
    prior = F.collect_list("score").over(w.rowsBetween(-before, -1))
    dim = (F.col("score") >= near) & F.exists(prior, lambda p: (p >= near) & (F.abs(p - F.col("score")) < gap))
    return ranked.withColumn("score", F.when(dim, F.col("score") * 0.5).otherwise(F.col("score")))


def over_fetch(k: int, narrowing: bool = False) -> int:
    """How many rows to ask a search for, so that k remain after later filters."""
    base = min(3 * k, k + 64)
    return min(4 * base, base + 128) if narrowing else base


def community_search(rows: DataFrame, summaries: DataFrame, query: list[float], least: float = 0.3, top: int = 5, members: int = 10, share: float = 0.8) -> DataFrame:
    """id, score, kind: summaries (id, embedding, members) near the query, and their members at a
    share of the best summary's score."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    best = summaries.withColumn("score", scoring.cosine(F.col("embedding"), vector)).where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(top)
    inherited = best.select("score", F.explode(F.slice("members", 1, members)).alias("id")).groupBy("id").agg((F.max("score") * share).alias("score"))
    found = rows.select("id").join(F.broadcast(inherited), "id")
    return best.select("id", "score", F.lit("summary").alias("kind")).unionByName(found.select("id", "score", F.lit("member").alias("kind")))

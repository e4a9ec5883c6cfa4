"""Retrieval as a whole: filters, recall in its order of effects, rounds of expansion, levels of
summaries, conflicts among results and the assembly of a context.

Result lists are small: a search's limit has cut them. Nulls: a null field fails a filter; a null score
counts 0. Equal scores go by the smaller id. Empty tables give no rows. Extra columns are kept unless
said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import scoring, text
from recollect.operators import search
from recollect.sources.settled import discard, settled

DAY_MS = 86_400_000
# Phrases of time with the days from which, and to which, they reach back; the first that a text holds counts.
PHRASES = (
    ("yesterday", 2, 1), ("today", 1, 0), ("last night", 2, 1), ("last week", 7, 0), ("this week", 7, 0), ("a week ago", 14, 0), ("weeks ago", 14, 0),
    ("last month", 30, 0), ("this month", 30, 0), ("a month ago", 30, 0), ("months ago", 90, 0), ("last year", 365, 0), ("this year", 365, 0), ("a year ago", 365, 0),
    ("years ago", 730, 0), ("recently", 7, 0), ("a few days ago", 7, 0), ("days ago", 7, 0),
)


def window_of(phrase: str, now_ms: int) -> tuple[int, int] | None:
    """The span in milliseconds that a text's first phrase of time means, both ends included."""
    low = phrase.lower()
    return next(((now_ms - a * DAY_MS, now_ms - b * DAY_MS) for p, a, b in PHRASES if p in low), None)


def involving(entities: Column, names: list[str]) -> Column:
    """Whether any of a row's entities is named."""
    return F.coalesce(F.arrays_overlap(entities, F.array(*[F.lit(n) for n in names])), F.lit(False))


def on_topic(rows: DataFrame, topics: DataFrame, label: str) -> DataFrame:
    """Rows whose id has the topic; all rows where no id has it."""
    ids = topics.where(F.col("topic") == label).select("id").distinct()
    return rows if ids.isEmpty() else rows.join(ids, "id", "left_semi")


def equal(a: Column, b: float, within: float = 1e-6) -> Column:
    """Equality of measured values."""
    return F.coalesce(F.abs(a - F.lit(b)) < within, F.lit(False))


def recall(rows: DataFrame, query: list[float], k: int, score: Column, narrow: Column | None = None, live: DataFrame | None = None, inhibit: tuple[float, float] = (0.95, 0.02)) -> DataFrame:
    """``rows`` (id, embedding, ...) with similarity and score, in the order of effects: search beyond
    ``k`` (further where filters follow), score (a Column over ``similarity`` and the row), filters,
    ``live`` heads (id) in place of dead revisions, inhibition of near equals, the ``k`` best."""
    found = search.vector_search(rows, query, search.over_fetch(k, narrow is not None)).withColumnRenamed("score", "similarity").withColumn("score", score)
    kept = found if narrow is None else found.where(narrow)
    kept = kept if live is None else kept.join(live.select("id"), "id", "left_semi")
    dimmed = search.inhibit(kept.select("id", F.col("similarity").alias("score")), *inhibit).withColumnRenamed("score", "dimmed")
    out = kept.join(dimmed, "id").withColumn("score", F.when(F.col("dimmed") < F.col("similarity"), F.col("score") * 0.5).otherwise(F.col("score"))).drop("dimmed")
    return out.orderBy(F.desc("score"), F.desc("similarity"), "id").limit(k)


def iterative(rows: DataFrame, terms: list[str], limit: int, rounds: int = 3, enough: float = 0.7, top: int = 4, read: int = 8) -> DataFrame:
    """id, score, round: full-text rounds over ``rows`` (id, text). A round adds the ``top`` terms that
    weigh most in the ``read`` best rows so far (their scores over the root of how many have the term);
    rounds end when enough rows are found. An id keeps its first round."""
    found, asked = None, list(terms)
    for number in range(1, rounds + 1):
        hits = search.bm25(rows, asked).orderBy(F.desc("score"), "id").limit(limit).withColumn("round", F.lit(number))
        now = settled(hits if found is None else found.unionByName(hits.join(found.select("id"), "id", "left_anti")), "rounds")
        if found is not None:
            discard(found)
        found = now
        if found.count() / max(limit, 5) >= enough or number == rounds:
            break
        best = found.orderBy(F.desc("score"), "id").limit(read).join(rows, "id").select("score", F.explode(text.lexical_terms(F.col("text"))).alias("term"))
        weighed = best.where(~F.col("term").isin(*asked)).groupBy("term").agg((F.sum(F.greatest("score", F.lit(0.05))) / F.sqrt(F.count("*"))).alias("w"))
        more = [r["term"] for r in weighed.orderBy(F.desc("w"), "term").limit(top).collect()]
        if not more:
            break
        asked += more
    return found


def levels(leaves: DataFrame, summaries: DataFrame, query: list[float], per_level: int = 5, least: float = 0.3, share: float = 0.8) -> DataFrame:
    """id, score, level of hierarchical summaries (id, level, embedding, members) near the query, the
    best ``per_level`` of each level, and at level 0 the leaves among their members at a share of the
    best score that leads to them. Summaries are no leaves."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    place = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("score"), "id"))
    best = summaries.withColumn("score", scoring.cosine(F.col("embedding"), vector)).where(F.col("score") >= least).withColumn("place", place).where(F.col("place") <= per_level)
    under = best.select("score", F.explode("members").alias("id")).groupBy("id").agg((F.max("score") * share).alias("score")).join(summaries.select("id"), "id", "left_anti")
    found = leaves.select("id").join(F.broadcast(under), "id").select("id", "score", F.lit(0).alias("level"))
    return best.select("id", "score", "level").unionByName(found)


def conflict_groups(results: DataFrame, contradicts: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``results`` (id, recency, reliability, support, overridden) that contradict each other, directly
    or through others, with group (its smallest id), preference and preferred. Preference weighs
    recency, reliability, support and a human's override."""
    ids = results.select("id")
    inside = contradicts.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")
    both = settled(inside.unionByName(inside.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct(), "conflicts")
    label = both.select(F.col("source").alias("id")).distinct().withColumn("group", F.col("id"))
    for _ in range(most_rounds):
        around = both.join(label, F.col("target") == F.col("id")).groupBy(F.col("source").alias("id")).agg(F.min("group").alias("least"))
        now = settled(label.join(around, "id", "left").select("id", F.least("group", "least").alias("group"), (F.col("least") < F.col("group")).alias("moved")), "groups")
        label = now.select("id", "group")
        if now.where("moved").isEmpty():
            break
    preference = 0.20 * F.col("recency") + 0.35 * F.col("reliability") + 0.30 * F.col("support") + 0.15 * F.col("overridden").cast("double")
    first = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("preference"), "id")) == 1
    return results.join(label, "id").withColumn("preference", preference).withColumn("preferred", first)


#: Parts of a budget by section.
SECTIONS = {"direct": 0.5, "graph": 0.25, "causal": 0.15}


def assemble(rows: DataFrame, budget: int, sections: dict[str, float] | None = None, full: float = 0.6) -> DataFrame:
    """``rows`` (id, section, score, trust, tokens, summary_tokens, entity_tokens) that fit, with
    ``rendering`` and ``spent``: within a section by score times trust; a row is shown in full from
    score ``full`` on, as a summary from half of it on, else as its entities; what is cumulatively
    beyond the section's part of the budget is left out."""
    part = F.lit(None).cast("double")
    for name, share in (sections or SECTIONS).items():
        part = F.when(F.col("section") == name, share * budget).otherwise(part)
    rendering = F.when(F.col("score") >= full, "full").when(F.col("score") >= full / 2, "summary").otherwise("entities")
    cost = F.when(F.col("score") >= full, F.col("tokens")).when(F.col("score") >= full / 2, F.col("summary_tokens")).otherwise(F.col("entity_tokens"))
    w = Window.partitionBy("section").orderBy(F.desc(F.col("score") * F.col("trust")), "id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"rendering": rendering, "spent": cost}).withColumn("upto", F.sum("spent").over(w))
    return out.where(F.col("upto") <= part).drop("upto")


def to_csv(rows: DataFrame) -> DataFrame:
    """``record``: each row as a line of comma-separated values."""
    return rows.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("record"))

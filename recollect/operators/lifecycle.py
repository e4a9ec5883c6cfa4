"""Sequences, revisions and forgetting, as window and aggregate plans.

Nulls: rows with a null key form a key of their own; null values are left out of averages, sums and
maxima. Rows equal in the order columns stand in any order, so give a column that tells them apart.
Empty tables give no rows. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adaptive_threshold(rows: DataFrame, key: str, order: list[str], value: str, gamma: float = 1.0, floor: float = 0.0, span: int = 20) -> DataFrame:
    """Mean plus gamma deviations of up to ``span`` earlier values, once there are two."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-span, -1)
    past = F.count(value).over(w)
    return rows.withColumn("threshold", F.when(past >= 2, F.greatest(F.avg(value).over(w) + gamma * F.stddev_pop(value).over(w), F.lit(floor))))


def segments(rows: DataFrame, key: str, order: list[str], ms: str, value: str, gap_s: int = 3600, gamma: float = 2.0) -> DataFrame:
    """``rows`` with ``segment``: a new one begins after a gap, or where the value exceeds the
    adaptive threshold."""
    w = Window.partitionBy(key).orderBy(*order)
    judged = adaptive_threshold(rows, key, order, value, gamma)
    first = F.lag(ms).over(w).isNull()
    edge = first | (F.col(ms) - F.lag(ms).over(w) > gap_s * 1000) | F.coalesce(F.col(value) > F.col("threshold"), F.lit(False))
    return judged.withColumn("edge", edge.cast("int")).withColumn("segment", F.sum("edge").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("edge")


def periods(rows: DataFrame, key: str, order: list[str], ms: str) -> DataFrame:
    """key, n, period_ms: the upper median gap of keys seen three times or more at regular gaps
    (deviation under half the mean)."""
    gaps = rows.withColumn("gap", F.col(ms) - F.lag(ms).over(Window.partitionBy(key).orderBy(*order))).where(F.col("gap").isNotNull())
    ranked = gaps.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("gap")) - 1)
    stats = gaps.groupBy(key).agg(F.count("*").alias("g"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("dev"))
    mid = ranked.join(stats, key).where((F.col("r") == F.floor(F.col("g") / 2)) & (F.col("g") >= 2) & (F.col("dev") < 0.5 * F.col("mean")))
    return mid.select(key, (F.col("g") + 1).alias("n"), F.col("gap").alias("period_ms"))


def heads(revisions: DataFrame, chain: str, version: str, as_of: Column | None = None) -> DataFrame:
    """The latest revision of each chain, of those that ``as_of`` admits. Only key columns are sorted."""
    kept = revisions if as_of is None else revisions.where(as_of)
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy(chain).orderBy(F.desc(version)))).where("_r = 1").drop("_r")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Whole rows of ``changes`` in place of those of ``base`` with equal keys, or added."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def delete(base: DataFrame, where: Column) -> DataFrame:
    """What the predicate doesn't hold for; a null outcome keeps the row."""
    return base.where(~F.coalesce(where, F.lit(False)))


def update(base: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return base.withColumns({name: F.when(hit, value).otherwise(F.col(name)) for name, value in values.items()})


def walked(rows: DataFrame, key: str, order: list[str], out: str, start: Callable[[], object], step: Callable[[object, tuple], tuple[object, bool]], reads: list[str]) -> DataFrame:
    """``rows`` with the boolean ``out`` of a walk through each key's rows in order: ``step(state, values
    of reads)`` gives the next state and the outcome. Rows stream through sorted; a task holds one
    batch and one state, however many rows a key has."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for pdf in parts:
            made = []
            for k, values in zip(pdf[key], zip(*(pdf[c] for c in reads), strict=True), strict=True):
                k = None if pd.isna(k) else k
                if k != now:
                    now, state = k, start()
                state, outcome = step(state, values)
                made.append(outcome)
            yield pdf.assign(**{out: made})

    schema = rows.withColumn(out, F.lit(True)).schema
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(work, schema)


def rate_limited(rows: DataFrame, key: str, seconds: str, most: int = 100, window: int = 60, tie: str = "id") -> DataFrame:
    """``rows`` with ``accepted``: a write is accepted while fewer than ``most`` accepted writes of its
    key are younger than ``window``; rejected ones don't count. The state is at most ``most`` times."""

    def step(held: tuple, values: tuple) -> tuple[tuple, bool]:
        now = values[0]
        held = tuple(t for t in held if now - t < window)
        return (*held, now) if len(held) < most else held, len(held) < most

    return walked(rows, key, [seconds, tie], "accepted", tuple, step, [seconds])


def token_budgeted(rows: DataFrame, key: str, order: list[str], tokens: str, budget: int = 500_000) -> DataFrame:
    """``rows`` with ``accepted``: a write is accepted if its tokens and those stored before for its key
    stay within ``budget``; rejected ones are not stored."""

    def step(stored: int, values: tuple) -> tuple[int, bool]:
        fits = stored + values[0] <= budget
        return stored + (values[0] if fits else 0), fits

    return walked(rows, key, order, "accepted", int, step, [tokens])


def contiguous(rows: DataFrame, key: str, order: list[str], hit: Column, score: Column, reach: int = 2, share: float = 0.7) -> DataFrame:
    """Rows that are hits or within ``reach`` places of one, with the best score they get."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-reach, reach)
    near = F.max(F.when(hit, score * share)).over(w)
    return rows.withColumn("score", F.greatest(F.when(hit, score), near)).where(F.col("score").isNotNull())


def causal_pairs(rows: DataFrame, ms: str, what: str, group: str, window_s: int = 3600, least: int = 3, least_confidence: float = 0.4) -> DataFrame:
    """cause, effect, n, strength, confidence: how often content B follows other content A within the
    window, in a group. A range join by time bucket: each row meets its own and the next bucket only."""
    span = window_s * 1000
    a = rows.select(group, F.col(ms).alias("ta"), F.col(what).alias("cause"), F.floor(F.col(ms) / span).alias("bucket"))
    b = rows.select(group, F.col(ms).alias("tb"), F.col(what).alias("effect"), F.explode(F.array(F.floor(F.col(ms) / span), F.floor(F.col(ms) / span) - 1)).alias("bucket"))
    pairs = a.join(b, [group, "bucket"]).where((F.col("tb") > F.col("ta")) & (F.col("tb") - F.col("ta") <= span) & (F.col("cause") != F.col("effect")))
    n = pairs.groupBy("cause", "effect").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    confidence = F.least(0.3 + 0.7 * (1 - 1 / (1 + F.col("n"))), F.lit(1.0))
    return n.select("cause", "effect", "n", F.least(F.col("n") / 10.0, F.lit(1.0)).alias("strength"), confidence.alias("confidence")).where(F.col("confidence") >= least_confidence)


def reconsolidate(pairs: DataFrame) -> DataFrame:
    """Of two contradicting memories the higher score wins (a on ties); the loser fades by margin."""
    margin = F.abs(F.col("score_a") - F.col("score_b"))
    factor = F.least(F.greatest(0.8 - 0.5 * margin, F.lit(0.3)), F.lit(0.8))
    a_wins = F.col("score_a") >= F.col("score_b")
    return pairs.withColumns({"winner": F.when(a_wins, F.col("id_a")).otherwise(F.col("id_b")), "loser_score": F.when(a_wins, F.col("score_b")).otherwise(F.col("score_a")) * factor})


def welford(parts: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, mean, m2: mergeable moments; finite values only."""
    v = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    return parts.groupBy(key).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))


def merge_welford(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    both = a.unionByName(b)
    total = both.groupBy(key).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("m2").alias("m2in"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("sq"))
    return total.select(key, "n", "mean", (F.col("m2in") + F.col("sq") - F.col("n") * F.col("mean") * F.col("mean")).alias("m2"))


def evict(rows: DataFrame, key: str, priority: str, order: str, tokens: str, limit: int) -> DataFrame:
    """``rows`` with ``kept``: those that fit the token limit by priority, then recency."""
    w = Window.partitionBy(key).orderBy(F.desc(priority), F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum(tokens).over(w)).withColumn("kept", F.col("upto") <= limit)


def expired(rows: DataFrame, created_ms: str, ttl_s: str, now_ms: int) -> Column:
    """Whether a row's time to live (null: for ever) is over."""
    return F.coalesce(F.col(created_ms) + F.col(ttl_s) * 1000 <= F.lit(now_ms), F.lit(False))


def decay_sweep(rows: DataFrame, accessed_ms: str, importance: str, now_ms: int, window_s: int = 86_400, factor: float = 0.95) -> DataFrame:
    """Importance of rows not accessed within the window, lowered by ``factor``."""
    stale = (F.col(accessed_ms) < now_ms - window_s * 1000) & (F.col(importance) > 0)
    return rows.withColumn(importance, F.when(stale, F.col(importance) * factor).otherwise(F.col(importance)))

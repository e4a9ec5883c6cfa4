"""What may be written: gates in order, of which the first that doesn't accept decides.

Nulls: a candidate without a vector passes the vector gates. Equal distances go to the smaller id.
Candidates are a stated set, compared with all stored rows in broadcast blocks; without stored rows
all pass. Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import scoring
from recollect.operators.closest import closest


def nearest(candidates: DataFrame, stored: DataFrame, block: int = 10_000) -> DataFrame:
    """``candidates`` (id, embedding, ...) with nearest_id and distance (1 - cosine) of the closest
    stored row of another id; null where there is none."""
    near = closest(stored, candidates.select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), 1, block=block)
    best = near.groupBy("query_id").agg(F.min(F.struct((1 - F.col("score")).alias("distance"), "id")).alias("m"))
    return candidates.join(best.select(F.col("query_id").alias("id"), F.col("m.id").alias("nearest_id"), F.col("m.distance").alias("distance")), "id", "left")


def duplicate_gate(distance: Column, likeness: float = 0.95, action: str = "reject") -> Column:
    """``action`` (reject or merge) for a candidate as near as ``likeness`` to a stored row, else null."""
    return F.when(distance <= 1 - likeness, F.lit(action))


def surprise_gate(distance: Column, least: float = 0.3) -> tuple[Column, Column]:
    """(decision, importance): what is nearer than ``least`` is rejected; else its distance, held in
    0 .. 1, becomes its importance."""
    return F.when(distance < least, F.lit("reject")), F.when(distance >= least, scoring.clamp(distance))


def admitted(rows: DataFrame, gates: list[tuple[str, Column, Column | None]]) -> DataFrame:
    """``rows`` with decision, decided_by and importance_override: ``gates`` are (name, decision or
    null, override or null) in order. The first decision wins, the last override before it holds."""
    decision = F.coalesce(*[g[1] for g in gates], F.lit("accept"))
    by = F.coalesce(*[F.when(g[1].isNotNull(), F.lit(g[0])) for g in gates], F.lit("none"))
    overrides = [g[2] for g in reversed(gates) if g[2] is not None]
    return rows.withColumns({"decision": decision, "decided_by": by, "importance_override": F.when(decision == "accept", F.coalesce(*overrides)) if overrides else F.lit(None).cast("double")})

"""Row policies, applied where a table is read so that no plan gets around them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Which values of ``column`` an agent may read (None: all), and of which it may see raw text."""

    column: str
    allowed: tuple[str, ...] | None = None
    raw: tuple[str, ...] | None = None


def governed(rows: DataFrame, policy: Policy, text: str | None = None) -> DataFrame:
    if policy.allowed is not None:
        rows = rows.where(F.col(policy.column).isin(*policy.allowed)) if policy.allowed else rows.where(F.lit(False))
    if text and policy.raw is not None:
        rows = rows.withColumn(text, F.when(F.col(policy.column).isin(*policy.raw), F.col(text)))
    return rows

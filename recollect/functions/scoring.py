"""Scores of memories as Column expressions: no Python runs per row, nulls in give nulls out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default weights of the recall score.
RECALL_WEIGHTS = {"similarity": 0.30, "importance": 0.20, "recency": 0.20, "activation": 0.10, "causal": 0.05, "surprise": 0.10, "source": 0.05}
# How far each kind of source is trusted.
SOURCE_TRUST = {"direct_observation": 1.0, "agent_generated": 0.8, "inferred": 0.6, "cross_agent": 0.5}
ORIGIN_TRUST = {"DirectObservation": 1.0, "UserProvided": 1.0, "LlmExtraction": 0.8, "Consolidation": 0.6, "DreamReplay": 0.6, "CrossAgent": 0.5}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def composite_score(similarity: Column, importance: Column, age_hours: Column, activation: Column, causal: Column, surprise: Column) -> Column:
    """Six-term score with a half-life of a week, not clamped."""
    recency = F.exp(F.lit(-0.6931471805599453 / 168.0) * age_hours)
    return 0.35 * similarity + 0.20 * importance + 0.20 * recency + 0.10 * activation + 0.05 * causal + 0.10 * surprise


def check_weights(weights: Mapping[str, float]) -> None:
    """Each weight in 0 .. 1, all together 1 within 1e-4."""
    if set(weights) != set(RECALL_WEIGHTS) or not all(0 <= w <= 1 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-4:
        raise ValueError(f"weights must name {sorted(RECALL_WEIGHTS)}, lie in 0 .. 1 and add up to 1")


def recall_score(terms: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> Column:
    """Seven-term weighted score; each term and the sum are clamped to 0 .. 1."""
    weights = weights or RECALL_WEIGHTS
    check_weights(weights)
    return clamp(sum((clamp(terms[k]) * w for k, w in weights.items()), F.lit(0.0)))


def decay_rate(base: Column, importance: Column, accesses: Column) -> Column:
    """Forgetting rate: slower for important and often used memories."""
    return base / (1 + importance) / (1 + accesses)


def temporal_decay(age_hours: Column, base: Column, accesses: Column, importance: Column) -> Column:
    return F.exp(-decay_rate(base, importance, accesses) * age_hours)


def recency(age_hours: Column, importance: Column, accesses: Column, rate: float = 0.01) -> Column:
    return F.exp(-decay_rate(F.lit(rate), clamp(importance), accesses) * age_hours)


def token_count(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / F.lit(4.0)).cast("int")


def prediction_error(max_similarity: Column, z: Column) -> Column:
    return clamp((1 - max_similarity) * (1 + z), 0.0, 2.0)


def source_reliability(kind: Column) -> Column:
    return F.when(kind.isNull(), None).otherwise(_by_name(kind, SOURCE_TRUST, 0.4))


def origin_reliability(origin: Column) -> Column:
    return F.when(origin.isNull(), None).otherwise(_by_name(origin, ORIGIN_TRUST, 0.4))


def _by_name(name: Column, values: Mapping[str, float], other: float) -> Column:
    out = F.lit(other)
    for key, value in values.items():
        out = F.when(name == key, value).otherwise(out)
    return out


def surprise_score(divergence: Column) -> Column:
    return 1 / (1 + F.exp(-divergence))


def causal_relevance(strength: Column, confidence: Column, evidence: Column) -> Column:
    return strength * confidence * F.log1p(evidence)


def retention(age_hours: Column, stability: Column, accesses: Column) -> Column:
    """Forgetting curve; repeated access lengthens it logarithmically."""
    return F.exp(-age_hours / (stability * (1 + 0.5 * F.log(F.greatest(accesses, F.lit(1)).cast("double")))))


def decayed_importance(importance: Column, age_hours: Column, factor: float = 0.95, half_life: float = 168.0) -> Column:
    return importance * F.pow(F.lit(factor), age_hours / half_life)


def interference(similarity: Column) -> Column:
    return clamp(2 * (similarity - 0.5))


def anomaly(similarity: Column, in_future: Column, stored: Column) -> Column:
    """Strangeness of a write; stores of under ten records don't judge."""
    return F.when(stored < 10, 0.0).otherwise(0.7 * (1 - similarity) + 0.3 * F.when(in_future, 0.5).otherwise(0.0))


def evidence_confidence(evidence: Column, contradictions: Column) -> Column:
    step = F.when(evidence <= 1, 0.3).when(evidence <= 3, 0.5).when(evidence <= 7, 0.7).otherwise(0.85)
    return clamp(step - 0.15 * contradictions, 0.1, 1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)

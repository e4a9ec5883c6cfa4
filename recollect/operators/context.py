"""Choosing what goes into a limited context. These work on a result list that a limit keeps small."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import scoring


def quality_gate(rows: DataFrame, budget: int, threshold: float = 0.5) -> DataFrame:
    """``rows`` (score, token_count, embedding) with quality_score and quality_action. The mean
    pairwise cosine comes from the sum of unit vectors, not from pairs."""
    unit = rows.where(F.col("embedding").isNotNull()).withColumn("u", F.transform("embedding", lambda x: x.cast("double") / scoring.norm(F.col("embedding"))))
    sums = unit.select(F.posexplode("u")).groupBy("pos").agg(F.sum("col").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("score").alias("confidence"), F.sum("token_count").alias("tokens"), F.count("embedding").alias("m"))
    one = stats.join(sums)
    m = F.col("m")
    coherence = F.when(m < 2, 0.6).otherwise(scoring.clamp((F.col("sq") - m) / (m * (m - 1))))
    quality = 0.3 * F.least(F.col("n") / 5.0, F.lit(1.0)) + 0.3 * F.col("confidence") + 0.2 * coherence + 0.2 * F.least(F.col("tokens") / F.lit(float(budget)), F.lit(1.0))
    gate = one.select(quality.alias("quality_score"), F.when(quality >= threshold, "pass").otherwise("escalate").alias("quality_action"))
    return rows.join(F.broadcast(gate))


def fit_budget(rows: DataFrame, budget: int, key: str) -> DataFrame:
    """Per ``key`` the rows that a greedy walk takes: best score per token first, then score, then
    id; a row that doesn't fit is skipped and the walk goes on. Rows are cut first to those that can
    matter: of each token size the best floor(budget / tokens)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key, "token_count").orderBy(F.desc("score"), "id")
    cut = rows.where((F.col("token_count") > 0) & (F.col("token_count") <= budget)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.floor(F.lit(budget) / F.col("token_count"))).drop("_r")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_d=pdf["score"] / pdf["token_count"]).sort_values(["_d", "score", "id"], ascending=[False, False, True], kind="stable")
        left, take = budget, []
        for n in pdf["token_count"]:
            take.append(n <= left)
            left -= n if take[-1] else 0
        return pdf[take].drop(columns="_d")

    return cut.groupBy(key).applyInPandas(walk, cut.schema)


def topics(rows: DataFrame, key: str, least: float = 0.6, most: int = 20) -> DataFrame:
    """``rows`` (id, text) with ``topic``: greedy clusters by shared words with each cluster's first
    member, in id order; the closest cluster takes what comes after ``most``. One key is one task's
    work; its state is the clusters' first members."""

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        heads: list[tuple[str, set[str]]] = []
        out = []
        for text in pdf.sort_values("id")["text"]:
            words = set(text.lower().split())
            sims = [len(words & h) / max(1, len(words | h)) for _, h in heads]
            best = max(range(len(sims)), key=sims.__getitem__, default=-1)
            if best < 0 or (sims[best] <= least and len(heads) < most):
                heads.append((text[:40], words))
                best = len(heads) - 1
            out.append(heads[best][0])
        return pdf.sort_values("id").assign(topic=out)

    schema = rows.withColumn("topic", F.lit("")).schema
    return rows.groupBy(key).applyInPandas(assign, schema)


def embed_trigrams(texts: DataFrame, dims: int = 64) -> DataFrame:
    """``texts`` (id, text) with a deterministic unit vector of hashed byte trigrams."""
    import numpy as np

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for text in pdf["text"]:
                b = np.frombuffer((text or "").encode(), dtype=np.uint8).astype(np.uint32)
                v = np.zeros(dims)
                if len(b) >= 3:
                    h = (b[:-2] * np.uint32(31) + b[1:-1]) * np.uint32(31) + b[2:]
                    v = np.bincount((h + np.arange(len(h), dtype=np.uint32)) % dims, minlength=dims).astype(float)
                n = np.linalg.norm(v)
                if n == 0:
                    v[0] = n = 1.0
                rows.append((v / n).tolist())
            yield pdf.assign(embedding=rows)

    return texts.select("id", "text").mapInPandas(work, "id long, text string, embedding array<double>")

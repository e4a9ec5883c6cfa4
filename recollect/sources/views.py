"""Memory-shaped views over the given tables. They are plain projections, so filters and the columns
that a query leaves out still reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, namespace, embedding of ``embeddings``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("ns"), F.col("label")).alias("namespace"), "embedding")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as episodic memories; importance is the value over 100, held in 0 .. 1."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("agent_id"), F.col("event_type").alias("namespace"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_ms"),
        F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)).alias("importance"), (F.col("event_id") % 7).alias("access_count"), "value", "props",
    )


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, weight: parts to suppliers by the share of the largest quantity supplied."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    top = sums.agg(F.max("q").alias("top"))
    return sums.crossJoin(F.broadcast(top)).select(F.col("l_partkey").alias("source"), (F.col("l_suppkey") + 1_000_000).alias("target"), (F.col("q") / F.col("top")).alias("weight"), F.col("n").alias("evidence"))


def causal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cause, effect, strength, confidence, evidence: one user's event followed by its next, by user
    and type, a type's node being user * 10 + type."""
    kinds = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 4).otherwise(5)
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    node = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("user_id") * 10 + kinds).alias("node"))
    steps = node.select("user_id", "node", F.lead("node").over(w).alias("next")).where((F.col("next") > F.col("node")))
    return steps.groupBy(F.col("node").alias("cause"), F.col("next").alias("effect")).agg(F.count("*").alias("evidence")).select(
        "cause", "effect", F.least(F.col("evidence") / 10.0, F.lit(1.0)).alias("strength"), F.least(0.3 + 0.7 * (1 - 1 / (1 + F.col("evidence"))), F.lit(1.0)).alias("confidence"), "evidence"
    )

"""The event table as a stream. Each query runs the stream over all rows that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.sources.settled import shared_dir
from recollect.sources.views import table
from recollect.streaming import events

from .register import registry

QUERIES, ORACLE, query = registry()
C = F.col


def _stream(spark: SparkSession, sf_dir: str, where=None) -> DataFrame:
    return events.subscribe(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema, where)


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('error', 'purchase') AND value > 50")
def watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subscription to important events of two types."""
    wanted = C("event_type").isin("error", "purchase") & (C("value") > 50)
    return events.drained(_stream(spark, sf_dir, wanted).select("event_id", "user_id", "event_type", "value"), shared_dir(spark))


@query("SELECT epoch_ms(date_trunc('day', ts)) AS day_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by type, in complete mode so that nothing is late."""
    w = events.windowed(_stream(spark, sf_dir).withColumn("ts", C("ts").cast("timestamp")), "1 day", "40 days")
    return events.drained(w, shared_dir(spark), "complete").select(F.unix_millis(C("start").cast("timestamp")).alias("day_ms"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id AS seq, user_id, event_type FROM events WHERE event_id >= 5000 AND ts >= TIMESTAMP '2024-01-10'")
def replay_and_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(C("event_id").alias("seq"), "ts", "user_id", "event_type")
    kept = events.retained(log, newer_than=C("ts") >= F.lit("2024-01-10").cast("timestamp"))
    return events.replay(kept, 5000).select("seq", "user_id", "event_type")

"""The event log as a stream: filtered subscriptions, windows and state that survives restarts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def subscribe(spark: SparkSession, path: str, schema, where: Column | None = None) -> DataFrame:
    """New rows of a Parquet event folder as they come, those that the subscription asks for."""
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    return stream if where is None else stream.where(where)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and tumbling window; later ones than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drained(stream: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that is there now and read what it wrote. Each micro-batch goes to a
    folder named by its id, so a batch that is run again replaces itself; in complete mode, where a batch
    holds the whole result so far, each replaces the one before it."""
    spark = stream.sparkSession
    at = f"{folder}/stream-{uuid.uuid4().hex[:12]}"

    def put(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{at}/out/{'last' if mode == 'complete' else f'part{number}'}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/out").select(*stream.columns)


def replay(log: DataFrame, since: int) -> DataFrame:
    """The log's rows from a sequence number on, in order."""
    return log.where(F.col("seq") >= since).orderBy("seq")


def retained(log: DataFrame, snapshot_seq: int | None = None, newer_than: Column | None = None) -> DataFrame:
    """What is left after dropping events before a snapshot or a horizon."""
    if snapshot_seq is not None:
        log = log.where(F.col("seq") >= snapshot_seq)
    return log if newer_than is None else log.where(newer_than)

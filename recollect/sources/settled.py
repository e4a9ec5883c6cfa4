"""Intermediate tables in the storage that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where the session names none, one in the warehouse,
    which driver and executors share as well."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_between"


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write ``df`` and read it back, so that its lineage ends there and it is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``settled`` gave and nothing will read again."""
    for df in frames:
        if hasattr(df, "written_at"):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)

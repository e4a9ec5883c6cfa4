"""Reading inputs and keeping intermediate tables in storage all executors share."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where the session names none, one in the warehouse,
    which driver and executors share as well."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_between"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, and a
    lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``written`` gave and nothing will read again."""
    for df in frames:
        jvm = df.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(df.written_at)
        place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def give_back() -> None:
    """Free memory goes back to the system: Python workers live on between stages, beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], drop: Callable[[], None] = lambda: None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` of a task, after which ``drop`` and ``give_back`` run, also where it fails."""

    @functools.wraps(work)
    def kept_lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            drop()
            give_back()

    return kept_lean


class Scratch:
    """Tables that one operator needs while it runs."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def written(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        self.frames.append(written(df, name, **options))
        return self.frames[-1]

    def clear(self) -> None:
        discard(*self.frames)
        self.frames.clear()


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that an operator needs, null text as the empty string. Other columns,
    whatever their names, never reach the operator."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def held_out(key, modulus: int, remainder: int):
    """crc32 of the key as text, by remainder (a null key counts as the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus == remainder

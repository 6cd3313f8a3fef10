"""The append log as a stream: follow it, copy it exactly once, keep derived tables current.

A store only grows, so its Parquet folder is a stream of appended files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.primitives import SCHEMA


def follow(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Primitives as they are appended under ``path``."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def replicate(stream: DataFrame, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Copy the stream to ``target``; a batch that runs again replaces its own folder, so none is copied twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def replica(spark: SparkSession, target: str) -> DataFrame:
    """What ``replicate`` has copied."""
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(target)


def newest(stream: DataFrame) -> DataFrame:
    """The newest version of each lineage, kept in the state store (update or complete output)."""
    own = [c for c in stream.columns if c != "lineage"]
    return stream.groupBy("lineage").agg(F.max_by(F.struct(*own), "id").alias("_p")).select("lineage", "_p.*")


def counts(stream: DataFrame) -> DataFrame:
    """Primitives of each type, live and all."""
    return stream.groupBy("typeguid").agg(F.count("*").alias("n"), F.count_if("live").alias("live"))


def rate(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Primitives of each type in windows of their timestamps; windows close ``late`` after."""
    timed = stream.withColumn("at", F.timestamp_seconds(F.shiftright("ts_raw", 16)))
    return timed.withWatermark("at", late).groupBy(F.window("at", width), "typeguid").agg(F.count("*").alias("n"))

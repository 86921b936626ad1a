"""Structured Streaming over folders that point files arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointmill.sources import blobs


def arriving(spark: SparkSession, folder: str, fmt: int, extra: int = 0, files_at_once: int = 100) -> DataFrame:
    """A stream of the points of new files, each read once."""
    files = spark.readStream.format("binaryFile").schema(blobs.FILES).option("pathGlobFilter", "*.la[sz]").option("maxFilesPerTrigger", files_at_once).load(folder)
    return blobs.decoded(files, fmt, extra)


def by_time(points: DataFrame, width: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Points and extremes of height by window of GPS time (seconds), once a window can get no more points."""
    timed = points.withColumn("time", F.timestamp_seconds("gps_time")).withWatermark("time", late)
    return timed.groupBy(F.window("time", width).alias("w")).agg(F.count(F.lit(1)).alias("n_points"), F.min("z").alias("min_z"), F.max("z").alias("max_z")).select(F.col("w.start").alias("start"), "n_points", "min_z", "max_z")


def ingest(points: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends a stream's rows to a Parquet folder: all that is there now, or again and again after so long."""
    out = points.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start(target)

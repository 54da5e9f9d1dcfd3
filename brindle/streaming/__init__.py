"""The stateless kernels on streams of image files, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def image_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """New files below path as (path, content, md5), as they appear."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    df = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(path)
    return df.select("path", "content", F.md5("content").alias("md5"))


def first_seen(stream: DataFrame, late: str = "1 day", time: str = "modificationTime", key: str = "md5") -> DataFrame:
    """Rows whose key hasn't come within the watermark: exact duplicates of a stream are dropped as they arrive."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str = "ts", by: str = "event_type", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count and mean by tumbling window; windows close when the watermark passes them."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))

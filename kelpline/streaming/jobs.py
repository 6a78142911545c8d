"""Structured Streaming forms: windowed counts and micro-batch scans; answer streams are in ``answers``, upserts in ``tables``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.paths import base_name, extension


def event_stream(spark: SparkSession, path: str, schema: str, max_files: int = 50) -> DataFrame:
    """Parquet files as a stream, some files a batch; ``ts`` becomes a timestamp with zone, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def minute_counts(events: DataFrame, keys: tuple[str, ...] = (), width: str = "1 minute", late: str | None = "10 minutes") -> DataFrame:
    """(start, keys, events, total) in tumbling windows; the same plan on a batch and on a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late and rows.isStreaming else rows
    return rows.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "events", "total")


def new_files(spark: SparkSession, path: str, max_files: int = 50) -> DataFrame:
    """(path, name, extension, size, modified_at) of files as they appear below a folder, at most ``max_files`` a batch."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).load(path)
    name = base_name("path")
    return raw.select("path", name.alias("name"), extension(name).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))

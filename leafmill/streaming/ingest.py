"""Streams: the stateless functions run unchanged on files as they arrive; windowed counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import base_name, source_kind


def arriving_files(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """(path, kind, name, content) of files that arrive in a folder."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", max_files).load(folder)
    leaf = F.regexp_extract("path", r"([^/]*)\z", 1)
    return files.select("path", source_kind(leaf, F.lit("")).alias("kind"), base_name(leaf).alias("name"), "content")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and tumbling window; late ones are taken until the watermark. Works on streams and tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")

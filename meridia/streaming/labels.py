"""Streaming forms: event counts by window, and the latest version of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, with the schema of a frame."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Counts of each kind in event-time windows; state older than the watermark is dropped."""
    w = events.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def hazard_stream(observations: DataFrame, cases: DataFrame, horizon: str = "3 days", lateness: str = "1 day") -> DataFrame:
    """Observations with a case of the same entity within the horizon after them: a bounded stream join."""
    o = observations.withWatermark("moment", lateness)
    c = cases.withColumnRenamed("entity", "_e").withWatermark("filed", lateness)
    on = (F.col("entity") == F.col("_e")) & (F.col("filed") > F.col("moment")) & (F.col("filed") <= F.col("moment") + F.expr(f"interval {horizon}"))
    return o.join(c, on).select("entity", "moment", "filed")

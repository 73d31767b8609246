"""Streaming ingestion: landing folder to text units, and windowed audit counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.operators.units import text_units


def unit_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Text units of the documents that arrive in a folder of Parquet files."""
    return text_units(spark.readStream.schema(schema).parquet(folder))


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window; rows later than the watermark are dropped when streaming."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")

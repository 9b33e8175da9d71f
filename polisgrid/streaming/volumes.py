"""Hourly volumes of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """hour, event_type, n, total by tumbling hours of ts; rows later than the watermark are dropped when streaming."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def run_once(spark: SparkSession, folder: str, schema, out: str, checkpoint: str):
    """Everything in the folder as a stream into Parquet; starts again where it stopped."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return hourly(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

"""Streaming ingest of the event log. An extension: batch operators read the table it appends to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadtide.sources.readers import EVENTS


def event_stream(spark: SparkSession, path: str, late: str = "3 days") -> DataFrame:
    """Events as they arrive, each key once; rows later than ``late`` by log date are left out."""
    rows = spark.readStream.schema(EVENTS).parquet(path)
    keyed = rows.withColumn("log_time", F.col("log_date").cast("timestamp")).withWatermark("log_time", late)
    return keyed.dropDuplicatesWithinWatermark(["log_date", "city_code", "checkin"])


def daily_arrivals(stream: DataFrame) -> DataFrame:
    """Searches by log day and city, for days that are complete."""
    return stream.groupBy(F.window("log_time", "1 day"), "city_code").agg(F.sum("search_count").alias("searches"))


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table by month of check-in, so as-of reads prune; restarts resume."""
    out = stream.drop("log_time").withColumn("checkin_month", F.date_format("checkin", "yyyy-MM"))
    return out.writeStream.format("parquet").partitionBy("checkin_month").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

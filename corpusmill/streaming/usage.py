"""Streams of usage: new files, daily windows, stateful deduplication, and the table that they are added to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import measures


def event_files(spark: SparkSession, path: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def daily_usage(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Usage by day and model; state of a day goes once the watermark has passed it."""
    timed = events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    grouped = timed.groupBy(F.window("created_at", "1 day"), "model").agg(*measures())
    return grouped.select(F.to_date("window.start").alias("day"), "model", "requests", "input_tokens", "output_tokens", "total_tokens", "cost_usd")


def once_each(events: DataFrame, key: str = "id", late: str = "1 hour") -> DataFrame:
    """First event of each id within the watermark."""
    return events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late).dropDuplicatesWithinWatermark([key])


def store_by_day(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add the events that there are to a table partitioned by day; each batch's files are committed once."""
    by_day = events.withColumn("day", F.to_date("created_at"))
    return by_day.writeStream.partitionBy("day").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)

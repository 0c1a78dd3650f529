"""An extension: scored events as a stream, watched for latency and drift in tumbling windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def monitored(events: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """(start, end, event_type, n, least, greatest, mean) per window of events (ts, event_type, value); later rows than ``late`` are left out."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.round(F.avg("value"), 6).alias("mean"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "least", "greatest", "mean")


def watch(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to a parquet folder, all that is there now."""
    return monitored(events).writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Ingest as a stream: each stage result once, and counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T


def once(stream: DataFrame, time: str = "ts", within: str = "1 hour") -> DataFrame:
    """stream (text, ts) with stage_key, repeated contents within the watermark dropped."""
    keyed = stream.withColumn("stage_key", T.stage_key(F.lit("ingest"), F.lit("1"), F.lit("{}"), F.array(T.short_hash(F.col("text")))))
    return keyed.withWatermark(time, within).dropDuplicatesWithinWatermark(["stage_key"])


def event_counts(stream: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(event_type, hour, n, total) of events (ts, event_type, value), for a stream or a table alike."""
    kind = dict(stream.dtypes)["ts"]  # event time must be a timestamp with a zone; the result is what came in
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counts.select("event_type", F.col("w.start").cast(kind).alias("hour"), "n", "total")

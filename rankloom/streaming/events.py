"""Event streams: windowed counts with a watermark, and sessions. Both work on batch and on streaming frames.

Watermarks take only instants: a stream's wall-clock times are read in the session's zone, and its results are wall-clock
times again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of windows; state older than the watermark is let go."""
    kind = events.schema["ts"].dataType
    return _watermarked(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").cast(kind).alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, n) of runs of events less than a gap apart."""
    kind = events.schema["ts"].dataType
    return _watermarked(events, late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").cast(kind).alias("session_start"), "n")

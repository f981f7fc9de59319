"""Event-time windows over streams and tables alike (an extension: the analysed dialects only name these functions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts per key and window; on a stream, rows later than `late` behind the watermark are dropped."""
    if events.isStreaming and late:
        events = events.withWatermark(time, late)
    out = events.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts per key and session."""
    if events.isStreaming and late:
        events = events.withWatermark(time, late)
    out = events.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")

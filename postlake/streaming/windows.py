"""Windowed counts; the same expressions serve batch tables and streams with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, *keys: str, late: str | None = None) -> DataFrame:
    """Count and sum of `value` in windows of `ts`; late: the watermark of a stream."""
    rows = events.withWatermark("ts", late) if late else events
    found = rows.groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of a user: events less than the gap apart."""
    rows = events.withWatermark("ts", late) if late else events
    found = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return found.select("user_id", "start", "last", "n")

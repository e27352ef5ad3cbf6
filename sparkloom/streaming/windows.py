"""Streaming forms: windows and sessions with watermarks, and islands in bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, width: str, late: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` by window; rows later than ``late`` are left out in a stream."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = df.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(df: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Islands in time: rows of a key at most ``gap`` apart."""
    out = df.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")

"""Streaming additions over event tables: windowed counts, sessions and running first starts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, keys: Sequence[str], width: str, lateness: str, slide: str | None = None, value: str | None = None) -> DataFrame:
    """Count, and sum of a value, in event-time windows; rows later than ``lateness`` are left out of closed windows."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    out = events.withWatermark(ts, lateness).groupBy(window.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, *(c for c in out.columns if c not in ("w", *keys)))


def sessions(events: DataFrame, ts: str, key: str, gap: str, lateness: str) -> DataFrame:
    """Sessions of each key: events less than ``gap`` apart."""
    out = events.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def deduplicated(events: DataFrame, ts: str, key: str, lateness: str) -> DataFrame:
    """The first row of each key within the lateness bound."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])

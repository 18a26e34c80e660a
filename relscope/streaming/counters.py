"""Runtime counters as a stream: windowed sums with a watermark, and drift of counters between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, key: str, value: str, ts: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(key, window_start, events, total) of a stream or a table; events later than the watermark are left out."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, window), F.col(key).alias("key")).agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    return counted.select("key", F.col("window.start").alias("window_start"), "events", "total")


def increments(earlier: DataFrame, later: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """What cumulative counters grew by between two snapshots; a counter that fell was reset and counts from 0."""
    old = earlier.select(*keys, *[F.col(c).alias(f"__{c}") for c in counters])
    joined = later.join(old, keys, "left")
    grown = [F.when(F.col(c) >= F.coalesce(f"__{c}", F.lit(0)), F.col(c) - F.coalesce(f"__{c}", F.lit(0))).otherwise(F.col(c)).alias(c) for c in counters]
    return joined.select(*keys, *grown)

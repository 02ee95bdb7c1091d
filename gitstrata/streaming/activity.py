"""Weekly and daily counts over a stream of events, late ones included up to the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_counts(events: DataFrame, width: str = "7 days", late: str = "1 day", key: str = "event_type") -> DataFrame:
    """start, key, n: for a stream of rows with ts (timestamp) and ``key``, counts by window, emitted once no more
    rows can fall into it. The same on a table, where the watermark has no effect."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), key, "n")


def latest_snapshots(snapshots: DataFrame, late: str = "1 day") -> DataFrame:
    """Each session's snapshots once, however often they arrive within the watermark."""
    return snapshots.withWatermark("snapshot_ts", late).dropDuplicatesWithinWatermark(["session_id", "snapshot_ts"])

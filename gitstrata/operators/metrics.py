"""Usage over time. The clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def weekly_pair(events: DataFrame, now: Column) -> DataFrame:
    """total, this_week ([now - 7 d, ...)), previous_week ([now - 14 d, now - 7 d)). now: one value."""
    week = F.expr("interval 7 days")
    recent = F.col("ts") >= now - week
    return events.agg(F.count("*").alias("total"), F.count_if(recent).alias("this_week"), F.count_if(~recent & (F.col("ts") >= now - week - week)).alias("previous_week"))


def daily(events: DataFrame, last: DataFrame, days: int = 30) -> DataFrame:
    """day, n of the ``days`` days up to the one in ``last`` (one row, column now); days without events have 0."""
    end = F.to_date("now")
    every = last.select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    n = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return every.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def usage(events: DataFrame) -> DataFrame:
    """event_type, users, events, refreshes (events after a user's first), last."""
    per = events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return per.groupBy("event_type").agg(F.count("*").alias("users"), F.sum("n").alias("events"), F.sum(F.greatest(F.lit(0), F.col("n") - 1)).alias("refreshes"), F.max("last").alias("last"))


def top_users(events: DataFrame, limit: int = 8) -> DataFrame:
    return events.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(limit)


def rolling_percentiles(events: DataFrame, window: int = 200) -> DataFrame:
    """event_type, size, p50, p95, max of each type's last ``window`` values; the value at floor(p / 100 * n)."""
    last = events.withColumn("_r", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))).filter(F.col("_r") <= window)
    a = F.sort_array(F.collect_list("value"))
    out = last.groupBy("event_type").agg(a.alias("_v"))
    at = lambda p: F.get("_v", F.least(F.size("_v") - 1, F.floor(F.lit(p) * F.size("_v") / 100)).cast("int"))
    return out.select("event_type", F.size("_v").cast("long").alias("size"), at(50).alias("p50"), at(95).alias("p95"), F.array_max("_v").alias("max"))


def watch_assessment(delta: DataFrame) -> DataFrame:
    """Adds alert to rows of verdict changes: critical, regression, drift or none. delta: direction, critical_delta,
    score_delta, grade_changed, departments_changed, drifting."""
    worse = F.col("direction") == "regressed"
    big = F.col("grade_changed") | (F.col("departments_changed") > 0) | (F.col("score_delta") <= -3)
    alert = F.when(worse & (F.col("critical_delta") > 0), "critical").when(worse & big, "regression").when(F.col("drifting") > 0, "drift").otherwise("none")
    return delta.withColumn("alert", alert)

"""Snapshots of relations over time, as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def append(relation: DataFrame, path: str, session_id: str, snapshot_ts: str) -> None:
    """Adds a relation's rows as one snapshot; a rerun with the same keys replaces that snapshot only."""
    rows = relation.withColumn("session_id", F.lit(session_id)).withColumn("snapshot_ts", F.lit(snapshot_ts))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id", "snapshot_ts").parquet(path)


def read(spark: SparkSession, path: str, session_id: str | None = None, snapshot_ts: str | None = None) -> DataFrame:
    """Filters on the two keys reach the folder listing."""
    out = spark.read.parquet(path)
    if session_id is not None:
        out = out.filter(F.col("session_id") == session_id)
    return out if snapshot_ts is None else out.filter(F.col("snapshot_ts") == snapshot_ts)


def latest(verdicts: DataFrame) -> DataFrame:
    """One row for each session, the one of its last snapshot; ``n`` counts its snapshots."""
    w = W.partitionBy("session_id").orderBy(F.desc("snapshot_ts"))
    n = F.count("*").over(W.partitionBy("session_id"))
    return verdicts.withColumn("n", n).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")

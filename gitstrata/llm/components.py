"""Connected components of an undirected graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gitstrata.llm import store


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join's two sides are plain shuffles and a vertex with many edges can be split
    least = store.written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "large")
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """After a large-star round no vertex has many smaller neighbours, so the join isn't skewed."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex u has one edge, to a vertex that has none of its own."""
    two = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
    chained = edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi")
    return two.unionByName(chained).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns (vertex, component) for the vertices of edges with u <> v, the component
    being its smallest vertex. Each round is written to the shared folder; nothing is gathered, and a
    vertex with many edges meets its minimum in a join that Spark can split. Null vertices are ignored."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v and u is not null and v is not null")
    at = store.written(down.distinct(), "edges")
    while not _stars(at):
        at = store.written(_small(store.written(_large(at), "star")), "edges")
    return at.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(at.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())

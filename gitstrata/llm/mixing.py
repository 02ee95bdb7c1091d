"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Nulls and edges: a null source is a source of its own, ordered last; a null or empty text has size 0
and gives no words; an empty table gives an empty result; rows with the same doc_id in a source are
taken alike. Columns named as those added here are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gitstrata.llm import store, text as T


def draw(seed: str) -> Column:
    """A document's place in its source's seeded order: the md5 of seed and id."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def ranked(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Adds ``weight`` by code-point order of the source, null last. The order is found in parts: a sort by
    range, ranks inside each part, and each part's offset; no task sees all sources."""
    cycle = F.array(*map(F.lit, weights))
    parts = store.written(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "sources")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each part of the sort
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    rank = F.col("_before") + F.col("_inside")
    return parts.withColumn("_inside", inside).join(before, "_part").withColumn("weight", F.get(cycle, (rank % len(weights)).cast("int"))).drop("_part", "_inside", "_before")


def water_fill(sources: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """sources: source, source_size, weight. Adds ``target``: the total, ``share`` times all sizes, by weight;
    sources above ``max_epochs`` times their size stop there and the excess goes to the others by weight,
    until none is above. Each round sends two sums to the driver."""
    state = sources.withColumn("_capped", F.lit(False))
    total = (state.agg(F.sum("source_size")).head()[0] or 0) * float(share)
    cap = F.col("source_size") * float(max_epochs)
    was = -1
    while True:
        row = state.agg(F.sum(F.when(F.col("_capped"), cap)), F.sum(F.when(~F.col("_capped"), F.col("weight"))), F.count_if("_capped")).head()
        rest, open_weight = total - (row[0] or 0.0), row[1] or 0
        even = F.when(F.col("_capped"), cap).otherwise(F.lit(rest) * F.col("weight") / F.lit(float(open_weight or 1)))
        if row[2] == was:
            return state.withColumn("target", even).drop("_capped")
        was = row[2]
        state = state.withColumn("_capped", F.col("_capped") | (even > cap))


def source_plan(docs: DataFrame, weights: Sequence[int], share: float, max_epochs: int, seed: str, width: int) -> DataFrame:
    """One row for each source: source, source_size, target, _whole repetitions of every document, and _last,
    the last place in the seeded order that is repeated once more.

    Sizes are summed for each source and each of 16**width slices of the seeded order, so the slice in
    which the extra words run out is found without gathering a source; only that slice is sorted.
    """
    sized = docs.select("source", draw(seed).alias("_draw"), T.n_words(F.col("text")).alias("size"))
    slices = store.written(sized.groupBy("source", F.left("_draw", F.lit(width)).alias("_slice")).agg(F.sum("size").alias("size")), "slices")
    sources = ranked(slices.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    plan = water_fill(sources, share, max_epochs)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("_whole", F.floor(times)).withColumn("_extra", F.col("target") - F.col("_whole") * F.col("source_size"))
    plan = store.written(plan, "plan")
    upto = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = (
        slices.withColumn("_upto", upto).join(plan.select(F.col("source").alias("_s"), "_extra"), F.col("source").eqNullSafe(F.col("_s")))
        .filter((F.col("_upto") < F.col("_extra")) & (F.col("_upto") + F.col("size") > F.col("_extra")))
        .select(F.col("_s").alias("_es"), F.col("_slice").alias("_edge"), "_upto", "_extra")
    )
    edge = store.written(edge, "edge")
    inside = docs.select("source", draw(seed).alias("_draw"), "text").join(edge, F.col("source").eqNullSafe(F.col("_es")) & (F.left("_draw", F.lit(width)) == F.col("_edge")))
    inside = inside.groupBy(F.col("_es").alias("source"), "_edge", "_draw").agg(F.sum(T.n_words(F.col("text"))).alias("size"), F.first("_upto").alias("_upto"), F.first("_extra").alias("_extra"))
    upto = F.col("_upto") + F.sum("size").over(W.partitionBy("source", "_edge").orderBy("_draw"))
    cut = (
        inside.withColumn("_taken", upto - F.col("size") / 2 <= F.col("_extra"))
        .groupBy(F.col("source").alias("_cs"), "_edge").agg(F.max(F.when(F.col("_taken"), F.col("_draw"))).alias("_cut"))
    )
    # without an edge slice a source's extra words end between slices, or it has none
    full = slices.withColumn("_upto", F.sum("size").over(W.partitionBy("source").orderBy("_slice")))
    full = (
        full.join(plan.select(F.col("source").alias("_s"), "_extra"), F.col("source").eqNullSafe(F.col("_s")))
        .filter(F.col("_upto") <= F.col("_extra")).groupBy(F.col("_s").alias("_fs")).agg(F.max("_slice").alias("_full"))
    )
    out = plan.join(cut, F.col("source").eqNullSafe(F.col("_cs")), "left").join(full, F.col("source").eqNullSafe(F.col("_fs")), "left")
    last = F.greatest(F.col("_cut"), F.concat(F.col("_full"), F.lit("g")))  # "g" sorts after all hex digits
    return out.select("source", "source_size", "target", "_whole", F.when(F.col("_extra") > 0, last).alias("_last"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix", width: int = 3) -> DataFrame:
    """All columns of ``docs`` and size, source_size (long), target (double), repeats (int), taken (long).

    Sizes count words. Every document of a source is taken floor(target / source_size) times, and the
    first ones in a seeded order once more, until the words that are left for the source run out (to the
    nearest document), so that a source's words come within half a document of its target.
    """
    plan = store.written(source_plan(docs, weights, share, max_epochs, seed, width), "mix").withColumnRenamed("source", "_ms")
    docs = docs.drop("source_size", "target")
    out = docs.join(plan, F.col("source").eqNullSafe(F.col("_ms")))
    more = F.coalesce(draw(seed) <= F.col("_last"), F.lit(False)).cast("int")
    out = out.withColumn("size", T.n_words(F.col("text"))).withColumn("repeats", (F.col("_whole") + more).cast("int"))
    return out.withColumn("taken", F.col("size") * F.col("repeats")).drop("_ms", "_whole", "_last")


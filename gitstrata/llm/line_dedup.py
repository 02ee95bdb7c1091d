"""Line dedup: levelled sorted runs of line hashes.

Documents come in batches, the largest doc_ids first. A batch is reduced to one row for each line key:
how many of its documents hold the key, and the largest of them. That table is merge-joined with the
runs so far: keys without a partner (the anti-join) are new, and the batch's largest document becomes
their keeper; keys with one only raise the count. The result is written as a run of its own, bucketed
and sorted by hash, so later merges read runs side by side without a shuffle. When a level holds
``fan_in`` runs they are merged into one run of the next level.

Nulls and edges: a null text is one empty line; a null doc_id is smaller than any other; rows that share
a doc_id count as one document and each lose or keep their lines alike; within a document a line may
repeat. Lines may be of any length: they are compared by 128 bits of hash. An empty table gives an empty
result. Columns named as those added here are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gitstrata.llm import store, text as T

KEY = ["_h1", "_h2"]
RUN = "_h1 bigint, _h2 bigint, n_docs bigint, keeper bigint"
LEAST = -(2**63)


def line_key(line: Column) -> Column:
    return T.ascii_lower(T.strip(line))


def hashed_keys(text: Column, min_chars: int) -> Column:
    """For each line, in order: the two hashes of its key, null where the key is too short."""

    def one(line: Column) -> Column:
        def hashed(k: Column) -> Column:
            a, b = T.hash128(k)
            return F.when(F.char_length(k) >= min_chars, F.struct(a.alias("_h1"), b.alias("_h2")))

        return T.let(line_key(line), hashed)

    return F.transform(T.lines(text), one)


def row_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))


def document_keys(docs: DataFrame, min_chars: int, repeated: DataFrame | None = None) -> DataFrame:
    """(_id, _h1, _h2), each key of a row once; of rows that share a doc_id of ``repeated``, each key once for all."""
    keys = F.array_distinct(F.filter(hashed_keys(F.col("text"), min_chars), lambda k: k.isNotNull()))
    rows = docs.select(row_id().alias("_id"), F.explode(keys).alias("_k")).select("_id", "_k._h1", "_k._h2")
    if repeated is None:
        return rows
    return rows.join(repeated, "_id", "left_anti").unionByName(rows.join(repeated, "_id", "left_semi").distinct())


def repeated_ids(docs: DataFrame) -> DataFrame | None:
    """_id of the rows that share a doc_id, as a written table; None where all differ, as they mostly do."""
    out = store.written(docs.groupBy(row_id().alias("_id")).agg(F.count("*").alias("n")).filter("n > 1").select("_id"), "repeated")
    return None if out.isEmpty() else out


@dataclass
class LineRuns:
    """The levels of runs. ``buckets`` is fixed at the start, as all runs share it."""

    spark: SparkSession
    fan_in: int = 2
    buckets: int = 0
    levels: list[list[str]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, run: DataFrame) -> str:
        path = store.new_path(self.spark, "run")
        name = "run_" + path.rsplit("-", 1)[1]
        run.write.option("path", path).format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        self.names.append(name)
        return name

    def _merge(self, names: list[str]) -> DataFrame:
        """Runs side by side: a full outer merge join, which needs no shuffle as the runs share their buckets."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            a, b = out.alias("a"), self.spark.table(name).alias("b")
            out = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEY], "full_outer").select(
                *(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in KEY),
                (F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))).alias("n_docs"),
                F.greatest("a.keeper", "b.keeper").alias("keeper"),
            )
        return out

    def add(self, batch: DataFrame) -> None:
        """batch: RUN's columns, each key once, of documents below those of all earlier batches."""
        old = [n for level in self.levels for n in level]
        if old:
            for i, name in enumerate(old):
                batch = batch.join(self.spark.table(name).select(*KEY, F.lit(True).alias(f"_old{i}")), KEY, "left")
            new = F.expr(" and ".join(f"_old{i} is null" for i in range(len(old))))
            batch = batch.select(*KEY, "n_docs", F.when(new, F.col("keeper")).alias("keeper"))
        self.levels = self.levels or [[]]
        self.levels[0].append(self._write(batch))
        self._compact()

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fan_in:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self._merge(self.levels[k])))
                for name in self.levels[k]:
                    self._drop(name)
                self.levels[k] = []

    def all(self) -> DataFrame:
        names = [n for level in self.levels for n in level]
        return self._merge(names) if names else self.spark.createDataFrame([], RUN)

    def _drop(self, name: str) -> None:
        path = self.spark.table(name).inputFiles()
        self.spark.sql(f"DROP TABLE {name}")
        self.names.remove(name)
        for p in {f.rsplit("/", 1)[0] for f in path}:
            store.delete(self.spark, p)

    def close(self) -> None:
        for name in list(self.names):
            self._drop(name)


def frequent_lines(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fan_in: int) -> DataFrame:
    """RUN's columns for the keys that at least ``min_docs`` documents hold, as a written table."""
    spark, ids, repeated = docs.sparkSession, row_id(), repeated_ids(docs)
    cuts = docs.select(F.percentile_approx(ids, [i / batches for i in range(1, batches)], 1000).alias("c")).head()["c"] or []
    edges = [None, *sorted(set(cuts)), None]
    runs = LineRuns(spark, fan_in)
    for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
        part = docs.filter((ids > low if low is not None else F.lit(True)) & (ids <= high if high is not None else F.lit(True)))
        runs.add(document_keys(part, min_chars, repeated).groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("_id").alias("keeper")))
    out = store.written(runs.all().filter(F.col("n_docs") >= min_docs), "frequent")
    runs.close()
    return out


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3, fan_in: int = 2) -> DataFrame:
    """All columns of ``docs`` and n_lines, n_dropped (long), kept_text.

    A line's key is the line stripped of white space and lower-cased (A-Z). Keys of ``min_chars`` code
    points or more that at least ``min_docs`` documents hold lose all their lines except in the largest
    doc_id holding them. Only hashes and ids are shuffled for the decision; the texts move once, to meet
    the list of what each document loses.
    """
    frequent = frequent_lines(docs, min_chars, min_docs, batches, fan_in)
    lost = (
        document_keys(docs, min_chars).join(frequent.select(*KEY, "keeper"), KEY).filter("_id < keeper")
        .groupBy("_id").agg(F.collect_set("_h1").alias("_lost"))
        .select(F.col("_id").alias("_lost_id"), "_lost")
    )
    met = docs.join(lost, row_id() == F.col("_lost_id"), "left")

    def stays(line: Column) -> Column:
        return T.let(line_key(line), lambda k: (F.char_length(k) < min_chars) | ~F.array_contains(F.col("_lost"), F.xxhash64(k)))

    every = T.lines(F.col("text"))
    kept = F.when(F.col("_lost").isNull(), every).otherwise(F.filter(every, stays))
    out = met.withColumn("n_lines", F.size(every).cast("long")).withColumn("_kept", kept)
    return (
        out.withColumn("n_dropped", F.col("n_lines") - F.size("_kept")).withColumn("kept_text", F.array_join("_kept", "\n"))
        .drop("_lost", "_lost_id", "_kept")
    )

"""Files to facts: texts are dealt over the tasks of a session and read one by one."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

#: Files whose facts are held at once, and how many a task reads at most, about, however many there are.
FILES_AT_ONCE = 1000
FILES_A_TASK = 20_000
TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def dealt(files: DataFrame, *keys: str) -> DataFrame:
    """The rows over all tasks by their keys, over more the more rows there are, so the longest task grows no longer. A table of many short
    texts is a small file, and what is read from one split stays one task. Rows are counted by their keys; their texts aren't read for that."""
    spark = files.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-files.select(*keys).count() // FILES_A_TASK))
    return files.repartition(n, *keys)


def read(files: DataFrame, facts: Callable[[str, str | None], list[dict]], schema: str) -> DataFrame:
    """files: path, content. A row of ``schema`` for each fact of each file; what a fact doesn't tell is null."""
    cells = [pa.field(c.split()[0], TYPES[c.split()[1]]) for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, FILES_AT_ONCE):
                part = b.slice(at, FILES_AT_ONCE)
                rows = [r for path, content in zip(part.column("path").to_pylist(), part.column("content").to_pylist()) for r in facts(path, content)]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in cells], schema=pa.schema(cells))

    return dealt(files.select("path", "content"), "path").mapInArrow(run, schema)


# tasks get this code with their closures, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

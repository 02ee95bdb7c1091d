"""Intermediate tables in the folder that the cluster's machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of some short columns that are broadcast at most.
LOOKUP = 20_000

_mine: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, local sessions get a folder of their own; on a cluster
    that is an error, as executors and driver share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if base:
        return base
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gitstrata-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    if app not in _mine:
        _mine[app] = f"{shared_dir(spark).rstrip('/')}/gitstrata-{app}"
        atexit.register(_sweep, spark, app)
    return f"{_mine[app]}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str = "table", *by: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: the lineage ends there, and the
    size of what was written is known to the planner. What asks for some values of ``by`` reads only their rows."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.select(*df.columns) if by else out


def growing(df: DataFrame) -> DataFrame:
    """``df``, of which joins are sorted and merged: rows that grow with the input, in a file so well compressed that its size would
    have them broadcast through the driver."""
    return df.hint("merge")


def large(df: DataFrame, name: str = "table", *by: str) -> DataFrame:
    """As ``written``, for what grows with the input."""
    return growing(written(df, name, *by))


def lookup(df: DataFrame, name: str = "table") -> DataFrame:
    """As ``large``, but broadcast if its rows, counted, are at most LOOKUP."""
    out = written(df, name)
    return F.broadcast(out) if out.count() <= LOOKUP else growing(out)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once nothing reads them any more."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            delete(t.sparkSession, path)


def _sweep(spark: SparkSession, app: str) -> None:
    try:
        delete(spark, _mine[app])
    except Exception:  # the session has ended; the folder is the cluster's to clean
        pass

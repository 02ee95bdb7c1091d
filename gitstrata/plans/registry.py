"""The queries over the driver's tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gitstrata.sources.testdata import Relations, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def once(f: Callable) -> Callable:
    """Makes what ``f`` derives from a folder of tables once in a session, for all queries that build on it."""
    made: dict[tuple[str, str], object] = {}

    def get(r: Relations):
        key = (r.spark.sparkContext.applicationId, r.sf_dir)
        if key not in made:
            made[key] = f(r)
        return made[key]

    return get


def query(sql: str | None = None):
    """Registers a function of Relations under its name."""

    def add(f: Callable[[Relations], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_relations(sql)
        return f

    return add

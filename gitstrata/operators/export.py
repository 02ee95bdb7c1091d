"""Class diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gitstrata.functions import exprs as E


def scope_options(classes: DataFrame, limit: int = 25) -> DataFrame:
    """folder and number of classes below it, for every folder above a class."""
    dirs = F.split(E.module_path(F.col("file")), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(dirs)), lambda n: F.array_join(F.slice(dirs, F.lit(1), n), "/"))
    out = classes.filter(F.col("file").contains("/")).select(F.explode(up).alias("folder")).groupBy("folder").agg(F.count("*").alias("classes"))
    return out.orderBy(F.desc("classes"), "folder").limit(limit)


def class_diagram(classes: DataFrame, scope: str = "", max_classes: int = 250) -> DataFrame:
    """kind, place, line: the lines of a Mermaid class diagram. classes: file, name, start_row, members array, parent,
    implements array. The diagram is the lines in the order of (kind, place, line); it is bounded by ``max_classes``."""
    chosen = classes.filter(F.col("file").startswith(scope)).orderBy("file", "start_row", "name").limit(max_classes)
    body = F.concat(F.lit("  class "), "name", F.lit(" {\n"), F.array_join(F.transform("members", lambda m: F.concat(F.lit("    +"), m)), "\n"), F.lit("\n  }"))
    boxes = chosen.select(F.lit(1).alias("kind"), "file", body.alias("line"))
    parents = chosen.filter("parent is not null").select(F.lit(2).alias("kind"), "file", F.concat(F.lit("  "), "parent", F.lit(" <|-- "), "name").alias("line"))
    contracts = chosen.select("file", "name", F.explode("implements").alias("i")).select(F.lit(3).alias("kind"), "file", F.concat(F.lit("  "), "i", F.lit(" <|.. "), "name").alias("line"))
    return boxes.unionByName(parents).unionByName(contracts)

"""Entry points that frameworks call: routes declared by decorators, by routing tables and by routers.

A routing table names a handler that lies elsewhere. Which one it means is narrowed down in steps that can only remove
candidates; where more than one is left, none is taken. A table that names a class means the methods that the framework
calls on it, its own or those of the nearest ancestors that have any. Candidates are counted and ordered under
every key they are asked by, so a name that many files define is never paired with all tables that use it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gitstrata import shared
from gitstrata.functions import exprs as E

#: The methods that web frameworks call on registered classes, and how far up their ancestors are searched.
CALLED_METHODS = (
    "get", "post", "put", "patch", "delete", "head", "options", "trace", "dispatch",
    "list", "create", "retrieve", "update", "partial_update", "destroy",
)
MAX_HOPS = 6


def narrowed(rows: DataFrame, definitions: DataFrame, bound: DataFrame) -> DataFrame:
    """rows: file, target_module, target_name and more. Adds ``at`` (file, name, container, start_row), the one definition that each means;
    rows without a candidate or with several are left out.

    definitions: file, name, container, start_row. bound: file, symbol, origin (what a file's imports bind). Of the
    definitions of the name: those in a file called as the module says, else those in the file that the module is
    an alias of; a bare name that several files define is the one that its import names; then those in the same directory."""
    d = definitions.select(F.struct("file", "name", "container", "start_row").alias("at"), F.col("name").alias("target_name"), F.col("file").alias("_file"), E.module_of(F.col("file")).alias("target_module"), E.module_path(F.col("file")).alias("_dir"))
    d = shared.large(d, "definitions")

    def asked(t: DataFrame, keys: list[str], name: str) -> DataFrame:
        found = d.groupBy(*keys).agg(F.struct(F.count("*").alias("n"), (F.min("_file") != F.max("_file")).alias("several"), F.min("at").alias("at")).alias(name))
        return t.join(found, keys, "left")

    t = rows.withColumn("_dir", E.module_path(F.col("file"))).withColumn("_by", F.coalesce("target_module", "target_name"))
    t = t.join(bound.select("file", F.col("symbol").alias("_by"), F.col("origin").alias("_file")), ["file", "_by"], "left")
    t = asked(t, ["target_name"], "_all")
    t = asked(t, ["target_name", "target_module"], "_mod")
    t = asked(t, ["target_name", "_file"], "_own")
    t = asked(t, ["target_name", "_dir"], "_near")
    t = asked(t, ["target_name", "target_module", "_dir"], "_modnear")
    by_module, c = F.col("target_module").isNotNull() & F.col("_mod").isNotNull(), F.col
    first = F.when(by_module, c("_mod")).when((c("target_module").isNotNull() | c("_all.several")) & c("_own").isNotNull(), c("_own")).otherwise(c("_all"))
    t = t.withColumn("_set", first)
    near = F.when(c("_set.several"), F.coalesce(F.when(by_module, c("_modnear")).otherwise(c("_near")), c("_set"))).otherwise(c("_set"))
    t = t.withColumn("_set", near).filter("_set.n = 1").withColumn("at", F.col("_set.at"))
    return t.select(*rows.columns, "at")


def called_methods(starts: DataFrame, classes: DataFrame, methods: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """For each class of ``starts`` (s_file, s_name) the methods that a framework calls: s_file, s_name, file, name, container, start_row.

    classes: file, name, start_row, bases. methods: file, name, container, start_row. The first level of ancestors
    that has such methods gives them, all bases of a level at once; a base is followed where one class of that name exists."""
    methods = methods.filter(F.col("name").isin(*CALLED_METHODS) & F.col("container").isNotNull())
    methods = shared.large(methods.select("file", F.col("container").alias("cls"), F.struct("file", "name", "container", "start_row").alias("m")), "methods")
    alone = classes.groupBy(F.col("name").alias("base")).agg(F.count("*").alias("n"), F.min("file").alias("base_file")).filter("n = 1").select("base", "base_file")
    own = classes.groupBy("file", F.col("name").alias("cls")).agg(F.min_by("bases", "start_row").alias("bases"))
    up = shared.large(own.select("file", "cls", F.explode("bases").alias("base")).join(alone, "base").select("file", "cls", "base_file", "base").distinct(), "bases")
    front = shared.large(starts.select("s_file", "s_name", F.col("s_file").alias("file"), F.col("s_name").alias("cls")).distinct(), "starts")
    seen, found = front, None
    for _ in range(hops):
        hit = shared.large(front.join(methods, ["file", "cls"]).select("s_file", "s_name", "m").distinct(), "hit")
        found = hit if found is None else found.unionByName(hit)
        open_ = front.join(hit.select("s_file", "s_name").distinct(), ["s_file", "s_name"], "left_anti")
        then = open_.join(up, ["file", "cls"]).select("s_file", "s_name", F.col("base_file").alias("file"), F.col("base").alias("cls")).distinct()
        front = shared.large(then.join(seen, ["s_file", "s_name", "file", "cls"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return found.select("s_file", "s_name", "m.*")


def declared_routes(parsed: DataFrame, functions: DataFrame, bound: DataFrame) -> DataFrame:
    """file, name, container, start_row, route, via of handlers: as their own decorators declare, else as tables and routers do; of several
    routes the smallest. parsed: facts; functions: file, name, container, start_row; bound: what imports bind."""
    key = ["file", "name", "container", "start_row"]
    least: list[Column] = [F.min(F.struct("route", "via")).alias("x")]
    rows = parsed.filter("kind = 'route'").select("file", F.col("row").alias("start_row"), "name", "container", "form", F.col("target").alias("route"), F.col("literal").alias("via"), F.col("receiver").alias("target_module"), F.coalesce("has_receiver", F.lit(False)).alias("is_class"))
    own = rows.filter("form = 'decorator'").groupBy(*key).agg(*least).select(*key, "x.*")
    tables = rows.filter("form = 'table'").select("file", "route", "via", "target_module", F.col("name").alias("target_name"), "is_class")
    to_functions = narrowed(tables.filter("not is_class"), functions.select(*key), bound).select("at.*", "route", "via")
    classes = shared.large(parsed.filter("kind = 'class'").select("file", "name", F.lit(None).cast("string").alias("container"), F.col("row").alias("start_row"), F.col("items").alias("bases")), "classes")
    to_classes = shared.large(narrowed(tables.filter("is_class"), classes.select(*key), bound).select(F.col("at.file").alias("s_file"), F.col("at.name").alias("s_name"), "route", "via"), "viewed")
    called = called_methods(to_classes, classes, functions.select(*key)).join(to_classes, ["s_file", "s_name"]).select(*key, "route", "via")
    claimed = to_functions.unionByName(called).groupBy(*key).agg(*least).select(*key, "x.*")
    return own.unionByName(claimed.join(own.select("file", "start_row"), ["file", "start_row"], "left_anti"))

"""Entry points, flows, reachability of sinks, and taint across functions. Functions are known by (file, name)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window as W, functions as F

from gitstrata.functions import exprs as E
from gitstrata.shared import large, written
from gitstrata.operators.traverse import FOLD

NODE = "concat_ws('|', {0}file, {0}name)"


def flow_edges(calls: DataFrame) -> DataFrame:
    rows = calls.filter("from_fn is not null and to_fn is not null").filter(~E.is_test_file(F.col("from_file")) & ~E.is_test_file(F.col("to_file")))
    return rows.selectExpr("concat_ws('|', from_file, from_fn) src", "concat_ws('|', to_file, to_fn) dst").filter("src <> dst").distinct()


def entry_points(calls: DataFrame, declared: DataFrame | None = None, min_fan_out: int = 3, limit: int | None = 40, edges: DataFrame | None = None) -> DataFrame:
    """file, name, fan_out, fan_in, kind, score of functions that something outside may start. edges: those of the calls, if at hand."""
    edges = flow_edges(calls) if edges is None else edges
    outs, ins = edges.groupBy("src").agg(F.count("*").alias("fan_out")), edges.groupBy("dst").agg(F.count("*").alias("fan_in"))
    rows = outs.join(ins, F.col("src") == F.col("dst"), "left").select(F.col("src").alias("id"), "fan_out", F.coalesce("fan_in", F.lit(0)).alias("fan_in"))
    rows = rows.withColumn("file", F.substring_index("id", "|", 1)).withColumn("name", F.substring_index("id", "|", -1))
    known = declared.select("file", "name").distinct().withColumn("_d", F.lit(True)) if declared is not None else None
    rows = rows.join(known, ["file", "name"], "left").fillna(False, ["_d"]) if known is not None else rows.withColumn("_d", F.lit(False))
    route, root = F.col("_d") | E.looks_like_entry_point(F.col("file"), F.col("name")), F.col("fan_in") == 0
    rows = rows.filter(route | root | (F.col("fan_out") >= min_fan_out))
    score = F.when(F.col("_d"), 2000).otherwise(0) + F.when(route, 1000).otherwise(0) + F.when(root, 100).otherwise(0) + F.least(F.col("fan_out"), F.lit(50))
    kind = F.when(route, "route-like").when(root, "root").otherwise("orchestrator")
    out = rows.select("file", "name", "fan_out", "fan_in", kind.alias("kind"), score.alias("score"))
    return out.orderBy(F.desc("score"), "file", "name").limit(limit) if limit else out


def flow_trace(calls: DataFrame, roots: DataFrame, depth: int = 4, children: int = 5, max_nodes: int = 14) -> DataFrame:
    """root, node, parent, hop, elided: a tree from each root, breadth first, a node's children by (name, file).

    Each level keeps ``children`` of a node's new callees and tells how many it left out; the tree keeps its
    first ``max_nodes`` by (hop, parent's place, child's place)."""
    edges = written(flow_edges(calls).withColumn("_name", F.substring_index("dst", "|", -1)), "edges")
    seen = written(roots.select("root", F.col("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("hop"), F.lit("").alias("path"), F.lit(0).cast("long").alias("elided")))
    front = seen
    for hop in range(1, depth + 1):
        step = front.select("root", F.col("node").alias("src"), "path").join(edges, "src").join(seen.select("root", F.col("node").alias("dst")), ["root", "dst"], "left_anti")
        # a node that several parents reach belongs to the first of them
        step = step.withColumn("_first", F.row_number().over(W.partitionBy("root", "dst").orderBy("path", "src"))).filter("_first = 1")
        of = W.partitionBy("root", "src")
        step = step.withColumn("_p", F.row_number().over(of.orderBy("_name", "dst"))).withColumn("elided", F.greatest(F.lit(0), F.count("*").over(of) - children))
        step = step.filter(F.col("_p") <= children)
        front = written(step.select("root", F.col("dst").alias("node"), F.col("src").alias("parent"), F.lit(hop).alias("hop"), F.concat("path", F.lpad(F.col("_p").cast("string"), 3, "0")).alias("path"), "elided"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    place = F.row_number().over(W.partitionBy("root").orderBy("hop", "path"))
    return seen.withColumn("place", place).filter(F.col("place") <= max_nodes).select("root", "node", "parent", "hop", "elided", "place")


def reachable_functions(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """node, origin, parent, hop: what the entries (column id) reach along ``edges`` (src, dst), each by the shortest way,
    ties to the smallest origin and then parent; until nothing new is found."""
    seen = written(entries.select(F.col("id").alias("node"), F.col("id").alias("origin"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("hop")).distinct())
    front = seen
    for hop in itertools.count(1):
        step = front.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("origin", F.col("src").alias("parent"))).alias("x"))
        front = written(step.join(seen, "node", "left_anti").select("node", "x.origin", "x.parent", F.lit(hop).alias("hop")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if hop % FOLD == 0:
            seen = written(seen)
    return seen


def classify_sinks(sinks: DataFrame, functions: DataFrame, calls: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """sinks: file, rule, severity, line, in_fn, origin, tainted. Adds reachability: reachable, unknown, module-scope or
    unreachable. Sinks in tests and in code that isn't run in production are left out."""
    sinks = sinks.filter(~E.is_test_file(F.col("file")) & ~E.is_non_production(F.col("file")))
    edges = written(flow_edges(calls), "edges")
    routes = entry_points(calls, declared, limit=None, edges=edges).filter("kind = 'route-like'").selectExpr(f"{NODE.format('')} id")
    if declared is not None:
        routes = routes.unionByName(declared.selectExpr(f"{NODE.format('')} id")).distinct()
    routes = written(routes)
    some = not routes.isEmpty()
    reach = reachable_functions(edges, routes).select(F.col("node").alias("id"), "hop", "origin")
    called = edges.select(F.col("dst").alias("id")).distinct().withColumn("_called", F.lit(True))
    known = functions.selectExpr(f"{NODE.format('')} id").distinct().withColumn("_known", F.lit(True))
    rows = sinks.withColumn("id", F.expr("concat_ws('|', file, in_fn)")).join(reach, "id", "left").join(called, "id", "left").join(known, "id", "left")
    kind = (
        F.when(F.col("origin_kind") == "template", "unknown").when(F.col("in_fn").isNull(), "module-scope").when(F.col("hop").isNotNull(), "reachable")
        .when(F.lit(some) & F.col("_known") & F.col("_called").isNull(), "unreachable").otherwise("unknown")
    )
    return rows.withColumn("reachability", kind).select("file", "rule", "severity", "line", "in_fn", "tainted", "reachability", "hop")


def taint(functions: DataFrame, arguments: DataFrame, sinks: DataFrame, max_hops: int = 6) -> DataFrame:
    """Sinks that wait for a parameter (file, in_fn, param, rule, line) and are proven tainted: adds source and hops.

    functions: file, name, params array, entry_point boolean. arguments, one row for each argument of a call:
    from_file, from_fn, to_file, to_fn, index, arg_name, source, param. Seeds are parameters of entry points
    other than ``request`` and arguments with a source; an argument made of a parameter carries it on."""
    fn = functions.filter(~E.is_test_file(F.col("file"))).selectExpr(f"{NODE.format('')} id", "params", "entry_point", "name")
    seeds = fn.filter("entry_point").select("id", F.explode("params").alias("param"), F.lit(1).alias("hops"), "name").filter("param <> 'request'")
    seeds = seeds.select("id", "param", "hops", F.concat("name", F.lit(" ("), "param", F.lit(")")).alias("source"))
    args = arguments.filter(~E.is_test_file(F.col("from_file"))).selectExpr("*", "concat_ws('|', from_file, from_fn) src", "concat_ws('|', to_file, to_fn) dst")
    args = args.join(functions.selectExpr(f"{NODE.format('')} dst", "params").dropDuplicates(["dst"]), "dst")
    lands = F.when(F.col("arg_name").isNull(), F.get("params", F.col("index"))).when(F.array_contains("params", F.col("arg_name")), F.col("arg_name"))
    args = large(args.withColumn("lands", lands).filter("lands is not null").selectExpr("src", "dst", "lands", "source as arg_source", "param as arg_param"))
    first = args.filter("arg_source is not null").select(F.col("dst").alias("id"), F.col("lands").alias("param"), F.lit(2).alias("hops"), F.col("arg_source").alias("source"))
    best = lambda t: t.groupBy("id", "param").agg(F.min(F.struct("hops", "source")).alias("x")).select("id", "param", "x.hops", "x.source")
    seen = large(best(seeds.unionByName(first)))
    front = seen
    for _ in range(max_hops):
        step = front.filter(F.col("hops") < max_hops).join(args.filter("arg_param is not null"), (F.col("id") == F.col("src")) & (F.col("param") == F.col("arg_param")))
        step = step.select(F.col("dst").alias("id"), F.col("lands").alias("param"), (F.col("hops") + 1).alias("hops"), "source")
        front = large(best(step).join(seen, ["id", "param"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return sinks.filter(~E.is_test_file(F.col("file"))).withColumn("id", F.expr("concat_ws('|', file, in_fn)")).join(seen, ["id", "param"]).drop("id")

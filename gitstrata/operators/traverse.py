"""Bounded traversal of graphs of files and functions.

Edges are written once, before the first hop. One frontier join a hop for all seeds at once, with the
visited set anti-joined; each hop is written as a table of its own, so lineages stay short and the planner
knows its size. Node caps keep the nearest by (hop, id).
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window as W, functions as F

from gitstrata.functions import exprs as E
from gitstrata.shared import written

#: After so many rounds the tables gathered so far are written as one, so that plans stay short.
FOLD = 32


def reach(edges: DataFrame, seeds: DataFrame, max_hops: int = 3, max_nodes: int | None = None, prepared: bool = False) -> DataFrame:
    """edges: src, dst; seeds: seed. Returns seed, node, hop (1 to ``max_hops``): what each seed reaches, by the
    shortest way, itself left out; of more than ``max_nodes`` the nearest. prepared: the edges are distinct and written already."""
    edges = edges if prepared else written(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    seen = written(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")).distinct())
    front = seen
    for hop in range(1, max_hops + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        front = written(step.join(seen, ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    out = seen.filter("hop > 0")
    if max_nodes is None:
        return out
    return out.withColumn("_n", F.row_number().over(W.partitionBy("seed").orderBy("hop", "node"))).filter(F.col("_n") <= max_nodes).drop("_n")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def blast_radius(edges: DataFrame, seeds: DataFrame, max_hops: int = 3, max_nodes: int = 200) -> DataFrame:
    """seed, direction (incoming: what depends on the seed; outgoing), node, hop, cross_module."""
    edges, seeds = written(edges.select("src", "dst").filter("src <> dst").distinct(), "edges"), written(seeds.select("seed"), "seeds")
    ins = reach(reversed_edges(edges), seeds, max_hops, max_nodes, True).withColumn("direction", F.lit("incoming"))
    outs = reach(edges, seeds, max_hops, max_nodes, True).withColumn("direction", F.lit("outgoing"))
    cross = E.module_path(F.col("seed")) != E.module_path(F.col("node"))
    return ins.unionByName(outs).withColumn("cross_module", cross).select("seed", "direction", "node", "hop", "cross_module")


def function_id(prefix: str = "") -> str:
    """A function's key as one string: file, name, container."""
    return f"concat_ws('|', {prefix}file, {prefix}name, coalesce({prefix}container, ''))"


def function_edges(calls: DataFrame, tests: bool = True) -> DataFrame:
    """src calls dst, resolved calls from inside functions only; without ``tests``, neither end in a test file."""
    rows = calls.filter("from_fn is not null and to_fn is not null")
    if not tests:
        rows = rows.filter(~E.is_test_file(F.col("from_file")) & ~E.is_test_file(F.col("to_file")))
    return rows.selectExpr("concat_ws('|', from_file, from_fn, coalesce(from_container, '')) src", "concat_ws('|', to_file, to_fn, coalesce(to_container, '')) dst").filter("src <> dst").distinct()


def rank_functions_by_blast(functions: DataFrame, calls: DataFrame, pool: int = 50, min_direct: int = 2, limit: int = 5, max_hops: int = 3) -> DataFrame:
    """id, direct callers, incoming (reached within ``max_hops`` backwards), complexity, name; the widest first.

    The ``pool`` with most direct callers are traversed together, as seeds of one frontier."""
    edges = written(function_edges(calls, tests=False), "edges")
    direct = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("direct")).filter(F.col("direct") >= min_direct)
    top = written(direct.orderBy(F.desc("direct"), "id").limit(pool))
    near = reach(reversed_edges(edges), top.select(F.col("id").alias("seed")), max_hops, prepared=True).groupBy(F.col("seed").alias("id")).agg(F.count("*").alias("incoming"))
    info = functions.selectExpr(f"{function_id()} id", "name", "complexity").groupBy("id").agg(F.max("complexity").alias("complexity"), F.max("name").alias("name"))
    out = top.join(near, "id").join(info, "id")
    return out.orderBy(F.desc("incoming"), F.desc("complexity"), "name", "id").limit(limit)


def fan_in(edges: DataFrame) -> DataFrame:
    """file and number of files that import or call it, tests counted as sources but not as targets."""
    return edges.filter("src <> dst").distinct().filter(~E.is_test_file(F.col("dst"))).groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("fan_in"))


def rank_files_by_fan_in(edges: DataFrame, limit: int = 12) -> DataFrame:
    return fan_in(edges).orderBy(F.desc("fan_in"), "file").limit(limit)


def rank_functions_in_files(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """file, name, container, callers: distinct calling functions, itself left out."""
    edges = function_edges(calls)
    n = edges.groupBy("dst").agg(F.count("*").alias("callers"))
    ids = functions.selectExpr("file", "name", "container", f"{function_id()} id").distinct()
    return ids.join(n, F.col("id") == F.col("dst"), "left").select("file", "name", "container", F.coalesce("callers", F.lit(0)).alias("callers"))


def neighborhood(edges: DataFrame, root: str, depth: int = 2, direction: str = "both", max_nodes: int = 50) -> DataFrame:
    """node, hop within ``depth`` of the root, the nearest ``max_nodes`` by (hop, node), and how many were dropped."""
    way = {"out": edges, "in": reversed_edges(edges), "both": edges.unionByName(reversed_edges(edges))}[direction]
    seeds = edges.sparkSession.range(1).select(F.lit(root).alias("seed"))
    near = written(reach(way, seeds, depth).select("node", "hop"))
    n = near.count()
    return near.orderBy("hop", "node").limit(max_nodes).withColumn("dropped", F.lit(max(0, n - max_nodes)))


def budgeted_blast(blast: DataFrame, untested: DataFrame, max_tokens: int = 2000) -> DataFrame:
    """For each seed and direction the nodes that fit a budget of 3.5 characters a token, at least one: untested
    first, then across modules, then near. ``size`` is the length of a node's entry as JSON."""
    rows = blast.join(untested.select(F.col("file").alias("node"), F.lit(True).alias("untested")), "node", "left").fillna(False, ["untested"])
    rows = rows.withColumn("size", F.length(F.to_json(F.struct("node", "hop", "cross_module", "untested"))))
    order = W.partitionBy("seed", "direction").orderBy(F.desc("untested"), F.desc("cross_module"), "hop", "node")
    rows = rows.withColumn("used", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order))
    return rows.filter((F.col("used") <= max_tokens * 3.5) | (F.col("place") == 1)).select("seed", "direction", "node", "hop", "place")


def caller_index(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """file, name, container, callers, callees; callees are 0 where the name isn't unique in its file."""
    edges = function_edges(calls)
    ids = functions.selectExpr("file", "name", "container", f"{function_id()} id").distinct()
    unique = ids.groupBy("file", "name").agg(F.count("*").alias("_same"))
    ins = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    outs = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
    out = ids.join(ins, "id", "left").join(outs, "id", "left").join(unique, ["file", "name"])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("file", "name", "container", zero("callers").alias("callers"), F.when(F.col("_same") > 1, 0).otherwise(zero("callees")).alias("callees"))


def _placed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, layer of the nodes that are on no cycle and behind none: the longest way from a node without predecessors.

    A node is placed once all its predecessors are. How many are is noted for the nodes that a round touches only;
    edges and the numbers to be waited for are written once and never again."""
    indegree = written(edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("waiting")), "indegree")
    front = done = written(nodes.join(indegree, "node", "left_anti").select("node", F.lit(0).alias("layer")), "roots")
    noted = None
    for k in itertools.count(1):
        if front.isEmpty():
            return done
        met = front.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("met"))
        if noted is not None:
            before = noted.join(met.select("node"), "node", "left_semi").groupBy("node").agg(F.max("met").alias("before"))
            met = met.join(before, "node", "left").select("node", (F.col("met") + F.coalesce("before", F.lit(0))).alias("met"))
        met = written(met.join(indegree, "node").select("node", "met", (F.col("met") == F.col("waiting")).alias("ready")), "met")
        front = met.filter("ready").select("node", F.lit(k).alias("layer"))
        done = done.unionByName(front)
        some = met.filter("not ready").select("node", "met")
        noted = some if noted is None else noted.unionByName(some)
        if k % FOLD == 0:
            done = written(done, "layers")
            noted = written(noted.groupBy("node").agg(F.max("met").alias("met")).join(done, "node", "left_anti"), "noted")


def cycles(edges: DataFrame) -> DataFrame:
    """node, root of the nodes that lie on cycles: two have the same root if each reaches the other.

    Forward and backward colouring: nodes with nothing before or behind them go; the greatest name that reaches a node is its
    colour; whoever reaches that name backwards within the colour is of its component. Components found leave, until no edge is left."""
    left = written(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    found = None
    while True:
        # trim
        while True:
            inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            inner = written(inner.select("src", "dst"), "inner")
            if inner.count() == left.count():
                break
            left = inner
        if left.isEmpty():
            return found if found is not None else left.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        colour = written(left.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("colour")), "colour")
        while True:
            reach_ = left.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.max("colour").alias("c"))
            now = written(colour.join(reach_, F.col("node") == F.col("dst"), "left").select("node", F.greatest("colour", F.coalesce("c", F.col("colour"))).alias("colour"), (F.coalesce("c", F.col("colour")) > F.col("colour")).alias("new")), "colour")
            colour = now.select("node", "colour")
            if now.filter("new").isEmpty():
                break
        within = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst").filter("cs = cd")
        within = written(within.select("src", "dst"), "within")
        front = members = written(colour.filter("node = colour"), "members")
        while not front.isEmpty():
            step = within.join(front.select(F.col("node").alias("dst"), "colour"), "dst").select(F.col("src").alias("node"), "colour").distinct()
            front = written(step.join(members.select("node"), "node", "left_anti"), "back")
            members = members.unionByName(front)
        members = written(members, "components")
        many = members.join(members.groupBy("colour").agg(F.count("*").alias("n")).filter("n > 1").select("colour"), "colour", "left_semi").select("node", F.col("colour").alias("root"))
        found = many if found is None else found.unionByName(many)
        gone = members.select("node")
        left = written(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "left")


def layers(edges: DataFrame) -> DataFrame:
    """node, layer: the longest way from a node without predecessors. The nodes of a cycle have one layer together: that of
    their component among the components of the graph, which have no cycles among them."""
    edges = written(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    nodes = written(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "nodes")
    done = written(_placed(edges, nodes), "layers")
    left = written(edges.join(done.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "left")
    if left.isEmpty():
        return done
    root = written(cycles(left.join(done.select(F.col("node").alias("src")), "src", "left_anti")), "cycles")
    name = lambda t, c: t.join(root.select(F.col("node").alias(c), F.col("root").alias("_r")), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
    whole = written(name(name(edges, "src"), "dst").filter("src <> dst").distinct(), "condensed")
    ends = nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("_c"))
    at = written(_placed(whole, ends.select(F.col("_c").alias("node")).distinct()), "layers")
    return ends.join(at.withColumnRenamed("node", "_c"), "_c").select("node", "layer")


def deepest_chain(edges: DataFrame, min_layer: int = 6) -> DataFrame:
    """place, node of one longest chain, from its root; of several the one with the smallest names from the end back. Where the way
    leads through a cycle, the chain's step enters and leaves it by any of its members, one of which stands for all.

    Each node's smallest predecessor of the layer before comes from one join; the way back is walked in doubling steps."""
    edges = written(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    placed = written(layers(edges), "layers")
    top = placed.agg(F.max("layer")).head()[0]
    spark = edges.sparkSession
    if top is None or top < min_layer:
        return spark.createDataFrame([], "place int, node string")
    of = lambda c, n: placed.select(F.col("node").alias(c), F.col("layer").alias(n))
    before = edges.join(of("src", "ls"), "src").join(of("dst", "ld"), "dst").filter("ls = ld - 1").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("to"))
    twins = placed.join(before.select("node"), "node", "left_anti").filter("layer > 0")
    if not twins.isEmpty():
        # a member of a cycle without a predecessor outside it takes its component's
        root = cycles(edges)
        mine = root.join(before, "node").groupBy("root").agg(F.min("to").alias("to"))
        before = before.unionByName(twins.join(root, "node").join(mine, "root").select("node", "to"))
    jump = written(before, "before")
    chain = placed.filter(F.col("layer") == top).agg(F.min("node").alias("node"))
    for k in range(max(1, int(top).bit_length())):
        chain = written(chain.unionByName(chain.join(jump, "node").select(F.col("to").alias("node"))).distinct(), "chain")
        if 2 ** (k + 1) <= top:
            jump = written(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")), "jump")
    return chain.join(placed, "node").select(F.col("layer").alias("place"), "node")


def locate_symbol(functions: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """Functions whose name is the query (tier 0), is it but for case (1) or contains it (2); only the best tier.
    ``A.b`` looks for b in container A, or without the container if there is none."""
    container, _, name = query.rpartition(".")
    low = F.lower("name")
    tier = F.when(F.col("name") == name, 0).when(low == name.lower(), 1).when(low.contains(name.lower()), 2)
    rows = functions.withColumn("tier", tier).filter("tier is not null")
    if container:
        inside = rows.filter(F.lower("container") == container.lower())
        rows = rows if inside.isEmpty() else inside
    best = rows.agg(F.min("tier").alias("_best"))  # one row
    return rows.join(F.broadcast(best), F.col("tier") == F.col("_best")).drop("_best").orderBy("file", "start_row", "name").limit(limit)


def fuzzy_search(functions: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """kind, file, name, score: files by their base name (50 more) and functions by name."""
    files = functions.select("file").distinct().select(F.lit("file").alias("kind"), "file", E.basename(F.col("file")).alias("name")).withColumn("score", E.fuzzy_score(query, F.col("name")) + 50)
    names = functions.select(F.lit("function").alias("kind"), "file", "name").distinct().withColumn("score", E.fuzzy_score(query, F.col("name")))
    return files.unionByName(names).filter("score is not null").orderBy(F.desc("score"), "kind", "name", "file").limit(limit)


def start_here(files: DataFrame, fans: DataFrame, churn: DataFrame, limit: int = 6) -> DataFrame:
    """Files worth reading first: 6 * fan-in + 4 * complexity + 2 * churn, each as a share of the largest."""
    rows = files.filter(~E.is_test_file(F.col("file"))).join(fans, "file").join(churn, "file", "left").filter("fan_in >= 1 and complexity >= 8").withColumn("churn", F.coalesce("churn", F.lit(0)))
    top = rows.agg(*(F.greatest(F.max(c), F.lit(1)).alias(f"_{c}") for c in ("fan_in", "complexity", "churn")))  # one row
    score = 6 * F.col("fan_in") / F.col("_fan_in") + 4 * F.col("complexity") / F.col("_complexity") + 2 * F.col("churn") / F.col("_churn")
    rows = rows.crossJoin(F.broadcast(top)).withColumn("score", F.round(score, 6))
    return rows.select("file", "fan_in", "complexity", "churn", "score").orderBy(F.desc("score"), "file").limit(limit)


def palette(functions: DataFrame, limit: int = 200) -> DataFrame:
    return functions.select("file", "name", "container", "complexity").orderBy(F.desc("complexity"), "file", "name", "container").limit(limit)


def file_tree(files: DataFrame) -> DataFrame:
    """path, depth, kind, files below: every folder above a file and the files themselves."""
    parts = F.split("file", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), n.alias("depth"), F.when(n == F.size(parts), "file").otherwise("dir").alias("kind")))
    return files.select("file").distinct().select(F.explode(up).alias("x")).groupBy("x.path", "x.depth", "x.kind").agg(F.count("*").alias("files"))

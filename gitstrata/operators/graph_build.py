"""From parse relations to the graph: imports, resolved calls, routes, class names, hashes and totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gitstrata import shared
from gitstrata.functions import exprs as E
from gitstrata.operators import routes, sinks
from gitstrata.sources import python_source


def import_edges(p_imports: DataFrame) -> DataFrame:
    """p_imports: file, resolved_path, kind. Resolved, not to itself, each (kind, from, to) once."""
    return p_imports.filter("resolved_path is not null and resolved_path <> file").select(F.col("file").alias("from_file"), F.col("resolved_path").alias("to_file"), "kind").distinct()


def reexports(p_imports: DataFrame) -> DataFrame:
    """file, symbol, origin: where a file gets a name from; of several imports of a name the last (by seq) counts."""
    rows = p_imports.filter("resolved_path is not null").select("file", F.explode("symbols").alias("symbol"), "resolved_path", "seq")
    return rows.groupBy("file", "symbol").agg(F.max_by("resolved_path", "seq").alias("origin"))


#: Ends of edges that offer more names than this are asked by name, and so are modules of which more than this have a name in common.
FEW = 32


def _offered(edges: DataFrame, offers: DataFrame, calls: DataFrame) -> DataFrame:
    """edges: file, at; offers: at, callee_name, what is offered. What the ends of a file's edges offer it.

    Most ends offer few names, and those are dealt to all files that lead there, asked for or not. One that offers many is asked
    for the names that a file calls, so an edge never makes more rows than FEW, or than its file has names."""
    many = shared.written(offers.groupBy("at").agg(F.count("*").alias("n")).filter(F.col("n") > FEW).select("at"), "many")
    if many.isEmpty():
        return edges.join(offers, "at")
    wide = edges.join(many, "at", "left_semi").join(calls.select("file", "callee_name").distinct(), "file")
    return edges.join(offers.join(many, "at", "left_anti"), "at").unionByName(wide.join(offers, ["at", "callee_name"]))


def _of_modules(asked: DataFrame, modules: DataFrame, dirs: DataFrame) -> DataFrame:
    """asked: file, callee_name, callee_type, each once; modules: callee_name, callee_type, _dir, a module's functions; dirs: file, _dir.
    The functions of modules of the type's name in a folder that the file imports from.

    Where few modules of a name have the function, they are looked up first, else the file's folders."""
    by, here = ["callee_name", "callee_type"], ["file", "_dir"]
    many = shared.written(modules.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > FEW).select(*by), "many")
    if many.isEmpty():
        return asked.join(modules, by).join(dirs, here, "left_semi")
    near = asked.join(many, by, "left_anti").join(modules, by).join(dirs, here, "left_semi")
    return near.unionByName(asked.join(many, by, "left_semi").join(dirs, "file").join(modules, [*by, "_dir"]))


def resolve_calls(p_calls: DataFrame, functions: DataFrame, imports: DataFrame, origins: DataFrame, repeated: DataFrame | None = None, kept: Callable[[DataFrame, str], DataFrame] = shared.large) -> DataFrame:
    """Adds to_file, to_fn, to_container (null where unresolved) to calls.

    p_calls: call_id, file, in_fn, from_container, callee_name, callee_type, has_receiver; read more than once, so a written table.
    A call is one row, but for call_ids in ``repeated``, where that is given: rows of such a call share the best of what they find.
    functions: file, name, container, fn_seq (anything that sorts: files by path, then in-file order). Candidates are the functions of
    the callee's name; code outside tests can't call into tests. The first of the rules that finds one wins, and
    within a rule the first in fn_seq.

    Rules that don't ask for the calling file look their answer up by name, counted and ordered already, so a name that many
    files use is never paired with all calls of it; ``kept`` says how these answers are kept. Calls that these leave open meet the candidates of the other rules at their
    file: both are dealt by it once, and by nothing else.
    """
    f = functions.select(F.col("name").alias("callee_name"), F.col("file").alias("t_file"), F.col("container").alias("t_container"), F.struct("fn_seq", F.col("file").alias("t_file"), F.col("container").alias("t_container")).alias("t"))
    f = shared.growing(f.withColumn("_test", E.is_test_file(F.col("t_file"))))
    top, prod = F.col("t_container").isNull(), ~F.col("_test")
    first = lambda c: F.min(F.when(c, F.col("t")))
    sole = lambda c: F.when(F.count_if(c) == 1, first(c))
    by_name, by_type = ["callee_name"], ["callee_name", "callee_type"]
    names = f.groupBy(*by_name).agg(sole(top).alias("top"), sole(top & prod).alias("top_prod"), sole(F.lit(True)).alias("any"), sole(prod).alias("any_prod"))
    names = kept(names.filter(F.coalesce("top", "top_prod", "any", "any_prod").isNotNull()), "names")
    types = kept(f.filter(~top).groupBy("callee_name", F.col("t_container").alias("callee_type")).agg(F.min("t").alias("typed"), first(prod).alias("typed_prod")), "types")

    own, direct = E.is_test_file(F.col("file")), ~F.coalesce("has_receiver", F.lit(False))
    mine = lambda c: F.when(F.coalesce(c, f"{c}_prod").isNotNull(), F.when(own, F.col(c)).otherwise(F.col(f"{c}_prod")))
    ranked = lambda k, t: F.when(t.isNotNull(), F.struct(F.lit(k).alias("rule"), t.alias("t")))
    typed, untyped = p_calls.filter("callee_type is not null"), p_calls.filter("callee_type is null")
    typed = typed.join(types, by_type, "left").join(names, by_name, "left").select(*p_calls.columns, F.coalesce(ranked(0, mine("typed")), ranked(1, F.when(direct, mine("top")))).alias("best"))
    untyped = untyped.join(names, by_name, "left").select(*p_calls.columns, ranked(4, F.when(direct, mine("any"))).alias("best"))

    edges = shared.growing(imports.select(F.col("from_file").alias("file"), F.col("to_file").alias("at")))
    passed = origins.select(F.col("file").alias("at"), F.col("symbol").alias("callee_name"), F.col("origin").alias("t_file")).join(f, ["callee_name", "t_file"]).drop("t_file")
    passed = _offered(edges, passed, p_calls).withColumn("callee_type", E.importable_name(F.col("at"))).drop("at").distinct()
    near = _offered(edges, f.withColumnRenamed("t_file", "at"), p_calls)
    modules = f.filter(top).select("callee_name", E.importable_name(F.col("t_file")).alias("callee_type"), E.module_path(F.col("t_file")).alias("_dir"), "t_container", "t", "_test")
    dirs = shared.growing(imports.select(F.col("from_file").alias("file"), E.module_path(F.col("to_file")).alias("_dir")).distinct())
    asked = _of_modules(typed.filter("best is null").select("file", *by_type).distinct(), modules, dirs)
    found = None
    for k, rule in ((2, passed), (3, asked), (5, f.withColumn("file", F.col("t_file"))), (6, near), (7, passed)):
        key = F.col("callee_type") if k < 4 else F.lit(None).cast("string")
        one = rule.filter(prod | own).select("file", "callee_name", key.alias("callee_type"), F.struct(F.lit(k).alias("rule"), "t").alias("found"))
        found = one if found is None else found.unionByName(one)

    both = typed.unionByName(untyped)
    rows = both.filter("best is null").drop("best").withColumn("_call", F.lit(True)).unionByName(found, allowMissingColumns=True).repartition("file")
    at = W.partitionBy("file", *by_type)
    least = lambda c: F.min(F.when(c, F.col("found"))).over(at)
    only = lambda c: F.when(F.count(F.when(c, 1)).over(at) == 1, least(c))
    rule = F.col("found.rule")
    best = F.coalesce(only(rule == 2), only((rule == 2) & F.col("found.t.t_container").isNull()), only(rule == 3), least(rule > 4))
    out = both.filter("best is not null").unionByName(rows.withColumn("best", best).filter("_call").select(*p_calls.columns, "best"))
    if repeated is not None:
        ids = kept(repeated.select("call_id").distinct(), "repeated")
        shares = out.join(ids, "call_id", "left_semi").withColumn("best", F.min("best").over(W.partitionBy("call_id")))
        out = out.join(ids, "call_id", "left_anti").unionByName(shares)
    t = F.col("best.t")
    return out.select(*p_calls.columns, t["t_file"].alias("to_file"), F.when(t.isNotNull(), F.col("callee_name")).alias("to_fn"), t["t_container"].alias("to_container"))


class Graph(dict):
    """Relations by name, each made when it is first asked for."""

    def __init__(self, **made: Callable[[Graph], DataFrame]) -> None:
        super().__init__()
        self._made = made

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._made[name](self)
        return self[name]


def build_graph(files: DataFrame) -> Graph:
    """files: path, content of Python sources. The graph's relations: parsed (facts), functions, imports, calls (resolved where
    they can be), arguments, routes, sinks."""
    return linked(shared.large(python_source.parse(files), "parsed", "kind"), files.select("path"))


def linked(parsed: DataFrame, paths: DataFrame) -> Graph:
    """The graph of parse relations, as ``build_graph`` gives it; paths: the files that imports may name."""
    return related(
        parsed, lambda g: shared.large(python_source.resolved_imports(parsed, paths), "imports"), lambda g: import_edges(g["p_imports"]),
        lambda g: shared.large(resolve_calls(shared.large(python_source.calls_of(parsed), "p_calls"), g["declared"], g["imports"].select("from_file", "to_file").distinct(), g["bound"]), "calls"),
    )


def related(parsed: DataFrame, p_imports: Callable[[Graph], DataFrame], imports: Callable[[Graph], DataFrame], calls: Callable[[Graph], DataFrame]) -> Graph:
    """The graph's relations, from how its imports (with what they bind) and edges and resolved calls are made."""
    return Graph(
        parsed=lambda g: parsed, p_imports=p_imports, imports=imports, bound=lambda g: reexports(g["p_imports"]), calls=calls, declared=lambda g: python_source.functions_of(parsed),
        routes=lambda g: shared.large(routes.declared_routes(parsed, g["declared"], g["bound"]), "routes"), functions=lambda g: entered(g["declared"], g["routes"]),
        arguments=lambda g: python_source.arguments_of(parsed, g["calls"]), sinks=lambda g: sinks.python_sinks(parsed),
    )


def entered(functions: DataFrame, declared: DataFrame) -> DataFrame:
    """functions with entry_point: whether a route leads to them."""
    entry = declared.select("file", "start_row", F.lit(True).alias("_e")).distinct()
    return functions.drop("entry_point").join(entry, ["file", "start_row"], "left").withColumn("entry_point", F.col("_e").isNotNull()).drop("_e")


def analysis_totals(files: DataFrame, graph: dict[str, DataFrame]) -> DataFrame:
    """One row: scanned, errors, functions, imports, resolved_imports, calls, resolved_calls of a built graph."""
    kinds = graph["parsed"].agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("error", "errors"), ("function", "functions"), ("import", "imports"), ("call", "calls"))))
    rest = (files.agg(F.count("*").alias("scanned")), graph["imports"].agg(F.count("*").alias("resolved_imports")), graph["calls"].agg(F.count("to_file").alias("resolved_calls")))
    for one in rest:  # tables of one row
        kinds = kinds.crossJoin(one)
    return kinds


def file_stats(functions: DataFrame) -> DataFrame:
    """ext, files, functions, complexity."""
    return functions.groupBy(E.extension(F.col("file")).alias("ext")).agg(F.count_distinct("file").alias("files"), F.count("*").alias("functions"), F.sum("complexity").alias("complexity"))


def distinct_class_names(classes: DataFrame) -> DataFrame:
    """Adds display: a name that several files use gets its file's base name, and if that isn't enough a number."""
    one = F.when(F.count("*").over(W.partitionBy("name")) > 1, F.concat("name", F.lit("_"), E.importable_name(F.col("file")))).otherwise(F.col("name"))
    rows = classes.withColumn("_one", one)
    n = F.row_number().over(W.partitionBy("_one").orderBy("file", "start_row"))
    return rows.withColumn("_n", n).withColumn("display", F.when(F.col("_n") > 1, F.concat("_one", F.lit("_"), F.col("_n").cast("string"))).otherwise(F.col("_one"))).drop("_one", "_n")


def resolution_rate(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count("*").alias("total"), F.count_if(F.col("to_file").isNotNull()).alias("resolved"))


def own_resolution(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """own_resolved, own_missed, pct: of calls inside functions outside tests, those to code of this repository."""
    names = functions.select(F.col("name").alias("callee_name")).distinct().withColumn("_own", F.lit(True))
    types = functions.filter("container is not null").select(F.col("container").alias("callee_type")).distinct().withColumn("_type", F.lit(True))
    rows = calls.filter(F.col("from_fn").isNotNull() & ~E.is_test_file(F.col("from_file"))).join(names, "callee_name", "left").join(types, "callee_type", "left")
    hit = F.col("to_file").isNotNull() & F.col("to_fn").isNotNull()
    missed = ~hit & F.coalesce("_own", F.lit(False)) & (~F.coalesce("has_receiver", F.lit(False)) | F.coalesce("_type", F.lit(False)))
    out = rows.agg(F.count_if(hit).alias("own_resolved"), F.count_if(missed).alias("own_missed"))
    return out.withColumn("pct", E.percent(F.col("own_resolved"), F.col("own_resolved") + F.col("own_missed")))


def djb2(text: Column) -> Column:
    """The 32-bit rolling hash (33 * h + code unit) of a text in base 36; null for null."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16LE")), F.lit("(.{4})"), F.lit(1)), lambda x: F.conv(F.concat(F.substring(x, 3, 2), F.substring(x, 1, 2)), 16, 10).cast("long"))
    return E.base36(F.aggregate(units, F.lit(5381).cast("long"), lambda h, u: (h * 33 + u).bitwiseAND(F.lit(0xFFFFFFFF))))


def analyzable(files: DataFrame, extensions: tuple[str, ...], max_bytes: int = 1_000_000, limit: int = 5000) -> DataFrame:
    """path, ext, content of the files that are analysed, in path order, with truncated where the limit cut some off."""
    ok = F.col("ext").isin(*extensions) & ~E.in_skipped_dir(F.col("path")) & ~E.is_vendored(F.col("path")) & (F.octet_length("content") <= max_bytes) & ~E.is_minified(F.col("content"))
    rows = files.filter(ok)
    n = rows.agg((F.count("*") > limit).alias("truncated"))  # one row
    return rows.orderBy("path").limit(limit).crossJoin(F.broadcast(n))


def regex_imports(files: DataFrame) -> DataFrame:
    """file, target, kind of import statements that regular expressions find in several languages. Approximate."""
    found: list[Column] = []
    for exts, pattern in IMPORT_PATTERNS:
        hit = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
        found.append(F.when(F.col("ext").isin(*exts), hit).otherwise(F.array().cast("array<string>")))
    return files.select(F.col("path").alias("file"), F.explode(F.array_distinct(F.flatten(F.array(*found)))).alias("target")).withColumn("kind", F.lit("import"))


#: Import statements by language.
IMPORT_PATTERNS = (
    (("py",), r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+[\w.]+)"),
    (("js", "jsx", "ts", "tsx", "mjs", "cjs"), r"(?:from|require\(|import\()\s*['\"]([^'\"]+)['\"]"),
    (("java", "kt"), r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)"),
    (("cs",), r"(?m)^\s*using\s+([\w.]+)\s*;"),
    (("php",), r"(?m)^\s*use\s+([\w\\]+)"),
    (("rb",), r"(?m)^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]"),
    (("go",), r"(?m)^\s*(?:import\s+)?\"([\w./-]+)\"\s*$"),
)

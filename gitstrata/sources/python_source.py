"""Python files to parse relations, by a table function over the standard syntax tree.

The function gives plain facts, a row each: functions, classes, calls, arguments with a known origin, imports,
assignments and routes. What they mean, how imports and calls resolve and which calls are sinks, is said by
DataFrame operators over them.
"""

from __future__ import annotations

import ast
import hashlib
import re
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from gitstrata import shared
from gitstrata.functions import exprs as E
from gitstrata.sources import facts as reading

#: Nodes that add a path through a function; an ``and`` or ``or`` adds one for each operand but the first.
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case)
#: What makes an expression's value come from outside, and what makes it harmless.
REQUEST = re.compile(r"(^|\.)request\.[A-Za-z_]")
SERVER_SET = re.compile(r"(^|\.)request\.(user|auth|session|id|site|resolver_match|csrf_token|_messages|current_app|urlconf)\b")
CLEAN_CALLS = frozenset(("int", "float", "bool", "len", "escape", "conditional_escape", "escapejs", "quote", "quote_plus", "urlencode", "UUID", "secure_filename"))
OUTSIDE_CALLS = frozenset(("input", "raw_input"))
OUTSIDE_NAMES = frozenset(("sys.argv", "sys.stdin", "os.environ"))
#: Decorators that declare a route, with and without a verb; functions of routing tables, and which imports make a file one.
VERBS = frozenset(("get", "post", "put", "delete", "patch", "head", "options"))
ROUTE_DECORATORS = frozenset(("route", "api_route", "websocket"))
TABLE_CALLS = frozenset(("path", "re_path", "url"))
TABLE_IMPORT = re.compile(r"django\.(urls|conf\.urls)\b")
#: What a class is derived from without being a kind of it.
MARKERS = frozenset(("ABC", "ABCMeta", "Protocol"))

SCHEMA = (
    "file string, kind string, name string, container string, row int, end_row int, complexity int, target string, has_receiver boolean, "
    "seq int, receiver string, callee_type string, items array<string>, body_hash string, form string, origin_kind string, origin string, literal string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def fact(path: str, kind: str, node: ast.AST | None = None, **cells) -> dict:
    at = {"row": node.lineno - 1, "end_row": (node.end_lineno or node.lineno) - 1} if node is not None else {}
    return {"file": path, "kind": kind, **at, **cells}


#: Nodes that no walk asks for, names of fields that hold none, and kinds of nodes that are told apart.
UNASKED = frozenset((ast.Load, ast.Store))
PLAIN_FIELDS = frozenset(("id", "attr", "arg", "module", "level", "type_comment", "kind", "conversion", "is_async", "simple"))
ASSIGNED = frozenset((ast.Assign, ast.AnnAssign, ast.AugAssign))
IMPORTED = frozenset((ast.Import, ast.ImportFrom))
TOLD = frozenset((*FUNCTION, ast.ClassDef, ast.Call, ast.If, ast.While, ast.Assign, ast.AnnAssign))
_fields: dict[type, tuple[str, ...]] = {}


def children(node: ast.AST) -> list[ast.AST]:
    """Its child nodes but UNASKED ones, in the order of ``ast.iter_child_nodes``; told once for each node, as several walks ask for them."""
    known = node.__dict__.get("_children")
    if known is None:
        known, kind = [], type(node)
        if kind is not ast.Constant:
            if kind not in _fields:
                _fields[kind] = tuple(x for x in node._fields if x not in PLAIN_FIELDS)
            for name in _fields[kind]:
                x = getattr(node, name, None)
                if type(x) is list:
                    known += [y for y in x if isinstance(y, ast.AST)]
                elif type(x) not in UNASKED and isinstance(x, ast.AST):
                    known.append(x)
        node._children = known
    return known


def walk(node: ast.AST) -> list[ast.AST]:
    """The node and all below it but UNASKED ones, in the order of ``ast.walk``."""
    out = [node]
    for x in out:
        known = x.__dict__.get("_children")
        out += children(x) if known is None else known
    return out


def complexity(function: ast.AST) -> int:
    """1 and the branches of the function itself; those of a function inside it are that one's."""
    n, todo = 1, [*children(function)]
    while todo:
        x = todo.pop()
        kind = type(x)
        if kind not in FUNCTION:
            n += (kind in BRANCHES) + (len(x.values) - 1 if kind is ast.BoolOp else 0)
            todo += children(x)
    return n


def body_hash(function: ast.AST) -> str:
    """Of the kinds of the body's nodes, operators included, names and literals left aside."""
    kinds = "|".join(type(x).__name__ for s in function.body for x in walk(s))
    return hashlib.md5(kinds.encode()).hexdigest()[:16]


def dotted(node: ast.AST | None, aliases: dict[str, str]) -> str | None:
    """``a.b`` of names and attributes, its first name resolved through the file's imports; None for anything else."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return None
    return ".".join([aliases.get(node.id, node.id), *reversed(parts)])


def last_name(node: ast.AST | None) -> str | None:
    """``c`` of ``a.b.c`` or ``c``."""
    return node.attr if isinstance(node, ast.Attribute) else getattr(node, "id", None)


def named_target(node: ast.AST | None) -> tuple[str | None, str, bool] | None:
    """(module, name, is class) of what a routing table names: ``view``, ``module.view`` or either with ``.as_view()``."""
    is_class = isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "as_view"
    node = node.func.value if is_class else node
    if isinstance(node, ast.Name):
        return None, node.id, is_class
    if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
        return node.value.id, node.attr, is_class
    return None


def table_route(call: ast.Call, is_table: bool) -> tuple[str, str | None, str, bool, str] | None:
    """(route, module, name, is class, via) of a row of a routing table or a router's registration of a view set."""
    callee = last_name(call.func)
    if len(call.args) < 2 or not (isinstance(call.args[0], ast.Constant) and isinstance(call.args[0].value, str)):
        return None
    target = named_target(call.args[1])
    if target is None:
        return None
    if is_table and callee in TABLE_CALLS:
        return call.args[0].value, *target, f"{callee}()"
    if callee == "register" and isinstance(call.func, ast.Attribute) and not target[2] and target[1].endswith("ViewSet"):
        return call.args[0].value, target[0], target[1], True, "router.register()"
    return None


class Scope:
    """What a function's names stand for, by its assignments in order: origins, assembled strings, types."""

    def __init__(self, function: ast.AST, aliases: dict[str, str], nodes: list[ast.AST]) -> None:
        self.aliases, self.origins, self.assembled, self.types, self.text = aliases, {}, set(), {}, {}
        if isinstance(function, FUNCTION):
            a = function.args
            for p in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))):
                if p.arg not in ("self", "cls"):
                    self.origins[p.arg] = ("param", p.arg)
        assigned = [x for x in nodes if type(x) in ASSIGNED and x.value is not None]
        for x in sorted(assigned, key=lambda x: (x.lineno, x.col_offset)):
            for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                if isinstance(t, ast.Name):
                    if (o := self.origin(x.value)) is not None:
                        self.origins[t.id] = o
                    if self.is_assembled(x.value) or isinstance(x, ast.AugAssign) and isinstance(x.op, ast.Add) and t.id in self.text:
                        self.assembled.add(t.id)
                    if isinstance(x.value, ast.Constant) and isinstance(x.value.value, str):
                        self.text[t.id] = x.value.value
                    if isinstance(x.value, ast.Call) and isinstance(x.value.func, ast.Name) and x.value.func.id[:1].isupper():
                        self.types[t.id] = x.value.func.id

    def origin(self, node: ast.AST | None) -> tuple[str, str] | None:
        """("source", its text) or ("param", name) of the first such value that an expression is made of."""
        todo = [node] if node is not None else []
        while todo:
            x = todo.pop(0)
            if isinstance(x, ast.Name) and x.id in self.origins:
                return self.origins[x.id]
            if isinstance(x, (ast.Attribute, ast.Subscript)):
                text = ast.unparse(x)
                if REQUEST.search(text) and not SERVER_SET.search(text):
                    return "source", text.split("(")[0]
                if dotted(x, self.aliases) in OUTSIDE_NAMES:
                    return "source", dotted(x, self.aliases)
            if isinstance(x, ast.Call):
                if isinstance(x.func, ast.Name) and x.func.id in OUTSIDE_CALLS:
                    return "source", x.func.id
                if last_name(x.func) in CLEAN_CALLS:
                    continue
            if not isinstance(x, (ast.Lambda, *FUNCTION)):
                todo[:0] = [c for c in children(x) if isinstance(c, (ast.expr, ast.keyword))]
        return None

    def is_assembled(self, node: ast.AST | None) -> bool:
        """Whether a string is put together from parts that aren't all literals."""
        if isinstance(node, ast.JoinedStr):
            return any(isinstance(v, ast.FormattedValue) for v in node.values)
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Mod)):
            texts = [x for x in walk(node) if isinstance(x, (ast.JoinedStr, ast.Constant)) and (isinstance(x, ast.JoinedStr) or isinstance(x.value, str))]
            return bool(texts) and any(isinstance(x, (ast.Name, ast.Attribute, ast.Call, ast.Subscript)) for x in walk(node))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format":
            return isinstance(node.func.value, ast.Constant)
        return isinstance(node, ast.Name) and node.id in self.assembled

    def literal(self, node: ast.AST | None) -> str | None:
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            return node.value
        return self.text.get(node.id) if isinstance(node, ast.Name) else None


def call_facts(path: str, call: ast.Call, scope: Scope, inside: str | None, container: str | None, seq: int) -> Iterator[dict]:
    """A call and its arguments whose values have a known origin."""
    func = call.func
    callee = func.attr if isinstance(func, ast.Attribute) else getattr(func, "id", None)
    if not callee:
        return
    receiver = dotted(func.value, scope.aliases) if isinstance(func, ast.Attribute) else None
    first = call.args[0] if call.args else None
    if callee in ("execute", "executemany", "executescript", "raw") and isinstance(first, ast.Call) and dotted(first.func, {}) in ("text", "sa.text", "sqlalchemy.text") and first.args:
        first = first.args[0]
    own = func.value.id if isinstance(func, ast.Attribute) and isinstance(func.value, ast.Name) else None
    kind = container if own in ("self", "cls") else scope.types.get(own) or (scope.aliases[own].rsplit(".", 1)[-1] if own in scope.aliases else None)
    made = "assembled" if scope.is_assembled(first) else "literal" if scope.literal(first) is not None else "name" if isinstance(first, ast.Name) else "none" if first is None else "other"
    origin = scope.origin(first) or (None, None)
    words = [f"{k.arg}={ast.unparse(k.value)}" for k in call.keywords if k.arg]
    yield fact(
        path, "call", call, name=inside, container=container, target=callee, has_receiver=isinstance(func, ast.Attribute), seq=seq, receiver=receiver, callee_type=kind, items=words, form=made,
        origin_kind=origin[0], origin=origin[1], literal=scope.literal(call.args[1]) if len(call.args) > 1 else None,
    )
    for k, (name, value) in enumerate([(None, a) for a in call.args] + [(w.arg, w.value) for w in call.keywords if w.arg]):
        if (o := scope.origin(value)) is not None:
            yield fact(path, "arg", call, name=inside, container=container, target=callee, seq=seq, complexity=k, literal=name, origin_kind=o[0], origin=o[1])


def facts(path: str, content: str | None) -> list[dict]:
    """The facts of one file; one of kind error if it can't be read."""
    try:
        tree = ast.parse(content or "")
        return list(_facts(path, tree))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [fact(path, "error", row=0, end_row=0, complexity=1)]


def compared(test: ast.AST) -> Iterator[tuple[str, str, ast.Compare]]:
    """(name, literal, node) where a condition, or a part of it, holds a name against a plain text."""
    if isinstance(test, ast.BoolOp):
        for x in test.values:
            yield from compared(x)
    elif isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.ops[0], (ast.Eq, ast.NotEq)):
        for a, b in ((test.left, test.comparators[0]), (test.comparators[0], test.left)):
            key = a.slice if isinstance(a, ast.Subscript) else None
            name = last_name(a) or (key.value if isinstance(key, ast.Constant) and isinstance(key.value, str) else None)
            if name and isinstance(b, ast.Constant) and isinstance(b.value, str):
                yield name, b.value, test
                return


def _facts(path: str, tree: ast.Module) -> Iterator[dict]:
    aliases: dict[str, str] = {}
    nodes = walk(tree)
    imports = [x for x in nodes if type(x) in IMPORTED]
    for x in imports:
        level = "." * getattr(x, "level", 0)
        base = level + (getattr(x, "module", None) or "")
        for a in x.names:
            full = a.name if isinstance(x, ast.Import) else f"{base}.{a.name}".lstrip(".") if base.strip(".") else a.name
            aliases[a.asname or a.name.split(".")[0]] = full if a.asname or isinstance(x, ast.ImportFrom) else a.name.split(".")[0]
            yield fact(path, "import", x, name=a.name if isinstance(x, ast.ImportFrom) else None, target=base if isinstance(x, ast.ImportFrom) else a.name, complexity=0, seq=x.lineno, literal=a.asname or a.name if isinstance(x, ast.ImportFrom) else None)
    is_table = any(isinstance(x, ast.Import) and any(TABLE_IMPORT.match(a.name) for a in x.names) or isinstance(x, ast.ImportFrom) and not x.level and TABLE_IMPORT.match(x.module or "") for x in imports)
    seq, outer = 0, Scope(tree, aliases, nodes)
    todo: list[tuple[ast.AST, str | None, str | None, Scope]] = [(tree, None, None, outer)]
    while todo:
        node, container, inside, scope = todo.pop()
        for child in children(node):
            c, f, s = container, inside, scope
            if type(child) not in TOLD:
                pass
            elif isinstance(child, FUNCTION):
                args = child.args
                yield fact(path, "function", child, name=child.name, container=container, complexity=complexity(child), body_hash=body_hash(child), items=[a.arg for a in (*args.posonlyargs, *args.args, *args.kwonlyargs) if a.arg not in ("self", "cls")])
                for d in child.decorator_list:
                    verb = d.func.attr if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) else None
                    if verb in VERBS | ROUTE_DECORATORS and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str) and d.args[0].value.startswith("/"):
                        yield fact(path, "route", child, name=child.name, container=container, target=d.args[0].value, form="decorator", items=[verb.upper()] if verb in VERBS else [], literal="@" + ast.unparse(d.func))
                f, s = child.name, Scope(child, aliases, walk(child))
            elif isinstance(child, ast.ClassDef):
                fields = [t.id for x in child.body if isinstance(x, (ast.Assign, ast.AnnAssign)) for t in (x.targets if isinstance(x, ast.Assign) else [x.target]) if isinstance(t, ast.Name)]
                yield fact(path, "class", child, name=child.name, complexity=0, items=[b for b in (last_name(x) for x in child.bases) if b and b not in MARKERS], literal=",".join(fields))
                c = child.name
            elif isinstance(child, ast.Call):
                seq += 1
                yield from call_facts(path, child, scope, inside, container, seq)
                if (route := table_route(child, is_table)) is not None:
                    yield fact(path, "route", child, name=route[2], target=route[0], receiver=route[1], has_receiver=route[3], form="table", items=[], literal=route[4], seq=seq)
            elif isinstance(child, (ast.If, ast.While)):
                for name, literal, at in compared(child.test):
                    yield fact(path, "compare", at, name=inside, container=container, target=name, literal=literal)
            elif isinstance(child, (ast.Assign, ast.AnnAssign)) and child.value is not None:
                for t in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    name = t.id if isinstance(t, ast.Name) else t.attr if isinstance(t, ast.Attribute) else t.slice.value if isinstance(t, ast.Subscript) and isinstance(t.slice, ast.Constant) else None
                    if isinstance(name, str):
                        value = child.value
                        given = value.args[1] if isinstance(value, ast.Call) and len(value.args) > 1 and (dotted(value.func, {}) or "").rsplit(".", 1)[-1] in ("getenv", "get") else value
                        yield fact(path, "assign", child, name=inside, container=container, target=name, form=ast.unparse(value), literal=given.value if isinstance(given, ast.Constant) and isinstance(given.value, str) else None)
            if children(child):
                todo.append((child, c, f, s))


def parse(files: DataFrame) -> DataFrame:
    """files: path, content. Returns SCHEMA."""
    return reading.read(files, facts, SCHEMA)


def functions_of(parsed: DataFrame) -> DataFrame:
    """file, name, container, start_row, end_row, complexity, body_hash, params, fn_seq, entry_point (whether a decorator declares a route)."""
    routed = parsed.filter("kind = 'route' and form = 'decorator'").select("file", F.col("row").alias("start_row"), F.lit(True).alias("_e")).distinct()
    f = parsed.filter("kind = 'function'").select(
        "file", "name", "container", F.col("row").alias("start_row"), "end_row", "complexity", "body_hash", F.col("items").alias("params"), F.struct("file", "row").alias("fn_seq"),
    )
    return f.join(routed, ["file", "start_row"], "left").withColumn("entry_point", F.col("_e").isNotNull()).drop("_e")


def module_paths(specs: DataFrame, paths: DataFrame) -> DataFrame:
    """specs: file, spec (as an import statement has it, dots in front for relative ones). file, spec, path of those that name a file of ``paths``.

    The module's own file or package counts before all else; without either, files and packages that end in its path, of which
    one outside test folders goes first, then one under src, then the shallowest, then the smallest path. All endings
    of all paths are counted and ordered beforehand, so a spec looks up one row."""
    dots = F.char_length(F.regexp_extract("spec", r"^\.*", 0))
    folder = F.filter(F.split(E.module_path(F.col("file")), "/"), lambda x: x != "")
    up = F.slice(folder, F.lit(1), F.greatest(F.lit(0), F.size(folder) - dots + 1))
    parts = F.filter(F.split(F.regexp_replace("spec", r"^\.+", ""), r"\."), lambda x: x != "")
    base = F.array_join(F.when(dots > 0, F.concat(up, parts)).otherwise(parts), "/")
    asked = specs.select("file", "spec").distinct().withColumn("base", base).filter((F.size(folder) >= dots - 1) & (base != ""))
    names = F.array(F.struct(F.lit(0).alias("k"), F.concat("base", F.lit(".py")).alias("end")), F.struct(F.lit(1).alias("k"), F.concat("base", F.lit("/__init__.py")).alias("end")))
    each = asked.select("file", "spec", F.explode(names).alias("x")).select("file", "spec", "x.k", "x.end")
    whole = paths.select(F.col("path").alias("end"), "path").distinct()
    steps = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(F.slice(steps, i, F.size(steps)), "/"))
    rank = F.struct(E.in_test_dir(F.col("path")).alias("test"), (~F.col("path").startswith("src/")).alias("elsewhere"), F.size(steps).alias("depth"), "path")
    nested = paths.filter(F.col("path").endswith(".py")).select("path").distinct().filter(F.size(steps) > 1)
    nested = nested.select(rank.alias("rank"), F.explode(ends).alias("end")).groupBy("end").agg(F.min("rank").alias("rank"))
    found = each.join(whole, "end").select("file", "spec", F.struct(F.lit(False).alias("test"), F.lit(False).alias("elsewhere"), (F.col("k") - 2).alias("depth"), "path").alias("rank"))
    found = found.unionByName(each.join(nested, "end").select("file", "spec", "rank"))
    return found.groupBy("file", "spec").agg(F.min("rank").alias("rank")).select("file", "spec", "rank.path")


def resolved_imports(parsed: DataFrame, paths: DataFrame) -> DataFrame:
    """file, resolved_path, kind, symbols, seq of import statements that name a file of ``paths`` (column path). In ``from a import b
    as c`` b may be a module of a: then that module is what c stands for, and a is imported as well. symbols are the names bound."""
    i = parsed.filter("kind = 'import'").select("file", "target", F.col("name").alias("orig"), F.col("literal").alias("bound"), "seq")
    i = i.withColumn("inner", F.when(F.col("orig").isNotNull(), F.concat("target", F.when(F.col("target").endswith("."), "").otherwise("."), "orig")))
    specs = i.select("file", F.explode(F.filter(F.array("target", "inner"), lambda x: x.isNotNull())).alias("spec"))
    known = shared.large(module_paths(specs, shared.growing(paths)), "modules")
    inner = known.select("file", F.col("spec").alias("inner"), F.col("path").alias("sub")).filter("sub <> file")
    outer = known.select("file", F.col("spec").alias("target"), F.col("path").alias("package"))
    at = i.join(inner, ["file", "inner"], "left").join(outer, ["file", "target"], "left")
    subs = at.filter("sub is not null").select("file", "seq", F.col("sub").alias("resolved_path"), F.col("bound").alias("symbol"))
    rest = at.filter("package is not null").select("file", "seq", F.col("package").alias("resolved_path"), F.when(F.col("sub").isNull(), F.col("bound")).alias("symbol"))
    return subs.unionByName(rest).groupBy("file", "seq", "resolved_path").agg(F.sort_array(F.collect_set("symbol")).alias("symbols")).withColumn("kind", F.lit("import"))


def calls_of(parsed: DataFrame) -> DataFrame:
    """p_calls: call_id, file, in_fn, from_container, callee_name, callee_type, has_receiver."""
    c = parsed.filter("kind = 'call'")
    return c.select(F.concat_ws("#", "file", "seq").alias("call_id"), "file", F.col("name").alias("in_fn"), F.col("container").alias("from_container"), F.col("target").alias("callee_name"), "callee_type", "has_receiver")


def arguments_of(parsed: DataFrame, resolved: DataFrame) -> DataFrame:
    """For resolved calls, each argument with an origin: from_file, from_fn, to_file, to_fn, index, arg_name, source, param, line."""
    a = parsed.filter("kind = 'arg'").select(F.concat_ws("#", "file", "seq").alias("call_id"), F.col("complexity").alias("index"), F.col("literal").alias("arg_name"), "origin_kind", "origin", "row")
    at = resolved.filter("to_fn is not null").select("call_id", F.col("file").alias("from_file"), F.col("in_fn").alias("from_fn"), "to_file", "to_fn")
    pick = lambda k: F.when(F.col("origin_kind") == k, F.col("origin"))
    return a.join(at, "call_id").select("from_file", "from_fn", "to_file", "to_fn", "index", "arg_name", pick("source").alias("source"), pick("param").alias("param"), (F.col("row") + 1).alias("line"))


# tasks get this code with their closures, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

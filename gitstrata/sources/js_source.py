"""JavaScript and TypeScript files to parse relations, by a tokenizer and the brackets between its tokens.

The reader gives plain facts, a row each: functions, classes, calls, imports, test cases and assertions, with the places
(token numbers) at which they begin and end. What they mean, which case an assertion counts for and which local helper
a call reaches, is said by DataFrame operators over them. Strings, templates, comments and regular expressions are
told apart by what stands before them; markup inside code is read as operators, and only functions with a
name of their own count, so the branches of an anonymous one belong to the function around it.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from gitstrata import shared
from gitstrata.sources import facts as reading

EXTENSIONS = ("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts")
#: Tokens that add a path through a function.
BRANCHES = frozenset(("if", "while", "for", "case", "catch", "&&", "||", "??"))
#: What opens a test case and may stand between it and its arguments; matchers and getters that check next to nothing.
RUNNERS = frozenset(("it", "test", "specify", "fit"))
CASE_MODIFIERS = frozenset(("only", "each", "concurrent", "failing"))
TRIVIAL_MATCHERS = (
    "toBeDefined", "toBeUndefined", "toBeNull", "toBeTruthy", "toBeFalsy", "toBeNaN", "toThrow", "toThrowError", "toBeInstanceOf", "toHaveBeenCalled", "ok",
)
TRIVIAL_GETTERS = ("null", "undefined", "exist", "ok", "empty", "NaN")
ROUTE_VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")

SCHEMA = (
    "file string, kind string, name string, container string, row int, end_row int, complexity int, target string, has_receiver boolean, receiver string, "
    "items array<string>, form string, exported boolean, pos int, end_pos int, scope_start int, scope_end int, fn_pos int, case_pos int"
)

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*")|(?P<name>[A-Za-z_$\#\u0080-￿][\w$]*)|(?P<number>\d[\w.]*)"""
    r"""|(?P<mark>=>|===|!==|==|!=|<=|>=|\?\?|\?\.(?!\d)|&&|\|\||\.\.\.|\+\+|--|.)""",
    re.S | re.X,
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
PIECE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
#: Words after which a value is still to come, and words that look like a call before a bracket.
OPERATORS = frozenset("return typeof case in of delete void throw new else do await yield instanceof extends default".split())
CONTROL = frozenset("if for while switch catch with function return typeof await yield super import new delete void throw in of else do case".split())
MODIFIERS = frozenset("async static get set public private protected readonly override abstract * declare".split())
PAIRS = {")": "(", "]": "[", "}": "{"}
#: Marks that tell something by themselves, and names that do without a bracket behind them.
TELLING = frozenset(("{", "=>", "?", "&&", "||", "??"))
LEADING = RUNNERS | {"class", "import", "export", "require", "expect", "assert"}


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, row): names, numbers, texts (strings, pieces of templates, regular expressions) and marks; ``${`` counts as a bracket."""
    out: list[tuple[str, str, int]] = []
    at, row, depth, inside, n = 0, 0, 0, [], len(text)
    while at < n:
        c = text[at]
        if c == "`" or c == "}" and inside and inside[-1] == depth:
            if c == "}":
                out.append(("mark", "}", row))
                inside.pop()
                depth -= 1
            m = PIECE.match(text, at + 1)
            out.append(("text", m[0], row))
            row += m[0].count("\n")
            at = m.end() + 1
            if text[m.end() : m.end() + 2] == "${":
                at += 1
                depth += 1
                inside.append(depth)
                out.append(("mark", "{", row))
            continue
        m, kind = None, "text"
        if c == "/" and (not out or not (out[-1][0] in ("number", "text") or out[-1][0] == "name" and out[-1][1] not in OPERATORS or out[-1][1] in (")", "]"))):
            m = REGEX.match(text, at)
        if m is None:
            m = TOKEN.match(text, at)
            kind = m.lastgroup
        t, at = m[0], m.end()
        if kind != "skip":
            out.append((kind, t, row))
        if kind == "mark":
            depth += (t == "{") - (t == "}")
        elif kind != "name":
            row += t.count("\n")
    return out


def brackets(toks: list[tuple[str, str, int]]) -> dict[int, int]:
    """The place of each bracket's partner, both ways; one that is never closed ends with the file."""
    pair, open_ = {}, []
    for i, (kind, t, _) in enumerate(toks):
        if kind == "mark" and t in "([{":
            open_.append(i)
        elif kind == "mark" and t in PAIRS:
            while open_ and toks[open_[-1]][1] != PAIRS[t]:
                pair[open_.pop()] = i
            if open_:
                pair[i] = open_.pop()
                pair[pair[i]] = i
    return pair | {i: len(toks) - 1 for i in open_}


class Reader:
    def __init__(self, path: str, text: str | None) -> None:
        self.path, self.t = path, tokens(text or "")
        self.n, self.pair, self.rows = len(self.t), brackets(self.t), []

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < self.n and (at := self.t[i])[1] in texts and at[0] != "text"

    def name(self, i: int) -> str | None:
        return self.t[i][1] if 0 <= i < len(self.t) and self.t[i][0] == "name" else None

    def bracket(self, i: int) -> int:
        """The place of the round bracket at i, or behind type arguments that stand there."""
        if self.is_(i, "<"):
            depth = 0
            for k in range(i, min(i + 40, len(self.t))):
                depth += self.is_(k, "<") - self.is_(k, ">")
                if depth == 0:
                    return k + 1
                if self.is_(k, ";", "&&", "||", ")"):
                    break
        return i

    def declared(self, i: int) -> int | None:
        """The place of x in ``const x: type = ``, i being that of ``=``."""
        for k in range(i - 1, max(i - 40, -1), -1):
            if self.is_(k, "const", "let", "var") or self.is_(k, ",") and k == i - 2:
                return k + 1 if self.name(k + 1) and (k + 2 == i or self.is_(k + 2, ":")) else None
            if self.is_(k, ";", "=", "=>") or self.is_(k, "{") and self.pair[k] > i:
                return None
        return None

    def expression_end(self, i: int) -> int:
        first = i
        while i < len(self.t):
            kind, t, row = self.t[i]
            if kind == "mark" and (t in PAIRS or t in ",;"):
                return i - 1
            ended = i > first and (self.t[i - 1][0] != "mark" or self.t[i - 1][1] in PAIRS) and not self.is_(i - 1, *OPERATORS)
            if ended and kind != "mark" and row > self.t[i - 1][2] and not self.is_(i, *OPERATORS):
                return i - 1
            i = (self.pair.get(i, i) if t in ("(", "[", "{") and kind == "mark" else i) + 1
        return len(self.t) - 1

    def body(self, after: int) -> int | None:
        """The place of the block behind a parameter list that ends at ``after``, past a type if there is one."""
        if self.is_(after + 1, "{"):
            return after + 1
        if self.is_(after + 1, ":"):
            for k in range(after + 2, min(after + 40, len(self.t))):
                if self.is_(k, "{") and not self.is_(k - 1, ":", "|", "&", "<", ","):
                    return k
                if self.is_(k, ";", "=>", ")", "=") and not (self.is_(k, ")") and self.pair.get(k, 0) > after):
                    return None
        return None

    def function(self, i: int) -> tuple[str, int, int, int] | None:
        """(name, first place, place of the parameters' bracket or name, last place) of the named function that the token at i is the sign of."""
        if self.is_(i, "function") and not self.is_(i - 1, "."):
            k = i + 1 + self.is_(i + 1, "*")
            first = i - self.is_(i - 1, "async")
            name = self.name(k)
            if name is None and self.is_(first - 1, "=") and (d := self.declared(first - 1)) is not None:
                name, first = self.name(d), d
            k += self.name(k) is not None
            while k < len(self.t) and not self.is_(k, "(", "{", ";"):
                k += 1
            b = self.body(self.pair[k]) if self.is_(k, "(") else None
            return (name, first, k, self.pair[b]) if name and b else None
        if self.is_(i, "=>"):
            k = i - 1
            while k > max(i - 20, 0) and not self.is_(k, ")") and not (self.name(k) and (self.is_(k - 1, "=") or self.is_(k - 1, "async"))):
                k -= 1
            params = self.pair.get(k, k) if self.is_(k, ")") else k
            first = params - 1
            if self.is_(first, ">"):
                while first > 0 and not self.is_(first, "<"):
                    first -= 1
                first -= 1
            first -= self.is_(first, "async")
            if not self.is_(first, "=") or (d := self.declared(first)) is None:
                return None
            return self.name(d), d, params, self.pair[i + 1] if self.is_(i + 1, "{") else self.expression_end(i + 1)
        name = self.name(i)
        k = self.bracket(i + 1)
        if name and name not in CONTROL and self.is_(k, "(") and not self.is_(i - 1, ".", "?.", "new", "function", "*" if self.is_(i - 2, "function") else "."):
            fresh = i == 0 or self.is_(i - 1, "{", "}", ";", ",") or self.t[i - 1][1] in MODIFIERS or self.t[i - 1][2] < self.t[i][2]
            b = self.body(self.pair[k]) if fresh else None
            return (name, i, k, self.pair[b]) if b else None
        return None

    def parameters(self, k: int) -> list[str]:
        if not self.is_(k, "("):
            return [self.t[k][1]]
        out, i, end = [], k + 1, self.pair[k]
        while i < end:
            j = i + (self.is_(i, "...") or self.t[i][1] in ("public", "private", "protected", "readonly"))
            if self.name(j):
                out.append(self.name(j))
            while i < end and not self.is_(i, ","):
                i = (self.pair[i] if self.t[i][0] == "mark" and self.t[i][1] in "([{" else i) + 1
            i += 1
        return out

    def add(self, kind: str, i: int, end: int | None = None, **cells) -> dict:
        end = i if end is None else end
        self.rows.append({"file": self.path, "kind": kind, "row": self.t[i][2], "end_row": self.t[end][2], "pos": i, "end_pos": end, **cells})
        return self.rows[-1]

    def import_(self, i: int) -> None:
        """import and export statements that name a module, and calls of import and require."""
        if self.is_(i + 1, "("):
            if i + 2 < len(self.t) and self.t[i + 2][0] == "text":
                self.add("import", i, target=self.t[i + 2][1].strip("'\"`"), items=[])
            return
        names, k = [], i + 1
        while k < len(self.t) and k < i + 400 and not self.is_(k, ";", "=", "(") and self.t[k][0] != "text":
            if self.name(k) and self.name(k) not in ("from", "type", "as") and not self.is_(k + 1, "as"):
                names.append(self.name(k))
            k += 1
        if k < len(self.t) and self.t[k][0] == "text" and (self.is_(k - 1, "from") or k == i + 1):
            self.add("import", i, target=self.t[k][1].strip("'\"`"), items=sorted(set(names)), form="export" if self.is_(i, "export") else "import")

    def case(self, i: int) -> tuple[str, int, int] | None:
        """(name, first and last place of the callback) of a test case that opens at i."""
        k = i + 1
        while self.is_(k, ".") and self.name(k + 1) in CASE_MODIFIERS:
            k += 2
        if not self.is_(k, "("):
            return None
        if self.is_(self.pair[k] + 1, "(") and self.is_(k - 1, "each"):
            k = self.pair[k] + 1
        end = self.pair[k]
        name = next((self.t[j][1].strip("'\"") for j in range(k + 1, min(k + 3, end)) if self.t[j][0] == "text"), "")
        j = k + 1
        while j < end:
            if self.is_(j, "=>", "function"):
                return name, j, end
            j = (self.pair[j] if self.is_(j, "[", "{") else j) + 1
        return None

    def assertion(self, i: int) -> tuple[str, str | None, int] | None:
        """(form, matcher, place to go on from) of an assertion whose root stands at i."""
        root, k = self.t[i][1], i + 1
        if root == "assert":
            if self.is_(k, "("):
                return "assert", None, k
            if self.is_(k, ".") and self.name(k + 1) and self.is_(k + 2, "("):
                return "call", self.name(k + 1), k + 2
            return None
        soft = self.is_(k, ".") and self.name(k + 1) is not None
        k += 2 * soft
        if not self.is_(k, "(") or self.is_(i - 1, "."):
            return None
        k, last = self.pair[k] + 1, None
        while self.is_(k, ".") and self.name(k + 1):
            last, k = self.name(k + 1), k + 2
        if last is None:
            return None if soft else ("bare", None, i + 1)
        return ("call" if self.is_(k, "(") else "getter", last, i + 1)

    def read(self) -> list[dict]:
        functions, cases, blocks, classes = [], [], [(-1, len(self.t))], []
        for i, (kind, t, _) in enumerate(self.t):
            if kind != "name" and (kind != "mark" or t not in TELLING):
                continue
            for stack in (functions, cases, blocks, classes):
                while stack and stack[-1][1] < i:
                    stack.pop()
            if kind == "mark" and t == "{":
                blocks.append((i, self.pair[i]))
                continue
            called = kind == "name" and self.is_(i + 1, "(", "<")
            found = self.function(i) if called or t in ("=>", "function") else None
            if found is not None:
                name, first, params, end = found
                owner = classes[-1][2] if classes and blocks[-1][0] == classes[-1][0] else None
                exported = any(self.is_(k, "export") for k in range(max(first - 3, 0), first))
                row_ = self.add("function", first, end, name=name, container=owner, complexity=1, items=self.parameters(params), exported=exported, scope_start=blocks[-1][0], scope_end=blocks[-1][1], case_pos=cases[-1][0] if cases else None)
                functions.append((first, end, row_))
            if functions and (kind != "text" and t in BRANCHES and not self.is_(i - 1, ".") or kind == "mark" and t == "?" and not self.is_(i + 1, ":", ")", ",", ";", "}", "=")):
                functions[-1][2]["complexity"] += 1
            if kind != "name" or self.is_(i - 1, ".") and t in ("import", "export", "class"):
                continue
            if not called and t not in LEADING:
                continue
            at = {"name": functions[-1][2]["name"] if functions else None, "container": functions[-1][2]["container"] if functions else None, "fn_pos": functions[-1][0] if functions else None, "case_pos": cases[-1][0] if cases else None}
            if t == "class" and self.name(i + 1):
                k = i + 2
                bases = []
                while k < len(self.t) and not self.is_(k, "{", ";"):
                    if self.is_(k - 1, "extends", "implements", ",") and self.name(k):
                        bases.append(self.name(k))
                    k += 1
                if self.is_(k, "{"):
                    classes.append((k, self.pair[k], self.t[i + 1][1]))
                    self.add("class", i, self.pair[k], name=self.t[i + 1][1], items=bases)
            elif t in ("import", "export", "require") and not self.is_(i - 1, "."):
                self.import_(i)
            if t in RUNNERS and not self.is_(i - 1, ".") and (c := self.case(i)) is not None:
                self.add("case", i, c[2], name=c[0], case_pos=at["case_pos"])
                cases.append((i, c[2]))
            elif cases and t in ("expect", "assert") and (a := self.assertion(i)) is not None:
                self.add("assertion", i, form=a[0], target=a[1], **at)
            elif functions and t in ("expect", "assert") and (a := self.assertion(i)) is not None:
                self.add("assertion", i, form=a[0], target=a[1], **at)
            if called and self.is_(self.bracket(i + 1), "(") and found is None and t not in CONTROL and not self.is_(i - 1, "new", "function"):
                own = self.is_(i - 1, ".", "?.")
                self.add("call", i, target=t, has_receiver=own, receiver=self.name(i - 2) if own and not self.is_(i - 3, ".", "?.") else None, **at)
        return self.rows


def facts(path: str, content: str | None) -> list[dict]:
    return Reader(path, content).read()


def parse(files: DataFrame) -> DataFrame:
    """files: path, content. Returns SCHEMA."""
    return reading.read(files, facts, SCHEMA)


def functions_of(parsed: DataFrame) -> DataFrame:
    """file, name, container, start_row, end_row, complexity, params, route: the route is that of an exported verb in a file that a
    framework serves by where it lies, ``app/.../route.ts``; folders in round brackets don't show."""
    f = parsed.filter("kind = 'function'")
    folders = F.split(F.regexp_extract("file", r"(?:^|.*/)app/((?:[^/]+/)*)route\.[cm]?[jt]sx?$", 1), "/")
    shown = F.array_join(F.filter(folders, lambda x: (x != "") & ~x.rlike(r"^\(.*\)$")), "/")
    served = F.col("file").rlike(r"(^|/)app/(.*/)?route\.[cm]?[jt]sx?$") & F.col("exported") & F.col("name").isin(*ROUTE_VERBS)
    return f.select("file", "name", "container", F.col("row").alias("start_row"), "end_row", "complexity", F.col("items").alias("params"), F.when(served, F.concat(F.lit("/"), shown)).alias("route"))


def imports_of(parsed: DataFrame, paths: DataFrame) -> DataFrame:
    """file, spec, resolved_path, symbols. Relative imports name a file of ``paths`` as they stand, with one of the extensions, or as
    a folder's index; of several the first in that order. Others are packages and stay null."""
    parsed, paths = shared.growing(parsed), shared.growing(paths)
    i = parsed.filter("kind = 'import'").select("file", F.col("target").alias("spec"), F.col("items").alias("symbols"), "pos")
    folder = F.filter(F.split(F.regexp_replace("file", r"/?[^/]*$", ""), "/"), lambda x: x != "")
    steps = F.filter(F.split("spec", "/"), lambda x: (x != "") & (x != "."))
    ups = F.size(F.filter(steps, lambda x: x == ".."))
    base = F.array_join(F.concat(F.slice(folder, F.lit(1), F.greatest(F.lit(0), F.size(folder) - ups)), F.filter(steps, lambda x: x != "..")), "/")
    own = i.filter(F.col("spec").startswith(".")).withColumn("base", base)
    stem = F.regexp_replace("base", r"\.[cm]?jsx?$", "")
    every = [F.col("base"), *(F.concat(F.col("base"), F.lit(f".{e}")) for e in EXTENSIONS), *(F.concat(stem, F.lit(f".{e}")) for e in ("ts", "tsx", "mts", "cts")), *(F.concat("base", F.lit(f"/index.{e}")) for e in EXTENSIONS)]
    each = own.select("file", "pos", F.posexplode(F.array(*every)).alias("k", "path"))
    hit = each.join(paths.select("path").distinct(), "path").groupBy("file", "pos").agg(F.min_by("path", "k").alias("resolved_path"))
    return i.join(hit, ["file", "pos"], "left").select("file", "spec", "resolved_path", "symbols")


def test_cases(parsed: DataFrame) -> DataFrame:
    """file, name, line, assertions, trivial_assertions, has_meaningful_oracle of each test case.

    An assertion counts for the innermost case around it. A call of a function of the same file that asserts counts as one
    assertion, as strong as the function's strongest; which function a name means is the one visible in the innermost
    block. The assertions of a function declared in a case that calls it are the call's, not the case's own."""
    parsed = shared.growing(parsed)
    weak = F.when(F.col("form") == "call", F.col("target").isin(*TRIVIAL_MATCHERS)).when(F.col("form") == "getter", F.col("target").isin(*TRIVIAL_GETTERS)).otherwise(True)
    found = parsed.filter("kind = 'assertion'").select("file", "pos", "fn_pos", "case_pos", weak.alias("weak"))
    cases = parsed.filter("kind = 'case'").select("file", F.col("pos").alias("case_pos"), "name", (F.col("row") + 1).alias("line"))
    local = parsed.filter("kind = 'function' and container is null").select("file", F.col("name").alias("target"), F.col("pos").alias("fn_pos"), "scope_start", "scope_end", F.col("case_pos").alias("in_case"))
    strength = found.filter("fn_pos is not null").groupBy("file", "fn_pos").agg(F.min("weak").alias("weak"))
    helpers = local.join(strength, ["file", "fn_pos"], "left")
    calls = parsed.filter("kind = 'call' and case_pos is not null and not has_receiver").select("file", "target", "case_pos", "pos")
    seen = calls.join(helpers, ["file", "target"]).filter("pos > scope_start and pos <= scope_end")
    reached = seen.groupBy("file", "case_pos", "pos").agg(F.max_by(F.struct("weak", "in_case", "fn_pos"), "scope_start").alias("x")).select("file", "case_pos", "x.*")
    by_call = reached.filter("weak is not null").select("file", "case_pos", "weak")
    called = reached.filter("in_case = case_pos").select("file", "case_pos", "fn_pos").distinct()
    own = found.filter("case_pos is not null").join(called, ["file", "case_pos", "fn_pos"], "left_anti").select("file", "case_pos", "weak")
    n = own.unionByName(by_call).groupBy("file", "case_pos").agg(F.count("*").alias("n"), F.count_if("weak").alias("w"))
    out, zero = cases.join(n, ["file", "case_pos"], "left"), lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return out.select("file", "name", "line", zero("n").alias("assertions"), zero("w").alias("trivial_assertions"), (zero("n") > zero("w")).alias("has_meaningful_oracle"))


# tasks get this code with their closures, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

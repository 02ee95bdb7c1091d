"""Python sources to facts and to the graph: complexity, sources and sanitizers, imports, routes."""

from gitstrata.operators import graph_build, routes
from gitstrata.sources import facts as reading, python_source as P


def facts(text, kind):
    return [f for f in P.facts("a.py", text) if f["kind"] == kind]


def origins(text):
    return {f["target"]: f["origin"] for f in facts(text, "call") if f["target"] in ("system", "open", "execute", "loads")}


def test_inner_functions_count_for_themselves():
    text = "def outer(a):\n    def inner(b):\n        if b and a:\n            return 1\n        for x in b:\n            pass\n    return [y for y in a] if a else inner\n"
    assert {f["name"]: f["complexity"] for f in facts(text, "function")} == {"outer": 2, "inner": 4}


def test_sanitizers_and_sources():
    assert origins("import os, shlex\ndef f(x):\n    os.system(shlex.quote(x))\n    open(secure_filename(x))\n") == {"system": None, "open": None}
    assert origins("import uuid\ndef f(x):\n    open(uuid.UUID(x))\n    os.system(isinstance(x, str) and x)\n") == {"open": None, "system": "x"}
    assert origins("import sys as s\ndef f():\n    open(s.stdin.read())\n    os.system(raw_input())\n") == {"open": "sys.stdin", "system": "raw_input"}


def imports(spark, files):
    df = spark.createDataFrame(files, "path string, content string")
    found = P.resolved_imports(P.parse(df), df.select("path"))
    return {(r.file, r.resolved_path): r.symbols for r in found.collect()}


def test_imports(spark):
    files = [
        ("app/urls.py", "from . import views as v\nfrom .helpers import a, b as c\nimport flask\nfrom deep.mod import x\nfrom ..other import y\nimport os\nfrom .... import z\n"),
        ("app/views.py", ""), ("app/helpers.py", ""), ("app/__init__.py", ""), ("other.py", ""),
        ("tests/apps/flask.py", ""), ("src/flask/__init__.py", ""), ("lib/a/deep/mod.py", ""), ("lib/deep/mod.py", ""), ("lib/deep/mod/x.py", ""),
    ]
    got = imports(spark, files)
    assert got == {
        ("app/urls.py", "app/views.py"): ["v"], ("app/urls.py", "app/__init__.py"): [], ("app/urls.py", "app/helpers.py"): ["a", "c"], ("app/urls.py", "src/flask/__init__.py"): [],
        ("app/urls.py", "lib/deep/mod/x.py"): ["x"], ("app/urls.py", "lib/deep/mod.py"): [], ("app/urls.py", "other.py"): ["y"],
    }


def handlers(spark, files):
    g = graph_build.build_graph(spark.createDataFrame(files, "path string, content string"))
    return {(r.file, r.container, r.name): (r.route, r.via) for r in g["routes"].collect()}


def test_routes_of_classes(spark):
    chain = "".join(f"class L{k}(L{k + 1}):\n    pass\n" for k in range(1, 9)) + "class L9:\n    def get(self): pass\n"
    files = [
        ("a/urls.py", "from django.urls import path\nfrom . import views as v\nfrom .views import Own\npath('z', v.Own.as_view())\npath('y', Own.as_view())\npath('loop', v.Loop.as_view())\npath('far', v.L1.as_view())\npath('near', v.L4.as_view())\npath('x', lambda r: r)\npath(f'q{1}', v.plain)\n"),
        ("a/views.py", "class Own(Mix, base.Deep):\n    def post(self): pass\n    def other(self): pass\nclass Loop(Loop2): pass\nclass Loop2(Loop): pass\ndef plain(r): pass\n" + chain),
        ("b/api.py", "router.register('sites', SiteViewSet)\nrouter.register('odd', Site)\nregister('no', SiteViewSet)\nclass SiteViewSet(Left, Right): pass\nclass Left: pass\nclass Right(Top):\n    def list(self): pass\nclass Top:\n    def list(self): pass\n    def create(self): pass\n"),
        ("c/main.py", "@app.route('/one')\n@app.post('/a')\ndef h(): pass\n@app.get(NAME)\ndef g(): pass\n@app.get('rel')\ndef k(): pass\nfrom django.conf.urls import url\nurl('h', h)\nurl('g', g)\n"),
    ]
    assert handlers(spark, files) == {
        ("a/views.py", "Own", "post"): ("y", "path()"), ("a/views.py", "L9", "get"): ("near", "path()"), ("b/api.py", "Right", "list"): ("sites", "router.register()"),
        ("c/main.py", None, "h"): ("/a", "@app.post"), ("c/main.py", None, "g"): ("g", "url()"),
    }


def test_narrowing_only_removes(spark):
    files = [
        ("p/urls.py", "from django.urls import path\nfrom q import handlers as hh\npath('1', views.show)\npath('2', hh.show)\npath('3', show)\npath('4', only)\npath('5', nowhere)\npath('6', gone.only)\n"),
        ("p/views.py", "def show(r): pass\n"), ("q/views.py", "def show(r): pass\n"), ("q/handlers.py", "def show(r): pass\n"), ("z/one.py", "def only(r): pass\n"),
    ]
    assert handlers(spark, files) == {("p/views.py", None, "show"): ("1", "path()"), ("q/handlers.py", None, "show"): ("2", "path()"), ("z/one.py", None, "only"): ("4", "path()")}
    assert routes.MAX_HOPS == 6


def test_texts_of_one_split_are_dealt(spark):
    files = spark.createDataFrame([(f"m{k}.py", f"import m{k + 1}") for k in range(200)], "path string, content string").coalesce(1)
    held = [n for n in P.parse(files).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(held) > 3 and sum(held) == 200


def test_tasks_grow_with_the_files(spark, monkeypatch):
    monkeypatch.setattr(reading, "FILES_A_TASK", 10)
    files = spark.createDataFrame([(f"m{k}.py", f"import m{k + 1}") for k in range(205)], "path string, content string").coalesce(1)
    assert reading.dealt(files, "path").rdd.getNumPartitions() == 21 and P.parse(files).count() == 205


def test_only_what_is_asked_for_is_made(spark, monkeypatch):
    def never(*a):
        raise AssertionError("calls were resolved")

    monkeypatch.setattr(graph_build, "resolve_calls", never)
    files = [("a.py", "from b import f\n@app.route('/x')\ndef g(q):\n    eval(q)\n"), ("b.py", "def f():\n    pass\n")]
    g = graph_build.build_graph(spark.createDataFrame(files, "path string, content string"))
    assert [tuple(r) for r in g["imports"].collect()] == [("a.py", "b.py", "import")] and [r.rule for r in g["sinks"].collect()] == ["py-eval"]
    assert sorted((r.name, r.entry_point) for r in g["functions"].collect()) == [("f", False), ("g", True)]

"""JavaScript and TypeScript sources to facts, imports and test cases."""

from gitstrata.sources import js_source as J

SOURCE = r"""import React, { useState as us, memo } from "react";
import * as ns from './ns';
import "./side.css";
export { a, b as c } from "../lib/x.js";
const cfg = require('./cfg'), lazy = () => import("./late");
// if (x) { comment
/* while ( */
const re = /a\/[/}]{2}/g, q = a / b / c;
export const add = (a: number, b = 2): number => a && b ? a + b : `t ${a ? "{" : `in ${b}`} }`;
const lone = x => x ?? 1
export async function load({ id }, ...rest) {
  for (const r of rest) { if (r || id) continue; }
  try { await fetch(`/x/${id}`) } catch (e) { return null }
  const inner = function () { return rest.map((z) => z ? 1 : 2) };
  switch (id) { case 1: case 2: break; default: }
  return inner()
}
class Store extends Base implements IStore {
  private n?: number = 1;
  constructor(private db: Db, size: number) { super(); this.x = new Thing(size) }
  static async get<T>(k: string): Promise<T> { return k ? this.db.find<T>(k) : null }
}
const obj = { run() { return 1 } };
"""


def rows(text, kind):
    return [r for r in J.Reader("a/b.ts", text).read() if r["kind"] == kind]


def test_functions():
    got = {(r["name"], r["container"]): (r["row"], r["complexity"], r["items"], r["exported"]) for r in rows(SOURCE, "function")}
    assert got == {
        ("lazy", None): (4, 1, [], False), ("add", None): (8, 4, ["a", "b"], True), ("lone", None): (9, 2, ["x"], False), ("load", None): (10, 7, ["rest"], True), ("inner", None): (13, 2, [], False),
        ("constructor", "Store"): (19, 1, ["db", "size"], False), ("get", "Store"): (20, 2, ["k"], False), ("run", None): (22, 1, [], False),
    }
    assert [(r["name"], r["items"]) for r in rows(SOURCE, "class")] == [("Store", ["Base", "IStore"])]
    calls = {(r["target"], r["receiver"], r["name"]) for r in rows(SOURCE, "call")}
    assert {("fetch", None, "load"), ("map", "rest", "inner"), ("inner", None, "load"), ("find", None, "get")} <= calls and not any(t == "Thing" for t, _, _ in calls)


def test_unfinished_files():
    for text in ("", None, "const a = `x ${", "function f( {", "class {", "/* open", "')", "}}}", "const x = (a => ", "import", "export {", "it('x'", "'\\"):
        assert isinstance(J.Reader("a.js", text).read(), list)


def test_imports(spark):
    files = [("a/b.ts", SOURCE), ("a/ns/index.tsx", ""), ("lib/x.ts", ""), ("a/cfg.js", ""), ("a/late.ts", ""), ("a/late.js", "")]
    df = spark.createDataFrame(files, "path string, content string")
    got = {r.spec: (r.resolved_path, r.symbols) for r in J.imports_of(J.parse(df), df.select("path")).collect()}
    assert got == {
        "react": (None, ["React", "memo", "us"]), "./ns": ("a/ns/index.tsx", ["ns"]), "./side.css": (None, []), "../lib/x.js": ("lib/x.ts", ["a", "c"]), "./cfg": ("a/cfg.js", []), "./late": ("a/late.js", []),
    }


def test_cases(spark):
    text = """
const strong = (v) => { expect(v).toBeDefined(); expect(v).toBe(1); };
function weak(v) { assert.ok(v); }
describe("a", () => {
  beforeEach(() => { expect(1).toBe(1); });
  it("two matchers", () => { expect(f(1)).not.toEqual(2); expect(x).toBeTruthy(); });
  it.only("getters", async () => { expect(x).to.be.true; expect(y).to.exist; expect(z); expect.assertions(3); });
  test.each([[1], [2]])("helpers %s", (n) => { strong(n); weak(n); test.step("s", () => { chai.assert.equal(n, 1); }); });
  test.skip("skipped", () => { expect(1).toBe(1); });
  it("outer", () => { it("inner", () => { expect(1).toBe(1); }); });
  it("nothing", () => { run(); });
  it("handed over", () => { const map = () => { expect(1).toBe(1); return 1; }; parse(map); });
  describe("b", () => { const strong = (v) => v; it("shadowed", () => { strong(1); }); });
});
it("todo");
"""
    df = spark.createDataFrame([("a.test.ts", text)], "path string, content string")
    got = {r.name: (r.assertions, r.trivial_assertions, r.has_meaningful_oracle) for r in J.test_cases(J.parse(df)).collect()}
    assert got == {
        "two matchers": (2, 1, True), "getters": (3, 2, True), "helpers %s": (3, 1, True), "outer": (0, 0, False), "inner": (1, 0, True), "nothing": (0, 0, False), "handed over": (1, 0, True), "shadowed": (0, 0, False),
    }


def test_served_routes(spark):
    files = [("web/app/(shop)/api/[id]/route.ts", "export async function GET(r) { return 1 }\nexport const POST = async (r) => 1;\nfunction PUT(r) {}\nexport function helper() {}"), ("web/api/route.ts", "export function GET() {}"), ("app/route.js", "export function GET() {}")]
    got = {(r.file, r.name): r.route for r in J.functions_of(J.parse(spark.createDataFrame(files, "path string, content string"))).collect()}
    at = "web/app/(shop)/api/[id]/route.ts"
    assert got == {(at, "GET"): "/api/[id]", (at, "POST"): "/api/[id]", (at, "PUT"): None, (at, "helper"): None, ("web/api/route.ts", "GET"): None, ("app/route.js", "GET"): "/"}


def test_texts_of_one_split_are_dealt(spark):
    files = spark.createDataFrame([(f"m{k}.ts", f"import x from './m{k + 1}';") for k in range(200)], "path string, content string").coalesce(1)
    parsed = J.parse(files)
    held = [n for n in parsed.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(held) > 3 and sum(held) == 200

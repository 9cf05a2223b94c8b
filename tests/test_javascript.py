"""The JavaScript scanner."""

from symgraph.functions.extract_javascript import extract, tokens
from symgraph.operators.resolve import module_targets

SOURCE = """import def, { add as plus, mul } from './math.js';
import * as all from "./lib";
const fs = require('fs');
const { helper, other: renamed } = require('./legacy');
export const LIMIT = 10;
let counter = 0;

export class Square extends Shape {
  constructor(side) { super(); this.side = side; }
  static of(n) { return new Square(n); }
  area = () => this.scale(plus(1, 2));
}

export function outer(a = "}") {
  const next = (x) => mul(x, /[/"}]/g.test(x) ? 1 : 2);
  function inner() { return next(`t ${all.go(1)} }`); }
  return inner();
}

View.prototype.render = function () { return this.lookup(); };
exports.make = async () => helper();
"""


def test_scan():
    nodes, raw = extract("src/a.js", SOURCE)
    got = {(n["id"].split("#")[-1], n["kind"], n["start_line"], n["end_line"]) for n in nodes}
    assert got == {
        ("src/a.js", "file", 1, 22), ("fs", "constant", 3, 3), ("LIMIT", "constant", 5, 5), ("counter", "variable", 6, 6), ("Square", "class", 8, 12), ("Square.constructor", "method", 9, 9), ("Square.of", "method", 10, 10), ("Square.area", "method", 11, 11),
        ("outer", "function", 14, 18), ("outer.next", "function", 15, 15), ("outer.inner", "function", 16, 16), ("View.render", "method", 20, 20), ("make", "function", 21, 21),
    }
    bound = {(e["name"], e["imported_name"], e["specifier"]) for e in raw if e["relation"] == "imports" and e.get("name")}
    assert bound == {("def", "default", "./math.js"), ("plus", "add", "./math.js"), ("mul", "mul", "./math.js"), ("all", "*", "./lib"), ("fs", "*", "fs"), ("helper", "helper", "./legacy"), ("renamed", "other", "./legacy")}
    calls = {(e["source"].split("#")[-1], e.get("via_member"), e["name"]) for e in raw if e["relation"] == "calls"}
    assert {("Square.area", "this", "scale"), ("Square.area", None, "plus"), ("outer.next", None, "mul"), ("outer.inner", None, "next"), ("outer", None, "inner"), ("View.render", "this", "lookup"), ("make", None, "helper")} <= calls
    assert not any(name == "Square" for _, _, name in calls)
    assert [(e["source"].split("#")[-1], e["name"]) for e in raw if e["relation"] == "extends"] == [("Square", "Shape")]


def test_odd_texts():
    for text in ("", "class", "const", "const x =", "function (", "a.b.", "`${`", "/* open", "import", "class A { x( }", "export default", "async", "}{)(", "'", "class A extends B"):
        extract("a.js", text)
        tokens(text)
    for cut in range(len(SOURCE)):
        extract("a.js", SOURCE[:cut])
        extract("a.js", SOURCE[cut:])


def test_module_targets(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.js", "src/math.js", "src/lib/index.ts", "top.mjs", "src/t.ts", "pkg/mod.py")], "path string")
    specs = [("src/a.js", "./math.js"), ("src/a.js", "./math"), ("src/a.js", "./lib"), ("src/lib/index.ts", "../t.js"), ("src/a.js", "../top"), ("src/a.js", "../../top"), ("src/a.js", "fs"), ("src/a.js", "mod"), ("pkg/mod.py", "mod")]
    got = {(r["file"], r["specifier"]): r["target"] for r in module_targets(spark.createDataFrame(specs, "file string, specifier string"), files).collect()}
    assert got == {specs[0]: "src/math.js", specs[1]: "src/math.js", specs[2]: "src/lib/index.ts", specs[3]: "src/t.ts", specs[4]: "top.mjs", specs[8]: "pkg/mod.py"}

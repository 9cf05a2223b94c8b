"""Ordinary and odd source code: nothing raises, nothing is read as empty, families and kinds are kept apart."""

import glob
import os
import sysconfig

import pytest

from symgraph.functions import extract_python
from symgraph.operators import extract, graph, resolve, search
from symgraph.plans.workspace import Workspace
from symgraph.render import Reader
from symgraph.server import handle, serve
from symgraph.sources import files


def test_forms_that_bind_names():
    code = "def f(x: Box, *a, **k):\n    n = Box()\n    n += 1\n    b, c = g()\n    d = Box()\n    [e for e in y]\n    (h := q())\n    with o() as p:\n        p.run()\n    x.area()\n    n.area()\n    d.area()\n    match x:\n        case {'a': r, **s}:\n            r.area()\n"
    nodes, edges = extract_python.extract("a.py", code)
    typed = {e["via_member"]: e["recv_type"] for e in edges if e.get("via_member")}
    assert [n["name"] for n in nodes] == ["a.py", "f"] and typed == {"p": None, "x": "Box", "n": None, "d": "Box", "r": None}


def test_deep_and_broken_files():
    deep = "x = " + "+".join(["1"] * 20_000) + "\ndef f():\n    return g()\n"
    for code in (deep, "def (", "\ufeffdef f():\n    pass\n", "def f():\r    return 1\r", "a = '\\ud800'\n", "(" * 5000):
        nodes, _ = extract_python.extract("a.py", code)
        assert nodes[0]["kind"] == "file"
    assert len(extract_python.extract("a.py", "\ufeffdef f():\n    pass\n")[0]) == 2


def test_standard_library():
    root = sysconfig.get_paths()["stdlib"]
    paths = [p for p in sorted(glob.glob(f"{root}/*.py") + glob.glob(f"{root}/asyncio/*.py") + glob.glob(f"{root}/test/test_[a-g]*.py")) if os.path.isfile(p)]
    assert len(paths) > 150
    found = 0
    for p in paths:
        with open(p, encoding="utf-8", errors="replace") as f:
            nodes, edges = extract_python.extract(p, f.read())
        found += len(nodes)
        assert len({n["id"] for n in nodes}) == len(nodes)
    assert found > 5000


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    for name, text in {
        "a/__init__.py": "def first():\n    return 1\n",
        "a/_priv.py": "VALUE = 3\ndef hidden():\n    return first()\n",
        "a/.dot.py": "def dotted():\n    return 1\n",
        "a/empty.py": "",
        "a/y.js": "function only_js() { return 1; }\n",
        "a/z.py": "from a._priv import VALUE\n\n\ndef call():\n    only_js()\n    VALUE()\n    return hidden()\n",
        "a/bad.py": "def f(:\n",
        "dist/d.py": "def built():\n    return 1\n",
        "venv/v.py": "def not_mine():\n    return 1\n",
    }.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    (root / "a/latin.py").write_bytes(b"x = '\xe9'\n")
    return root


def test_every_file_is_read(spark, tree):
    got = {r["path"]: r for r in files.read_tree(spark, str(tree)).collect()}
    assert set(got) == {"a/__init__.py", "a/_priv.py", "a/.dot.py", "a/empty.py", "a/y.js", "a/z.py", "a/bad.py", "dist/d.py"}
    assert all(r["size"] == len(r["content"].encode()) and (r["size"] > 0 or p == "a/empty.py") for p, r in got.items())


def test_families_and_kinds(spark, tree):
    tagged = extract.extract_files(files.read_tree(spark, str(tree)).select("path", "content", "file_ord")).cache()
    edges = {(r["source"], r["target"]) for r in resolve.resolve(extract.nodes_of(tagged), extract.raw_edges_of(tagged)).filter("relation = 'calls'").collect()}
    assert edges == {("a/z.py#call", "a/_priv.py#hidden"), ("a/_priv.py#hidden", "a/__init__.py#first")}


def test_callers_of_a_file_and_bad_patterns(spark, tree, monkeypatch):
    import io
    import json

    reader = Reader(Workspace(spark, str(tree)))
    assert "a/z.py#call" in reader.callers("a/_priv.py")
    ask = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "find_all", "arguments": {"pattern": "["}}}
    assert handle(reader, ask)["result"]["isError"]
    monkeypatch.setattr("symgraph.server.open_reader", lambda root: reader)
    start = {"jsonrpc": "2.0", "id": 0, "method": "initialize", "params": {"protocolVersion": "2025-06-18"}}
    out = io.StringIO()
    serve("", io.StringIO("\n".join(map(json.dumps, ([ask], start, [ask], ask)))), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert isinstance(replies[0], list) and replies[2]["error"]["code"] == -32600 and replies[3]["result"]["isError"]


def test_terms_and_ranking(spark):
    from symgraph.functions.text import terms

    one = spark.createDataFrame([("How does sha256HTTPServer parsing work with classes?",)], "q string")
    assert one.select(terms("q").alias("t")).first()["t"] == ["sha", "256", "http", "server", "pars"]
    rows = [
        ("a.py#load", "load", "load", "def load(path)", "reads a file", "a.py", "function"),
        ("b.py#reload", "reload", "reload", "def reload()", "load load load", "b.py", "function"),
        ("tests/t.py#load_it", "load_it", "load_it", "def load_it()", "load", "tests/t.py", "function"),
        ("c.py#x", "x", "x", "x = require ('load')", "", "c.py", "variable"),
        ("d.py", "d.py", "d.py", None, None, "d.py", "file"),
    ]
    docs = spark.createDataFrame(rows, "id string, name string, qualified string, signature string, body string, path string, kind string")
    score = {r["id"]: r["score"] for r in search.lexical(docs, ["load"], "where is load() in the latest contest?").collect()}
    assert set(score) == {"a.py#load", "b.py#reload", "tests/t.py#load_it", "c.py#x"}
    assert max(score, key=score.get) == "a.py#load" and score["tests/t.py#load_it"] < score["b.py#reload"] * 2
    asked = {r["id"]: r["score"] for r in search.lexical(docs, ["load"], "load in the test").collect()}
    assert abs(asked["tests/t.py#load_it"] - score["tests/t.py#load_it"] / 0.4) < 1e-9


def test_blast_order(spark):
    nodes = spark.createDataFrame([("p.py", "p.py"), ("p.py#f", "p.py")], "id string, path string")
    edges = spark.createDataFrame([(f"q{i:02d}", "p.py#f", "calls", 20 - i) for i in range(20)], "source string, target string, relation string, ord int")
    assert [r["source"] for r in graph.blast_first(nodes, edges, "p.py").collect()] == [f"q{i:02d}" for i in range(19, 11, -1)]

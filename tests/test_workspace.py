"""Builds, incremental refresh, the queries' text and the tool server, over one small tree."""

import pytest

from symgraph.plans.workspace import Workspace
from symgraph.render import Reader
from symgraph.server import handle


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "a").mkdir()
    (root / "a/one.py").write_text("def load(path):\n    return open(path)\n\n\ndef store(path):\n    return load(path)\n")
    (root / "a/two.py").write_text("from a.one import load\n\n\ndef run():\n    return load('x')\n")
    return root


def test_build_and_ask(spark, tree):
    w = Workspace(spark, str(tree))
    first = w.build()
    assert (first["files"], first["misses"], first["hits"], first["changed"]) == (2, 2, 0, True)
    assert w.build()["changed"] is False and w.check() == "fresh"
    (tree / "a/two.py").write_text("from a.one import load, store\n\n\ndef run():\n    store('x')\n    return load('x')\n")
    assert w.check() == "stale"
    second = w.build()
    assert (second["misses"], second["hits"]) == (1, 1)
    edges = {(r["source"], r["target"]) for r in w._table("edges").filter("relation = 'calls'").collect()}
    assert edges == {("a/one.py#store", "a/one.py#load"), ("a/two.py#run", "a/one.py#load"), ("a/two.py#run", "a/one.py#store")}
    r = Reader(w)
    assert "a/two.py#run calls" in r.callers("load") and r.check().startswith("fresh")
    assert r.grep("load(", literal=True).splitlines()[0] == "3 lines in 2 files"
    call = lambda name, **a: handle(r, {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})
    assert "def store(path)" in call("file_outline", path="a/one.py")["result"]["content"][0]["text"]
    assert call("trace_calls")["result"]["isError"] and call("nothing")["error"]["code"] == -32602
    assert handle(r, {"jsonrpc": "2.0", "method": "x"}) is None and handle(r, [])["error"]["code"] == -32600
    assert handle(r, {"jsonrpc": "2.0", "id": 2, "method": "nope"})["error"]["code"] == -32601


def test_parts_of_answers():
    import re

    from symgraph.render import STRUCTURAL, _excerpt, _next_step, _signature

    asked = lambda q: next(((m.group(1), d) for p, d in STRUCTURAL if (m := re.search(p, q, re.I))), None)
    assert asked("Who calls `a.load`?") == ("a.load", "in") and asked("what does store call") == ("store", "out") and asked("where is it") is None
    hit = {"id": "a.py#f", "path": "a.py", "start_line": 9, "end_line": 20}
    lines = [f"line {i}" for i in range(1, 30)]
    assert _excerpt(hit, lines, 8)[0] == "      9  line 9" and _excerpt(hit, lines, 8)[-1] == "     … +4 more lines (L17-L20)" and len(_excerpt(hit, lines, 80)) == 12
    assert len(_signature("x " * 300)) == 200 and _next_step([]).startswith("no hits") and _next_step([hit]).startswith("only 1 hit;") and _next_step([hit] * 4).startswith("not here?")

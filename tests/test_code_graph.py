"""A small source tree, from files to resolved edges."""

from symgraph.operators import extract, graph, resolve, search
from symgraph.sources import files

TREE = {
    "app/__init__.py": "",
    "app/shapes.py": '''"""Shapes."""
LIMIT = 3
scale = 2


class Shape:
    def area(self):
        return self.size() * scale

    def size(self):
        return LIMIT


class Square(Shape):
    @property
    def side(self):
        return 1

    def twice(self):
        return self.area() * 2
''',
    "app/run.py": '''import json
from app import shapes
from app.shapes import Square as Box, Shape
from .tools import helper


def main(shape: Shape, n=1):
    box = Box()
    shape.area()
    helper()
    json.dumps(n)
    shapes.Square()
    lonely()

    def inner():
        return helper()

    return inner()
''',
    "app/tools.py": "from app.shapes import *\n\n\ndef helper():\n    return missing()\n\n\ndef lonely():\n    return helper()\n",
    "app/broken.py": "def (:\n",
    "skip/x.py": "y = 1\n",
    ".gitignore": "skip/\n*.log\n!keep.log\n",
    "a.log": "",
    "keep.log": "",
}


def test_tree_to_graph(spark, tmp_path):
    for path, text in TREE.items():
        p = tmp_path / path
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    assert files.walk(str(tmp_path)) == [".gitignore", "app/__init__.py", "app/broken.py", "app/run.py", "app/shapes.py", "app/tools.py", "keep.log"]
    table = files.read_tree(spark, str(tmp_path))
    tagged = extract.extract_files(table).cache()
    nodes, raw = extract.nodes_of(tagged).cache(), extract.raw_edges_of(tagged)
    got = {(r["id"], r["kind"], r["start_line"], r["end_line"]) for r in nodes.collect()}
    assert ("app/shapes.py#Square.side", "method", 16, 17) in got
    assert ("app/shapes.py#LIMIT", "constant", 2, 2) in got and ("app/shapes.py#scale", "variable", 3, 3) in got
    assert ("app/run.py#main.inner", "function", 15, 16) in got
    assert [x for x in got if x[0].startswith("app/broken")] == [("app/broken.py", "file", 1, 2)]
    sign = {r["id"]: r["signature"] for r in nodes.collect()}
    assert sign["app/run.py#main"] == "def main(shape: Shape, n=1)"
    edges = resolve.resolve(nodes, raw).cache()
    have = {(r["source"], r["target"], r["relation"], r["confidence"]) for r in edges.collect()}
    want = {
        ("app/run.py", "json", "imports", "extracted"),
        ("app/run.py", "app/__init__.py", "imports", "extracted"),
        ("app/run.py", "app/shapes.py", "imports", "extracted"),
        ("app/run.py", "app/tools.py", "imports", "extracted"),
        ("app/tools.py", "app/shapes.py", "imports", "extracted"),
        ("app/shapes.py#Square", "app/shapes.py#Shape", "extends", "extracted"),
        ("app/shapes.py#Shape.area", "app/shapes.py#Shape.size", "calls", "extracted"),
        ("app/shapes.py#Square.twice", "app/shapes.py#Shape.area", "calls", "extracted"),
        ("app/run.py#main", "app/shapes.py#Square", "calls", "extracted"),
        ("app/run.py#main", "app/shapes.py#Shape.area", "calls", "extracted"),
        ("app/run.py#main", "app/tools.py#helper", "calls", "extracted"),
        ("app/run.py#main.inner", "app/tools.py#helper", "calls", "extracted"),
        ("app/run.py#main", "app/run.py#main.inner", "calls", "extracted"),
        ("app/run.py#main", "app/tools.py#lonely", "calls", "inferred"),
        ("app/tools.py#lonely", "app/tools.py#helper", "calls", "extracted"),
    }
    assert {x for x in have if x[2] != "contains"} == want
    assert len([x for x in have if x[2] == "contains"]) == nodes.filter("kind <> 'file'").count()
    assert graph.validate(nodes.select("id", "path", "start_line", "end_line"), edges).count() == 0
    assert [r["id"].split("#")[1] for r in search.skeleton(nodes, "app/shapes.py").collect()][:3] == ["LIMIT", "scale", "Shape"]

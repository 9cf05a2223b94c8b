"""Cards, concept pages, state files, transcripts, savings, probes, payloads."""

import json
import os

import pytest
from pyspark.sql import functions as F

from symgraph.functions.text import register_functions
from symgraph.operators import hooks, meaning
from symgraph.plans import cards, state

NODE = "id string, name string, kind string, path string, start_line int, end_line int, summary string, signature string, ord long"


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        ("src/a.js", "a.js", "file", "src/a.js", 1, 9, "Adds\nmore", None, 1),
        ("src/a.js#g", "g", "function", "src/a.js", 5, 6, None, "function g( x )", 3),
        ("src/a.js#f", "f", "function", "src/a.js", 1, 3, " Does f.\nReally.", "function f()", 2),
        ("src/a.ts", "a.ts", "file", "src/a.ts", 1, 1, None, None, 4),
        ("index.py", "index.py", "file", "index.py", 1, 1, None, None, 5),
        ("lib/Util.py", "Util.py", "file", "lib/Util.py", 1, 1, None, None, 6),
        ("lib/.env", ".env", "file", "lib/.env", 1, 1, None, None, 7),
    ]
    return spark.createDataFrame(rows, NODE)


def test_card_names(spark, nodes):
    got = {r["path"]: r["card"] for r in cards.card_names(nodes.filter("kind = 'file'")).collect()}
    assert got == {"src/a.js": "src/a.js.md", "src/a.ts": "src/a.ts.md", "index.py": "index.py.md", "lib/Util.py": "lib/Util.md", "lib/.env": "lib/.env.md"}


def test_cards_are_written_where_they_changed(spark, nodes, tmp_path):
    sources = spark.createDataFrame([("adding", "src/a.js")], "slug string, path string")
    concepts = spark.createDataFrame([("adding", 'Add"ing', "process", "Sums.")], "slug string, name string, type string, summary string")
    links = spark.createDataFrame([("adding", "other", "part_of")], "slug string, to string, relation string")
    every = cards.file_cards(nodes, sources).unionByName(cards.concept_cards(concepts, sources, links, nodes))
    out = str(tmp_path / "out")
    assert cards.write_cards(every, out) == {"files": 7, "removed": 0} and cards.intact(out)
    read = lambda p: open(os.path.join(out, p)).read()
    assert read("src/a.js.md") == "# src/a.js · [[adding]]\n\nAdds\n\n- f · function · L1-L3 — Does f.\n- g · function · L5-L6 — function g( x )\n"
    page = read("concepts/adding.md")
    assert 'name: "Add\\"ing"' in page and '"at":"src/a.js:L1-L3"' in page and "- part of [[other]]" in page and page.endswith(cards.NOTES)
    with open(os.path.join(out, "concepts/adding.md"), "a") as f:
        f.write("mine\n")
    assert not cards.intact(out)
    times = {p: os.stat(os.path.join(out, p)).st_mtime_ns for p in ("src/a.ts.md", "lib/Util.md")}
    fewer = every.filter("name <> 'lib/Util.md'")
    assert cards.write_cards(fewer, out) == {"files": 6, "removed": 1}
    assert read("concepts/adding.md").endswith("mine\n") and not os.path.exists(os.path.join(out, "lib/Util.md")) and os.stat(os.path.join(out, "src/a.ts.md")).st_mtime_ns == times["src/a.ts.md"]
    assert [r["name"] for r in cards.gone(every, fewer).collect()] == ["lib/Util.md"]
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine/index.py.md").write_text("own")
    with pytest.raises(FileExistsError):
        cards.write_cards(cards.file_cards(nodes), str(tmp_path / "mine"))
    assert (tmp_path / "mine/index.py.md").read_text() == "own"


def test_state_files(spark, nodes, tmp_path):
    path = str(tmp_path / "s/state.json")
    assert state.read_state(path) == {}
    assert state.update_state(path, lambda s: s | {"n": s.get("n", 0) + 1}) == {"n": 1} and state.update_state(path, lambda s: s | {"n": s["n"] + 1})["n"] == 2
    open(path, "w").write("{")
    assert state.read_state(path) == {}
    with state.locked(str(tmp_path / "lock")), pytest.raises(TimeoutError), state.locked(str(tmp_path / "lock"), 0.2):
        pass
    (tmp_path / "w/.symgraph").mkdir(parents=True)
    (tmp_path / "w/.symgraph/manifest.json").write_text("{}")
    (tmp_path / "w/deep/er").mkdir(parents=True)
    assert state.workspace_root(str(tmp_path / "w/deep/er")) == str(tmp_path / "w") and state.workspace_root("/") is None
    timer = state.Phases()
    timer.mark("a")
    timer.mark("a")
    assert set(timer.seconds) == {"a"}
    edges = spark.createDataFrame([("src/a.js", "src/a.js#f", "contains", "extracted", 1)], "source string, target string, relation string, confidence string, ord long")
    state.write_json(nodes, edges, str(tmp_path / "g.json"))
    back, links = state.read_json(spark, str(tmp_path / "g.json"))
    assert {r["id"] for r in back.collect()} == {r["id"] for r in nodes.collect()} and links.first()["target"] == "src/a.js#f"
    assert state.read_json(spark, path) is None


def test_transcripts_paths_and_savings(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("x" * (1 << 20) + '\n{"a": 1}\nnot json\n[1]\n\n{"b": {"c": 2}}\n')
    got = hooks.transcript_tail(spark.createDataFrame([(str(tmp_path / "t.jsonl"),), ("/nowhere",)], "path string"))
    assert [r["e"] for r in got.orderBy("line_no").select(F.to_json("entry").alias("e")).collect()] == ['{"a":1}', '{"b":{"c":2}}']
    texts = spark.createDataFrame([(1, "see src\\a.py and lib/b.py:L1-L9. src/a.py."), (2, "none")], "id int, text string")
    files = spark.createDataFrame([("src/a.py",), ("lib/b.py",), ("c.py",)], "path string")
    assert [r["path"] for r in hooks.paths_in(texts, files).orderBy("at").collect()] == ["src/a.py", "lib/b.py"]
    said = spark.createDataFrame([("s", "[symgraph] tokens saved ≈ 1,200 (3%)\n[symgraph] tokens saved ≈ 30"), ("s", "⚡ symgraph saved ~12k tokens")], "session string, text string")
    assert [r[0] for r in said.select(hooks.savings_in("text")).collect()] == [1230, 0]
    assert tuple(hooks.tallies(said).first()) == ("s", 2, 1)
    held = spark.createDataFrame([("s", ["b", "a", "c"], ["c"])], "session string, stale array<string>, pending array<string>")
    assert hooks.still_stale(held).first()["stale"] == ["a", "b"]


def test_probe(spark):
    hits = spark.createDataFrame([("load_file", "a.py", "load_file", "def load_file(p)", "opens"), ("x", "b.py", "x", None, "path of a file")], "name string, path string, qualified string, signature string, body string")
    assert tuple(hooks.probe(hits, ["load", "path", "zzz"]).first()) == (1 / 3, 1 / 3, True)
    assert tuple(hooks.probe(hits.limit(0), ["load"]).first()) == (0.0, 0.0, False) and not hooks.probe(hits, []).first()["good"]


def test_payloads_and_batches(spark):
    want = {"nodes": [1]}
    for text in ('```json\n{"nodes": [1]}\n```', 'Sure: {"name": "t", "arguments": "{\\"nodes\\": [1]}"} done', '[{"name": "other", "args": {"nodes": [2]}}, {"parameters": {"nodes": [1]}}]'):
        assert meaning.recover(text, ["t"], "nodes") == want
    assert meaning.recover("no", ["t"], "nodes") is None and meaning.recover(None, [], "nodes") is None and meaning.recover('{"nodes": 3}', [], "nodes") is None
    rows = spark.createDataFrame([(1, '{"nodes": [1]}'), (2, None)], "id int, text string")
    assert {r["id"]: r["payload"] for r in meaning.recover_payloads(rows, [], "nodes").collect()} == {1: json.dumps(want), 2: None}
    files = [(0, "a", "1"), (0, "b", None), (1, "b", None), (1, "a", "1"), (2, "a", "2")]
    keys = {r["batch"]: r["key"] for r in meaning.batch_keys(spark.createDataFrame(files, "batch int, path string, body_hash string")).collect()}
    assert keys[0] == keys[1] != keys[2]
    sources = spark.createDataFrame([("a", "x.py")], "slug string, path string")
    links = spark.createDataFrame([("b", "a"), ("b", "c")], "slug string, to string")
    concepts = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "slug string")
    assert {tuple(r) for r in meaning.inherited_sources(sources, links, concepts).collect()} == {("a", "x.py"), ("b", "x.py"), ("c", "x.py")}
    assert meaning.keep_previous("new", "old", 1) == "old" and meaning.keep_previous("new", None, 1) == "new" and meaning.keep_previous("new", "old", 0) == "new"


def test_symbol_requests(spark):
    nodes = spark.createDataFrame([("a.py#f", "function", "a.py", "pending"), ("a.py#g", "function", "a.py", "ready"), ("b.py#h", "function", "b.py", "ready")], "id string, kind string, path string, summary_state string")
    lines = spark.createDataFrame([("a.py", 2, "  pass"), ("a.py", 1, "def f():"), ("b.py", 1, "x")], "path string, line_no int, line string")
    asked = meaning.symbol_requests(nodes, lines)
    assert [tuple(r) for r in asked.collect()] == [("a.py", "1  def f():\n2    pass", ["a.py#f"])]
    assert meaning.omitted(asked, spark.createDataFrame([], "path string, id string")).first()["wanted"] == ["a.py#f"]
    assert tuple(meaning.coverage(nodes).first()) == (2, 3, 67)


def test_sql_functions(spark):
    register_functions(spark)
    assert spark.sql("SELECT tokenize_text('parsing HTTPServers of sha256') AS t, stem_word('parties') AS s, occurrences('aXbX', 'X') AS n, slug_ascii('Ä b') AS g").first().asDict() == {"t": ["pars", "http", "server", "sha", "256"], "s": "party", "n": 2, "g": "a-b"}

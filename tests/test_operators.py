"""Operators against plain Python, and the streaming programs."""

import random

from symgraph.functions.ignore import compile_rules, ignored, selected
from symgraph.operators import graph, meaning
from symgraph.streaming import sessions


def test_ignore_rules():
    rules = compile_rules("build/\n*.tmp\n!keep.tmp\n/top.txt\na/**/z\n# note\n") + compile_rules("*.md\n", "docs")
    assert ignored("x/build", True, rules) and not ignored("x/build", False, rules)
    assert ignored("x/y.tmp", False, rules) and not ignored("x/keep.tmp", False, rules)
    assert ignored("top.txt", False, rules) and not ignored("x/top.txt", False, rules)
    assert ignored("a/b/c/z", False, rules) and ignored("a/z", False, rules)
    assert ignored("docs/r.md", False, rules) and not ignored("r.md", False, rules)
    assert selected("src/a.py", ["src"], []) and not selected("lib/a.py", ["src"], []) and not selected("src/a_test.py", ["src"], ["*_test.py"])


def test_reach_equals_plain_search(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(90)}
    edges = spark.createDataFrame(sorted(pairs), "source long, target long")
    want = set()
    for seed in (0, 7, 20):
        level, seen, now = 0, {seed}, {seed}
        while now:
            level += 1
            now = {t for s, t in pairs if s in now} - seen
            seen |= now
            want |= {(seed, x, level) for x in now}
    seeds = spark.createDataFrame([(0,), (7,), (20,)], "id long")
    assert {tuple(r) for r in graph.reach(edges, seeds).select("seed", "id", "level").collect()} == want
    assert {tuple(r) for r in graph.reach(edges, seeds, 2).select("seed", "id", "level").collect()} == {x for x in want if x[2] <= 2}


def test_traverse_lists_in_discovery_order(spark):
    rows = [("a", "b", "calls", "extracted"), ("a", "c", "calls", "inferred"), ("b", "d", "calls", "extracted"), ("c", "d", "calls", "extracted"), ("d", "a", "calls", "extracted"), ("a", "e", "contains", "extracted")]
    edges = spark.createDataFrame(rows, "source string, target string, relation string, confidence string")
    got = [tuple(r) for r in graph.traverse(edges, "a", "out").orderBy("pos").collect()]
    assert got == [(1, 1, "a", "b", "calls", False), (2, 1, "a", "c", "calls", True), (3, 2, "b", "d", "calls", False)]


def test_summaries_stop_after_failures(spark):
    files = spark.createDataFrame([(f"f{i}", "x") for i in range(8)], "path string, content string").coalesce(1)

    def make():
        def model(path, content):
            raise ValueError("no")

        return model

    got = [r["error"] for r in meaning.summarise(files, make).collect()]
    assert got.count("no") == meaning.MAX_FAILURES and got.count("skipped") == 3


def test_streams(spark, tmp_path):
    spark.createDataFrame([("s", "p1", ["a", "b"]), ("s", "p2", ["a", "c"]), ("t", "p3", [])], "session string, prompt string, hits array<string>").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, prompt string, hits array<string>").parquet(str(tmp_path / "in"))
    q = sessions.pointers(stream).writeStream.format("memory").queryName("pointed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["prompt"]: (r["pointers"], r["nudge"]) for r in spark.table("pointed").collect()}
    assert got == {"p1": (["a", "b"], False), "p2": (["c"], False), "p3": ([], True)}
    seen = []
    sessions.refresh(stream, lambda df, _: seen.append(df.count()), str(tmp_path / "r")).awaitTermination()
    assert seen == [3]

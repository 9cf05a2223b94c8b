"""Text of query results, on the driver: results are under the queries' limits."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions import text
from symgraph.operators import graph, search
from symgraph.plans.workspace import Workspace
from symgraph.session import local_session, staged

LINE, GROUP_LINES, GROUPS, CALLERS = 160, 8, 60, 400

#: Lines of an excerpt, of a full one, hits that get those, characters of a signature, hits that are few; questions for callers and calls.
SOME_LINES, FULL_LINES, FULL_HITS, SIGNATURE, FEW = 8, 80, 2, 200, 3
STRUCTURAL = (
    (r"\b(?:who|what)\s+calls\s+`?([\w.#/~-]+)", "in"),
    (r"\bcallers?\s+of\s+`?([\w.#/~-]+)", "in"),
    (r"\bwhat\s+uses\s+`?([\w.#/~-]+)", "in"),
    (r"\bwhat\s+does\s+`?([\w.#/~-]+)`?\s+call", "out"),
    (r"\bcallees?\s+of\s+`?([\w.#/~-]+)", "out"),
)


def _span(r) -> str:
    return f"{r['path']}:L{r['start_line']}-L{r['end_line']}"


def _signature(signature: str) -> str:
    flat = " ".join(signature.split())
    return flat if len(flat) <= SIGNATURE else flat[: SIGNATURE - 1] + "…"


def _excerpt(r, lines: list[str], limit: int) -> list[str]:
    """A hit's first lines, numbered, and how many more there are."""
    own = lines[r["start_line"] - 1 : r["end_line"]]
    width = len(str(r["start_line"] + min(len(own), limit)))
    rows = [f"     {r['start_line'] + i:>{width}}  {x}" for i, x in enumerate(own[:limit])]
    return rows + ([f"     … +{len(own) - limit} more lines (L{r['start_line'] + limit}-L{r['end_line']})"] if len(own) > limit else [])


def _next_step(ranked: list) -> str:
    """What to ask next, more firmly where few definitions match at all."""
    path, symbol = (ranked[0]["path"], ranked[0]["id"]) if ranked else ("<file>", "<symbol>")
    tools = f"grep for every occurrence · skeleton {path} for a file's definitions · callers {symbol} --direction out for what it calls"
    if len(ranked) <= FEW:
        found = f"only {len(ranked)} hit{'s' * (len(ranked) != 1)}" if ranked else "no hits"
        return f"{found}; other words won't help, use another tool: {tools}"
    return f"not here? use another tool: {tools}"


def _cut(line: str) -> str:
    line = line.strip()
    return line if len(line) <= LINE else line[: LINE - 1] + "…"


class Reader:
    """The queries over one workspace; arguments are checked before a job starts."""

    def __init__(self, workspace: Workspace):
        self.workspace = workspace

    def map(self) -> str:
        nodes, edges = self.workspace.tables()
        t = graph.totals(nodes, edges).first()
        rows = [f"{t['files']} files, {t['symbols']} symbols, {t['edges']} edges"]
        for r in graph.cluster_map(nodes).orderBy(F.desc("files"), "cluster").limit(12).collect():
            rows.append(f"  {r['cluster']}  {r['files']} files, {r['symbols']} symbols")
        rows.append("most referenced:")
        rows += [f"  {r['id']} ({r['kind']}, {r['refs']})" for r in graph.hotspots(nodes, edges).collect()]
        return "\n".join(rows)

    def skeleton(self, path: str) -> str:
        nodes, _ = self.workspace.tables()
        own = search.skeleton(nodes, _text(path)).collect()
        return "\n".join([f"{path}: {len(own)} definitions", *(f"  L{r['start_line']}-L{r['end_line']} {r['kind']} {r['signature'] or r['name']}" for r in own)])

    def callers(self, symbol: str, direction: str = "in", depth: object = 1) -> str:
        steps = _depth(depth)
        if direction not in ("in", "out"):
            raise ValueError("direction is in or out")
        nodes, edges = self.workspace.tables()
        spark = self.workspace.spark
        seeds = [r["id"] for r in graph.lookup(nodes, spark.createDataFrame([(_text(symbol),)], "query string")).orderBy("id").collect()]
        rows = []
        for seed in seeds:
            starts = graph.starts_of(nodes, seed) if "#" not in seed else [seed]
            found = graph.traverse(edges, seed, direction, steps, CALLERS + 1, starts).orderBy("pos").collect()
            more = found[CALLERS:]
            found = found[:CALLERS]
            rows.append(seed)
            rows += [f"{'  ' * r['level']}{'<-' if direction == 'in' else '->'} {r['other']} {r['relation']}{' (inferred)' if r['inferred'] else ''}{'' if r['parent'] == seed else ' via ' + r['parent']}" for r in found] or ["  none"]
            rows += [f"  … stopped after {CALLERS} symbols; more exist"] if more else []
        return "\n".join(rows) or f"no symbol {symbol}"

    def grep(self, pattern: str, literal: bool = False, ignore_case: bool = False, scope: str | None = None) -> str:
        _pattern(_text(pattern), literal)
        nodes, edges = self.workspace.tables()
        files = self.workspace.files()
        if scope:
            files = files.filter(F.col("path").startswith(scope.rstrip("/") + "/"))
        lines = files.select("path", F.posexplode(F.split("content", r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]", -1)).alias("p", "line")).withColumn("line_no", F.col("p") + 1).drop("p")
        hits = search.grep(lines, pattern, literal, ignore_case)
        found = search.enclosing(hits, nodes.filter("kind <> 'file'"), "path").withColumn("enclosing", F.coalesce("enclosing", "path"))
        found = staged(found, "hits")
        every = search.grep_groups(found, graph.reference_counts(nodes, edges), None)
        groups, n_groups = every.limit(GROUPS).collect(), every.count()
        total = found.agg(F.count("*").alias("n"), F.count_distinct("path").alias("f")).first()
        kept = search.top_per_key(found.join(F.broadcast(self.workspace.spark.createDataFrame([(g["enclosing"],) for g in groups], "enclosing string")), "enclosing"), "enclosing", ["line_no"], GROUP_LINES) if groups else None
        by = {}
        for r in kept.orderBy("enclosing", "line_no").collect() if kept is not None else []:
            by.setdefault(r["enclosing"], []).append(f"    {r['line_no']}: {_cut(r['line'])}")
        rows = [f"{total['n']} lines in {total['f']} files"]
        for g in groups:
            more = [f"    … {g['hits'] - GROUP_LINES} more"] if g["hits"] > GROUP_LINES else []
            rows += [f"  {g['enclosing']} ({g['hits']}, {g['refs']} in-edges)", *by[g["enclosing"]], *more]
        if n_groups > GROUPS:
            rows.append(f"… {n_groups - GROUPS} more symbols not shown; narrow the pattern or the scope")
        return "\n".join(rows)

    def ask(self, question: str, limit: object = 8, source: bool = False, full: bool = False, scope: str | None = None) -> str:
        """Ranked definitions; a question for callers or calls of a known symbol is answered by these."""
        count = _count(limit)
        for pattern, direction in STRUCTURAL:
            if found := re.search(pattern, _text(question), re.I):
                answer = self.callers(found.group(1).strip("`'\"?.,"), direction)
                if not answer.startswith("no symbol"):
                    return answer
        nodes, edges = self.workspace.tables()
        if scope:
            nodes = nodes.filter(F.col("path").startswith(scope.replace("\\", "/").strip("/") + "/"))
        one = self.workspace.spark.createDataFrame([(question,)], "q string")
        words = one.select(text.terms("q").alias("t")).first()["t"]
        if not words:
            return "nothing to look for"
        docs = nodes.select("id", "name", F.regexp_replace(F.substring_index("id", "#", -1), "~[0-9]+$", "").alias("qualified"), "signature", F.concat_ws(" ", "summary", "body").alias("body"), "path", "kind")
        hits = search.ask(docs, edges, words, question, search.SHORTLIST)
        ranked = hits.join(nodes.select("id", "kind", "path", "start_line", "end_line", "signature"), "id").orderBy(F.desc("score"), "id").collect()  # SHORTLIST rows at most
        shown = ranked[:count]
        lines = self._lines({r["path"] for r in shown}) if shown and (source or full) else {}
        rows = []
        for i, r in enumerate(shown, 1):
            rows.append(f"{i}. {r['id']} · {r['kind']} · {_span(r)} · {r['score']:.2f}")
            if r["signature"]:
                rows.append("   " + _signature(r["signature"]))
            if source or full:
                rows += _excerpt(r, lines.get(r["path"], []), FULL_LINES if full and i <= FULL_HITS else SOME_LINES)
        return "\n".join([*(rows or ["nothing found"]), _next_step(ranked)])

    def _lines(self, paths: set[str]) -> dict[str, list[str]]:
        """Lines of the files of a few hits."""
        own = self.workspace.files().filter(F.col("path").isin(*paths)).select("path", "content").collect()
        return {r["path"]: r["content"].splitlines() for r in own}

    def check(self) -> str:
        found = self.workspace.check()
        if found != "fresh":
            return found
        rows = [found]
        for r in self.workspace.meaning().orderBy("state").collect():
            more = f", … +{r['n'] - len(r['sample'])} more" if r["n"] > len(r["sample"]) else ""
            rows.append(f"{r['n']} {r['state']}: {', '.join(r['sample'])}{more}")
        return "\n".join(rows)


def _text(value: object) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError("a non-blank text is needed")
    return value


def _pattern(pattern: str, literal: bool) -> None:
    """Refuses a pattern that no regular expression is, before a job starts."""
    if not literal:
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"not a pattern: {e}") from e


def _count(value: object) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value) or value < 1:
        raise ValueError("a positive whole number is needed")
    return int(value)


def _depth(value: object) -> int | None:
    if value in ("all", "full"):
        return None
    return _count(int(value)) if isinstance(value, str) and value.isdigit() else _count(value)


def open_reader(root: str) -> Reader:
    return Reader(Workspace(local_session(os.environ.get("SYMGRAPH_CPUS", "*")), root))

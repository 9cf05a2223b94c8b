"""Text search: exhaustive by pattern, and ranked."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from symgraph.functions.text import all_terms, is_test_path, occurrences
from symgraph.operators.graph import pagerank, usage
from symgraph.session import staged

#: Weights of the fields, saturation, weight of a body's length, shares of related words and fragments, least length of a beginning, blend, sizes of the stages, penalties.
WEIGHTS = {"name": 4.0, "qualified": 2.0, "signature": 1.5, "body": 2.2}
SATURATION, LENGTH, RELATED, FRAGMENT, SHORT = 1.2, 0.75, 0.65, 0.3, 3
LEXICAL, CENTRAL = 0.75, 0.25
SHORTLIST, SEEDS = 600, 200
FILE_PENALTY, ALIAS_PENALTY, TEST_PENALTY = 0.5, 0.3, 0.4
TEST_WORDS = {"test", "tests", "testing", "spec"}


def grep(lines: DataFrame, pattern: str, literal: bool = False, ignore_case: bool = False) -> DataFrame:
    """Lines that match; the pattern runs in the scan's stage."""
    text = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E" if literal else pattern
    return lines.filter(F.col("line").rlike(("(?i)" if ignore_case else "") + text))


def enclosing(hits: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Each hit (key, line_no) with the innermost span (id, start_line, end_line) of its key around it, or null.

    The join has an equality on the file, so a line meets its file's spans alone.
    """
    s = spans.select(F.col(key).alias("_k"), "id", "start_line", "end_line")
    both = hits.join(s, (F.col(key) == F.col("_k")) & F.col("line_no").between(F.col("start_line"), F.col("end_line")), "left")
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "id", "start_line", "end_line")).alias("best")
    inside = both.groupBy(*hits.columns).agg(best)
    return inside.select(*hits.columns, F.col("best.id").alias("enclosing"), "best.start_line", "best.end_line")


def grep_groups(found: DataFrame, references: DataFrame, limit: int | None = 60) -> DataFrame:
    """path, enclosing, hits, refs: the spans with hits, those most referred to first, then by path, span and id. found: (path, enclosing, start_line, end_line); references: (id, refs)."""
    groups = found.groupBy("path", "enclosing").agg(F.count("*").alias("hits"), F.min("start_line").alias("start_line"), F.min("end_line").alias("end_line"))
    counted = groups.join(references.select(F.col("id").alias("enclosing"), "refs"), "enclosing", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    ordered = counted.orderBy(F.desc("refs"), "path", "start_line", "end_line", "enclosing")
    return (ordered.limit(limit) if limit else ordered).select("path", "enclosing", "hits", "refs")


def document_frequency(docs: DataFrame, words: list[str], *fields: str) -> DataFrame:
    """term, df over rows that hold the term as a part of any field; the terms are columns of one pass."""
    text = F.lower(F.concat_ws(" ", *fields))
    row = docs.agg(*(F.count_if(text.contains(w)).alias(f"t{i}") for i, w in enumerate(words)), F.count("*").alias("n"))
    return row.select("n", F.inline(F.array(*(F.struct(F.lit(w).alias("term"), F.col(f"t{i}").alias("df")) for i, w in enumerate(words)))))


def idf(frequencies: DataFrame) -> DataFrame:
    return frequencies.withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def _saturated(count, length=None):
    return count / (count + SATURATION * (length if length is not None else 1.0))


def name_count(parts: Column, word: str) -> Column:
    """How often a word is among a name's terms; one that shares its beginning counts RELATED, from three letters."""
    exact = F.size(F.filter(parts, lambda p: p == F.lit(word)))
    if len(word) < SHORT:
        return exact.cast("double")
    return exact + RELATED * F.size(F.filter(parts, lambda p: (p != F.lit(word)) & (p.startswith(word) | ((F.length(p) >= SHORT) & F.lit(word).startswith(p)))))


def _whole(tokens: str, word: str) -> tuple[Column, Column]:
    """How many of a text's terms are the word, and how many longer ones begin with it."""
    exact = F.size(F.filter(tokens, lambda t: t == F.lit(word)))
    return exact, F.size(F.filter(tokens, lambda t: (t != F.lit(word)) & t.startswith(word))) if len(word) >= SHORT else F.lit(0)


def _fields(docs: DataFrame) -> DataFrame:
    """id, kind, path, name, own (the qualified name), qualified (path and qualified name), signature, body."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return docs.select("id", "kind", text("path").alias("path"), text("name").alias("name"), text("qualified").alias("own"), F.concat_ws(" ", text("path"), text("qualified")).alias("qualified"), text("signature").alias("signature"), text("body").alias("body"))


def _score(words: list[str], weights: dict[str, float], average: float, question: str) -> Column:
    """Score of rows with counts c{word number}_{field}, length, kind, path, name, own and alias."""
    length = 1 - LENGTH + LENGTH * F.col("length") / average
    score, matched = F.lit(0.0), F.lit(0)
    for i, w in enumerate(words):
        each = {f: F.col(f"c{i}_{f}") for f in WEIGHTS}
        own = sum((F.lit(WEIGHTS[f]) * _saturated(c, length if f == "body" else None) for f, c in each.items()), F.lit(0.0))
        hit = reduce(lambda a, b: a | b, (c > 0 for c in each.values()))
        score = score + F.when(hit, F.lit(weights[w]) * own).otherwise(0.0)
        matched = matched + F.when(hit, 1).otherwise(0)
    asked = sorted({x.lower() for x in re.findall(r"[\w.]+", question)})
    if asked:
        named = F.lower("name").isin(asked) | F.lower("own").isin(asked)
        score = score + F.when(named & (score > 0), WEIGHTS["name"] * max(weights.values())).otherwise(0.0)
    score = score * F.sqrt(matched / F.lit(len(words)))
    score = score * F.when(F.col("kind") == "file", FILE_PENALTY).when((F.col("kind") == "variable") & F.col("alias"), ALIAS_PENALTY).otherwise(1.0)
    if not TEST_WORDS & {x.lower() for x in re.findall(r"\w+", question)}:
        score = score * F.when(is_test_path("path"), TEST_PENALTY).otherwise(1.0)
    return score


def lexical(docs: DataFrame, words: list[str], question: str = "") -> DataFrame:
    """id, score > 0 of the SHORTLIST best docs (id, name, qualified, signature, body, path, kind) for the terms.

    One scan of the text leaves counts by term and field; frequencies, lengths and the first score come from those.
    The best of it are scored again by tiers: whole words, words that begin with the term, other fragments.
    """
    words = list(dict.fromkeys(words))
    if not words:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    fields = _fields(docs)
    rest = ("qualified", "signature", "body")
    # What an array of one is exploded to is evaluated once, and not where it is used.
    low = fields.select("*", F.explode(F.array(F.struct(all_terms("name").alias("parts"), *(F.lower(f).alias(f) for f in rest)))).alias("x"))
    counts = [name_count(F.col("x.parts"), w).alias(f"c{i}_name") for i, w in enumerate(words)]
    counts += [occurrences(F.col(f"x.{f}"), F.lit(w)).alias(f"c{i}_{f}") for i, w in enumerate(words) for f in rest]
    kept = ("id", "kind", "path", "name", "own", "alias", "length")
    first = low.select(*kept[:5], F.col("signature").rlike(r"=\s*require\s*\(").alias("alias"), F.length("body").alias("length"), *counts)
    first = staged(first, "term-counts")
    some = [reduce(lambda a, b: a | b, (F.col(f"c{i}_{f}") > 0 for f in WEIGHTS)) for i in range(len(words))]
    totals = first.agg(F.count("*").alias("n"), F.avg("length").alias("a"), *(F.count_if(s).alias(f"d{i}") for i, s in enumerate(some))).first()
    weights = {w: math.log(1 + (max(totals["n"], 1) - totals[f"d{i}"] + 0.5) / (totals[f"d{i}"] + 0.5)) for i, w in enumerate(words)}
    average = totals["a"] or 1.0
    best = shortlist(first.select("*", _score(words, weights, average, question).alias("score")))
    best = staged(best.drop("score"), "shortlist")
    again = fields.join(F.broadcast(best.drop("kind", "path", "name", "own")), "id")  # SHORTLIST rows
    for f in rest:
        again = again.select("*", F.explode(F.array(all_terms(f))).alias(f"t_{f}"))
    for i, w in enumerate(words):
        for f in rest:
            exact, longer = _whole(f"t_{f}", w)
            fragment = F.greatest(F.lit(0), F.col(f"c{i}_{f}") - exact - longer)
            again = again.withColumn(f"c{i}_{f}", exact + RELATED * longer + FRAGMENT * fragment)
    return again.select("id", _score(words, weights, average, question).alias("score")).filter("score > 0")


def name_tiers(names: DataFrame, word: str) -> DataFrame:
    """id, exact, related, count: how many terms (parts) of a name are the word, or share its beginning."""
    exact = F.size(F.filter("parts", lambda p: p == F.lit(word)))
    count = name_count(F.col("parts"), word)
    return names.select("id", exact.cast("long").alias("exact"), F.round((count - exact) / RELATED).cast("long").alias("related"), count.alias("count"))


def shortlist(scored: DataFrame, limit: int = SHORTLIST) -> DataFrame:
    return scored.filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """Usage edges, both ways and as often as they are there, among what lies within so many hops of the seeds (id)."""
    e = usage(edges).filter("source <> target").select("source", "target")
    both = e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target")))
    steps = both.distinct()
    near = seeds.select("id").distinct()
    for _ in range(hops):
        near = near.unionByName(near.join(steps, near["id"] == steps["source"]).select(F.col("target").alias("id"))).distinct()
    near = staged(near, "near")
    return both.join(near.withColumnRenamed("id", "source"), "source", "left_semi").join(near.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")


def blend(scored: DataFrame, central: DataFrame) -> DataFrame:
    """id, score: three parts lexical, one part central, each by its largest."""
    top = scored.agg(F.max("score").alias("s")).crossJoin(central.agg(F.max("rank").alias("r")))  # one row by one row
    both = scored.join(central, "id", "left").crossJoin(F.broadcast(top))
    return both.select("id", (LEXICAL * F.col("score") / F.col("s") + CENTRAL * F.coalesce(F.col("rank") / F.nullif("r", F.lit(0.0)), F.lit(0.0))).alias("score"))


def ask(nodes: DataFrame, edges: DataFrame, words: list[str], question: str = "", limit: int = 8) -> DataFrame:
    """The best definitions for a question's terms: lexical shortlist, local PageRank, blend."""
    few = staged(lexical(nodes, words, question), "lexical")
    seeds = few.orderBy(F.desc("score"), "id").limit(SEEDS).select("id", F.col("score").alias("weight"))
    if seeds.isEmpty():
        return few.limit(0)
    central = pagerank(neighbourhood(edges, seeds), seeds)
    return blend(few, central).orderBy(F.desc("score"), "id").limit(limit)


def skeleton(nodes: DataFrame, path: str) -> DataFrame:
    """A file's definitions in source order."""
    own = nodes.filter((F.col("path") == path) & (F.col("kind") != "file"))
    return own.orderBy("start_line", "end_line", "id")


def residual(lines: DataFrame, spans: DataFrame, key: str, cap: int = 16_000) -> DataFrame:
    """Text of each file outside all spans: key, residual."""
    s = spans.select(F.col(key).alias("_k"), "start_line", "end_line")
    left = lines.join(s, (F.col(key) == F.col("_k")) & F.col("line_no").between(F.col("start_line"), F.col("end_line")), "left_anti")
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return left.groupBy(key).agg(F.substring(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), 1, cap).alias("residual"))


def top_per_key(df: DataFrame, key: str, order: list, limit: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= limit)

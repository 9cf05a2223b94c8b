"""Summaries' bookkeeping: batches, concepts, failures. The model itself is injected."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symgraph.functions.text import slug

#: Characters of a batch, of a file and of a file's numbered source; failures in a row that stop a pass.
BATCH_CHARS, FILE_CHARS, SOURCE_CHARS, MAX_FAILURES = 48_000, 24_000, 18_000, 5
LINK_RELATIONS = ("part_of", "uses", "depends_on", "produces", "configures", "validates", "implements")


def pack(rows: DataFrame, group: str, order: str, cost: str, budget: int = BATCH_CHARS) -> DataFrame:
    """rows with batch: greedy in order within a group; a batch ends before it would be over budget. A fold, so one pandas pass per group."""
    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        batches, held, batch = [], 0, 0
        for c in pdf[cost]:
            if held and held + c > budget:
                batch, held = batch + 1, 0
            held += c
            batches.append(batch)
        return pdf.assign(batch=batches)

    return rows.groupBy(group).applyInPandas(fold, schema)


def merge_concepts(drafts: DataFrame) -> DataFrame:
    """slug, name, type, summary, sources of drafts (ord, name, type, summary, source): the first name, the first type that isn't other, the longest summary (the first of these), all sources."""
    keyed = drafts.withColumn("slug", slug("name")).filter("slug <> ''")
    return keyed.groupBy("slug").agg(
        F.min_by("name", "ord").alias("name"),
        F.coalesce(F.min_by("type", F.when(F.col("type") != "other", F.col("ord"))), F.lit("other")).alias("type"),
        F.max_by("summary", F.struct(F.length("summary"), -F.col("ord"))).alias("summary"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
    )


def concept_links(drafts: DataFrame, links: DataFrame) -> DataFrame:
    """slug, to, relation of links (from_name, to_name, relation) whose ends are concepts, without self-links and unknown relations."""
    names = drafts.select(F.lower("name").alias("n"), slug("name").alias("slug")).distinct()
    a = names.select(F.col("n").alias("a"), "slug")
    b = names.select(F.col("n").alias("b"), F.col("slug").alias("to"))
    known = links.filter(F.col("relation").isin(*LINK_RELATIONS))
    return known.join(a, F.lower("from_name") == F.col("a")).join(b, F.lower("to_name") == F.col("b")).filter("slug <> `to`").select("slug", "to", "relation").distinct()


def summarise(files: DataFrame, make_model: Callable[[], Callable[[str, str], str]]) -> DataFrame:
    """path, summary, error of files (path, content), one model for each partition; a partition stops asking after MAX_FAILURES failures in a row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, failed = make_model(), 0
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                if failed >= MAX_FAILURES:
                    out.append((path, None, "skipped"))
                    continue
                try:
                    out.append((path, model(path, content[:FILE_CHARS]), None))
                    failed = 0
                except Exception as e:  # whatever a model raises is that file's result
                    failed += 1
                    out.append((path, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "summary", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, summary string, error string")


def batch_keys(batches: DataFrame) -> DataFrame:
    """batch, key: a hash of the batch's files (path, body_hash), whatever their order. Batches are of a bounded size (pack)."""
    line = F.concat_ws(":", "path", F.coalesce("body_hash", F.lit("")))
    return batches.groupBy("batch").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("key"))


def inherited_sources(sources: DataFrame, links: DataFrame, concepts: DataFrame) -> DataFrame:
    """slug, path: concepts' own sources; those of what a concept links to where it has none, else of what links to it."""
    own = sources.select("slug", "path").distinct()
    bare = concepts.select("slug").distinct().join(own, "slug", "left_anti")
    there = bare.join(links.select("slug", "to"), "slug").join(own.withColumnRenamed("slug", "to"), "to").select("slug", "path").distinct()
    left = bare.join(there, "slug", "left_anti").withColumnRenamed("slug", "to")
    back = left.join(links.select("slug", "to"), "to").join(own.unionByName(there), "slug").select(F.col("to").alias("slug"), "path").distinct()
    return own.unionByName(there).unionByName(back)


def keep_previous(new: DataFrame, previous: DataFrame | None, failed: int) -> DataFrame:
    """The new concepts, or the previous ones where a run that failed in part would replace them."""
    return previous if failed and previous is not None else new


def coverage(nodes: DataFrame) -> DataFrame:
    """ready, total, percent of definitions with a summary of their present body."""
    ready, total = F.count_if(F.col("summary_state") == "ready"), F.count("*")
    return nodes.agg(ready.alias("ready"), total.alias("total"), F.coalesce(F.bround(100 * ready / F.nullif(total, F.lit(0)), 0), F.lit(0)).cast("long").alias("percent"))


def _payload(value: object, tools: set[str], key: str) -> dict | None:
    """The first object below a value, or in a tool call around it, whose key is a list."""
    queue = [value]
    while queue:
        x = queue.pop(0)
        if isinstance(x, list):
            queue = x + queue
        elif isinstance(x, dict):
            name, given = x.get("name"), next((x[f] for f in ("parameters", "arguments", "args") if f in x), None)
            call = isinstance(name, str) or given is not None
            if call and isinstance(name, str) and name and name not in tools:
                continue
            if call and isinstance(given, str):
                try:
                    given = json.loads(given)
                except ValueError:
                    continue
            if call and (hit := _payload(given, tools, key)) is not None:
                return hit
            if isinstance(x.get(key), list):
                return x
    return None


def recover(text: str | None, tools: list[str], key: str) -> dict | None:
    """A tool's payload out of a model's plain text: whole, in a code fence, or from the first bracket to the last."""
    body = re.sub(r"^```(json|JSON)?|```$", "", (text or "").strip()).strip()
    spans = [body] + [body[body.find(a) : body.rfind(b) + 1] for a, b in ("{}", "[]") if 0 <= body.find(a) < body.rfind(b)]
    for span in spans:
        try:
            hit = _payload(json.loads(span), set(tools), key)
        except ValueError:
            continue
        if hit is not None:
            return hit
    return None


def recover_payloads(texts: DataFrame, tools: list[str], key: str) -> DataFrame:
    """id, payload (JSON, null where there is none) of texts (id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [recover(t, tools, key) for t in frame["text"]]
            yield frame[["id"]].assign(payload=[None if x is None else json.dumps(x) for x in found])

    return texts.select("id", "text").mapInPandas(run, f"id {texts.schema['id'].dataType.simpleString()}, payload string")


def symbol_requests(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """path, source, wanted: for each file with symbols that need a summary, its numbered lines (path, line_no, line), SOURCE_CHARS of them at most, and these symbols' ids. A group is one file."""
    need = nodes.filter("kind <> 'file' AND summary_state <> 'ready'").groupBy("path").agg(F.array_sort(F.collect_list("id")).alias("wanted"))
    text = lines.join(need.select("path"), "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    numbered = F.array_join(F.transform("x", lambda r: F.concat_ws("  ", r["line_no"].cast("string"), r["line"])), "\n")
    return need.join(text.select("path", F.substring(numbered, 1, SOURCE_CHARS).alias("source")), "path").select("path", "source", "wanted")


def omitted(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """path, wanted: what an answer (path, id) left out, to be asked for once more."""
    asked = requests.select("path", F.explode("wanted").alias("id"))
    return asked.join(answers.select("path", "id"), ["path", "id"], "left_anti").groupBy("path").agg(F.array_sort(F.collect_list("id")).alias("wanted"))

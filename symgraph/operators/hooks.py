"""What sessions say: transcripts, paths and savings named in texts, probes of a prompt, stale files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.functions.text import terms

#: Bytes of a transcript's end, floors of a probe, forms of a path, a saving and a tally.
TAIL = 1 << 20
STRONG, BROAD = 0.1, 0.5
PATH_TOKEN = r"[\w./\\-]+"
SAVING = r"\[symgraph\] tokens saved ≈ ([\d,]+)"
TALLY = r"(?i)symgraph\s+saved\s*[~≈]?\s*[\d,.]+\s*[km]?\s*(?:tok|tokens)"


def _tails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path in frame["path"]:
            try:
                with open(path, "rb") as f:
                    size = f.seek(0, os.SEEK_END)
                    f.seek(max(0, size - TAIL))
                    raw = f.read().decode("utf-8", "replace")
            except OSError:
                continue
            if size > TAIL:
                raw = raw.partition("\n")[2]  # the first line is cut
            rows += [(path, i, x) for i, x in enumerate(raw.splitlines()) if x.strip()]
        yield pd.DataFrame(rows, columns=["path", "line_no", "line"]).astype({"line_no": "int64"})


def transcript_tail(paths: DataFrame) -> DataFrame:
    """path, line_no, entry (a variant): the JSON objects at the end of transcripts (path); what can't be read is left out."""
    lines = paths.select("path").mapInPandas(_tails, "path string, line_no long, line string")
    entry = lines.select("path", "line_no", F.try_parse_json("line").alias("entry"))
    return entry.filter(F.col("entry").isNotNull() & F.schema_of_variant("entry").startswith("OBJECT"))


def paths_in(texts: DataFrame, files: DataFrame) -> DataFrame:
    """id, path, at: the known files (path) that texts (id, text) name, where first."""
    tokens = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(PATH_TOKEN), F.lit(0))).alias("at", "token"))
    named = tokens.select("id", "at", F.rtrim(F.replace("token", F.lit("\\"), F.lit("/")), F.lit(".")).alias("path"))
    return named.join(files.select("path").distinct(), "path", "left_semi").groupBy("id", "path").agg(F.min("at").alias("at"))


def savings_in(text: str | Column) -> Column:
    """The total of the savings that a text reports."""
    found = F.regexp_extract_all(text, F.lit(SAVING), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("long"), lambda s, x: s + F.replace(x, F.lit(","), F.lit("")).cast("long"))


def has_tally(text: str) -> Column:
    return F.col(text).rlike(TALLY)


def tallies(turns: DataFrame) -> DataFrame:
    """session, turns, reported: turns whose reply (text) gives a tally."""
    return turns.groupBy("session").agg(F.count("*").alias("turns"), F.count_if(has_tally("text")).alias("reported"))


def probe(hits: DataFrame, words: list[str]) -> DataFrame:
    """strong, broad, good: the best share of the words in a hit's name, and anywhere in a hit (name, path, qualified, signature, body). Both 0 without hits or words."""
    n = max(len(words), 1)
    text = F.lower(F.concat_ws(" ", "path", "qualified", F.coalesce("signature", F.lit("")), F.coalesce("body", F.lit(""))))
    strong = F.size(F.array_intersect(terms("name"), F.array(*map(F.lit, words)).cast("array<string>"))) / n
    broad = sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0)) / n
    best = hits.agg(F.coalesce(F.max(strong), F.lit(0.0)).alias("strong"), F.coalesce(F.max(broad), F.lit(0.0)).alias("broad"))
    return best.withColumn("good", (F.col("strong") >= STRONG) | (F.col("broad") >= BROAD))


def still_stale(sessions: DataFrame) -> DataFrame:
    """session, stale: files marked stale but for those that were pending when a sync began (stale, pending: arrays)."""
    return sessions.select("session", F.array_sort(F.array_except("stale", "pending")).alias("stale"))

"""Markdown cards of a graph: one for each file, one for each concept, and an index, written where they changed."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.functions.text import first_line_or_signature

INDEX, CONCEPTS, STAMPS = "INDEX.md", "concepts", ".cards.json"
START, END = "<!-- generated:start -->", "<!-- generated:end -->"
NOTES = "\n## Notes\n\n_What is written below the generated block stays._\n"


def _stem(path: str) -> Column:
    """A path with .md in place of its extension; names without one, or that only begin with a dot, get it appended."""
    return F.when(F.col(path).rlike(r"[^/]\.[^./]+$"), F.regexp_replace(path, r"\.[^./]+$", ".md")).otherwise(F.concat(path, F.lit(".md")))


def card_names(paths: DataFrame) -> DataFrame:
    """path, card: the stem, or the whole name where several paths (in any case), or the index, would share the stem."""
    named = paths.select("path").distinct().withColumn("stem", _stem("path")).withColumn("folded", F.lower("stem"))
    taken = named.groupBy("folded").agg((F.count("*") + F.max(F.when(F.col("folded") == INDEX.lower(), 1).otherwise(0))).alias("n"))
    return named.join(taken, "folded").select("path", F.when(F.col("n") == 1, F.col("stem")).otherwise(F.concat("path", F.lit(".md"))).alias("card"))


def _span() -> Column:
    return F.format_string("L%d-L%d", "start_line", "end_line")


def covers(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """slug, path, symbol, kind, at: the definitions in the files (path) that a concept (slug) is drawn from."""
    symbols = nodes.filter("kind <> 'file'").select("path", F.col("name").alias("symbol"), "kind", F.concat_ws(":", "path", _span()).alias("at"))
    return sources.select("slug", "path").distinct().join(symbols, "path").select("slug", "path", "symbol", "kind", "at")


def file_cards(nodes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """name, text of each file's card: its path and the concepts that cite it, its summary, a line for each definition in the order of the source. A group is one file's definitions."""
    files = nodes.filter("kind = 'file'").select("path", F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", first_line_or_signature()).alias("about"))
    meaning = first_line_or_signature()
    line = F.concat(F.format_string("- %s · %s · ", "name", "kind"), _span(), F.when(meaning != "", F.concat(F.lit(" — "), meaning)).otherwise(""))
    rows = nodes.filter("kind <> 'file'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("rows"))
    out = files.join(rows, "path", "left")
    if sources is not None:
        cited = sources.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_set("slug")), lambda s: F.concat(F.lit("[["), s, F.lit("]]"))), " ").alias("links"))
        out = out.join(cited, "path", "left")
    else:
        out = out.withColumn("links", F.lit(None).cast("string"))
    head = F.concat(F.lit("# "), "path", F.coalesce(F.concat(F.lit(" · "), "links"), F.lit("")))
    body = F.concat(F.array(head, F.lit("")), F.when(F.col("about").isNotNull(), F.array("about", F.lit(""))).otherwise(F.array().cast("array<string>")), F.coalesce(F.transform("rows", lambda r: r["line"]), F.array().cast("array<string>")))
    return out.join(card_names(nodes.filter("kind = 'file'")), "path").select(F.col("card").alias("name"), F.concat(F.array_join(body, "\n"), F.lit("\n")).alias("text"))


def concept_cards(concepts: DataFrame, sources: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, text of each concept's page (slug, name, type, summary): front matter with the symbols that it covers, summary, links. Notes are the sink's to keep."""
    by = lambda df, what, order: df.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct(*order, what.alias("line")))).alias("x")).select("slug", F.transform("x", lambda r: r["line"]).alias("x"))
    seen = by(covers(sources, nodes), F.concat(F.lit("  - "), F.to_json(F.struct("symbol", "kind", "at"))), ["path", "at", "symbol"]).withColumnRenamed("x", "covered")
    drawn = by(sources, F.concat(F.lit("  - "), F.to_json(F.struct("path"))), ["path"]).withColumnRenamed("x", "drawn")
    tied = by(links, F.concat(F.lit("- "), F.replace("relation", F.lit("_"), F.lit(" ")), F.lit(" [["), "to", F.lit("]]")), ["to", "relation"]).withColumnRenamed("x", "tied")
    none = F.array().cast("array<string>")
    every = concepts.join(drawn, "slug", "left").join(seen, "slug", "left").join(tied, "slug", "left")
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    front = F.concat(F.array(F.lit("---"), *(F.concat(F.lit(f"{c}: "), quoted(c)) for c in ("name", "slug", "type")), F.lit("sources:")), F.coalesce("drawn", none), F.array(F.lit("covers:")), F.coalesce("covered", none), F.array(F.lit("---"), F.lit(START)))
    related = F.when(F.size(F.coalesce("tied", none)) > 0, F.concat(F.array(F.lit("## Related"), F.lit("")), "tied", F.array(F.lit("")))).otherwise(none)
    summary = F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.lit("_(no summary)_"))
    body = F.concat(front, F.array(F.lit("## Summary"), F.lit(""), summary, F.lit("")), related, F.array(F.lit(END)))
    return every.select(F.concat(F.lit(f"{CONCEPTS}/"), "slug", F.lit(".md")).alias("name"), F.concat(F.array_join(body, "\n"), F.lit("\n")).alias("text"))


def gone(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Names of previous cards that aren't among the current ones."""
    return previous.select("name").join(current.select("name"), "name", "left_anti")


def _held(out: str) -> dict[str, list]:
    """Stamps of the last write; none where they can't be read."""
    try:
        with open(os.path.join(out, STAMPS), encoding="utf-8") as f:
            held = json.load(f)
    except (OSError, ValueError):
        return {}
    return held if isinstance(held, dict) else {}


def _write(out: str, held: dict[str, list]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, text in zip(frame["name"], frame["text"], strict=True):
                path, old = os.path.join(out, name), None
                try:
                    with open(path, "rb") as f:
                        old = f.read()
                except OSError:
                    pass
                if name.startswith(f"{CONCEPTS}/"):
                    before = old.decode("utf-8", "replace") if old is not None else ""
                    text += before.split(END, 1)[1].removeprefix("\n") if END in before else NOTES
                data = text.encode()
                if old is not None and old != data and name not in held:
                    rows.append((name, None, None, None))  # not ours
                    continue
                if old != data:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(path, "wb") as f:
                        f.write(data)
                stat = os.stat(path)
                rows.append((name, hashlib.sha256(data).hexdigest(), stat.st_size, stat.st_mtime_ns))
            yield pd.DataFrame(rows, columns=["name", "hash", "size", "mtime"]).astype({"size": "Int64", "mtime": "Int64"})

    return run


def write_cards(cards: DataFrame, out: str) -> dict[str, int]:
    """Writes cards (name, text) that changed below a folder that all executors share; deletes its own that are gone, and never replaces a file that it didn't write. files, removed."""
    held = _held(out)
    os.makedirs(out, exist_ok=True)
    index = cards.agg(F.count_if(~F.col("name").startswith(f"{CONCEPTS}/")).alias("files"), F.count_if(F.col("name").startswith(f"{CONCEPTS}/")).alias("concepts")).select(F.lit(INDEX).alias("name"), F.format_string("# Index\n\n%d files, %d concepts\n", "files", "concepts").alias("text"))
    rows = cards.unionByName(index).mapInPandas(_write(out, held), "name string, hash string, size long, mtime long").collect()  # a row for each file
    foreign = sorted(r["name"] for r in rows if r["hash"] is None)
    if foreign:
        raise FileExistsError(f"not written by this tool: {', '.join(foreign[:5])}" + (f" and {len(foreign) - 5} more" if len(foreign) > 5 else ""))
    new = {r["name"]: [r["hash"], r["size"], r["mtime"]] for r in rows}
    folded, removed = {n.casefold() for n in new}, 0
    for name in sorted(set(held) - set(new)):
        path = os.path.join(out, name)
        if name.startswith(f"{CONCEPTS}/") and os.path.exists(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                notes = f.read().split(END, 1)[-1].removeprefix("\n")
            if notes != NOTES:
                new[name] = held[name]  # a page without its concept keeps what its reader wrote
                continue
        if name.casefold() in folded or not os.path.exists(path):
            continue
        os.remove(path)
        removed += 1
        folder = os.path.dirname(path)
        while folder != out.rstrip("/") and not os.listdir(folder):
            os.rmdir(folder)
            folder = os.path.dirname(folder)
    with open(os.path.join(out, STAMPS), "w", encoding="utf-8") as f:
        json.dump(new, f, sort_keys=True)
    return {"files": len(rows), "removed": removed}


def intact(out: str) -> bool:
    """Whether all that the last write left is there with its size and time."""
    held = _held(out)
    for name, stamp in held.items():
        try:
            stat = os.stat(os.path.join(out, name))
        except OSError:
            return False
        if stamp[1:] != [stat.st_size, stat.st_mtime_ns]:
            return False
    return bool(held)

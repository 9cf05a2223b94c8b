"""Keeping a graph current by content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("body_hash", F.sha2("content", 256))


def split_by_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (path, body_hash) with hit: the cache has the path with the same hash."""
    known = cache.select(F.col("path").alias("_p"), F.col("body_hash").alias("_h"))
    return files.join(known, (F.col("path") == F.col("_p")), "left").withColumn("hit", F.coalesce(F.col("_h") == F.col("body_hash"), F.lit(False))).drop("_p", "_h")


def tree_fingerprint(files: DataFrame, parts: int = 256) -> DataFrame:
    """One row: count, fingerprint of (path, body_hash). Hashes of hash parts of the paths, then of these: no task holds all paths."""
    part = F.substring(F.sha2("path", 256), 1, 2)
    rows = F.array_sort(F.collect_list(F.concat_ws(":", "path", "body_hash")))
    each = files.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sha2(F.array_join(rows, "\n"), 256).alias("h"))
    return each.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda r: r["h"]), "\n"), 256).alias("fingerprint"))


def carry_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """new (id, body_hash, start_line) with summary, summary_state and crux_start of old: ready for the same body, stale for another, else pending.

    A ready crux moves with its definition's first line; a stale one keeps its text.
    """
    o = old.select(F.col("id").alias("_id"), F.col("body_hash").alias("_hash"), F.col("summary").alias("_summary"), F.col("summary_state").alias("_state"), F.col("start_line").alias("_start"), F.col("crux_start").alias("_crux"))
    both = new.join(o, F.col("id") == F.col("_id"), "left")
    has = F.col("_summary").isNotNull()
    ready = has & (F.col("_state") == "ready") & (F.col("_hash") == F.col("body_hash"))
    state = F.when(ready, "ready").when(has, "stale").otherwise("pending")
    crux = F.when(ready, F.col("_crux") + F.col("start_line") - F.col("_start")).when(has, F.col("_crux"))
    return both.select("id", "body_hash", "start_line", F.col("_summary").alias("summary"), state.alias("summary_state"), crux.alias("crux_start"))


def state_counts(nodes: DataFrame) -> DataFrame:
    return nodes.agg(*(F.count_if(F.col("summary_state") == s).alias(s) for s in ("ready", "pending", "stale")))


def check(stored: DataFrame, fresh: DataFrame, columns: list[str]) -> DataFrame:
    """side, and the rows of either that the other lacks, repeats counted."""
    a, b = stored.select(*columns), fresh.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("fresh")))


def retain(cache: DataFrame, files: DataFrame) -> DataFrame:
    return cache.join(files.select("path"), "path", "left_semi")


def crux_slice(nodes: DataFrame, max_lines: int = 12) -> DataFrame:
    """id, from_line, to_line, code: the marked lines (crux_from, crux_to) clamped to the definition, max_lines at most; blank code is null."""
    lo = F.greatest("crux_from", "start_line")
    hi = F.least("crux_to", "end_line", lo + max_lines - 1)
    code = F.array_join(F.slice(F.split("content", "\n", -1), lo.cast("int"), F.greatest(hi - lo + 1, F.lit(0)).cast("int")), "\n")
    return nodes.select("id", lo.alias("from_line"), hi.alias("to_line"), code.alias("code")).filter((F.col("to_line") >= F.col("from_line")) & (F.trim("code") != ""))

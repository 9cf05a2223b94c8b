"""Accounting of agents' sessions and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def classify(tool: str = "tool") -> Column:
    """graph or source read, else null."""
    return F.when(F.col(tool).isin("view", "search"), "graph").when(F.col(tool).isin("click", "purchase"), "source")


def session_stats(uses: DataFrame) -> DataFrame:
    """session, graph_reads, source_reads, mix (% of reads that are graph reads, half to even), saved (of graph reads)."""
    kind = classify()
    out = uses.withColumn("kind", kind).groupBy("session").agg(
        F.count_if(F.col("kind") == "graph").alias("graph_reads"),
        F.count_if(F.col("kind") == "source").alias("source_reads"),
        F.sum(F.when(F.col("kind") == "graph", F.col("saved_micros")).otherwise(F.lit(0))).alias("saved_micros"),
    )
    reads = F.col("graph_reads") + F.col("source_reads")
    return out.withColumn("mix", F.bround(F.try_divide(100 * F.col("graph_reads"), reads)).cast("long"))


def blended_rate(usage: DataFrame) -> DataFrame:
    """session, micros, tokens, rate (micros per token; null without tokens)."""
    out = usage.groupBy("session").agg(F.sum("micros").alias("micros"), F.sum("tokens").alias("tokens"))
    return out.withColumn("rate", F.try_divide("micros", "tokens"))


def price_micros(model: str, fresh: str, cache_write: str, cache_read: str, prices: dict[str, int]) -> Column:
    """Micro-dollars of token counts by the longest model prefix with a price (micros per thousand); cache writes cost 1.25, reads 0.1. Unpriced: null."""
    rate = F.lit(None).cast("long")
    for prefix, micros in sorted(prices.items(), key=lambda x: len(x[0])):
        rate = F.when(F.col(model).startswith(prefix), F.lit(micros)).otherwise(rate)
    twentieths = 20 * F.col(fresh) + 25 * F.col(cache_write) + 2 * F.col(cache_read)  # whole numbers, so that halves are exact
    return F.bround(rate * twentieths / 20_000).cast("long")


def turn_segments(entries: DataFrame) -> DataFrame:
    """entries (conv_id, turn, role) with segment: the number of user prompts up to each."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    return entries.withColumn("segment", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w))


def last_turn(entries: DataFrame) -> DataFrame:
    """conv_id, turns, chars of what came since the last user prompt; an aggregate, then a join, no sort."""
    last = entries.filter("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    since = entries.join(last, "conv_id").filter("turn > last")
    return since.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


def turn_billing(messages: DataFrame) -> DataFrame:
    """conv_id, billed: of repeated message ids the last counts; unpriced (null) and zero sums are left out."""
    last = messages.groupBy("conv_id", "message_id").agg(F.max_by("micros", "seq").alias("micros"))
    return last.filter("micros IS NOT NULL").groupBy("conv_id").agg(F.sum("micros").alias("billed")).filter("billed > 0")


def savings(mentions: DataFrame, sizes: DataFrame, packed_chars: str = "packed_chars") -> DataFrame:
    """key, files, base_tokens, pack_tokens, saved, percent: what reading the mentioned files would have cost. Nothing where it isn't more."""
    each = mentions.select("key", "path", packed_chars).dropDuplicates(["key", "path"]).join(sizes, "path")
    out = each.groupBy("key").agg(F.count("*").alias("files"), F.sum("chars").alias("base"), F.max(packed_chars).alias("pack"))
    out = out.select("key", "files", F.bround(F.col("base") / 4).cast("long").alias("base_tokens"), F.bround(F.col("pack") / 4).cast("long").alias("pack_tokens"))
    out = out.filter("base_tokens > pack_tokens").withColumn("saved", F.col("base_tokens") - F.col("pack_tokens"))
    return out.withColumn("percent", F.bround(100 * F.col("saved") / F.col("base_tokens")).cast("long"))


def longest_scope(paths: DataFrame, scopes: DataFrame) -> DataFrame:
    """path, prefix: the longest scope (prefix) around each path, by equality on the path's own prefixes."""
    parts = F.split("path", "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    found = paths.select("path", F.explode(each).alias("prefix")).join(scopes.select("prefix").distinct(), "prefix")
    return found.groupBy("path").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def latest(sessions: DataFrame) -> DataFrame:
    """The session that changed last: one row."""
    return sessions.agg(F.max_by("session", F.struct("mtime", "session")).alias("session"))

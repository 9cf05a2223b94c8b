"""Sharding by balanced label propagation, with DataFrame functions alone.

Law `rows`: the shards' counts are at most one apart. Equal texts are linked. Documents
start dealt out evenly in hash order; in each round every group of equal texts asks to
go where most of it is (a group larger than a shard: to as many shards as it needs), and
a shard pair's requests are granted as far as as many documents come back: first
requests the other way, then documents without a link, which are equally well anywhere.
So every round keeps the sizes and cuts fewer links. Rounds go on until PATIENCE of them, with ties and
turns drawn anew in each, cut no fewer; cut_links() counts what is cut, and `trace` of shards() receives it before and after each round.

State is (group, shard, n): no document moves until the end, and a group of any size is
eight rows at most. What is collected are sums per shard, pair of shards and hash bucket.

Nulls: a null text has no bytes and counts as equal to an empty one. Repeated rows are
documents of their own. A null doc_id is dealt like others. Other columns don't matter;
an empty table gives an empty one. A group larger than a shard fills as many as it needs.
Very long texts are hashed whole. Of shards that hold equally many of a group the one that
comes first by a hash of both is asked for.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from symgraph.llm.checked import join_skewed
from symgraph.session import drop_staged, staged, staged_with_path

SHARDS, PATIENCE = 8, 3
#: Hash buckets in which running totals are taken, for each shard or pair of shards, at least; rows for each bucket beyond; buckets of a group.
BUCKETS, BUCKET_ROWS, GROUP_BUCKETS = 256, 100_000, 64
SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def _running(rows: DataFrame, keys: list[str], order: list[str], weight: Column) -> DataFrame:
    """Adds `before`: the sum of weight over the rows before in the order of (bucket, order), for each value of keys, which are few.

    Only the sums of buckets, one for each BUCKET_ROWS rows, come to the driver; rows are ordered within a bucket.
    """
    n = max(BUCKETS, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int")).withColumn("_w", weight.cast("long"))
    sums = rows.groupBy(*keys, "_b").agg(F.sum("_w").alias("w")).collect()
    total: dict[tuple, int] = {}
    offsets = []
    for r in sorted(sums, key=lambda r: tuple(r)):
        key = tuple(r)[: len(keys)]
        offsets.append((*key, r["_b"], total.get(key, 0)))
        total[key] = total.get(key, 0) + r["w"]
    schema = ", ".join([*(f"{k} int" for k in keys), "_b int", "_o long"])
    at = F.broadcast(rows.sparkSession.createDataFrame(offsets, schema))
    within = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.join(at, [*keys, "_b"]).withColumn("before", F.col("_o") + F.coalesce(F.sum("_w").over(within), F.lit(0))).drop("_b", "_w", "_o")


def _requests(cells: DataFrame, cap: int, salt: int) -> DataFrame:
    """Cells of groups of two or more with the shard that each asks for (its own, where it stays)."""
    by = W.partitionBy("g").orderBy(F.desc("n"), F.xxhash64("g", "shard", F.lit(salt)))
    top = cells.withColumn("_r", F.row_number().over(by)).withColumn("total", F.sum("n").over(W.partitionBy("g")))
    top = top.withColumn("k", F.ceil(F.col("total") / F.lit(max(cap, 1))).cast("int"))
    tops = F.array_sort(F.collect_list(F.struct("_r", "shard")).over(W.partitionBy("g")))
    asked = F.element_at(tops, (F.pmod(F.col("_r"), F.col("k")) + 1).cast("int"))["shard"]
    return top.withColumn("to", F.when(F.col("_r") <= F.col("k"), F.col("shard")).otherwise(asked)).select("g", "shard", "n", "total", "to")


def _grants(asked: dict[tuple[int, int], int], free: list[int]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """How many of each pair's requests are granted, and how many unlinked documents go the other way for them."""
    granted, back = {}, {}
    left = list(free)
    for (s, t), n in sorted(asked.items(), key=lambda x: (-x[1], x[0])):
        other = asked.get((t, s), 0)
        extra = min(max(0, n - other), left[t])
        left[t] -= extra
        granted[s, t] = min(n, other) + extra
        if extra:
            back[t, s] = extra
    return granted, back


def _round(cells: DataFrame, cap: int, salt: int) -> DataFrame | None:
    """The cells after one round; None if nothing moves. salt decides on ties, and on whose turn it is where not all requests are granted."""
    asks = staged(_requests(cells, cap, salt).withColumn("turn", F.xxhash64("g", F.lit(salt))), "asks")
    moving = asks.filter("shard <> to")
    asked = {(r["shard"], r["to"]): r["n"] for r in moving.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
    alone = asks.filter("total = 1").select("g", "shard", "turn")
    free = [0] * SHARDS
    for r in alone.groupBy("shard").count().collect():
        free[r["shard"]] = r["count"]
    granted, back = _grants(asked, free)
    if not any(granted.values()):
        return None
    spark = cells.sparkSession
    quota = F.broadcast(spark.createDataFrame([(s, t, n) for (s, t), n in granted.items()], "shard int, to int, quota long"))
    moves = _running(moving, ["shard", "to"], ["turn", "g"], F.col("n")).join(quota, ["shard", "to"])
    moves = moves.withColumn("x", F.least("n", F.greatest(F.lit(0), F.col("quota") - F.col("before")))).select("g", "shard", "to", "x")
    if back:
        ends = []
        for t in range(SHARDS):
            out = [(s, n) for (a, s), n in back.items() if a == t]
            tos = list(accumulate(n for _, n in out))
            ends += [(t, s, to - n, to) for (s, n), to in zip(out, tos, strict=True)]
        ranges = F.broadcast(spark.createDataFrame(ends, "shard int, to int, lo long, hi long"))
        swapped = _running(alone, ["shard"], ["turn", "g"], F.lit(1)).join(ranges, "shard").filter("before >= lo AND before < hi")
        moves = moves.unionByName(swapped.select("g", "shard", "to", F.lit(1).cast("long").alias("x")))
    moves = moves.filter("x > 0")
    change = moves.select("g", "shard", (-F.col("x")).alias("n")).unionByName(moves.select("g", F.col("to").alias("shard"), F.col("x").alias("n")))
    return asks.select("g", "shard", "n").unionByName(change).groupBy("g", "shard").agg(F.sum("n").alias("n")).filter("n > 0")


def cut_links(cells: DataFrame) -> int:
    """Links cut by cells (g, shard, n): each member of a group that isn't in the shard with most of it, where that is at all possible."""
    by = cells.groupBy("g").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    return by.agg(F.sum(F.col("n") - F.col("most"))).first()[0] or 0


def _in_group(rows: DataFrame) -> DataFrame:
    """Adds `rank`, from 0 within g, with no task holding more than a bucket of a group."""
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start"), F.lit(GROUP_BUCKETS)).cast("int"))
    sums = rows.groupBy("g", "_b").agg(F.count("*").alias("n"))
    offsets = sums.withColumn("_o", F.coalesce(F.sum("n").over(W.partitionBy("g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = W.partitionBy("g", "_b").orderBy("doc_id", "start")
    return rows.withColumn("_r", F.row_number().over(within)).join(offsets, ["g", "_b"]).withColumn("rank", F.col("_o") + F.col("_r") - 1).drop("_b", "_o", "_r")


def shards(docs: DataFrame, trace: list[int] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document. trace receives the links cut before the first round and after each."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("g"))
    rows = staged(rows.withColumn("_one", F.lit(0)), "rows")
    dealt = _running(rows, ["_one"], ["doc_id", "g"], F.lit(1))
    rows = staged(dealt.withColumn("start", F.pmod("before", F.lit(SHARDS)).cast("int")).drop("_one", "before"), "dealt")
    cap = -(-rows.count() // SHARDS)
    cells, path = staged_with_path(rows.groupBy("g", F.col("start").alias("shard")).agg(F.count("*").alias("n")), "cells")
    cut, stalled, salt = cut_links(cells), 0, 0
    trace = trace if trace is not None else []
    trace.append(cut)
    while cut and stalled < PATIENCE:
        new = _round(cells, cap, salt)
        if new is None:
            break
        new, new_path = staged_with_path(new, "cells")
        now, salt = cut_links(new), salt + 1
        stalled = 0 if now < cut else stalled + 1
        if now > cut:
            drop_staged(new.sparkSession, new_path)
            continue
        drop_staged(cells.sparkSession, path)
        cells, path, cut = new, new_path, now
        trace.append(cut)
    ends = cells.withColumn("hi", F.sum("n").over(W.partitionBy("g").orderBy("shard")))
    held = ends.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("hi", "shard"))).alias("cells"), F.max("hi").alias("_n"))
    held = staged(held, "held")
    alone = held.filter("_n = 1").select("g", F.element_at("cells", 1)["shard"].alias("shard"))
    grouped = held.filter("_n > 1")
    many = join_skewed(rows, grouped.select("g", "_n"), "g")
    placed = join_skewed(_in_group(many), grouped, "g")
    shard = F.element_at(F.filter("cells", lambda c: c["hi"] > F.col("rank")), 1)["shard"]
    single = rows.join(alone, "g").select("doc_id", "size", "text_crc32", "shard", "g", F.lit(0).cast("long").alias("rank"))
    placed = placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), "g", F.col("rank").cast("long").alias("rank"))
    placed = staged(placed.unionByName(single), "placed")
    out = _running(placed, ["shard"], ["doc_id", "g", "rank"], F.lit(1))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("before").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

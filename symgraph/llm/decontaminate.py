"""Benchmark decontamination by SimHash, with DataFrame functions alone.

A document is contaminated by an item where one of its windows of as many words as the
item has (the whole document, where it is shorter) is similar to it: the overlap of the
two multisets of 5-word shingles is at least 0.8 of their union. Words are runs of
characters other than blanks and U+0009 to U+000D, with A-Z in lower case.

1. Windows: all that hold an anchor. An item's anchors are its rarest shingles in the
   benchmark, one more than a similar window can lack, so no similar window is missed.
2. Fingerprints: the 64-bit SimHash of each window and item, shingles weighing as often
   as they occur. Fingerprints within 20 bits agree in one of 21 blocks at least, so a
   join on (size, block, value) finds them all; 20 bits are 3.7 standard deviations from
   the mean distance at similarity 0.8.
3. The exact weighted similarity verifies what is within the radius.

The benchmark's side of a join, and of the documents what is found, is broadcast up to a
counted number of bytes and shuffled beyond. Windows carry their own hashes alone.

Nulls: a null or wordless text and a null or wordless item match nothing; a null doc_id
is matched like others. Items under 5 words are one shingle. Repeated rows with one
doc_id and text give one result; repeated items each count, equal rows once. Of windows
that tie the first is reported. Very long texts are searched whole; an empty table of
either kind gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from symgraph.llm.checked import join_small
from symgraph.session import staged

SHINGLE = 5
PART, WHOLE = 100, 80
RADIUS, BITS = 20, 64
SPACE = r"[\x20\x09-\x0D]+"


def word_array(text: str | Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, SPACE, -1), lambda w: w != "")


def _with_words(table: DataFrame, *names: str) -> DataFrame:
    """names and w; the words are exploded out of an array of one, so that they are cut once."""
    return table.filter(F.col("text").isNotNull()).select(*names, F.explode(F.array(word_array("text"))).alias("w")).filter(F.size("w") > 0)


def _grams(size: int) -> Column:
    """Hashes of the runs of size words of w."""
    parts = ", ".join(f"w[i + {k}]" for k in range(size))
    return F.expr(f"CASE WHEN size(w) < {size} THEN array() ELSE transform(sequence(0, size(w) - {size}), i -> xxhash64({parts})) END").cast("array<long>")


def _fingerprint(grams: str) -> Column:
    """Bit b of a SimHash is set where more than half of the hashes have it."""
    return F.expr(f"aggregate(sequence(0, {BITS - 1}), 0L, (f, b) -> f | shiftleft(CASE WHEN 2 * size(filter({grams}, h -> (shiftright(h, b) & 1L) = 1L)) > size({grams}) THEN 1L ELSE 0L END, b))")


def _blocks(fingerprint: str) -> Column:
    """(block, value) of RADIUS + 1 blocks of a fingerprint."""
    cut = [BITS * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.col(fingerprint), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, ih (hash of its words), m (words), g (words of a shingle), grams, fingerprint; repeated rows once."""
    words = _with_words(benchmark.select("item_id", "text").distinct(), "item_id").withColumn("m", F.size("w"))
    grams = reduce(lambda c, g: F.when(F.col("m") == g, _grams(g)).otherwise(c), range(1, SHINGLE), _grams(SHINGLE))
    out = words.select("item_id", F.xxhash64("w").alias("ih"), "m", F.least(F.col("m"), F.lit(SHINGLE)).alias("g"), F.explode(F.array(grams)).alias("grams"))
    return out.withColumn("fingerprint", _fingerprint("grams"))


def anchors_of(items: DataFrame) -> DataFrame:
    """gram, g, m: of each item, enough of its rarest grams that a similar window holds one."""
    every = items.select("item_id", "ih", "g", "m", F.size("grams").alias("n"), F.posexplode("grams").alias("at", "gram"))
    spread = every.groupBy("gram").agg(F.count("*").alias("often"))
    ranked = every.join(spread, "gram").withColumn("rank", F.row_number().over(W.partitionBy("item_id", "ih").orderBy("often", "gram", "at")))
    return ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * WHOLE / PART) + 1).select("gram", "g", "m").distinct()


def _similar(a: str, b: str) -> Column:
    """Overlap of two multisets of hashes."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.expr(f"aggregate(array_distinct({b}), 0, (o, s) -> o + least(size(filter({a}, x -> x = s)), size(filter({b}, x -> x = s))))")
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th, item_id, start (first word of the best window, from 0), n_words of it, similarity: the best window of each document and similar item."""
    items = staged(items_of(benchmark), "items")
    anchors = staged(anchors_of(items), "anchors")
    sizes = [r["g"] for r in items.select("g").distinct().orderBy("g").collect()]  # 1 to 5
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    found = []
    for g in sizes or [SHINGLE]:
        words = _with_words(docs, "doc_id", "th")
        at = words.select("doc_id", "th", F.posexplode(_grams(g)).alias("at", "gram"))
        hits = join_small(at, anchors.filter(F.col("g") == g).select("gram", "m"), "gram")
        found.append(hits.groupBy("doc_id", "th", "m").agg(F.collect_set("at").alias("at")).withColumn("g", F.lit(g)))
    hits = staged(reduce(DataFrame.unionByName, found), "hits")
    hit = hits.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "m", "g", "at")
    held = join_small(docs, hit, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).drop("_d", "_t")
    held = held.dropDuplicates(["doc_id", "th", "m", "g"])
    held = _with_words(held, "doc_id", "th", "m", "g", "at").withColumn("n", F.size("w"))
    grams = reduce(lambda c, g: F.when(F.col("g") == g, _grams(g)).otherwise(c), [g for g in sizes if g != SHINGLE], _grams(SHINGLE))
    starts = F.expr("array_distinct(flatten(transform(at, p -> sequence(greatest(0, least(p - m + g, n - m)), greatest(0, least(p, n - m))))))")
    held = held.select("doc_id", "th", "m", "g", "n", F.explode(F.array(grams)).alias("every"), starts.alias("starts"))
    windows = held.select("doc_id", "th", "m", "g", "n", "every", F.explode("starts").alias("start"))
    windows = windows.select("doc_id", "th", "m", "start", F.least("m", "n").alias("n_words"), F.explode(F.array(F.expr("slice(every, start + 1, least(m, n) - g + 1)"))).alias("grams"))
    windows = staged(windows.filter(F.size("grams") > 0).withColumn("fingerprint", _fingerprint("grams")), "windows")
    prints = windows.select("m", "fingerprint").distinct().select("m", "fingerprint", F.inline(_blocks("fingerprint")))
    targets = staged(items.select("m", "item_id", F.col("fingerprint").alias("target"), F.inline(_blocks("fingerprint"))), "targets")
    near = join_small(prints, targets, ["m", "block", "value"])
    near = near.filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("target"))) <= RADIUS).select("m", "fingerprint", "item_id", "target").distinct()
    near = staged(near, "near")
    pairs = join_small(windows, near.drop("target"), ["m", "fingerprint"]).drop("fingerprint")
    named = items.select(F.col("item_id").alias("_item"), F.col("m").alias("_m"), F.col("grams").alias("item"))
    pairs = join_small(pairs, named, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("m") == F.col("_m")))
    overlap = F.col("overlap")
    pairs = pairs.withColumn("overlap", _similar("grams", "item")).withColumn("union", F.size("grams") + F.size("item") - overlap)
    ok = pairs.filter(F.lit(PART) * overlap >= F.lit(WHOLE) * F.col("union"))
    best = F.max(F.struct((overlap / F.col("union")).alias("similarity"), (-F.col("start")).alias("back"), "n_words")).alias("best")
    return ok.groupBy("doc_id", "th", "item_id").agg(best).select("doc_id", "th", "item_id", (-F.col("best.back")).alias("start"), F.col("best.n_words").alias("n_words"), F.col("best.similarity").alias("similarity"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity."""
    return matches(docs, benchmark).drop("th")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a window similar to an item, with their columns."""
    bad = staged(matches(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct(), "contaminated")
    return join_small(docs, bad, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t")), "left_anti")

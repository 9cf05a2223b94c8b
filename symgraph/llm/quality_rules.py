"""Quality rules by a rule bitmask ledger.

Every rule is evaluated once per document and leaves one failure bit; the
measurements stay beside the bits. A policy is a set of rules with a version,
that is a mask: applying it, changing it, or asking what one rule alone costs
is bitwise arithmetic over the ledger and reads no text again.

Nulls: a null text measures as empty (0 words, so it fails the base rules).
Empty and very long texts are measured whole. Repeated rows give repeated
ledger rows; other columns and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.textchunk import IS_SPACE, mix, slices, words

#: The rules in bit order.
RULES = (
    "too_few_words",
    "repeated_windows",
    "too_many_symbols",
    "word_length",
    "duplicate_lines",
    "few_letters",
    "long_word",
    "few_distinct_words",
)
BIT = {name: 1 << k for k, name in enumerate(RULES)}

#: Policies by version.
POLICIES = {
    "v1": ("too_few_words", "repeated_windows", "too_many_symbols", "word_length", "duplicate_lines"),
    "v2": ("too_few_words", "repeated_windows", "too_many_symbols", "word_length", "duplicate_lines", "few_letters", "long_word", "few_distinct_words"),
}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]

LEDGER = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_letters long, n_distinct_words long, longest_word long"
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(0xC3, 256))] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _by_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _lines(data: bytes) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier one."""
    full = [x for x in data.split(b"\n") if x.strip()]
    return len(full), len(full) - len(set(full))


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        w = words(batch.column("text"))
        n = w.counts()
        hashes, doc = w.hashes(), w.doc_of_word()
        repeat = np.zeros(w.n_docs, np.int64)
        grams, at = w.grams(hashes, 8)
        if len(grams):
            key = mix(grams ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            found = at[count[inverse] > 1]
            step = np.zeros(len(hashes) + 1, np.int64)
            step[found] += 1  # windows start once at a word each
            step[found + 8] -= 1
            repeat = _by_doc(np.cumsum(step[:-1]) > 0, w.first)
        own = np.unique(mix(hashes ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
        distinct = np.bincount(doc[own], minlength=w.n_docs)
        length = np.concatenate((np.diff(np.concatenate(([0], np.cumsum(_LEAD[w.data]))).take(np.stack((w.start, w.end), 1)), axis=1).ravel(), [0]))
        longest = np.where(n > 0, np.maximum.reduceat(length, np.minimum(w.first[:-1], len(length) - 1)), 0) if w.n_docs else n
        raw = w.data.tobytes()
        lines = np.array([_lines(raw[a:b]) for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True)], np.int64).reshape(-1, 2)
        columns = [
            n,
            _by_doc(_LEAD[w.data] & ~IS_SPACE[w.data], w.offsets),
            _by_doc(_SYMBOL[w.data], w.offsets),
            lines[:, 1],
            repeat,
            lines[:, 0],
            _by_doc(_LETTER[w.data], w.offsets),
            distinct,
            longest,
        ]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(np.asarray(c, np.int64)) for c in columns)], [x.split()[0] for x in LEDGER.split(", ")])


def _failures() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "too_few_words": n < 20,
        "repeated_windows": 100 * F.col("n_repeat_words") > 30 * n,
        "too_many_symbols": 10 * F.col("n_symbols") > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "duplicate_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "few_letters": 2 * F.col("n_letters") < F.col("word_chars"),
        "long_word": F.col("longest_word") > 200,
        "few_distinct_words": 50 * F.col("n_distinct_words") < n,
    }


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: measurements and failure_bits, bit k for RULES[k]."""
    table = docs.select("doc_id", "text").mapInArrow(measure, LEDGER)
    bits = F.lit(0).cast("long")
    for name, failed in _failures().items():
        bits = bits.bitwiseOR(F.when(failed, F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return table.withColumn("failure_bits", bits)


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def apply_policy(table: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with base_failed and kept under a policy's mask."""
    bits = F.col("failure_bits")
    return table.withColumn("base_failed", bits.bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", bits.bitwiseAND(F.lit(BASE | mask(policy))) == 0)


def ablation(table: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: documents it fails, and those that only it fails, from one pass over the bits."""
    held = mask(policy)
    bits = F.col("failure_bits").bitwiseAND(F.lit(held))
    counts = table.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in POLICIES[policy])))
    return (
        counts.select("bits", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )

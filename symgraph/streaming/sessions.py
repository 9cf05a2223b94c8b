"""Session accounting and incremental refresh as Structured Streaming programs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from symgraph.operators.sessions import classify

#: Pointers that a session remembers, pointers of a prompt, and nudges of a session.
MEMORY, POINTERS, NUDGES = 40, 3, 2


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, event_type, n by tumbling windows; what is later than the watermark is left out."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def session_counters(events: DataFrame) -> DataFrame:
    """session, graph_reads, source_reads of a stream of (session, tool), in update mode."""
    kind = classify()
    return events.withColumn("kind", kind).filter("kind IS NOT NULL").groupBy("session").agg(F.count_if(F.col("kind") == "graph").alias("graph_reads"), F.count_if(F.col("kind") == "source").alias("source_reads"))


def pointers(prompts: DataFrame) -> DataFrame:
    """session, prompt, pointers, nudge: of ranked hits (session, prompt, hits array<string>), those that the session hasn't seen lately; a bounded number of nudges where there are none."""
    state, out = "seen array<string>, nudges int", "session string, prompt string, pointers array<string>, nudge boolean"

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        seen, nudges = held.get if held.exists else ([], 0)
        seen, rows = list(seen), []
        for frame in frames:
            for prompt, hits in zip(frame["prompt"], frame["hits"], strict=True):
                new = [h for h in hits if h not in seen][:POINTERS]
                nudge = not len(hits) and nudges < NUDGES
                nudges += nudge
                seen = (seen + new)[-MEMORY:]
                rows.append((key[0], prompt, new, nudge))
        held.update((seen, int(nudges)))
        yield pd.DataFrame(rows, columns=["session", "prompt", "pointers", "nudge"])

    return prompts.groupBy("session").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def turn_costs(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Messages counted once each by message_id within the watermark."""
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "message_id"])


def refresh(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run apply on each micro-batch of changed files that is there, one writer, then stop."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

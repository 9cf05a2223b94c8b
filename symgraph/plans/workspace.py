"""A source tree's graph on disk: built, refreshed by content hash, queried.

A build writes a new folder of tables and then replaces the one-line manifest that names
it, so readers see the old graph or the new one. One writer at a time, by a lock; who
waited for it finds the tree's fingerprint published and builds nothing. Files whose size
and time are those of the last build, and older than it by RACY, aren't opened again.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from symgraph.operators import extract, graph, incremental, resolve
from symgraph.plans import state
from symgraph.session import staged
from symgraph.sources import files as sources

#: Changes with what the extractor gives; a cache of another version isn't used.
EXTRACTOR = "2"
#: Seconds before a build in which a file may have changed without its time showing it.
RACY = 2
#: Seconds that a build waits for another one.
LOCK_WAIT = 1800.0
CARRIED = ("summary", "summary_state", "crux_start")


class Workspace:
    def __init__(self, spark: SparkSession, root: str, out: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None):
        self.spark, self.root = spark, os.path.abspath(root)
        self.out = out or os.path.join(self.root, ".symgraph")
        self.include, self.exclude = include, [*(exclude or []), "/.symgraph"]

    # State

    def _manifest(self) -> dict:
        """The manifest; empty where there is none or it can't be read."""
        try:
            with open(os.path.join(self.out, "manifest.json"), encoding="utf-8") as f:
                held = json.load(f)
        except (OSError, ValueError):
            return {}
        return held if isinstance(held, dict) and held.get("extractor") == EXTRACTOR else {}

    def _table(self, name: str, at: str | None = None) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.out, at or self._manifest()["at"], name))

    def files(self) -> DataFrame:
        return incremental.content_hash(sources.read_tree(self.spark, self.root, self.include, self.exclude))

    def _current(self, held: dict) -> DataFrame:
        """Files with body_hash; content is null where the stored hash is trusted."""
        listed = sources.listing(self.spark, self.root, self.include, self.exclude)
        if not held.get("began"):
            return incremental.content_hash(sources.read_tree(self.spark, self.root, listed=listed))
        old = self._table("stat", held["at"]).filter(F.unix_micros("mtime") < F.lit(int((held["began"] - RACY) * 1e6)))
        trusted = listed.join(old, ["path", "size", "mtime"]).select("path", F.lit(None).cast("string").alias("content"), "size", "mtime", "file_ord", "body_hash")
        opened = sources.read_tree(self.spark, self.root, listed=listed.join(trusted.select("path"), "path", "left_anti"))
        return incremental.content_hash(opened).unionByName(trusted)

    def build(self, force: bool = False) -> dict:
        """files, nodes, edges, hits, misses, changed. Nothing is written where the tree's fingerprint is the stored one."""
        with state.locked(os.path.join(self.out, "lock"), LOCK_WAIT):
            return self._build(force)

    def _build(self, force: bool) -> dict:
        began = time.time()
        held = self._manifest()
        current = staged(self._current({} if force else held), "files")
        print_ = incremental.tree_fingerprint(current.select("path", "body_hash")).first()
        if held and held["fingerprint"] == print_["fingerprint"] and not force:
            return held["counts"] | {"changed": False}
        at = f"v-{uuid.uuid4().hex}"
        where = lambda name: os.path.join(self.out, at, name)
        current.select("path", "size", "mtime", "body_hash").write.parquet(where("stat"))
        fresh, reused, hits = current, None, 0
        if held and not force:
            cache = self._table("cache", held["at"])
            known = incremental.split_by_cache(current, cache.select("path", F.col("file_hash").alias("body_hash")).distinct())
            fresh = known.filter("NOT hit").drop("hit")
            order = known.filter("hit").select("path", "file_ord")
            reused = cache.drop("file_ord").join(order, "path")
            hits = order.count()
        tagged = extract.extract_files(fresh.select("path", "content", "file_ord")).withColumnRenamed("path", "node_path")
        of_file = tagged.withColumn("path", F.coalesce("file", "node_path"))
        rows = of_file.join(fresh.select("path", F.col("body_hash").alias("file_hash")), "path")
        if reused is not None:
            rows = rows.unionByName(reused)
        rows.write.parquet(where("cache"))
        again = self._table("cache", at).drop("path").withColumnRenamed("node_path", "path")
        nodes = extract.nodes_of(again)
        edges = resolve.resolve(nodes, extract.raw_edges_of(again))
        edges.write.parquet(where("edges"))
        if held:
            old = self._table("nodes", held["at"]).select("id", "body_hash", "summary", "summary_state", "start_line", "crux_start")
        else:
            old = self.spark.createDataFrame([], "id string, body_hash string, summary string, summary_state string, start_line int, crux_start int")
        meaning = incremental.carry_over(nodes.select("id", "body_hash", "start_line"), old).select("id", *CARRIED)
        nodes.join(meaning, "id").write.parquet(where("nodes"))
        sources.scopes(current.select("path")).write.parquet(where("scopes"))
        broken = [tuple(r) for r in graph.validate(self._table("nodes", at), self._table("edges", at)).orderBy("rule", "id").limit(21).collect()]
        if broken:
            shutil.rmtree(os.path.join(self.out, at))
            raise ValueError(f"the graph breaks invariants: {broken[:20]}" + " and more" * (len(broken) > 20))
        counts = {"files": print_["n"], "nodes": self._table("nodes", at).count(), "edges": self._table("edges", at).count(), "hits": hits, "misses": print_["n"] - hits}
        self._publish({"at": at, "fingerprint": print_["fingerprint"], "extractor": EXTRACTOR, "began": began, "counts": counts}, held.get("at"))
        return counts | {"changed": True}

    def _publish(self, manifest: dict, before: str | None) -> None:
        new = os.path.join(self.out, f"manifest-{uuid.uuid4().hex}.tmp")
        with open(new, "w", encoding="utf-8") as f:
            json.dump(manifest, f)
        os.replace(new, os.path.join(self.out, "manifest.json"))
        if before:
            shutil.rmtree(os.path.join(self.out, before), ignore_errors=True)

    def tables(self, refresh: bool = True) -> tuple[DataFrame, DataFrame]:
        if refresh or not self._manifest():
            self.build()
        return self._table("nodes"), self._table("edges")

    def check(self) -> str:
        """fresh, stale (the tree has changed, or gives another graph when all of it is extracted again) or missing."""
        held = self._manifest()
        if not held:
            return "missing"
        files = staged(self.files(), "files")
        if incremental.tree_fingerprint(files.select("path", "body_hash")).first()["fingerprint"] != held["fingerprint"]:
            return "stale"
        tagged = staged(extract.extract_files(files.select("path", "content", "file_ord")), "extracted")
        nodes = extract.nodes_of(tagged)
        for new, old in ((nodes, self._table("nodes").drop(*CARRIED)), (resolve.resolve(nodes, extract.raw_edges_of(tagged)), self._table("edges"))):
            columns = sorted(new.columns)
            a, b = new.select(*columns), old.select(*columns)
            if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
                return "stale"
        return "fresh"

    def meaning(self) -> DataFrame:
        """state, n, sample: definitions whose summary is stale or pending, and the first ids of them."""
        limit = {"stale": 20, "pending": 8}
        named = self._table("nodes").filter(F.col("summary_state").isin(*limit)).select(F.col("summary_state").alias("state"), "id")
        few = F.row_number().over(W.partitionBy("state").orderBy("id"))
        ranked = named.withColumn("r", few)
        return ranked.groupBy("state").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= F.when(F.col("state") == "stale", limit["stale"]).otherwise(limit["pending"]), F.col("id")))).alias("sample"))

"""Connected components by large-star and small-star rounds of joins, or in the driver where links are counted and few."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symgraph.llm.checked import SHARE
from symgraph.session import drop_staged, staged_with_path

#: Links up to which the driver takes them, 16 bytes each; the rounds' joins cost more than these links do.
HELD_LINKS = 500_000


def _least(edges: DataFrame, total: int) -> DataFrame:
    """Each u's least neighbour (counting u), beside every edge of u.

    Minima are combined before the shuffle. Nodes with more than a SHARE of all edges, of which there are SHARE at
    most, are broadcast, so that a hub's edges stay where they are.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    if total < 100 * SHARE:  # a task holds all of them
        return edges.join(least.drop("n"), "u")
    hot, cold = (F.broadcast(least.filter(F.col("n") * SHARE > total).drop("n")), least.filter(F.col("n") * SHARE <= total).drop("n"))
    return edges.join(hot, "u").unionByName(edges.join(hot.select("u"), "u", "left_anti").join(cold, "u"))


def held_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of the component of each."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[label]


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, component (the least node of its component) of every node of the links; a link is an unordered pair.

    Labels are of the links' type. Self-links make single components; null ends and repeated links are ignored. Rounds
    go on until nothing changes, of which there are about the square of the logarithm of the nodes at most. Up to
    HELD_LINKS links of whole numbers there are no rounds.
    """
    spark = links.sparkSession
    edges = links.select(F.col(u).alias("u"), F.col(v).alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, path = staged_with_path(edges, "edges")
    before, total = None, edges.count()
    if 0 < total <= HELD_LINKS and isinstance(edges.schema["u"].dataType, T.LongType):
        held = edges.toArrow()
        node, component = held_components(held["u"].to_numpy(), held["v"].to_numpy())
        return spark.createDataFrame(pa.table({"node": node, "component": component}))
    while total:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, 2 * total).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(edges.filter(F.col("u") == F.col("v"))).distinct()
        pairs = _least(large, total)
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(pairs.select("u", F.col("m").alias("v")))
        new, new_path = staged_with_path(small.distinct(), "edges")
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        drop_staged(spark, path)
        edges, path = new, new_path
        if state == before:
            break
        before, total = state, state["n"]
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))

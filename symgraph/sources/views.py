"""The engine's tables as views over relational tables: what the operators are run on where there is no source tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(df: DataFrame, kind: str, key: str, name: str, node_kind: str) -> DataFrame:
    ident = F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))
    start = (F.col(key) % 97 + 1).cast("long")
    return df.select(ident.alias("id"), F.col(name).alias("name"), F.lit(node_kind).alias("kind"), ident.alias("path"), start.alias("start_line"), (start + F.col(key) % 7).cast("long").alias("end_line"))


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, kind, path, start_line, end_line: orders are files, the other tables' rows symbols."""
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        _node(t("region"), "region", "r_regionkey", "r_name", "module"),
        _node(t("nation"), "nation", "n_nationkey", "n_name", "module"),
        _node(t("customer"), "customer", "c_custkey", "c_name", "class"),
        _node(t("supplier"), "supplier", "s_suppkey", "s_name", "interface"),
        _node(t("part"), "part", "p_partkey", "p_name", "function"),
        _node(t("orders"), "orders", "o_orderkey", "o_orderpriority", "file"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edge(df: DataFrame, source: tuple[str, str], target: tuple[str, str], relation: str, confidence, order) -> DataFrame:
    end = lambda kind, key: F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))
    return df.select(end(*source).alias("source"), end(*target).alias("target"), F.lit(relation).alias("relation"), confidence.alias("confidence"), order.cast("long").alias("ord"))


def star_raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, relation, confidence, ord, with the repeats that line items have."""
    t = lambda n: table(spark, sf_dir, n)
    sure, lines = F.lit("extracted"), t("lineitem")
    said = F.when(F.col("l_returnflag") == "R", F.lit("inferred")).otherwise(F.lit("extracted"))
    parts = [
        _edge(t("nation"), ("region", "n_regionkey"), ("nation", "n_nationkey"), "contains", sure, F.col("n_nationkey")),
        _edge(t("customer"), ("nation", "c_nationkey"), ("customer", "c_custkey"), "contains", sure, F.col("c_custkey")),
        _edge(t("supplier"), ("nation", "s_nationkey"), ("supplier", "s_suppkey"), "contains", sure, F.col("s_suppkey")),
        _edge(t("orders"), ("customer", "o_custkey"), ("orders", "o_orderkey"), "imports", sure, F.col("o_orderkey")),
        _edge(lines, ("orders", "l_orderkey"), ("part", "l_partkey"), "calls", said, F.col("l_linenumber")),
        _edge(lines, ("orders", "l_orderkey"), ("supplier", "l_suppkey"), "calls", said, F.col("l_linenumber")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse graph with cycles: source, target (part numbers)."""
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    lines = table(spark, sf_dir, "lineitem")
    return lines.crossJoin(F.broadcast(n)).select(F.col("l_partkey").alias("source"), ((7 * F.col("l_partkey") + F.col("l_suppkey")) % F.col("n")).alias("target")).distinct()


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: doc_id, path, content."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


def doc_lines(files: DataFrame) -> DataFrame:
    """doc_id, path, line_no from 1, line."""
    return files.select("doc_id", "path", F.posexplode(F.split("content", "\n", -1)).alias("p", "line")).withColumn("line_no", (F.col("p") + 1).cast("long")).drop("p")


def doc_spans(files: DataFrame) -> DataFrame:
    """Sections of ten lines, and one of four inside each: doc_id, id, start_line, end_line."""
    n = files.select("doc_id", "path", F.size(F.split("content", "\n", -1)).alias("n"))
    outer = n.select("doc_id", "path", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(10))).alias("s"))
    a = outer.select("doc_id", F.concat("path", F.lit("#s"), "s").alias("id"), F.col("s").cast("long").alias("start_line"), (F.col("s") + 8).cast("long").alias("end_line"))
    b = outer.select("doc_id", F.concat("path", F.lit("#s"), "s", F.lit(".in")).alias("id"), (F.col("s") + 2).cast("long").alias("start_line"), (F.col("s") + 5).cast("long").alias("end_line"))
    return a.unionByName(b)

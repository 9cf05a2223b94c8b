"""Operators over nodes (id, name, kind, path, ...) and edges (source, target, relation, confidence, ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from symgraph.schemas import MAY_DANGLE, STRUCTURAL
from symgraph.session import drop_staged, staged, staged_with_path


def usage(edges: DataFrame) -> DataFrame:
    """Edges that say that something is used: not structural, no self-loops."""
    return edges.filter(~F.col("relation").isin(*STRUCTURAL) & (F.col("source") != F.col("target")))


def first_wins(raw: DataFrame) -> DataFrame:
    """One edge for each (source, target, relation): the first emitted; an aggregate, so combined before the shuffle."""
    best = F.min(F.struct("ord", "confidence")).alias("b")
    return raw.groupBy("source", "target", "relation").agg(best).select("source", "target", "relation", F.col("b.confidence").alias("confidence"), F.col("b.ord").alias("ord"))


def reference_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, refs of the nodes that usage edges point at."""
    counts = usage(edges).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("refs"))
    return counts.join(nodes.select("id"), "id", "left_semi")


def hotspots(nodes: DataFrame, edges: DataFrame, limit: int = 12) -> DataFrame:
    symbols = nodes.filter("kind <> 'file'").select("id", "name", "kind")
    return reference_counts(nodes, edges).join(symbols, "id").orderBy(F.desc("refs"), "id").limit(limit)


def cluster(path: str = "path") -> Column:
    return F.substring_index(path, "/", 1)


def cluster_map(nodes: DataFrame) -> DataFrame:
    """cluster, files, symbols by the first path segment."""
    return nodes.groupBy(cluster().alias("cluster")).agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") != "file").alias("symbols"))


def cluster_hubs(nodes: DataFrame, edges: DataFrame, limit: int = 3) -> DataFrame:
    """The most referenced symbols of each cluster. Few per cluster are kept before they meet: see _top."""
    refs = reference_counts(nodes, edges).join(nodes.filter("kind <> 'file'").select("id", cluster().alias("cluster")), "id")
    return _top(refs, "cluster", [F.desc("refs"), F.col("id")], limit)


def _top(df: DataFrame, key: str, order: list[Column], limit: int, parts: int = 64) -> DataFrame:
    """The first rows of each key with their rank: within hash parts first, so that no task sorts a whole key."""
    salted = df.withColumn("_p", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    few = salted.withColumn("rank", F.row_number().over(W.partitionBy(key, "_p").orderBy(*order))).filter(F.col("rank") <= limit).drop("_p")
    return few.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= limit)


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") != "file").alias("symbols"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return n.crossJoin(edges.agg(F.count("*").alias("edges")))  # one row by one row


def adjacent(edges: DataFrame, seeds: DataFrame, direction: str) -> DataFrame:
    """seed, other, relation, confidence of usage edges at the seeds (id)."""
    at, other = ("target", "source") if direction == "in" else ("source", "target")
    e = usage(edges).select(F.col(at).alias("seed"), F.col(other).alias("other"), "relation", "confidence")
    return e.join(F.broadcast(seeds.select(F.col("id").alias("seed"))), "seed")


def neighbours(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, direction: str = "in") -> DataFrame:
    """adjacent() with the other end's name and kind; names outside the graph stay, marked external."""
    found = adjacent(edges, seeds, direction).join(nodes.select(F.col("id").alias("other"), "name", "kind"), "other", "left")
    return found.select("seed", "other", "relation", (F.col("confidence") != "extracted").alias("inferred"), "name", "kind", F.col("kind").isNull().alias("external"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None, cap: int | None = None) -> DataFrame:
    """seed, id, level of what each seed (id) reaches over edges (source, target), breadth first, the seed not counted.

    Each round's frontier is staged, so lineage doesn't grow; the loop looks only at whether it is empty.
    cap: results for each seed, in the order of (level, id).
    """
    edges = edges.select("source", "target").distinct()
    seen, path = staged_with_path(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("level")).distinct(), "seen")
    level = 0
    while depth is None or level < depth:
        last = seen.filter(F.col("level") == level).select("seed", F.col("id").alias("source"))
        new = last.join(edges, "source").select("seed", F.col("target").alias("id")).distinct().join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
        level += 1
        new, new_path = staged_with_path(new.withColumn("level", F.lit(level)), "frontier")
        if new.isEmpty():
            drop_staged(new.sparkSession, new_path)
            break
        both, both_path = staged_with_path(seen.unionByName(new), "seen")
        drop_staged(seen.sparkSession, path)
        drop_staged(seen.sparkSession, new_path)
        seen, path = both, both_path
    out = seen.filter("level > 0")
    if cap is None:
        return out
    return out.withColumn("rank", F.row_number().over(W.partitionBy("seed").orderBy("level", "id"))).filter(F.col("rank") <= cap).drop("rank")


def starts_of(nodes: DataFrame, seed: str) -> list[str]:
    """Where a traversal from a seed starts: there, and at every definition of it if it is a file, which callers mean by it. One file's definitions."""
    own = nodes.filter((F.col("path") == seed) & (F.col("kind") != "file")).select("id").orderBy("id")
    return [seed, *(r["id"] for r in own.collect())]


def traverse(edges: DataFrame, seed: str, direction: str = "in", depth: int | None = None, cap: int = 400, starts: list[str] | None = None) -> DataFrame:
    """Breadth-first listing from one seed, or several starts in order, in discovery order: pos, level, parent, other, relation, inferred.

    A parent's edges come in the order (relation, source, target); what was listed isn't listed again. The
    listing is capped, so each level's rows are few; levels are joined, ranked and staged like in reach().
    """
    at, other = ("target", "source") if direction == "in" else ("source", "target")
    e = usage(edges).select(F.col(at).alias("parent"), F.col(other).alias("other"), "relation", "source", "target", (F.col("confidence") != "extracted").alias("inferred"))
    spark = edges.sparkSession
    schema = "pos int, level int, parent string, other string, relation string, inferred boolean"
    rows: list[tuple] = []
    starts = starts or [seed]
    frontier, listed, level = list(enumerate(starts, -len(starts))), set(starts), 0
    while frontier and (depth is None or level < depth) and len(rows) < cap:
        level += 1
        now = F.broadcast(spark.createDataFrame(frontier, "parent_rank int, parent string"))  # cap rows at most
        found = e.join(now, "parent")
        first = found.withColumn("r", F.row_number().over(W.partitionBy("other").orderBy("parent_rank", "relation", "source", "target"))).filter("r = 1")
        got = first.orderBy("parent_rank", "relation", "source", "target").limit(cap + len(listed)).collect()
        frontier = []
        for r in got:
            if r["other"] in listed or len(rows) >= cap:
                continue
            listed.add(r["other"])
            rows.append((len(rows) + 1, level, r["parent"], r["other"], r["relation"], r["inferred"]))
            frontier.append((len(rows), r["other"]))
    return spark.createDataFrame(rows, schema)


def blast_first(nodes: DataFrame, edges: DataFrame, path_suffix: str, limit: int = 8) -> DataFrame:
    """The first edges of blast_radius in the order of the edges (ord)."""
    return blast_radius(nodes, edges, path_suffix).join(edges, ["source", "target", "relation"]).orderBy("ord").limit(limit).select("source", "target", "relation")


def blast_radius(nodes: DataFrame, edges: DataFrame, path_suffix: str) -> DataFrame:
    """Edges from outside into the symbols of a file (named by path or path suffix), contains left out, imports not."""
    own = nodes.filter((F.col("path") == path_suffix) | F.col("path").endswith("/" + path_suffix)).select("id")
    into = edges.filter("relation <> 'contains'").join(own.withColumnRenamed("id", "target"), "target", "left_semi")
    return into.join(own.withColumnRenamed("id", "source"), "source", "left_anti").select("source", "target", "relation")


def tiered(candidates: DataFrame, key: str, tier: str = "tier", unique: bool = False) -> DataFrame:
    """Candidates of each key's first non-empty tier; with unique, only where that tier holds one."""
    best = candidates.groupBy(key).agg(F.min(tier).alias("_t"))
    own = candidates.join(best, key).filter(F.col(tier) == F.col("_t")).drop("_t")
    if not unique:
        return own
    alone = own.groupBy(key).agg(F.count("*").alias("_n")).filter("_n = 1").select(key)
    return own.join(alone, key, "left_semi")


def lookup(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Symbols of each query (query): exact id, qualified name, dotted suffix, bare name; the first tier that has any.

    Each tier is an equality join on a key that nodes give, so no query is compared with all nodes.
    """
    qualified = F.regexp_replace(F.substring_index("id", "#", -1), "~[0-9]+$", "")
    has = F.col("id").contains("#")
    parts = F.split(qualified, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keys = nodes.select("id", F.explode(F.concat(
        F.array(F.struct(F.lit(1).alias("tier"), F.col("id").alias("query"))),
        F.when(has, F.array(F.struct(F.lit(2).alias("tier"), qualified.alias("query")))).otherwise(F.array().cast("array<struct<tier:int,query:string>>")),
        F.when(has, F.transform(suffixes, lambda s: F.struct(F.lit(3).alias("tier"), s.alias("query")))).otherwise(F.array().cast("array<struct<tier:int,query:string>>")),
        F.array(F.struct(F.lit(4).alias("tier"), F.col("name").alias("query"))),
    )).alias("k")).select("id", "k.tier", "k.query")
    return tiered(keys.join(queries, "query").distinct(), "query").select("query", "tier", "id").distinct()


def suffix_unique(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (suffix) to the one file (path) that ends in it, by an equality join on exploded suffixes."""
    parts = F.split("path", "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    every = files.select("path", F.explode(each).alias("suffix"))
    return every.join(wanted, "suffix").groupBy("suffix").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path")).filter("n = 1").select("suffix", "path")


def inherited(methods: DataFrame, parents: DataFrame, calls: DataFrame, levels: int = 3) -> DataFrame:
    """calls (owner, name) to a method (owner, name, id) found up to so many parents (child, parent) up; the first level with any must hold one."""
    at = calls.select("owner", "name", F.col("owner").alias("now"))
    found = None
    for level in range(1, levels + 1):
        at = at.join(parents, at["now"] == parents["child"]).select("owner", "name", F.col("parent").alias("now")).distinct()
        hit = at.join(methods.select(F.col("owner").alias("now"), "name", "id"), ["now", "name"]).select("owner", "name", "id", F.lit(level).alias("tier")).distinct()
        found = hit if found is None else found.unionByName(hit)
    keyed = found.withColumn("k", F.concat_ws("\0", "owner", "name"))
    return tiered(keyed, "k", unique=True).select("owner", "name", "id", F.col("tier").alias("level"))


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rule, id of everything that breaks an invariant."""
    ids = nodes.select("id").distinct()
    rule = lambda df, name, key: df.select(F.lit(name).alias("rule"), F.col(key).alias("id"))
    bad_path = F.col("path").startswith("/") | F.col("path").contains("\\") | F.col("path").rlike(r"(^|/)\.\.(/|$)") | (F.col("path") == "")
    outside = edges.filter(~(F.col("relation").isin(*MAY_DANGLE) & (F.col("target") != ""))).join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    checks = [
        rule(nodes.groupBy("id").count().filter("count > 1"), "duplicate id", "id"),
        rule(nodes.filter(bad_path), "path form", "id"),
        rule(nodes.filter(~((F.col("id") == F.col("path")) | F.expr("startswith(id, concat(path, '#'))"))), "id outside path", "id"),
        rule(nodes.filter("start_line < 1 OR end_line < start_line"), "span", "id"),
        rule(edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti"), "unknown source", "source"),
        rule(outside, "unknown target", "target"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.distinct()


def diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change (added, removed, changed), what: fields that differ."""
    a = old.select(F.col(key), F.struct(*fields).alias("a"))
    b = new.select(F.col(key), F.struct(*fields).alias("b"))
    both = a.join(b, key, "full")
    what = F.array_join(F.filter(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull()), ",")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(what != "", "changed")
    return both.select(key, change.alias("change"), F.when(change == "changed", what).otherwise("").alias("what")).filter("change IS NOT NULL")


#: Seeds that are broadcast at most.
SEEDS_BROADCAST = 10_000


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """Personalised PageRank: id, rank. seeds: (id, weight); edges (source, target) count as often as they are there.

    Restarts and the mass of vertices without edges go to the seeds. One join and one aggregate a round on the
    edges' key; ranks are used once in a round, so the plan grows by a round at a time, and are staged every few.
    """
    total = seeds.agg(F.sum("weight").alias("t")).first()["t"]
    restart = staged(seeds.groupBy("id").agg((F.sum("weight") / F.lit(total)).alias("share")), "restart")
    degree = edges.groupBy("source").agg(F.count("*").alias("degree"))
    out = staged(edges.groupBy("source", "target").agg(F.count("*").alias("n")).join(degree, "source").select("source", "target", (F.col("n") / F.col("degree")).alias("part")), "out-edges")
    few = restart.limit(SEEDS_BROADCAST + 1).count() <= SEEDS_BROADCAST
    seeds_at = restart.select(F.col("id").alias("seed"), "share", F.lit(1).alias("k"))
    seeds_at = F.broadcast(seeds_at) if few else seeds_at
    rank, path = restart.select("id", F.col("share").alias("rank")), None
    for step in range(1, rounds + 1):
        # What has no edge on goes to the target null, and from there to the seeds.
        flow = rank.join(out, rank["id"] == out["source"], "left").groupBy(F.col("target").alias("to")).agg(F.sum(F.col("rank") * F.coalesce("part", F.lit(1.0))).alias("r"))
        on = flow.withColumn("k", F.when(F.col("to").isNull(), 1))
        if few:
            moved = on.join(seeds_at, "k", "left").select(F.coalesce("seed", "to").alias("id"), (F.lit(damping) * F.col("r") * F.coalesce("share", F.lit(1.0))).alias("r"))
        else:
            lost = on.filter("k = 1").join(seeds_at, "k").select(F.col("seed").alias("id"), (F.lit(damping) * F.col("r") * F.col("share")).alias("r"))
            moved = on.filter("k IS NULL").select(F.col("to").alias("id"), (F.lit(damping) * F.col("r")).alias("r")).unionByName(lost)
        back = restart.select("id", (F.col("share") * F.lit(1 - damping)).alias("r"))
        rank = moved.unionByName(back).groupBy("id").agg(F.sum("r").alias("rank"))
        if step % every == 0 or not few:
            rank, new_path = staged_with_path(rank, "rank")
            if path:
                drop_staged(rank.sparkSession, path)
            path = new_path
    return rank


def encloses(parents: DataFrame, levels: int = 12) -> DataFrame:
    """ancestor, id: the closure of a contains tree (parent, child), itself included, by doubling joins."""
    up = parents.select(F.col("parent").alias("ancestor"), F.col("child").alias("id"))
    every, step = up, 1
    while step < levels:
        more = every.alias("a").join(every.alias("b"), F.col("a.id") == F.col("b.ancestor")).select(F.col("a.ancestor"), F.col("b.id"))
        every = staged(every.unionByName(more).distinct(), "closure")
        step *= 2
    ids = parents.select(F.explode(F.array("parent", "child")).alias("id")).distinct()
    return every.unionByName(ids.select(F.col("id").alias("ancestor"), "id")).distinct()

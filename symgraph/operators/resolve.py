"""Raw edges to edges, by joins: imports, heritage, contains and calls, in this order; the first emission of an edge wins.

Every step is an equality join on a name, a path or both; a name that many definitions
share is counted before callers meet it, as only unique names resolve by name alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.operators.graph import first_wins, tiered
from symgraph.session import staged
from symgraph.sources.files import family

#: Suffixes tried for a module, in order.
SUFFIXES = ("", ".py", ".pyi", "/__init__.py")
SCRIPT_SUFFIXES = ("", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs")
SCRIPT = r"\.[mc]?[jt]sx?$"
#: Kinds that a bare name can mean, and those that an import can bind.
BY_NAME = ("function", "class", "struct")
BINDABLE = (*BY_NAME, "interface", "trait")
PASS = 1 << 60


def _parent_of(ident: str) -> Column:
    """The id of a definition's lexical parent: the file, or the scope before the last dot."""
    path, scope = F.substring_index(ident, "#", 1), F.substring_index(ident, "#", -1)
    return F.when(scope.contains("."), F.concat(path, F.lit("#"), F.regexp_replace(scope, r"\.[^.]*$", ""))).otherwise(path)


def _script_targets(specs: DataFrame, files: DataFrame) -> DataFrame:
    """file, specifier, tier, target of relative specifiers; one that climbs out of the tree means nothing."""
    segments = F.split(F.concat_ws("/", F.regexp_replace("file", "/?[^/]*$", ""), "specifier"), "/")
    step = "CASE WHEN x IN ('', '.') OR acc IS NULL THEN acc WHEN x <> '..' THEN concat(acc, array(x)) WHEN size(acc) = 0 THEN NULL ELSE slice(acc, 1, size(acc) - 1) END"
    stems = specs.withColumn("segments", segments).withColumn("stem", F.array_join(F.expr(f"aggregate(segments, cast(array() as array<string>), (acc, x) -> {step})"), "/")).filter("stem IS NOT NULL")
    plain = [F.struct(F.lit(i).alias("tier"), F.ltrim(F.concat("stem", F.lit(x)), F.lit("/")).alias("path")) for i, x in enumerate(SCRIPT_SUFFIXES)]
    other = [F.struct(F.lit(20 + i).alias("tier"), F.concat(F.regexp_replace("stem", r"\.[mc]?jsx?$", ""), F.lit(x)).alias("path")) for i, x in enumerate(SCRIPT_SUFFIXES[1:7])]
    return stems.select("file", "specifier", F.inline(F.array(*plain, *other))).join(files.select("path"), "path").select("file", "specifier", "tier", F.col("path").alias("target"))


def module_targets(specs: DataFrame, files: DataFrame) -> DataFrame:
    """file, specifier, target: the file that each distinct specifier of a file means. Candidates carry their priority; Python's unique suffix comes last."""
    is_script = F.col("file").rlike(SCRIPT)
    scripts, specs = specs.filter(is_script & F.col("specifier").rlike(r"^\.\.?(/|$)")), specs.filter(~is_script)
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace("specifier", r"^\.+", ""), F.lit("."), F.lit("/"))
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    up = F.slice(parts, 1, F.greatest(F.size(parts) - dots + 1, F.lit(0)))
    inside = dots <= F.size(parts) + 1
    stem = F.when(dots == 0, rest).when(inside, F.array_join(F.concat(up, F.filter(F.array(rest), lambda x: x != "")), "/"))
    keyed = specs.withColumn("stem", stem).withColumn("absolute", dots == 0).filter("stem IS NOT NULL")
    tries = F.array(*(F.struct(F.lit(i).alias("tier"), (F.when(F.col("stem") == "", F.lit(s.lstrip("/"))).otherwise(F.concat("stem", F.lit(s)))).alias("path")) for i, s in enumerate(SUFFIXES)))
    each = keyed.select("file", "specifier", "absolute", F.inline(tries))
    exact = each.join(files.select("path"), "path").select("file", "specifier", "tier", F.col("path").alias("target"))
    segments = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, i, F.size(segments)), "/"))
    suffixes = files.select(F.col("path").alias("target"), F.explode(ends).alias("path"))
    loose = each.filter("absolute").join(suffixes, "path").groupBy("file", "specifier").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"))
    found = exact.unionByName(loose.filter("n = 1").select("file", "specifier", F.lit(99).alias("tier"), "target")).unionByName(_script_targets(scripts, files))
    key = F.concat_ws("\0", "file", "specifier")
    return tiered(found.withColumn("k", key), "k").groupBy("file", "specifier").agg(F.min("target").alias("target"))


def resolve(nodes: DataFrame, raw: DataFrame) -> DataFrame:
    """source, target, relation, confidence, ord of all raw edges that resolve."""
    order = F.col("file_ord").cast("long") * (1 << 32) + F.col("seq")
    raw = staged(raw.withColumn("at", order), "raw-edges")
    files = nodes.filter("kind = 'file'").select("path")
    defs = staged(nodes.filter("kind <> 'file'").select("id", "name", "kind", "path", "owner", _parent_of("id").alias("parent"), family("path").alias("family")), "definitions")
    imports = raw.filter("relation = 'imports'")
    specs = imports.select("file", "specifier").unionByName(
        imports.filter("imported_name IS NOT NULL AND imported_name <> '*'").select("file", F.when(F.col("specifier").endswith("."), F.concat("specifier", "imported_name")).otherwise(F.concat_ws(".", "specifier", "imported_name")).alias("specifier"))
    ).distinct()
    modules = staged(module_targets(specs, files), "modules")
    emitted: list[DataFrame] = []

    def emit(df: DataFrame, step: int, relation: str | None = None) -> None:
        kind = F.lit(relation) if relation else F.col("relation")
        emitted.append(df.select("source", "target", kind.alias("relation"), "confidence", (F.col("at") + F.lit(step * PASS)).alias("ord")))

    # Pass 1: imports and what they bind.
    with_module = imports.join(modules, ["file", "specifier"], "left")
    named = F.when(F.col("specifier").endswith("."), F.concat("specifier", "imported_name")).otherwise(F.concat_ws(".", "specifier", "imported_name"))
    sub = modules.select(F.col("file").alias("_f"), F.col("specifier").alias("_s"), F.col("target").alias("submodule"))
    bound = with_module.filter("name IS NOT NULL").join(sub, (F.col("file") == F.col("_f")) & (named == F.col("_s")) & (F.col("imported_name") != "*"), "left").drop("_f", "_s")
    symbols = defs.filter(F.col("kind").isin(*BINDABLE) & (F.col("parent") == F.col("path"))).select(F.col("path").alias("_p"), F.col("name").alias("_n"), F.col("id").alias("symbol"))
    bound = bound.join(symbols, (F.col("target") == F.col("_p")) & (F.col("imported_name") == F.col("_n")), "left").drop("_p", "_n")
    bound = staged(bound.select("file", "source", "name", "scope_id", "specifier", "imported_name", "target", "submodule", "symbol", "at"), "bindings")
    sure = F.lit("extracted").alias("confidence")
    emit(with_module.filter("name IS NULL").select(F.col("file").alias("source"), F.coalesce("target", "specifier").alias("target"), sure, "at"), 0, "imports")
    emit(bound.filter("symbol IS NULL AND submodule IS NOT NULL").select(F.col("file").alias("source"), F.col("submodule").alias("target"), sure, "at"), 0, "imports")

    def visible(calls: DataFrame, what: str) -> DataFrame:
        """calls with a binding of their name: what a function binds itself hides what its file binds."""
        b = bound.filter(f"{what} IS NOT NULL").select(F.col("file").alias("_f"), F.col("name").alias("_n"), "scope_id", F.col(what).alias("target"))
        near = F.col("scope_id").isNull() | (F.col("source") == F.col("scope_id")) | F.expr("startswith(source, concat(scope_id, '.'))")
        key = F.col("key") if "key" in calls.columns else F.col("name")
        both = calls.join(b, (F.col("file") == F.col("_f")) & (key == F.col("_n"))).filter(near)
        both = both.withColumn("tier", F.when(F.col("scope_id").isNull(), 1).otherwise(0)).withColumn("k", F.col("at").cast("string"))
        return tiered(both.drop("_f", "_n", "scope_id").distinct(), "k", unique=True).drop("tier", "k")

    # Pass 2: heritage, the first tier with candidates; it must hold one.
    # A bare name reaches definitions of its own language family alone.
    bases = raw.filter("relation IN ('extends', 'implements')").select("source", "relation", "file", "name", "at", family("file").alias("family"))
    types = defs.filter(F.col("kind").isin("class", "interface", "trait", "struct"))
    tiers = [
        visible(bases, "symbol").join(types.select(F.col("id").alias("target")), "target", "left_semi").withColumn("tier", F.lit(0)),
        bases.join(types.select(F.col("path").alias("file"), "name", F.col("id").alias("target")), ["file", "name"]).filter("target <> source").withColumn("tier", F.lit(1)),
        bases.join(types.groupBy("name", "family").agg(F.count("*").alias("n"), F.min("id").alias("target")).filter("n = 1").drop("n"), ["name", "family"]).filter("target <> source").withColumn("tier", F.lit(2)),
    ]
    foreign = bound.filter("target IS NULL AND submodule IS NULL").select("file", "name").distinct()
    tiers[2] = tiers[2].join(foreign, ["file", "name"], "left_anti")
    pick = reduce(DataFrame.unionByName, (t.select("source", "relation", "file", "name", "at", "target", "tier") for t in tiers)).distinct()
    chosen = tiered(pick.withColumn("k", F.col("at").cast("string")), "k", unique=True).select("at", "target", F.when(F.col("tier") < 2, "extracted").otherwise("inferred").alias("confidence"))
    heritage = staged(bases.join(chosen, "at", "left").select("source", F.coalesce("target", "name").alias("target"), "relation", F.coalesce("confidence", F.lit("inferred")).alias("confidence"), "at"), "heritage")
    emit(heritage, 1)
    parents = heritage.filter("relation = 'extends'").join(defs.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("child"), F.col("target").alias("parent")).distinct()

    # Pass 3: contains, then calls by the form of the callee.
    emit(raw.filter("relation = 'contains'").select("source", F.col("target_id").alias("target"), sure, "at"), 2, "contains")
    calls = raw.filter("relation = 'calls'").select("source", "file", "name", "via_member", "recv_type", "at", family("file").alias("family"))
    methods = defs.filter("kind = 'method'").select(F.col("parent").alias("type"), F.col("name").alias("name"), F.col("id").alias("target"))

    def member(of_type: DataFrame) -> DataFrame:
        """Calls with a type (an id) to its method, or to one inherited from up to three levels above, the first level that has it once."""
        now, found = of_type, []
        for level in range(4):
            found.append(now.join(methods, ["type", "name"]).withColumn("tier", F.lit(level)))
            if level < 3:
                now = now.join(parents, now["type"] == parents["child"]).withColumn("type", F.col("parent")).drop("child", "parent").distinct()
        every = reduce(DataFrame.unionByName, found).withColumn("k", F.col("at").cast("string"))
        return tiered(every.distinct(), "k", unique=True)

    typed = calls.filter("recv_type IS NOT NULL").withColumn("key", F.col("recv_type"))
    own_type = types.select(F.col("path").alias("file"), F.col("name").alias("key"), F.col("id").alias("type")).groupBy("file", "key").agg(F.min("type").alias("type"), F.count("*").alias("n")).filter("n = 1").drop("n")
    lone = types.groupBy(F.col("name").alias("key"), "family").agg(F.count("*").alias("n"), F.min("id").alias("type")).filter("n = 1").drop("n")
    by_type = [
        visible(typed, "symbol").withColumnRenamed("target", "type").withColumn("c", F.lit(0)),
        typed.join(own_type, ["file", "key"]).withColumn("c", F.lit(0)),
        typed.join(lone, ["key", "family"]).withColumn("c", F.lit(1)),
    ]
    columns = ["source", "file", "name", "at", "type", "c"]
    of_type = reduce(DataFrame.unionByName, (t.select(*columns) for t in by_type)).withColumn("k", F.col("at").cast("string"))
    of_type = tiered(of_type, "k", "c").drop("k").distinct()
    emit(member(of_type).withColumn("confidence", F.when(F.col("c") == 0, "extracted").otherwise("inferred")), 3, "calls")

    selfs = calls.filter("recv_type IS NULL AND via_member IN ('self', 'cls', 'this')")
    # The type around a method is its parent; functions inside a method belong to it too.
    home = defs.filter("kind = 'method'").select(F.col("id").alias("method"), F.col("parent").alias("type"))
    scopes = F.split(F.substring_index("source", "#", -1), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(scopes)), lambda i: F.concat(F.substring_index("source", "#", 1), F.lit("#"), F.array_join(F.slice(scopes, 1, i), ".")))
    inside = selfs.withColumn("method", F.explode(above)).join(home, "method").withColumn("depth", F.length("method"))
    inside = inside.groupBy("source", "file", "name", "at").agg(F.max_by("type", "depth").alias("type"))
    kin = member(inside)
    near = (F.col("tier") == 0) | (F.substring_index("target", "#", 1) == F.col("file"))
    emit(kin.withColumn("confidence", F.when(near, "extracted").otherwise("inferred")), 3, "calls")

    spaces = calls.filter("recv_type IS NULL AND via_member IS NOT NULL AND via_member NOT IN ('self', 'cls', 'this')").withColumn("key", F.col("via_member"))
    star = bound.filter("imported_name = '*' AND target IS NOT NULL").select("file", "name", "scope_id", F.col("target").alias("module"))
    subs = bound.filter("symbol IS NULL AND submodule IS NOT NULL").select("file", "name", "scope_id", F.col("submodule").alias("module"))
    spaced = spaces.join(star.unionByName(subs).select("file", F.col("name").alias("key"), "module").distinct(), ["file", "key"])
    top = defs.filter((F.col("parent") == F.col("path")) & F.col("kind").isin(*BY_NAME)).select(F.col("path").alias("module"), "name", F.col("id").alias("target"))
    emit(spaced.join(top, ["module", "name"]).withColumn("confidence", F.lit("extracted")), 3, "calls")

    bare = calls.filter("via_member IS NULL")
    named_ = defs.filter(F.col("kind").isin(*BY_NAME)).select(F.col("id").alias("target"))
    through = staged(visible(bare, "symbol").join(named_, "target", "left_semi").select("source", "file", "name", "at", "target"), "bound-calls")
    emit(through.withColumn("confidence", F.lit("extracted")), 3, "calls")
    rest = bare.join(through.select("at"), "at", "left_anti")
    callable_ = defs.filter(F.col("kind").isin(*BY_NAME))
    local = rest.join(callable_.select(F.col("path").alias("file"), "name", F.col("id").alias("target"), "parent"), ["file", "name"])
    reach = (F.col("parent") == F.col("file")) | (F.col("source") == F.col("parent")) | F.expr("startswith(source, concat(parent, '.'))")
    local = staged(local.withColumn("ok", reach), "local-calls")
    # The innermost visible definition; of repeated ones the last.
    nearest = local.filter("ok").groupBy("at", "source").agg(F.max_by("target", F.struct(F.length("parent"), F.length("target"), "target")).alias("target"))
    emit(nearest.withColumn("confidence", F.lit("extracted")), 3, "calls")
    open_ = rest.join(local.select("at").distinct(), "at", "left_anti").join(foreign, ["file", "name"], "left_anti")
    every = defs.filter(F.col("kind").isin(*BY_NAME)).groupBy("name", "family").agg(F.count("*").alias("n"), F.min("id").alias("target"), F.min("parent").alias("parent"), F.min("path").alias("path"))
    alone = every.filter((F.col("n") == 1) & (F.col("parent") == F.col("path"))).select("name", "family", "target")
    emit(open_.join(alone, ["name", "family"]).withColumn("confidence", F.lit("inferred")), 3, "calls")
    return first_wins(reduce(DataFrame.unionByName, emitted))

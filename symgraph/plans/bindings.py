"""The operators bound to relational tables as queries, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions import text
from symgraph.operators import graph, incremental, meaning, search, sessions
from symgraph.session import staged
from symgraph.sources import views
from symgraph.sources.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


NODES = """nodes AS (
  SELECT 'region/' || r_regionkey AS id, r_name AS name, 'module' AS kind, r_regionkey % 97 + 1 AS s, r_regionkey % 97 + 1 + r_regionkey % 7 AS e FROM region
  UNION ALL SELECT 'nation/' || n_nationkey, n_name, 'module', n_nationkey % 97 + 1, n_nationkey % 97 + 1 + n_nationkey % 7 FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, c_name, 'class', c_custkey % 97 + 1, c_custkey % 97 + 1 + c_custkey % 7 FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, s_name, 'interface', s_suppkey % 97 + 1, s_suppkey % 97 + 1 + s_suppkey % 7 FROM supplier
  UNION ALL SELECT 'part/' || p_partkey, p_name, 'function', p_partkey % 97 + 1, p_partkey % 97 + 1 + p_partkey % 7 FROM part
  UNION ALL SELECT 'orders/' || o_orderkey, o_orderpriority, 'file', o_orderkey % 97 + 1, o_orderkey % 97 + 1 + o_orderkey % 7 FROM orders)"""
RAW = """raw AS (
  SELECT 'region/' || n_regionkey AS source, 'nation/' || n_nationkey AS target, 'contains' AS relation, 'extracted' AS confidence, n_nationkey::BIGINT AS ord FROM nation
  UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey, 'contains', 'extracted', c_custkey FROM customer
  UNION ALL SELECT 'nation/' || s_nationkey, 'supplier/' || s_suppkey, 'contains', 'extracted', s_suppkey FROM supplier
  UNION ALL SELECT 'customer/' || o_custkey, 'orders/' || o_orderkey, 'imports', 'extracted', o_orderkey FROM orders
  UNION ALL SELECT 'orders/' || l_orderkey, 'part/' || l_partkey, 'calls', CASE WHEN l_returnflag = 'R' THEN 'inferred' ELSE 'extracted' END, l_linenumber FROM lineitem
  UNION ALL SELECT 'orders/' || l_orderkey, 'supplier/' || l_suppkey, 'calls', CASE WHEN l_returnflag = 'R' THEN 'inferred' ELSE 'extracted' END, l_linenumber FROM lineitem)"""
EDGES = f"""{RAW}, edges AS (
  SELECT source, target, relation, confidence, ord FROM (SELECT *, row_number() OVER (PARTITION BY source, target, relation ORDER BY ord, confidence) AS rn FROM raw) WHERE rn = 1)"""
GRAPH = f"WITH {NODES}, {EDGES}"
REFS = f"""{GRAPH}, refs AS (
  SELECT target AS id, count(*) AS refs FROM edges WHERE relation NOT IN ('contains', 'imports') AND source <> target AND target IN (SELECT id FROM nodes) GROUP BY target)"""
PARTS = "WITH RECURSIVE pe AS (SELECT DISTINCT l_partkey AS source, (7 * l_partkey + l_suppkey) % (SELECT count(*) FROM part) AS target FROM lineitem)"
LINES = """WITH files AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, text AS content FROM documents), lines AS (
  SELECT doc_id, path, i AS line_no, ls[i] AS line FROM (SELECT doc_id, path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, path, string_split(content, chr(10)) AS ls FROM files)))"""
SPANS = """spans AS (
  SELECT doc_id, path || '#s' || s AS id, s AS start_line, s + 8 AS end_line FROM (SELECT doc_id, path, unnest(range(1, len(string_split(content, chr(10))) + 1, 10)) AS s FROM files)
  UNION ALL SELECT doc_id, path || '#s' || s || '.in', s + 2, s + 5 FROM (SELECT doc_id, path, unnest(range(1, len(string_split(content, chr(10))) + 1, 10)) AS s FROM files))"""


def star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return views.star_nodes(spark, sf_dir), graph.first_wins(views.star_raw_edges(spark, sf_dir))


def of(spark: SparkSession, column: str, *values) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} {'long' if isinstance(values[0], int) else 'string'}")


# Graph


@query(f"{GRAPH} SELECT source, target, relation, confidence, ord FROM edges")
def edge_dedupe_first(spark, d):
    return star(spark, d)[1]


@query(f"{REFS} SELECT refs.id, refs.refs, name, kind FROM refs JOIN nodes USING (id) WHERE kind <> 'file' ORDER BY refs DESC, id LIMIT 12")
def map_hotspots(spark, d):
    return graph.hotspots(*star(spark, d))


@query(f"WITH {NODES} SELECT split_part(id, '/', 1) AS cluster, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind <> 'file') AS symbols FROM nodes GROUP BY 1")
def cluster_map(spark, d):
    return graph.cluster_map(views.star_nodes(spark, d))


@query(f"{REFS} SELECT * FROM (SELECT id, refs, split_part(id, '/', 1) AS cluster, row_number() OVER (PARTITION BY split_part(id, '/', 1) ORDER BY refs DESC, id)::BIGINT AS rank FROM refs JOIN nodes USING (id) WHERE kind <> 'file') WHERE rank <= 3")
def hubs_per_cluster(spark, d):
    return graph.cluster_hubs(*star(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(f"{GRAPH} SELECT count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind <> 'file') AS symbols, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, (SELECT count(*) FROM edges) AS edges FROM nodes")
def map_totals(spark, d):
    return graph.totals(*star(spark, d))


@query("SELECT lang AS ext, count(*) AS files FROM documents GROUP BY 1")
def ext_histogram(spark, d):
    return views.doc_files(spark, d).groupBy(F.element_at(F.split("path", "/"), 2).alias("ext")).agg(F.count("*").alias("files"))


def _near_sql(at: str, other: str, seeds: str) -> str:
    return f"""{GRAPH} SELECT e.{at} AS seed, e.{other} AS other, relation, confidence <> 'extracted' AS inferred, n.name, n.kind, n.kind IS NULL AS external
      FROM edges e LEFT JOIN nodes n ON n.id = e.{other} WHERE relation NOT IN ('contains', 'imports') AND source <> target AND e.{at} IN ({seeds})"""


@query(_near_sql("target", "source", "'part/1', 'part/2', 'supplier/3'"))
def callers_in1(spark, d):
    return graph.neighbours(*star(spark, d), of(spark, "id", "part/1", "part/2", "supplier/3"), "in")


@query(_near_sql("source", "target", "'orders/1', 'orders/2', 'orders/5'"))
def callers_out1(spark, d):
    return graph.neighbours(*star(spark, d), of(spark, "id", "orders/1", "orders/2", "orders/5"), "out")


REACH = """, walk AS (SELECT s AS seed, s AS id, 0 AS level FROM (VALUES {seeds}) t(s) UNION SELECT seed, target, level + 1 FROM walk JOIN pe ON pe.source = walk.id WHERE level < {depth})
SELECT seed, id, min(level)::BIGINT AS level FROM walk GROUP BY 1, 2 HAVING min(level) > 0"""


@query(PARTS + REACH.format(seeds="(1::BIGINT), (5), (9)", depth=3))
def callers_depth3(spark, d):
    return graph.reach(views.part_edges(spark, d), of(spark, "id", 1, 5, 9), 3).withColumn("level", F.col("level").cast("long"))


@query(PARTS + ", walk AS (SELECT 1::BIGINT AS id UNION SELECT target FROM walk JOIN pe ON pe.source = walk.id) SELECT 1::BIGINT AS seed, id FROM walk WHERE id <> 1")
def closure_out(spark, d):
    return graph.reach(views.part_edges(spark, d), of(spark, "id", 1)).select("seed", "id")


def _traverse_sql(depth: int) -> str:
    steps = ["f0 AS (SELECT '1' AS id, 0::BIGINT AS pos, '' AS parent)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM f{i}" for i in range(k))
        steps.append(f"""f{k} AS MATERIALIZED (SELECT id, (SELECT count(*) - 1 FROM ({seen})) + row_number() OVER (ORDER BY pr, source, target) AS pos, parent FROM (
          SELECT e.target AS id, p.id AS parent, p.pos AS pr, e.source, e.target, row_number() OVER (PARTITION BY e.target ORDER BY p.pos, e.source) AS rn FROM f{k - 1} p JOIN e ON e.source = p.id WHERE e.target NOT IN ({seen})) WHERE rn = 1)""")
    rows = " UNION ALL ".join(f"SELECT pos::INT AS pos, {k}::INT AS level, parent, id AS other, 'calls' AS relation, false AS inferred FROM f{k}" for k in range(1, depth + 1))
    return f"{PARTS}, e AS (SELECT DISTINCT source::VARCHAR AS source, target::VARCHAR AS target FROM pe WHERE source <> target), {', '.join(steps)} SELECT * FROM ({rows}) WHERE pos <= 400"


@query(_traverse_sql(4))
def traverse_order(spark, d):
    e = views.part_edges(spark, d).select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.lit("calls").alias("relation"), F.lit("extracted").alias("confidence"))
    return graph.traverse(e, "1", "out", 4)


@query(f"{GRAPH} SELECT source, target, relation FROM edges WHERE relation <> 'contains' AND target = 'part/7' AND source <> 'part/7'")
def blast_radius(spark, d):
    return graph.blast_radius(*star(spark, d), "part/7")


CODE = """code AS (SELECT 'f' || p_partkey % 50 || '.py#' || replace(p_name, ' ', '.') AS id, split_part(p_name, ' ', 2) AS name FROM (SELECT DISTINCT p_partkey % 50 AS p_partkey, p_name FROM part))"""


def code_nodes(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("k"), "p_name").distinct()
    return p.select(F.concat(F.lit("f"), "k", F.lit(".py#"), F.replace("p_name", F.lit(" "), F.lit("."))).alias("id"), F.get(F.split("p_name", " "), F.lit(1)).alias("name"))


@query(f"""WITH {CODE}, q AS (SELECT * FROM (VALUES ('f1.py#small.ring'), ('small.ring'), ('ring'), ('nothing')) t(query)), k AS (
  SELECT 1 AS tier, id AS query, id FROM code UNION SELECT 2, split_part(id, '#', 2), id FROM code
  UNION SELECT 3, split_part(split_part(id, '#', 2), '.', 2), id FROM code WHERE id LIKE '%.%.%' UNION SELECT 3, split_part(id, '#', 2), id FROM code UNION SELECT 4, name, id FROM code),
  m AS (SELECT k.* FROM k JOIN q USING (query)) SELECT DISTINCT query, tier::BIGINT AS tier, id FROM m WHERE tier = (SELECT min(tier) FROM m m2 WHERE m2.query = m.query)""")
def symbol_lookup_tiers(spark, d):
    return graph.lookup(code_nodes(spark, d), of(spark, "query", "f1.py#small.ring", "small.ring", "ring", "nothing")).withColumn("tier", F.col("tier").cast("long"))


@query("""WITH f AS (SELECT source || '/' || lang || '/' || doc_id % (SELECT count(*) FROM documents) AS path FROM documents), s AS (
  SELECT DISTINCT path, unnest([path, split_part(path, '/', 2) || '/' || split_part(path, '/', 3), split_part(path, '/', 3)]) AS suffix FROM f)
  SELECT suffix, min(path) AS path FROM s WHERE suffix IN (SELECT lang || '/' || doc_id FROM documents) GROUP BY 1 HAVING count(DISTINCT path) = 1""")
def suffix_unique(spark, d):
    docs = table(spark, d, "documents")
    files = docs.select(F.concat_ws("/", "source", "lang", (F.col("doc_id") % F.lit(max(1, docs.count()))).cast("string")).alias("path"))
    return graph.suffix_unique(files, docs.select(F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("suffix")))


TIERED = """WITH c AS (
  SELECT l_orderkey AS k, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_linestatus = 'O' THEN 2 ELSE 3 END AS tier, l_suppkey AS id FROM lineitem), d AS (SELECT DISTINCT * FROM c),
  o AS (SELECT d.* FROM d JOIN (SELECT k, min(tier) AS t FROM d GROUP BY k) b ON b.k = d.k AND b.t = d.tier) SELECT k, min(tier)::BIGINT AS tier, min(id) AS id FROM o GROUP BY k HAVING count(*) = 1"""


@query(TIERED)
def tiered_resolve(spark, d):
    tier = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_linestatus") == "O", 2).otherwise(3)
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), tier.cast("long").alias("tier"), F.col("l_suppkey").alias("id")).distinct()
    return graph.tiered(c, "k", unique=True)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def external_antijoin(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


INHERITED = """WITH RECURSIVE par AS (SELECT DISTINCT s_suppkey AS child, (s_suppkey * 3 + 1) % (SELECT count(*) FROM supplier) AS parent FROM supplier),
  meth AS (SELECT DISTINCT l_suppkey AS owner, l_shipmode AS name, 'x' AS id FROM (SELECT l_suppkey, l_returnflag || l_linenumber AS l_shipmode FROM lineitem)),
  calls AS (SELECT DISTINCT s_suppkey AS owner, r || n AS name FROM supplier, (VALUES ('A'), ('N'), ('R')) t(r), range(1, 8) u(n)),
  up AS (SELECT owner, name, owner AS now, 0 AS level FROM calls UNION SELECT owner, name, parent, level + 1 FROM up JOIN par ON par.child = up.now WHERE level < 3),
  hit AS (SELECT DISTINCT up.owner, up.name, now || '.' || up.name AS id, level FROM up JOIN meth ON meth.owner = up.now AND meth.name = up.name WHERE level > 0),
  f AS (SELECT hit.* FROM hit JOIN (SELECT owner, name, min(level) AS m FROM hit GROUP BY 1, 2) b ON b.owner = hit.owner AND b.name = hit.name AND b.m = hit.level)
  SELECT owner::VARCHAR AS owner, name, min(id) AS id, min(level)::BIGINT AS level FROM f GROUP BY owner, name HAVING count(*) = 1"""


@query(INHERITED)
def inherited_lookup(spark, d):
    supplier, lines = table(spark, d, "supplier"), table(spark, d, "lineitem")
    n = supplier.count()
    s = lambda c: c.cast("string")
    parents = supplier.select(s(F.col("s_suppkey")).alias("child"), s((F.col("s_suppkey") * 3 + 1) % n).alias("parent")).distinct()
    name = F.concat("l_returnflag", s(F.col("l_linenumber")))
    methods = lines.select(s(F.col("l_suppkey")).alias("owner"), name.alias("name")).distinct().withColumn("id", F.concat_ws(".", "owner", "name"))
    names = F.array(*(F.lit(f"{r}{k}") for r in "ANR" for k in range(1, 8)))
    calls = supplier.select(s(F.col("s_suppkey")).alias("owner"), F.explode(names).alias("name"))
    return graph.inherited(methods, parents, calls).withColumn("level", F.col("level").cast("long"))


BROKEN = """bn AS (SELECT CASE WHEN o_orderkey % 500 = 0 THEN 'dup' ELSE 'o/' || o_orderkey END AS id, CASE WHEN o_orderkey % 700 = 1 THEN '/abs' ELSE 'o/' || o_orderkey END AS path,
  (o_orderkey % 9)::BIGINT AS start_line, (o_orderkey % 11)::BIGINT AS end_line FROM orders),
 be AS (SELECT DISTINCT 'o/' || l_orderkey AS source, 'o/' || l_partkey * 2 AS target, CASE WHEN l_linenumber % 2 = 0 THEN 'imports' ELSE 'calls' END AS relation FROM lineitem)"""


@query(f"""WITH {BROKEN} SELECT DISTINCT rule, id FROM (
  SELECT 'duplicate id' AS rule, id FROM bn GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'path form', id FROM bn WHERE path LIKE '/%'
  UNION ALL SELECT 'id outside path', id FROM bn WHERE id <> path AND NOT starts_with(id, path || '#') UNION ALL SELECT 'span', id FROM bn WHERE start_line < 1 OR end_line < start_line
  UNION ALL SELECT 'unknown source', source FROM be WHERE source NOT IN (SELECT id FROM bn) UNION ALL SELECT 'unknown target', target FROM be WHERE relation = 'calls' AND target NOT IN (SELECT id FROM bn))""")
def invariants(spark, d):
    o, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    key = F.col("o_orderkey")
    name = F.concat(F.lit("o/"), key.cast("string"))
    nodes = o.select(F.when(key % 500 == 0, "dup").otherwise(name).alias("id"), F.when(key % 700 == 1, "/abs").otherwise(name).alias("path"), (key % 9).alias("start_line"), (key % 11).alias("end_line"))
    relation = F.when(F.col("l_linenumber") % 2 == 0, "imports").otherwise("calls")
    edges = lines.select(F.concat(F.lit("o/"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("o/"), (F.col("l_partkey") * 2).cast("string")).alias("target"), relation.alias("relation")).distinct()
    return graph.validate(nodes, edges)


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS owner FROM orders WHERE o_orderkey % 10 <> 3),
  b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_custkey + (o_orderkey % 14 = 0)::INT AS owner FROM orders WHERE o_orderkey % 10 <> 4),
  j AS (SELECT coalesce(a.id, b.id) AS id, a.id IS NULL AS added, b.id IS NULL AS gone, a.status IS DISTINCT FROM b.status AS s, a.owner IS DISTINCT FROM b.owner AS o FROM a FULL JOIN b ON a.id = b.id)
  SELECT id, CASE WHEN added THEN 'added' WHEN gone THEN 'removed' ELSE 'changed' END AS change, CASE WHEN added OR gone THEN '' ELSE concat_ws(',', CASE WHEN s THEN 'status' END, CASE WHEN o THEN 'owner' END) END AS what
  FROM j WHERE added OR gone OR s OR o""")
def graph_diff(spark, d):
    key, o = F.col("o_orderkey"), table(spark, d, "orders")
    a = o.filter(key % 10 != 3).select(key.alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"))
    b = o.filter(key % 10 != 4).select(key.alias("id"), F.when(key % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), (F.col("o_custkey") + F.when(key % 14 == 0, 1).otherwise(0)).alias("owner"))
    return graph.diff(a, b, "id", ["status", "owner"])


@query(f"""{GRAPH}, RECURSIVE_ AS (SELECT 1), c AS (SELECT source AS p, target AS c FROM edges WHERE relation = 'contains'),
  ids AS (SELECT p AS id FROM c UNION SELECT c FROM c) SELECT p AS ancestor, c AS id FROM c UNION SELECT a.p, b.c FROM c a JOIN c b ON a.c = b.p UNION SELECT id, id FROM ids""")
def contains_closure(spark, d):
    e = star(spark, d)[1].filter("relation = 'contains'").select(F.col("source").alias("parent"), F.col("target").alias("child"))
    return graph.encloses(e, 4)


def _pagerank_sql(rounds: int) -> str:
    seeds = "seeds AS (SELECT * FROM (VALUES (1::BIGINT, 0.5::DOUBLE), (5, 0.3), (9, 0.2)) t(id, share))"
    steps = ["r0 AS (SELECT id, share AS rank FROM seeds)"]
    for i in range(1, rounds + 1):
        steps.append(f"""r{i} AS MATERIALIZED (SELECT id, sum(r) AS rank FROM (
          SELECT target AS id, 0.85 * sum(rank / deg) AS r FROM r{i - 1} JOIN o ON o.source = r{i - 1}.id GROUP BY target
          UNION ALL SELECT id, share * (0.15 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE id NOT IN (SELECT source FROM o))) FROM seeds) GROUP BY id)""")
    return f"{PARTS}, o AS (SELECT source, target, count(*) OVER (PARTITION BY source) AS deg FROM pe), {seeds}, {', '.join(steps)} SELECT id, round(rank, 6) AS rank FROM r{rounds} WHERE round(rank, 6) > 0"


@query(_pagerank_sql(20))
def pagerank_20(spark, d):
    seeds = spark.createDataFrame([(1, 0.5), (5, 0.3), (9, 0.2)], "id long, weight double")
    return graph.pagerank(views.part_edges(spark, d), seeds).select("id", F.round("rank", 6).alias("rank")).filter("rank > 0")


# Search


@query(f"{LINES} SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, '(?i)licensed? under')")
def grep_lines(spark, d):
    return search.grep(views.doc_lines(views.doc_files(spark, d)), "licensed? under", ignore_case=True).select("doc_id", "line_no", "line")


@query(f"{LINES} SELECT doc_id, line_no FROM lines WHERE contains(line, ' | ')")
def grep_literal(spark, d):
    return search.grep(views.doc_lines(views.doc_files(spark, d)), " | ", literal=True).select("doc_id", "line_no")


ENCLOSING = f"""{LINES}, {SPANS}, hits AS (SELECT doc_id, path, line_no FROM lines WHERE regexp_matches(line, 'tion')),
  f AS (SELECT doc_id, path, line_no, id AS enclosing, start_line, end_line FROM (SELECT h.*, s.id, s.start_line, s.end_line, row_number() OVER (PARTITION BY h.doc_id, line_no ORDER BY s.end_line - s.start_line, s.id) AS rn FROM hits h LEFT JOIN spans s ON s.doc_id = h.doc_id AND h.line_no BETWEEN s.start_line AND s.end_line) WHERE rn = 1)"""


def _enclosed(spark, d):
    files = views.doc_files(spark, d)
    hits = search.grep(views.doc_lines(files), "tion").select("doc_id", "path", "line_no")
    return search.enclosing(hits, views.doc_spans(files), "doc_id")


@query(f"{ENCLOSING} SELECT doc_id, path, line_no, enclosing FROM f")
def grep_enclosing(spark, d):
    return _enclosed(spark, d).select("doc_id", "path", "line_no", "enclosing")


@query(f"""{ENCLOSING}, r AS (SELECT path || '#s1' AS id, count(*) AS refs FROM files JOIN events ON event_id % (SELECT count(*) FROM documents) = doc_id GROUP BY 1),
  g AS (SELECT path, enclosing, count(*) AS hits, min(start_line) AS s, min(end_line) AS e FROM f GROUP BY 1, 2) SELECT path, enclosing, hits, coalesce(refs, 0)::BIGINT AS refs FROM g LEFT JOIN r ON r.id = enclosing
  ORDER BY refs DESC, path, s NULLS FIRST, e NULLS FIRST, enclosing NULLS FIRST LIMIT 60""")
def grep_groups(spark, d):
    files = views.doc_files(spark, d)
    into = table(spark, d, "events").select((F.col("event_id") % F.lit(max(1, files.count()))).alias("doc_id"))
    refs = files.select("doc_id", F.concat("path", F.lit("#s1")).alias("id")).join(into, "doc_id").groupBy("id").agg(F.count("*").alias("refs"))
    return search.grep_groups(_enclosed(spark, d), refs)


def _stem_sql(w: str) -> str:
    return f"""CASE WHEN {w} LIKE '%ing' AND length({w}) > 6 THEN {w}[:-4] WHEN {w} LIKE '%ies' AND length({w}) > 6 THEN {w}[:-4] || 'y' WHEN {w} LIKE '%es' AND length({w}) > 5 THEN {w}[:-3]
      WHEN {w} LIKE '%ed' AND length({w}) > 5 THEN {w}[:-3] WHEN {w} LIKE '%s' AND length({w}) > 4 THEN {w}[:-2] ELSE {w} END"""


STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def _terms_sql(x: str) -> str:
    """Terms of a text as a list, in order; RE2 has no look-ahead, so case changes get a blank first."""
    parts = f"regexp_extract_all(regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"
    return f"list_filter(list_transform(list_transform({parts}, lambda w: lower(w)), lambda w: {_stem_sql('w')}), lambda w: length(w) > 1 AND w NOT IN ({STOP}))"


TERMS = f"""t AS (SELECT p_partkey, replace(p_name, ' ', '') || 'RingsOf' || p_brand || ' HTTPServer2Go ' || p_type AS x FROM part), v AS (SELECT DISTINCT p_partkey, unnest({_terms_sql('x')}) AS term FROM t)"""


def _part_terms(spark, d):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("RingsOf"), "p_brand", F.lit(" HTTPServer2Go "), "p_type")
    return table(spark, d, "part").select("p_partkey", F.explode(text.terms(name)).alias("term"))


@query(f"WITH {TERMS} SELECT p_partkey, term FROM v")
def tokenize_terms(spark, d):
    return _part_terms(spark, d)


@query(f"WITH {TERMS} SELECT term, count(*) AS df FROM v GROUP BY 1")
def term_frequency(spark, d):
    return _part_terms(spark, d).groupBy("term").agg(F.count("*").alias("df"))


WORDS = ("tion", "thing", "ring", "veren")
DF = ", ".join(f"('{w}')" for w in WORDS)


@query(f"SELECT term, (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM documents WHERE contains(lower(text), term)) AS df FROM (VALUES {DF}) t(term)")
def doc_freq(spark, d):
    return search.document_frequency(table(spark, d, "documents"), list(WORDS), "text")


@query(f"WITH f AS (SELECT term, (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM documents WHERE contains(lower(text), term)) AS df FROM (VALUES {DF}) t(term)) SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM f")
def term_idf(spark, d):
    return search.idf(search.document_frequency(table(spark, d, "documents"), list(WORDS), "text")).select("term", F.round("idf", 6).alias("idf"))


def doc_symbols(spark, d):
    first = F.get(F.split("text", " "), F.lit(0))
    return table(spark, d, "documents").select(
        F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("id"), first.alias("name"), F.concat_ws(".", "source", first).alias("qualified"), F.substring("text", 1, 60).alias("signature"), F.col("text").alias("body"),
        F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("tests/x"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("src/x"), F.col("doc_id").cast("string"))).alias("path"), F.when(F.col("doc_id") % 7 == 0, "file").otherwise("function").alias("kind"),
    )


def _count(f: str, w: str) -> str:
    return f"((length({f}) - length(replace({f}, '{w}', ''))) // {len(w)})"


def _lexical_sql() -> str:
    """Two passes: counts of parts of the text for all, then tiers of whole terms for the 600 best."""
    words, fields = WORDS[:3], {"n": 4.0, "q": 2.0, "s": 1.5, "b": 2.2}
    first = {(f, k): f"{f}{k}" for f in fields for k in range(len(words))}

    def score(c: dict) -> str:
        some = [" OR ".join(f"{c[f, k]} > 0" for f in fields) for k in range(len(words))]
        own = [" + ".join(f"{x} * {c[f, k]} / ({c[f, k]} + 1.2 * {'(0.25 + 0.75 * len / a)' if f == 'b' else '1.0'})" for f, x in fields.items()) for k in range(len(words))]
        every = " + ".join(f"i{k} * ({own[k]})" for k in range(len(words)))
        matched = " + ".join(f"({x})::INT" for x in some)
        return f"({every}) * sqrt(({matched}) / {len(words)}.0) * CASE WHEN kind = 'file' THEN 0.5 ELSE 1.0 END * CASE WHEN starts_with(path, 'tests/') THEN 0.4 ELSE 1.0 END"

    names = ", ".join(f"len(list_filter(parts, lambda x: x = '{w}')) + 0.65 * len(list_filter(parts, lambda x: x <> '{w}' AND (starts_with(x, '{w}') OR (length(x) >= 3 AND starts_with('{w}', x))))) AS n{k}" for k, w in enumerate(words))
    counts = ", ".join(f"{_count(f'lower({t})', w)} AS {f}{k}" for k, w in enumerate(words) for f, t in (("q", "qual"), ("s", "sig"), ("b", "text")))
    idfs = ", ".join(f"ln(1 + (count(*) - count(*) FILTER ({x}) + 0.5) / (count(*) FILTER ({x}) + 0.5)) AS i{k}" for k, x in enumerate(" OR ".join(f"{f}{k} > 0" for f in fields) for k in range(len(words))))
    exact = lambda f, w: f"len(list_filter({f}t, lambda x: x = '{w}'))"
    longer = lambda f, w: f"len(list_filter({f}t, lambda x: x <> '{w}' AND starts_with(x, '{w}')))"
    tiers = ", ".join(f"{exact(f, w)} + 0.65 * {longer(f, w)} + 0.3 * greatest(0, {f}{k} - {exact(f, w)} - {longer(f, w)}) AS {f}x{k}" for k, w in enumerate(words) for f in "qsb")
    return f"""d0 AS (SELECT doc_id, 'd/' || doc_id AS id, text, split_part(text, ' ', 1) AS name, source || '.' || split_part(text, ' ', 1) AS own, text[1:60] AS sig, CASE WHEN doc_id % 10 = 0 THEN 'tests/x' || doc_id ELSE 'src/x' || doc_id END AS path, CASE WHEN doc_id % 7 = 0 THEN 'file' ELSE 'function' END AS kind FROM documents),
      d1 AS (SELECT *, path || ' ' || own AS qual, {_terms_sql('name')} AS parts, length(text) AS len FROM d0), d2 AS (SELECT id, kind, path, qual, sig, text, len, {names}, {counts} FROM d1),
      st AS (SELECT {idfs}, avg(len) AS a FROM d2), p1 AS (SELECT d2.*, st.*, {score(first)} AS score1 FROM d2, st), p2 AS (SELECT * FROM p1 WHERE score1 > 0 ORDER BY score1 DESC, id LIMIT 600),
      p3 AS (SELECT *, {_terms_sql('qual')} AS qt, {_terms_sql('sig')} AS st, {_terms_sql('text')} AS bt FROM p2), p4 AS (SELECT *, {tiers} FROM p3),
      lex AS (SELECT id, {score({(f, k): (f"{f}{k}" if f == "n" else f"{f}x{k}") for f in fields for k in range(len(words))})} AS score FROM p4)"""


@query(f"WITH {_lexical_sql()} SELECT id, round(score, 6) AS score FROM lex WHERE score > 0")
def lexical_rank(spark, d):
    return search.lexical(doc_symbols(spark, d), list(WORDS[:3])).select("id", F.round("score", 6).alias("score"))


def _doc_edges(spark, d):
    n = F.lit(max(1, table(spark, d, "documents").count()))
    return table(spark, d, "events").select(F.concat(F.lit("d/"), (F.col("event_id") % n).cast("string")).alias("source"), F.concat(F.lit("d/"), ((F.col("event_id") * 31 + F.col("user_id")) % n).cast("string")).alias("target"), F.lit("calls").alias("relation"))


def _degree_sql() -> str:
    n = "(SELECT count(*) FROM documents)"
    return f"c AS (SELECT id, count(*)::DOUBLE AS rank FROM (SELECT 'd/' || (event_id * 31 + user_id) % {n} AS id, 'd/' || event_id % {n} AS source FROM events) WHERE id <> source GROUP BY 1)"


@query(f"WITH {_lexical_sql()}, s AS (SELECT * FROM lex WHERE score > 0), {_degree_sql()}, m AS (SELECT max(score) AS s, (SELECT max(rank) FROM c) AS r FROM s) SELECT s.id, round(0.75 * score / m.s + 0.25 * coalesce(rank / m.r, 0), 6) AS score FROM s LEFT JOIN c USING (id), m")
def rank_blend(spark, d):
    """The blend with a plain centrality, the count of edges that come in."""
    e = _doc_edges(spark, d).filter("source <> target")
    central = e.groupBy(F.col("target").alias("id")).agg(F.count("*").cast("double").alias("rank"))
    return search.blend(staged(search.lexical(doc_symbols(spark, d), list(WORDS[:3])), "lexical"), central).select("id", F.round("score", 6).alias("score"))


def _ask_sql() -> str:
    """The whole of ask: lexical score, two steps around the 200 best, twenty rounds of PageRank both ways, blend, the 8 best."""
    n = "(SELECT count(*) FROM documents)"
    steps = ["r0 AS (SELECT id, share AS rank FROM sd)"]
    for i in range(1, 21):
        steps.append(f"""r{i} AS MATERIALIZED (SELECT id, sum(r) AS rank FROM (SELECT o.target AS id, 0.85 * sum(rank / deg) AS r FROM r{i - 1} JOIN o ON o.source = r{i - 1}.id GROUP BY 1
          UNION ALL SELECT id, share * (0.15 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE id NOT IN (SELECT source FROM o))) FROM sd) GROUP BY id)""")
    return f"""{_lexical_sql()}, s AS MATERIALIZED (SELECT * FROM lex WHERE score > 0), sd AS MATERIALIZED (SELECT id, score / sum(score) OVER () AS share FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 200)),
      e AS (SELECT * FROM (SELECT 'd/' || event_id % {n} AS source, 'd/' || (event_id * 31 + user_id) % {n} AS target FROM events) WHERE source <> target), b AS MATERIALIZED (SELECT source, target FROM e UNION ALL SELECT target, source FROM e),
      n1 AS (SELECT id FROM sd UNION SELECT b.target FROM b JOIN sd ON b.source = sd.id), n2 AS MATERIALIZED (SELECT id FROM n1 UNION SELECT b.target FROM b JOIN n1 ON b.source = n1.id),
      o AS MATERIALIZED (SELECT source, target, count(*) OVER (PARTITION BY source) AS deg FROM b WHERE source IN (SELECT id FROM n2) AND target IN (SELECT id FROM n2)), {', '.join(steps)}
      SELECT s.id, round(0.75 * score / (SELECT max(score) FROM s) + 0.25 * coalesce(rank, 0) / (SELECT max(rank) FROM r20), 6) AS score FROM s LEFT JOIN r20 USING (id) ORDER BY 2 DESC, 1 LIMIT 8"""


@query(f"WITH {_ask_sql()}")
def ask_ranked(spark, d):
    return search.ask(doc_symbols(spark, d), _doc_edges(spark, d), list(WORDS[:3])).select("id", F.round("score", 6).alias("score"))


@query("""WITH p AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS ps FROM part), c AS (SELECT id, len(list_filter(ps, lambda x: x = 'ring')) AS exact,
  len(list_filter(ps, lambda x: x <> 'ring' AND (starts_with(x, 'ring') OR (length(x) >= 3 AND starts_with('ring', x))))) AS related FROM p) SELECT id, exact::BIGINT AS exact, related::BIGINT AS related, exact + 0.65 * related AS count FROM c""")
def name_tiers(spark, d):
    return search.name_tiers(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.lower("p_name"), " ").alias("parts")), "ring")


@query(f"WITH {NODES} SELECT id, s::BIGINT AS start_line, e::BIGINT AS end_line, row_number() OVER (ORDER BY s, e, id)::BIGINT AS pos FROM nodes WHERE id LIKE 'nation/%'")
def skeleton_order(spark, d):
    from pyspark.sql import Window as W

    own = search.skeleton(views.star_nodes(spark, d).withColumn("path", graph.cluster()), "nation")
    return own.select("id", "start_line", "end_line", F.row_number().over(W.orderBy("start_line", "end_line", "id")).cast("long").alias("pos"))  # one file's definitions


@query(f"{LINES}, {SPANS} SELECT doc_id, substr(string_agg(line, chr(10) ORDER BY line_no), 1, 16000) AS residual FROM lines l WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = l.doc_id AND l.line_no BETWEEN s.start_line AND s.end_line) GROUP BY doc_id")
def residual_lines(spark, d):
    files = views.doc_files(spark, d)
    return search.residual(views.doc_lines(files), views.doc_spans(files), "doc_id")


@query(r"SELECT doc_id, path, regexp_matches(path, '(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|_test\.[a-z]+$|\.(test|spec)\.[a-z]+$') AS is_test FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'tests/a.py' WHEN 1 THEN 'src/test_b.py' WHEN 2 THEN 'src/c.spec.ts' WHEN 3 THEN 'specs/d.rb' WHEN 4 THEN 'pkg/e_test.go' ELSE 'src/contest.py' END AS path FROM documents)")
def test_path_penalty(spark, d):
    k = F.col("doc_id") % 6
    path = F.when(k == 0, "tests/a.py").when(k == 1, "src/test_b.py").when(k == 2, "src/c.spec.ts").when(k == 3, "specs/d.rb").when(k == 4, "pkg/e_test.go").otherwise("src/contest.py")
    return table(spark, d, "documents").select("doc_id", path.alias("path")).withColumn("is_test", text.is_test_path("path"))


# Incremental


@query("SELECT doc_id, sha256(text) AS body_hash FROM documents")
def body_hash(spark, d):
    return incremental.content_hash(views.doc_files(spark, d)).select("doc_id", "body_hash")


@query("""WITH f AS (SELECT source || '/' || lang || '/' || doc_id AS path, sha256(text) AS h FROM documents), p AS (SELECT substr(sha256(path), 1, 2) AS part, count(*) AS n, sha256(string_agg(path || ':' || h, chr(10) ORDER BY path || ':' || h)) AS h FROM f GROUP BY 1)
  SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, chr(10) ORDER BY part)) AS fingerprint FROM p""")
def tree_fingerprint(spark, d):
    return incremental.tree_fingerprint(incremental.content_hash(views.doc_files(spark, d)))


@query("SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 10 <> 1 AS hit FROM documents")
def cache_hits_misses(spark, d):
    files = incremental.content_hash(views.doc_files(spark, d)).select("doc_id", "path", "body_hash")
    cache = files.filter("doc_id % 10 <> 1").select("path", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("body_hash")).alias("body_hash"))
    return incremental.split_by_cache(files, cache).select("doc_id", "hit")


CARRY = """n AS (SELECT doc_id AS id, n_chars + (doc_id % 3 = 0)::INT AS h, doc_id % 40 + 5 AS s FROM documents), o AS (SELECT doc_id AS id, n_chars AS h, doc_id % 40 AS s, doc_id % 40 + 2 AS x, CASE WHEN doc_id % 4 > 0 THEN lang END AS summary, CASE WHEN doc_id % 5 = 0 THEN 'stale' ELSE 'ready' END AS state FROM documents WHERE doc_id % 10 <> 7),
  c AS (SELECT n.id, n.h::VARCHAR AS body_hash, n.s AS start_line, summary, CASE WHEN summary IS NULL THEN 'pending' WHEN state = 'ready' AND o.h = n.h THEN 'ready' ELSE 'stale' END AS summary_state, CASE WHEN summary IS NULL THEN NULL WHEN state = 'ready' AND o.h = n.h THEN x + n.s - o.s ELSE x END AS crux_start FROM n LEFT JOIN o ON o.id = n.id)"""


def _carried(spark, d):
    k, docs = F.col("doc_id"), table(spark, d, "documents")
    new = docs.select(k.alias("id"), (F.col("n_chars") + F.when(k % 3 == 0, 1).otherwise(0)).cast("string").alias("body_hash"), (k % 40 + 5).alias("start_line"))
    old = docs.filter(k % 10 != 7).select(k.alias("id"), F.col("n_chars").cast("string").alias("body_hash"), (k % 40).alias("start_line"), (k % 40 + 2).alias("crux_start"), F.when(k % 4 > 0, F.col("lang")).alias("summary"), F.when(k % 5 == 0, "stale").otherwise("ready").alias("summary_state"))
    return incremental.carry_over(new, old)


@query(f"WITH {CARRY} SELECT * FROM c")
def carry_over(spark, d):
    return _carried(spark, d)


@query(f"WITH {CARRY} SELECT count(*) FILTER (summary_state = 'ready') AS ready, count(*) FILTER (summary_state = 'pending') AS pending, count(*) FILTER (summary_state = 'stale') AS stale FROM c")
def stale_report(spark, d):
    return incremental.state_counts(_carried(spark, d))


@query("SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber = 1 THEN 'stored' ELSE 'fresh' END AS side FROM lineitem WHERE l_linenumber IN (1, 7) AND false UNION ALL (SELECT *, 'stored' FROM (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber < 4 EXCEPT ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber > 2)) UNION ALL (SELECT *, 'fresh' FROM (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber > 2 EXCEPT ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber < 4))")
def check_structure(spark, d):
    lines = table(spark, d, "lineitem")
    return incremental.check(lines.filter("l_linenumber < 4"), lines.filter("l_linenumber > 2"), ["l_orderkey", "l_partkey"])


@query("SELECT DISTINCT l_partkey AS path FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def cache_retain(spark, d):
    return incremental.retain(table(spark, d, "lineitem").select(F.col("l_partkey").alias("path")).distinct(), table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("path")))


@query("""WITH x AS (SELECT doc_id AS id, text, 1 + doc_id % 3 AS s, 1 + doc_id % 3 + 6 AS e, doc_id % 5 AS cf, doc_id % 5 + 14 AS ct FROM documents), y AS (SELECT id, text, greatest(cf, s) AS lo, least(ct, e, greatest(cf, s) + 11) AS hi FROM x),
  z AS (SELECT id, lo AS from_line, hi AS to_line, coalesce(array_to_string(string_split(text, chr(10))[lo:hi], chr(10)), '') AS code FROM y) SELECT * FROM z WHERE to_line >= from_line AND trim(code) <> ''""")
def crux_slice(spark, d):
    k = F.col("doc_id")
    n = table(spark, d, "documents").select(k.alias("id"), F.col("text").alias("content"), (1 + k % 3).alias("start_line"), (7 + k % 3).alias("end_line"), (k % 5).alias("crux_from"), (k % 5 + 14).alias("crux_to"))
    return incremental.crux_slice(n)


# Sessions


@query("""SELECT user_id AS session, count(*) FILTER (event_type = 'view') AS graph_reads, count(*) FILTER (event_type IN ('click', 'purchase')) AS source_reads, coalesce(sum(CASE WHEN event_type = 'view' THEN round(value * 100)::BIGINT ELSE 0 END), 0)::BIGINT AS saved_micros,
  round_even(100.0 * count(*) FILTER (event_type = 'view') / nullif(count(*) FILTER (event_type IN ('view', 'click', 'purchase')), 0), 0)::BIGINT AS mix FROM events GROUP BY 1""")
def session_stats(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("tool"), F.round(F.col("value") * 100).cast("long").alias("saved_micros"))
    return sessions.session_stats(e)


@query("SELECT user_id AS session, sum(round(value * 100)::BIGINT)::BIGINT AS micros, sum(event_id % 50)::BIGINT AS tokens, round(sum(round(value * 100)::BIGINT) / nullif(sum(event_id % 50), 0), 6) AS rate FROM events GROUP BY 1")
def blended_rate(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.round(F.col("value") * 100).cast("long").alias("micros"), (F.col("event_id") % 50).alias("tokens"))
    return sessions.blended_rate(e).withColumn("rate", F.round("rate", 6))


@query("SELECT event_id, round_even((CASE event_type WHEN 'click' THEN 3000 WHEN 'view' THEN 15000 END) * (20 * (event_id % 1000) + 25 * (user_id % 100) + 2 * (event_id % 77)) / 20000.0, 0)::BIGINT AS micros FROM events")
def usage_price(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("a"), (F.col("user_id") % 100).alias("b"), (F.col("event_id") % 77).alias("c"))
    return e.select("event_id", sessions.price_micros("model", "a", "b", "c", {"click": 3000, "vi": 1, "view": 15000}).alias("micros"))


@query("SELECT conv_id, turn, role, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS segment FROM conversations")
def turn_segments(spark, d):
    return sessions.turn_segments(table(spark, d, "conversations").select("conv_id", "turn", "role"))


@query("WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'user' GROUP BY 1) SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations JOIN l USING (conv_id) WHERE turn > last GROUP BY 1")
def last_turn(spark, d):
    return sessions.last_turn(table(spark, d, "conversations"))


@query("WITH m AS (SELECT conv_id, turn // 2 AS mid, arg_max(CASE WHEN role <> 'system' THEN length(text) END, turn) AS x, arg_max(coalesce(CASE WHEN role <> 'system' THEN length(text) END, -1), turn) AS y FROM conversations GROUP BY 1, 2) SELECT conv_id, sum(y)::BIGINT AS billed FROM m WHERE y >= 0 GROUP BY 1 HAVING sum(y) > 0")
def turn_billing(spark, d):
    c = table(spark, d, "conversations")
    return sessions.turn_billing(c.select("conv_id", F.floor(F.col("turn") / 2).alias("message_id"), F.col("turn").alias("seq"), F.when(F.col("role") != "system", F.length("text")).cast("long").alias("micros")))


@query("""WITH m AS (SELECT DISTINCT user_id AS key, event_id % (SELECT count(*) FROM documents) AS doc_id FROM events), b AS (SELECT key, count(*) AS files, sum(n_chars) AS base FROM m JOIN documents USING (doc_id) GROUP BY 1),
  t AS (SELECT key, files, round_even(base / 4.0, 0)::BIGINT AS base_tokens, round_even((key * 997 % 90000) / 4.0, 0)::BIGINT AS pack_tokens FROM b)
  SELECT *, base_tokens - pack_tokens AS saved, round_even(100.0 * (base_tokens - pack_tokens) / base_tokens, 0)::BIGINT AS percent FROM t WHERE base_tokens > pack_tokens""")
def savings_baseline(spark, d):
    docs = table(spark, d, "documents")
    m = table(spark, d, "events").select(F.col("user_id").alias("key"), (F.col("event_id") % F.lit(max(1, docs.count()))).alias("path"), (F.col("user_id") * 997 % 90000).alias("packed_chars"))
    return sessions.savings(m, docs.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("chars")))


@query("WITH p AS (SELECT 'a/' || source || '/' || lang || '/' || doc_id AS path, source, lang FROM documents), s AS (SELECT DISTINCT unnest(['a', 'a/src1', 'a/src1/en', 'a/src2/fr']) AS prefix) SELECT DISTINCT path, arg_max(prefix, length(prefix)) OVER (PARTITION BY path) AS prefix FROM p JOIN s ON path = prefix OR starts_with(path, prefix || '/')")
def scope_longest_prefix(spark, d):
    paths = table(spark, d, "documents").select(F.concat_ws("/", F.lit("a"), "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return sessions.longest_scope(paths, of(spark, "prefix", "a", "a/src1", "a/src1/en", "a/src2/fr"))


@query("SELECT arg_max(user_id, (ts, user_id)) AS session FROM events")
def latest_session(spark, d):
    return sessions.latest(table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("ts").alias("mtime")))


# Meaning


@query("""WITH RECURSIVE x AS (SELECT source, doc_id, least(n_chars, 24000) AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
  w AS (SELECT source, doc_id, cost, rn, cost AS held, 0::BIGINT AS batch FROM x WHERE rn = 1 UNION ALL SELECT x.source, x.doc_id, x.cost, x.rn, CASE WHEN w.held > 0 AND w.held + x.cost > 48000 THEN x.cost ELSE w.held + x.cost END, w.batch + (w.held > 0 AND w.held + x.cost > 48000)::BIGINT
  FROM w JOIN x ON x.rn = w.rn + 1 AND x.source IS NOT DISTINCT FROM w.source) SELECT source, doc_id, cost, batch FROM w""")
def batch_pack(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.least("n_chars", F.lit(24_000)).alias("cost"))
    return meaning.pack(rows, "source", "doc_id", "cost")


MERGE = "WITH x AS (SELECT p_partkey AS ord, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'other' ELSE p_type END AS type, p_brand || p_size AS summary, p_brand AS source, replace(p_name, ' ', '-') AS slug FROM part)"


@query(f"{MERGE} SELECT slug, arg_min(name, ord) AS name, coalesce(arg_min(type, ord) FILTER (type <> 'other'), 'other') AS type, arg_max(summary, (length(summary), -ord)) AS summary, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM x GROUP BY slug")
def concept_merge(spark, d):
    p = table(spark, d, "part")
    drafts = p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "other").otherwise(F.col("p_type")).alias("type"), F.concat("p_brand", F.col("p_size").cast("string")).alias("summary"), F.col("p_brand").alias("source"))
    return meaning.merge_concepts(drafts)


@query()
def slugify_ascii(spark, d):
    """Whole texts of all documents; SQL's accent stripping differs on some letters."""
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("name")).withColumn("slug", text.slug("name")).select("doc_id", "slug")


@query("SELECT doc_id, length(text)::BIGINT AS chars, (length(text) - length(replace(text, 'th', ''))) // 2 AS ths FROM documents")
def text_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.utf16_units("text").alias("chars"), text.occurrences("text", F.lit("th")).alias("ths"))


@query("SELECT event_type AS metric, count(*) AS samples, min(value) AS least, median(value) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_samp(value), 6) AS stdev FROM events GROUP BY 1")
def bench_summary(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("samples"), F.min("value").alias("least"), F.percentile("value", F.lit(0.5)).alias("median"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.round(F.stddev_samp("value"), 6).alias("stdev"))

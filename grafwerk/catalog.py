"""Every query of the engine by name, with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grafwerk.functions import text as T
from grafwerk.operators import incremental, knowledge, lexical, lookup, memory, resolve, rollup, traverse, vector, viz
from grafwerk.plans.store import build
from grafwerk.sources import files as files_source
from grafwerk.sources import parsers, views
from grafwerk.sources.views import Graph, table
from grafwerk.streaming import metrics

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

VIEWS = "WITH RECURSIVE " + views.SQL
RESOLVED = VIEWS + "," + resolve.SQL
AS_OF = "2024-02-01 00:00:00"


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _oracles[name] = sql
        return f

    return keep


def on_graph(name: str, sql: str | None = None, resolved: bool = True) -> Callable:
    """A query over the built graph; its SQL continues the views (and the resolved edges)."""

    def keep(f: Callable[[Graph], DataFrame]) -> Callable:
        add(name, None if sql is None else (RESOLVED if resolved else VIEWS) + sql)(lambda spark, sf_dir: f(build(spark, sf_dir)))
        return f

    return keep


def on_tables(name: str, tables: str, sql: str | None = None) -> Callable:
    """A query over driver tables, given to the function in this order."""

    def keep(f: Callable[..., DataFrame]) -> Callable:
        add(name, sql)(lambda spark, sf_dir: f(*(table(spark, sf_dir, t) for t in tables.split())))
        return f

    return keep


def name_of(graph: Graph, symbol_id: int = 7) -> str:
    return graph.symbols.where(F.col("id") == symbol_id).first()["name"]


NAME = "(SELECT name FROM symbols WHERE id = 7)"


# --- resolution -----------------------------------------------------------------------
@on_graph("r1_symbol_index", " SELECT s.name, s.id, f.repo_id, s.file_id, s.qualified_name FROM symbols s JOIN files f ON f.id = s.file_id", False)
def _(g):
    return lookup.located(g).select("name", "id", "repo_id", "file_id", "qualified_name")


@on_graph("r2_import_index", " SELECT i.file_id, f.repo_id, count(*)::BIGINT AS imports, min(imported_path) AS first FROM imports i JOIN files f ON f.id = i.file_id GROUP BY ALL", False)
def _(g):
    place = g.files.select(F.col("id").alias("file_id"), "repo_id")
    return g.imports.join(place, "file_id").groupBy("file_id", "repo_id").agg(F.count("*").alias("imports"), F.min("imported_path").alias("first"))


def _brands(g: Graph) -> DataFrame:
    return g.symbols.select(F.split("qualified_name", "\\.")[0].alias("type_name")).distinct()


@on_graph("r3_members_index", " SELECT string_split(qualified_name, '.')[1] AS type_name, name, count(*)::BIGINT AS members FROM symbols WHERE kind IN ('method', 'function', 'property', 'variable', 'field', 'constant') GROUP BY ALL", False)
def _(g):
    return resolve.members(g, _brands(g)).groupBy("type_name", "name").agg(F.count("*").alias("members"))


@on_graph("r4_ancestors", """, up AS (SELECT DISTINCT s.name AS type_name, e.target_name AS ancestor FROM raw_edges e JOIN symbols s ON s.id = e.source_id WHERE e.kind IN ('extends', 'implements')),
w AS (SELECT type_name, ancestor, 1 AS distance FROM up UNION ALL SELECT DISTINCT a.type_name, b.ancestor, 2 FROM up a JOIN up b ON b.type_name = a.ancestor)
SELECT type_name, ancestor, min(distance)::INT AS distance FROM w WHERE type_name <> ancestor GROUP BY ALL""", False)  # fmt: skip
def _(g):
    return resolve.ancestors(g, 2)


@on_graph("r6_resolve_edges", " SELECT id, source_id, target_name, target_id, resolution, tier FROM redges")
def _(g):
    return g.edges.select("id", "source_id", "target_name", "target_id", "resolution", "tier")


@add("r6_resolve_receiver", RESOLVED + """, mem AS (SELECT e.id, count(*) AS n, min(c.id) AS c0 FROM raw_edges e JOIN symbols c ON c.name = e.target_name AND c.brand = e.receiver_type AND c.kind IN ('method', 'function', 'property', 'variable', 'field', 'constant') GROUP BY e.id)
SELECT CASE WHEN m.n = 1 THEN 'exact' WHEN m.n > 1 THEN 'ambiguous' ELSE r.resolution END AS resolution, CASE WHEN m.n > 0 THEN 'receiver' ELSE r.tier END AS tier, count(*)::BIGINT AS edges,
sum(CASE WHEN m.n = 1 THEN m.c0 WHEN m.n IS NULL THEN r.target_id END)::BIGINT AS targets FROM redges r LEFT JOIN mem m ON m.id = r.id GROUP BY ALL""")  # fmt: skip
def _(spark, sf_dir):
    g = build(spark, sf_dir)
    return resolve.resolve_edges(g, _brands(g)).groupBy("resolution", "tier").agg(F.count("*").alias("edges"), F.sum("target_id").alias("targets"))


@add("r6_resolve_inherited", RESOLVED + """, br AS (SELECT DISTINCT brand FROM symbols), up AS (SELECT brand AS t, left(brand, 7) || (right(brand, 1)::INT % 5 + 1) AS a FROM br),
w AS (SELECT brand AS t, brand AS a, 0 AS d FROM br UNION ALL SELECT w.t, up.a, d + 1 FROM w JOIN up ON up.t = w.a WHERE d < 8),
h AS (SELECT e.id, w.d, count(*) AS n, min(c.id) AS c0 FROM raw_edges e JOIN w ON w.t = e.receiver_type JOIN symbols c ON c.name = e.target_name AND c.brand = w.a AND c.kind IN ('method', 'function', 'property', 'variable', 'field', 'constant') GROUP BY ALL),
m AS (SELECT id, arg_min(n, d) AS n, arg_min(c0, d) AS c0 FROM h GROUP BY id)
SELECT r.id, CASE WHEN m.n = 1 THEN 'exact' WHEN m.n > 1 THEN 'ambiguous' ELSE r.resolution END AS resolution, CASE WHEN m.n > 0 THEN 'receiver' ELSE r.tier END AS tier, CASE WHEN m.n = 1 THEN m.c0 WHEN m.n IS NULL THEN r.target_id END AS target_id FROM redges r LEFT JOIN m ON m.id = r.id""")  # fmt: skip
def _(spark, sf_dir):
    """Each brand inherits from the next one of its maker, so members are found through ancestors."""
    g = build(spark, sf_dir)
    brands = _brands(g)
    up = brands.select("type_name", F.concat(F.left("type_name", F.lit(7)), (F.right("type_name", F.lit(1)).cast("int") % 5 + 1).cast("string")).alias("ancestor"))
    return resolve.resolve_edges(g, brands, up).select("id", "resolution", "tier", "target_id")


@on_graph("r7_import_scores", " SELECT sf AS file_id, cand AS candidate, score::INT AS score FROM sc")
def _(g):
    return resolve.import_scores(resolve.candidates(g), g.imports)


@on_graph("r10_repair_incoming", f" SELECT id, target_id, resolution FROM redges WHERE target_name = {NAME}")
def _(g):
    return resolve.repair_incoming(g, g.symbols.where("id = 7").select("name")).select("id", "target_id", "resolution")


@on_graph("r11_resolution_stats", " SELECT resolution, tier, count(*)::BIGINT AS edges FROM redges GROUP BY ALL")
def _(g):
    return resolve.resolution_stats(g.edges)


@on_graph("r11_resolve_rate", " SELECT count(*)::BIGINT AS edges, round(avg((resolution <> 'unresolved')::INT), 6) AS resolve_rate FROM redges")
def _(g):
    return resolve.resolve_rate(g.edges)


FUZZY = f"SELECT id FROM redges WHERE target_name = {NAME} UNION SELECT id FROM redges WHERE target_id IN (SELECT id FROM symbols WHERE name = {NAME})"


@on_graph("r12_false_positive_rate", f""", p AS (SELECT count(*) AS precise FROM redges WHERE target_id IN (SELECT id FROM symbols WHERE name = {NAME})), z AS (SELECT count(*) AS fuzzy FROM ({FUZZY}))
SELECT precise::BIGINT AS precise, fuzzy::BIGINT AS fuzzy, CASE WHEN fuzzy > 0 THEN round(1 - precise / fuzzy, 6) END AS false_positive_rate FROM p, z""")  # fmt: skip
def _(g):
    return resolve.fuzzy_false_positive_rate(g, name_of(g))


# --- lookups --------------------------------------------------------------------------
@on_graph("g1_find_definition", f" SELECT s.id, s.name, s.qualified_name, s.kind, f.path, 1 AS match FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name = {NAME} ORDER BY kind, s.id LIMIT 50", False)
def _(g):
    return lookup.find_definition(g, name_of(g))


@on_graph("g1_find_definition_part", " SELECT s.id, s.name, s.qualified_name, s.kind, f.path, 3 AS match FROM symbols s JOIN files f ON f.id = s.file_id WHERE contains(lower(s.name), 'ol_1') ORDER BY kind, s.id LIMIT 50", False)
def _(g):
    return lookup.find_definition(g, "OL_1")


@on_graph("g2_find_by_id", " SELECT s.id, s.name, s.qualified_name, s.kind, f.path FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.id = 11", False)
def _(g):
    return lookup.find_by_id(g, 11)


@on_graph("g4_public_symbols", " SELECT f.language, count(*)::BIGINT AS symbols FROM symbols s JOIN files f ON f.id = s.file_id WHERE (f.language NOT IN ('kotlin', 'java') OR s.id % 2 = 0) AND kind IN ('function', 'method', 'class', 'interface', 'enum') GROUP BY ALL", False)
def _(g):
    rows = lookup.located(g).withColumn("modifiers", F.when(F.col("id") % 2 == 0, F.array(F.lit("public"))).otherwise(F.array(F.lit("private"))))
    return rows.where(lookup.is_public(F.col("language"), F.col("name"), F.col("kind"), F.col("modifiers"))).groupBy("language").agg(F.count("*").alias("symbols"))


@on_graph("g5_test_symbols", " SELECT CASE WHEN f.path LIKE '%/test/%' THEN 'path' ELSE '' END AS test, count(*)::BIGINT AS symbols FROM symbols s JOIN files f ON f.id = s.file_id GROUP BY ALL", False)
def _(g):
    return lookup.located(g).groupBy(lookup.test_method(F.col("path"), F.col("name"), F.col("qualified_name")).alias("test")).agg(F.count("*").alias("symbols"))


@on_graph("g6_filter_tests", " SELECT count(*)::BIGINT AS symbols FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.path NOT LIKE '%/test/%'", False)
def _(g):
    return lookup.located(g).where(lookup.test_method(F.col("path"), F.col("name"), F.col("qualified_name")) == "").agg(F.count("*").alias("symbols"))


@on_graph("g7_symbols_in_module", " SELECT s.id, s.name, s.kind, f.path FROM symbols s JOIN files f ON f.id = s.file_id WHERE lower(f.path) LIKE '%main/mod3%'", False)
def _(g):
    return lookup.symbols_in_module(g, "Main/mod3")


@on_graph("g8_files_exist", """, r AS (SELECT unnest(['F3.py', 'mod3/F3.kt', 'nowhere.py', 'src/main/mod3/F3.kt']) AS ref UNION SELECT regexp_replace(path, '^src/', '') FROM files)
SELECT r.ref, count(f.id) > 0 AS found FROM r LEFT JOIN files f ON f.path = r.ref OR ends_with(f.path, '/' || r.ref) GROUP BY r.ref""", False)  # fmt: skip
def _(g):
    fixed = g.files.sparkSession.createDataFrame([(x,) for x in ("F3.py", "mod3/F3.kt", "nowhere.py", "src/main/mod3/F3.kt")], "ref string")
    return lookup.files_exist(g.files, fixed.unionByName(g.files.select(F.regexp_replace("path", "^src/", "").alias("ref"))))


@on_graph("g9_symbols_exist", """, r AS (SELECT qualified_name || '()' AS ref FROM symbols WHERE id % 10 = 0 UNION SELECT 'Nope.' || name FROM symbols WHERE id % 10 = 1 UNION SELECT name || 'x' FROM symbols WHERE id % 10 = 2)
SELECT ref, NOT ends_with(ref, 'x') AS found FROM r""", False)  # fmt: skip
def _(g):
    s = g.symbols
    refs = s.where("id % 10 = 0").select(F.concat("qualified_name", F.lit("()")).alias("ref")).unionByName(s.where("id % 10 = 1").select(F.concat(F.lit("Nope."), "name").alias("ref"))).unionByName(s.where("id % 10 = 2").select(F.concat("name", F.lit("x")).alias("ref")))
    return lookup.symbols_exist(s, refs)


@on_graph("g13_stale_files", " SELECT id, path FROM files WHERE id % 3 = 0 ORDER BY path LIMIT 200", False)
def _(g):
    return lookup.stale_files(g.files, g.files.where("id % 3 = 0").select("path"))


@on_graph("s13_enclosing_symbol", """, q AS (SELECT DISTINCT id AS file_id, l AS line FROM files, (SELECT unnest(generate_series(1, 90, 7)) AS l)),
h AS (SELECT q.file_id, q.line, s.id AS owner, row_number() OVER (PARTITION BY q.file_id, q.line ORDER BY line_end - line_start, s.id) AS n FROM q JOIN symbols s ON s.file_id = q.file_id AND q.line BETWEEN line_start AND line_end)
SELECT file_id, line::INT AS line, owner FROM h WHERE n = 1""", False)  # fmt: skip
def _(g):
    lines = g.files.select(F.col("id").alias("file_id"), F.explode(F.sequence(F.lit(1), F.lit(90), F.lit(7))).alias("line"))
    return lookup.enclosing_symbol(lines, g.symbols)


@on_graph("s15_preceding_definition", """, d AS (SELECT file_id, line_start AS line, min(id) AS lo, max(id) AS def_id FROM symbols GROUP BY ALL),
r AS (SELECT e.id AS ref_id, s.file_id, e.line * 9 AS line FROM raw_edges e JOIN symbols s ON s.id = e.source_id WHERE e.kind = 'references')
SELECT r.ref_id, r.file_id, r.line, d.def_id AS owner FROM r ASOF LEFT JOIN d ON d.file_id = r.file_id AND r.line >= d.line""", False)  # fmt: skip
def _(g):
    refs = g.raw_edges.where("kind = 'references'").join(g.symbols.select(F.col("id").alias("source_id"), "file_id"), "source_id").select("id", "file_id", (F.col("line") * 9).alias("line"))
    return lookup.preceding_definition(refs, g.symbols.select("id", "file_id", F.col("line_start").alias("line")))


# --- traversals -----------------------------------------------------------------------
CALLERS = " SELECT e.id AS edge_id, e.source_id, s.name AS caller, f.path, e.kind, e.line FROM redges e JOIN symbols s ON s.id = e.source_id JOIN files f ON f.id = s.file_id WHERE "


@on_graph("t1_callers", CALLERS + f"e.target_id IN (SELECT id FROM symbols WHERE name = {NAME}) ORDER BY e.id LIMIT 200")
def _(g):
    return lookup.callers(g, name_of(g))


@on_graph("t1_callers_fuzzy", CALLERS + f"e.id IN ({FUZZY}) ORDER BY e.id LIMIT 200")
def _(g):
    return lookup.callers(g, name_of(g), fuzzy=True)


CALLEES = f" SELECT e.id AS edge_id, e.target_id, coalesce(t.name, e.target_name) AS callee, coalesce(t.kind, 'unknown') AS callee_kind, f.path, e.kind, e.line FROM redges e JOIN symbols s ON s.id = e.source_id JOIN files f ON f.id = s.file_id LEFT JOIN symbols t ON t.id = e.target_id WHERE s.name = {NAME}"


@on_graph("t2_callees", CALLEES + " AND e.target_id IS NOT NULL ORDER BY e.id LIMIT 200")
def _(g):
    return lookup.callees(g, name_of(g))


@on_graph("t2_callees_fuzzy", CALLEES + " ORDER BY e.id LIMIT 200")
def _(g):
    return lookup.callees(g, name_of(g), fuzzy=True)


@on_graph("t9_callers_or_fuzzy", f""", p AS (SELECT id FROM redges WHERE target_id IN (SELECT id FROM symbols WHERE name = {NAME})), z AS ({FUZZY})
SELECT e.id AS edge_id, e.source_id, s.name AS caller, f.path, e.kind, e.line, CASE WHEN (SELECT count(*) FROM p) > 0 THEN 'precise' ELSE 'fuzzy' END AS mode
FROM redges e JOIN symbols s ON s.id = e.source_id JOIN files f ON f.id = s.file_id WHERE e.id IN (SELECT id FROM p) OR ((SELECT count(*) FROM p) = 0 AND e.id IN (SELECT id FROM z)) ORDER BY e.id LIMIT 200""")  # fmt: skip
def _(g):
    return lookup.callers_or_fuzzy(g, name_of(g))


STEPS = ", ce AS MATERIALIZED (SELECT DISTINCT source_id, target_id FROM redges WHERE target_id IS NOT NULL AND kind IN ('calls', 'extends', 'implements')), seed AS (SELECT id FROM symbols WHERE name = " + NAME + "), "
IMPACT = STEPS + """b AS (SELECT id AS node, 0 AS depth FROM seed UNION SELECT ce.source_id, b.depth + 1 FROM b JOIN ce ON ce.target_id = b.node WHERE b.depth < 10),
m AS MATERIALIZED (SELECT node, min(depth) - 1 AS depth FROM b WHERE depth > 0 AND node NOT IN (SELECT id FROM seed) GROUP BY node) """  # fmt: skip


@on_graph("t3_impact", IMPACT + "SELECT m.node, s.name, f.path, m.depth::INT AS depth, CASE WHEN f.path LIKE '%/test/%' THEN 'path' ELSE '' END AS test, (SELECT count(*) FROM m) > 500 AS truncated FROM m JOIN symbols s ON s.id = m.node JOIN files f ON f.id = s.file_id ORDER BY m.depth, m.node LIMIT 500")
def _(g):
    return traverse.impact(g, name_of(g))


@on_graph("t8_impact_histogram", IMPACT + "SELECT m.depth::INT AS depth, count(*)::BIGINT AS symbols, count(*) FILTER (f.path LIKE '%/test/%')::BIGINT AS tests FROM m JOIN symbols s ON s.id = m.node JOIN files f ON f.id = s.file_id GROUP BY 1")
def _(g):
    return traverse.impact_histogram(g, name_of(g))


@on_graph("t4_cycles", """, ce AS (SELECT DISTINCT source_id AS a, target_id AS b FROM redges WHERE target_id IS NOT NULL AND kind IN ('calls', 'extends', 'implements') AND source_id <> target_id)
SELECT x.a || '>' || x.b AS ring, 2 AS length FROM ce x JOIN ce y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b
UNION SELECT x.a || '>' || x.b || '>' || y.b, 3 FROM ce x JOIN ce y ON y.a = x.b JOIN ce z ON z.a = y.b AND z.b = x.a WHERE x.a < x.b AND x.a < y.b AND y.b <> x.b""")  # fmt: skip
def _(g):
    return traverse.cycles(g, 3)


@on_graph("t6_flow", STEPS + """b AS (SELECT id AS node, 0 AS depth, NULL::BIGINT AS parent FROM seed UNION SELECT ce.target_id, b.depth + 1, b.node FROM b JOIN ce ON ce.source_id = b.node WHERE b.depth < 8),
m AS (SELECT node, min(depth) AS depth FROM b GROUP BY node), p AS (SELECT m.node, m.depth, min(b.parent) AS parent FROM m JOIN b ON b.node = m.node AND b.depth = m.depth GROUP BY ALL), o AS (SELECT source_id, count(*) AS n FROM ce GROUP BY 1)
SELECT p.node, s.name, p.depth::INT AS depth, p.parent, coalesce(o.n, 0)::BIGINT AS callees, array_to_string(string_split(f.path, '/')[-3:-2], '/') AS module
FROM p LEFT JOIN o ON o.source_id = p.node JOIN symbols s ON s.id = p.node JOIN files f ON f.id = s.file_id""")  # fmt: skip
def _(g):
    return traverse.flow(g, name_of(g))


@on_graph("t10_closure", """, uq AS (SELECT name, min(id) AS only FROM symbols GROUP BY name HAVING count(*) = 1),
h AS (SELECT e.source_id, coalesce(t.name, e.target_name) AS target_name, min(e.target_id) AS target_id FROM redges e LEFT JOIN symbols t ON t.id = e.target_id GROUP BY ALL),
x AS MATERIALIZED (SELECT h.*, coalesce(h.target_id, uq.only) AS nxt FROM h LEFT JOIN uq ON uq.name = h.target_name),
l2 AS MATERIALIZED (SELECT a.source_id, b.target_name, min(b.target_id) AS target_id, min(b.nxt) AS nxt FROM (SELECT DISTINCT source_id, nxt FROM x WHERE nxt IS NOT NULL) a JOIN x b ON b.source_id = a.nxt GROUP BY ALL),
l3 AS (SELECT a.source_id, b.target_name, min(b.target_id) AS target_id FROM (SELECT DISTINCT source_id, nxt FROM l2 WHERE nxt IS NOT NULL) a JOIN x b ON b.source_id = a.nxt GROUP BY ALL),
n AS (SELECT source_id, target_name, target_id, 1 AS distance FROM x UNION ALL SELECT source_id, target_name, target_id, 2 FROM l2 UNION ALL SELECT source_id, target_name, target_id, 3 FROM l3)
SELECT distance, count(*)::BIGINT AS n, sum(source_id)::BIGINT AS sources, sum(target_id)::BIGINT AS targets, count(DISTINCT target_name)::BIGINT AS names FROM n GROUP BY 1""")  # fmt: skip
def _(g):
    return traverse.closure(g).groupBy("distance").agg(F.count("*").alias("n"), F.sum("source_id").alias("sources"), F.sum("target_id").alias("targets"), F.count_distinct("target_name").alias("names"))


DATAFLOW = """, ce AS (SELECT DISTINCT source_id, target_id FROM redges WHERE target_id IS NOT NULL AND kind IN ('calls', 'extends', 'implements')),
b AS (SELECT id AS seed, id AS node, 0 AS depth FROM symbols WHERE kind IN ('class', 'function', 'method', 'interface', 'enum') UNION SELECT b.seed, ce.source_id, b.depth + 1 FROM b JOIN ce ON ce.target_id = b.node WHERE b.depth < 5),
m AS (SELECT seed, node, min(depth) AS depth FROM b GROUP BY ALL), lv AS (SELECT seed, depth, sum(count(*)) OVER (PARTITION BY seed ORDER BY depth) AS n FROM m WHERE depth > 0 GROUP BY seed, depth),
stop AS (SELECT seed, coalesce(min(depth) FILTER (n > 500), 99) AS depth FROM lv GROUP BY 1),
df AS (SELECT m.seed AS symbol_id, least(count(*), 500)::BIGINT AS within, count(DISTINCT f.repo_id)::BIGINT AS repos, count(*) > 500 AS truncated FROM m JOIN stop ON stop.seed = m.seed AND m.depth <= stop.depth JOIN symbols s ON s.id = m.node JOIN files f ON f.id = s.file_id WHERE m.node <> m.seed GROUP BY 1) """  # fmt: skip


@on_graph("t11_dataflow_index", DATAFLOW + "SELECT * FROM df")
def _(g):
    return traverse.dataflow_index(g)


@on_graph("t12_dataflow_lookup", DATAFLOW + "SELECT df.* FROM df JOIN symbols s ON s.id = df.symbol_id WHERE s.name = (SELECT name FROM symbols WHERE kind = 'function' ORDER BY id LIMIT 1)")
def _(g):
    """From the index that is kept with the graph."""
    name = g.symbols.where("kind = 'function'").orderBy("id").first()["name"]
    return traverse.dataflow_lookup(g, name)


@on_graph("t13_ambiguous_dispatch", ", u AS (SELECT DISTINCT target_name, s.name FROM redges e JOIN symbols s ON s.id = e.source_id WHERE resolution = 'ambiguous'), r AS (SELECT *, row_number() OVER (PARTITION BY target_name ORDER BY name) AS k FROM u) SELECT target_name, count(*)::BIGINT AS n, string_agg(name, ',' ORDER BY name) FILTER (k <= 50) AS callers FROM r GROUP BY 1")
def _(g):
    return traverse.ambiguous_dispatch(g)


EDGES_OF_7 = " SELECT * FROM (SELECT id, source_id, target_id, kind FROM redges WHERE target_id = 7 ORDER BY id LIMIT 30) UNION ALL SELECT * FROM (SELECT id, source_id, target_id, kind FROM redges WHERE source_id = 7 AND target_id <> 7 ORDER BY id LIMIT 30)"


@on_graph("t16_symbol_subgraph", EDGES_OF_7)
def _(g):
    return traverse.symbol_subgraph(g, 7)


def _drawn(g: Graph) -> DataFrame:
    return traverse.symbol_subgraph(g, 7).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "kind")


@on_graph("k8_mermaid", f", d AS ({EDGES_OF_7}) SELECT 'graph LR' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS text FROM (SELECT '  n' || source_id || ' -->|' || kind || '| n' || target_id AS line FROM d)")
def _(g):
    return viz.mermaid(_drawn(g))


@on_graph("k8_dot", f""", d AS ({EDGES_OF_7}) SELECT 'digraph {{' || chr(10) || string_agg(line, chr(10) ORDER BY line) || chr(10) || '}}' AS text FROM (SELECT '  "' || source_id || '" -> "' || target_id || '" [label="' || kind || '"];' AS line FROM d)""")
def _(g):
    return viz.dot(_drawn(g))


@on_graph("k8_json", f""", d AS ({EDGES_OF_7}) SELECT '[' || string_agg('{{"source":' || source_id || ',"target":' || target_id || ',"kind":"' || kind || '"}}', ',' ORDER BY source_id, target_id, kind) || ']' AS text FROM d""")
def _(g):
    return viz.as_json(_drawn(g))


# --- aggregations ---------------------------------------------------------------------
@on_graph("a1_stats", """ SELECT 'repos' AS metric, '' AS key, count(*)::BIGINT AS value FROM repos UNION ALL SELECT 'files', '', count(*) FROM files UNION ALL SELECT 'symbols', '', count(*) FROM symbols
UNION ALL SELECT 'edges', '', count(*) FROM redges UNION ALL SELECT 'imports', '', count(*) FROM imports UNION ALL SELECT 'kind', kind, count(*) FROM symbols GROUP BY kind
UNION ALL SELECT 'repo', f.repo_id::VARCHAR, count(*) FROM symbols s JOIN files f ON f.id = s.file_id GROUP BY 2 UNION ALL SELECT 'resolved', '', count(*) FROM redges WHERE target_id IS NOT NULL""")  # fmt: skip
def _(g):
    return rollup.stats(g)


@on_graph("a3_tree", """, n AS (SELECT file_id, count(*) AS n FROM symbols GROUP BY 1) SELECT array_to_string(string_split(path, '/')[1:3], '/') AS folder, count(*)::BIGINT AS files, coalesce(sum(n), 0)::BIGINT AS symbols FROM files LEFT JOIN n ON n.file_id = files.id GROUP BY 1""", False)
def _(g):
    return rollup.tree(g)


@on_graph("a4_repo_dependencies", """, ns AS (SELECT DISTINCT f.repo_id, string_split(s.qualified_name, '.')[1] || '.' || left(s.name, 3) AS prefix FROM symbols s JOIN files f ON f.id = s.file_id)
SELECT f.repo_id AS source, ns.repo_id AS target, count(*)::BIGINT AS n, min(prefix) AS evidence FROM imports i JOIN files f ON f.id = i.file_id JOIN ns ON starts_with(i.imported_path, prefix) AND ns.repo_id <> f.repo_id GROUP BY ALL""", False)  # fmt: skip
def _(g):
    ns = lookup.located(g).select("repo_id", F.concat(F.split("qualified_name", "\\.")[0], F.lit("."), F.left("name", F.lit(3))).alias("prefix")).distinct()
    return rollup.repo_dependencies(g, ns)


PLACED = ", p AS (SELECT s.*, f.path, f.repo_id, array_to_string(string_split(f.path, '/')[1:3], '/') AS module FROM symbols s JOIN files f ON f.id = s.file_id), inc AS (SELECT target_id AS id, count(*) AS n FROM redges WHERE target_id IS NOT NULL GROUP BY 1) "


@on_graph("a6_key_files", PLACED + "SELECT path, coalesce(sum(n), 0)::BIGINT AS incoming FROM p LEFT JOIN inc ON inc.id = p.id WHERE path LIKE '%mod2%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(g):
    return rollup.key_files(g, "mod2")


@on_graph("a7_module_dependencies", PLACED + "SELECT a.module, b.module AS other, count(*)::BIGINT AS edges FROM redges e JOIN p a ON a.id = e.source_id JOIN p b ON b.id = e.target_id WHERE a.module <> b.module GROUP BY ALL")
def _(g):
    return rollup.module_dependencies(g)


@on_graph("a8_hub_types", PLACED + ", r AS (SELECT repo_id, p.id, name, coalesce(n, 0)::BIGINT AS incoming, row_number() OVER (PARTITION BY repo_id ORDER BY coalesce(n, 0) DESC, p.id)::INT AS rank FROM p LEFT JOIN inc ON inc.id = p.id WHERE kind IN ('class', 'interface')) SELECT * FROM r WHERE rank <= 10")
def _(g):
    return rollup.hub_types(g)


OUT = ", fc AS (SELECT s.id, s.name, s.file_id, count(*)::BIGINT AS outgoing FROM redges e JOIN symbols s ON s.id = e.source_id WHERE target_id IS NOT NULL AND s.kind IN ('function', 'method') GROUP BY ALL HAVING count(*) >= 5) "


@on_graph("a9_flow_candidates", OUT + "SELECT * FROM fc")
def _(g):
    return rollup.flow_candidates(g)


@on_graph("a10_flow_gaps", OUT + """, k AS (SELECT fc.*, string_split(f.path, '/')[-1] AS base, (SELECT count(DISTINCT file_id) FROM fc x WHERE x.name = fc.name) AS nf FROM fc JOIN files f ON f.id = fc.file_id),
u AS (SELECT CASE WHEN nf > 1 THEN name || '#' || base ELSE name END AS key, sum(outgoing)::BIGINT AS outgoing FROM k GROUP BY 1)
SELECT key, outgoing, key IN (SELECT name FROM symbols WHERE id % 2 = 0) AS covered FROM u""")  # fmt: skip
def _(g):
    return rollup.flow_gaps(g, g.symbols.where("id % 2 = 0").select(F.col("name").alias("key")))


@on_graph("a11_module_gaps", PLACED + ", m AS (SELECT module, count(*)::BIGINT AS symbols FROM p GROUP BY 1 HAVING count(*) >= 5) SELECT * FROM m WHERE NOT (module = 'src/main' OR starts_with(module, 'src/main/') OR module IN ('src/test/mod1', 'src/lib/mod5'))")
def _(g):
    guides = g.files.sparkSession.createDataFrame([("src/main",), ("src/test/mod1/deep/er",), ("src/lib/mod5",)], "prefix string")
    return rollup.module_gaps(g, guides)


@on_graph("s6_dominant_language", " SELECT repo_id, arg_min(language, (-n, language)) AS language FROM (SELECT repo_id, language, count(*) AS n FROM files GROUP BY ALL) GROUP BY 1", False)
def _(g):
    return rollup.dominant_language(g.files)


def _metrics(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("tool"), F.col("user_id").alias("session"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("ts").cast("timestamp").alias("at"), "event_id")


@on_tables("a12_tool_metrics", "events", "SELECT event_type AS tool, count(*)::BIGINT AS calls, round(avg(value), 6) AS avg_ms, count(*) FILTER (event_type = 'error')::BIGINT AS errors, round(100 * avg((event_type = 'error')::INT), 6) AS error_pct FROM events GROUP BY 1")
def _(events):
    return rollup.tool_metrics(_metrics(events))


@on_tables("a14_distinct_sessions", "events", "SELECT event_id % 200 AS id, least(count(DISTINCT user_id) / 5.0, 1.0)::DOUBLE AS refs FROM events GROUP BY 1")
def _(events):
    return memory.refs_signal(_metrics(events).withColumn("id", F.col("event_id") % 200))


@on_tables("a18_percentiles", "events", "SELECT event_type AS tool, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def _(events):
    return rollup.percentiles(_metrics(events))


@on_tables("a19_regressions", "events", """WITH t AS (SELECT event_type AS op, avg(value) FILTER (event_id % 2 = 0) AS now, avg(value) FILTER (event_id % 2 = 1) AS before FROM events GROUP BY 1)
SELECT op, now, before, round(100 * (now - before) / before, 6) AS delta_pct, round(100 * (now - before) / before, 6) > 15 AS regressed FROM t WHERE before > 0""")  # fmt: skip
def _(events):
    side = lambda k: events.where(f"event_id % 2 = {k}").groupBy(F.col("event_type").alias("op")).agg(F.avg("value").alias("sec"))
    return rollup.regressions(side(0), side(1))


@on_tables("i5_windowed_metrics", "events", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS tool, count(*)::BIGINT AS calls, count(*) FILTER (event_type = 'error')::BIGINT AS errors FROM events GROUP BY ALL")
def _(events):
    return metrics.windowed_metrics(_metrics(events)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@on_tables("i5_sessions", "events", """WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id AS session, count(DISTINCT k)::BIGINT AS sessions, count(*)::BIGINT AS events FROM s GROUP BY 1""")  # fmt: skip
def _(events):
    return metrics.sessions(_metrics(events)).groupBy("session").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


# --- lexical --------------------------------------------------------------------------
BM25 = """, w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(name || ' ' || qualified_name || ' ' || docstring), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM symbols),
tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY ALL), ln AS (SELECT id, sum(tf) AS len FROM tf GROUP BY 1), tt AS (SELECT count(*) AS n, avg(len) AS avg_len FROM ln),
hits AS (SELECT id, q, sum(tf) AS tf FROM tf JOIN (SELECT unnest(['$1', '$2']) AS q) ON starts_with(term, q) GROUP BY ALL), dq AS (SELECT q, count(*) AS df FROM hits GROUP BY 1),
sc AS (SELECT hits.id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score, count(*) AS k FROM hits JOIN dq ON dq.q = hits.q JOIN ln ON ln.id = hits.id, tt GROUP BY 1) """  # fmt: skip


@on_graph("l1_bm25", BM25.replace("$1", "brand").replace("$2", "1") + "SELECT id, score FROM sc WHERE k = 2", False)
def _(g):
    return lexical.bm25(lexical.postings(g.symbols, "id", ["name", "qualified_name", "docstring"]), ["brand", "1"], prefix=True)


@on_graph("l1_search_symbols", BM25.replace("$1", "brand").replace("$2", "1") + """, h AS (SELECT id, score, 0 AS source FROM sc WHERE k = 2 UNION ALL SELECT id, 0.0, 1 FROM symbols WHERE (name ILIKE '%brand#1%' OR qualified_name ILIKE '%brand#1%') AND id NOT IN (SELECT id FROM sc WHERE k = 2))
SELECT h.id, h.score::DOUBLE AS score, h.source, s.name, s.kind FROM h JOIN symbols s ON s.id = h.id ORDER BY source, score DESC, h.id LIMIT 100""", False)  # fmt: skip
def _(g):
    return lexical.search_symbols(g.symbols, "Brand#1")


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@on_tables("l5_tokens", "documents", f"""WITH w AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS l FROM documents)),
d AS (SELECT doc_id, w, min(i) AS i FROM w WHERE length(w) >= 3 AND NOT list_contains({STOP_SQL}, w) GROUP BY ALL), t AS (SELECT doc_id, count(*) AS n, array_to_string(list(w ORDER BY i)[1:5], ' ') AS first FROM d GROUP BY 1)
SELECT documents.doc_id, coalesce(n, 0)::INT AS n, coalesce(first, '') AS first FROM documents LEFT JOIN t ON t.doc_id = documents.doc_id""")  # fmt: skip
def _(docs):
    t = T.tokens(F.col("text"))
    return docs.select("doc_id", F.size(t).alias("n"), F.array_join(F.slice(t, 1, 5), " ").alias("first"))


def _stem_sql() -> str:
    rules = [f"WHEN ends_with(w, '{e}') AND length(w) - {len(e)} + {len(n)} >= 3 THEN left(w, length(w) - {len(e)}) || '{n}'" for e, n in T.ENDINGS]
    rules += [f"WHEN ends_with(w, '{e}') AND length(w) > {m} THEN left(w, length(w) - {len(e)})" for e, m in (("es", 5), ("s", 4), ("ed", 5))]
    return "CASE " + " ".join(rules) + " ELSE '' END"


@on_tables("l6_stems", "documents", f"SELECT stem, count(*)::BIGINT AS n FROM (SELECT {_stem_sql()} AS stem FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents) WHERE w <> '') GROUP BY 1")
def _(docs):
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("w")).where("w <> ''")
    return words.groupBy(T.stem(F.col("w")).alias("stem")).agg(F.count("*").alias("n"))


@on_tables("l7_query_tokens", "benchmark", f"""WITH b AS (SELECT item_id, text || ' getUserName and parseURL' AS text FROM benchmark), c AS (SELECT item_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT item_id, regexp_extract_all(text, '([A-Za-z0-9]*[a-z0-9][A-Z][A-Za-z0-9]*)', 1) AS l FROM b)),
cd AS (SELECT item_id, w, min(i) AS i FROM c GROUP BY ALL), t AS (SELECT item_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT item_id, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS l FROM b)),
td AS (SELECT item_id, w, 1000000 + min(i) AS i FROM t WHERE length(w) >= 3 AND NOT list_contains({STOP_SQL}, w) GROUP BY ALL), u AS (SELECT * FROM cd UNION ALL SELECT * FROM td ANTI JOIN cd ON cd.item_id = td.item_id AND lower(cd.w) = td.w)
SELECT item_id, string_agg(w, ' ' ORDER BY i) AS tokens FROM u GROUP BY 1""")  # fmt: skip
def _(questions):
    return questions.select("item_id", F.array_join(lexical.query_tokens(F.concat("text", F.lit(" getUserName and parseURL"))), " ").alias("tokens"))


@on_graph("l8_per_term_top", """, t AS (SELECT unnest(['ol', 'br']) AS term), r AS (SELECT s.id, s.name, t.term, row_number() OVER (PARTITION BY t.term ORDER BY s.name, s.id)::INT AS rank FROM symbols s JOIN t ON contains(lower(s.name), t.term)) SELECT * FROM r WHERE rank <= 5""", False)
def _(g):
    return lexical.per_term_top(g.symbols, ["ol", "br"])


def _docs(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("id"), F.left("text", F.lit(40)).alias("title"), F.col("source").alias("description"), F.col("text").alias("body"), F.array("lang", "source").alias("tags"))


@on_tables("l9_occurrence_search", "documents", "SELECT doc_id AS id, score FROM (SELECT doc_id, ((length(lower(left(text, 40))) - length(replace(lower(left(text, 40)), 'the', ''))) // 3 + (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3)::INT AS score FROM documents) WHERE score > 0 ORDER BY score DESC, id LIMIT 20")
def _(documents):
    return lexical.occurrence_search(_docs(documents), "The", ["title", "body"])


@on_tables("l10_weighted_search", "documents", "SELECT * FROM (SELECT doc_id AS id, (10 * (contains(lower(left(text, 40)), 'tion')::INT + contains(lower(left(text, 40)), 'ing')::INT) + 5 * (contains(source, 'tion')::INT + contains(source, 'ing')::INT) + contains(lower(text), 'tion')::INT + contains(lower(text), 'ing')::INT)::INT AS score FROM documents) WHERE score > 0 ORDER BY score DESC, id LIMIT 20")
def _(documents):
    return lexical.weighted_search(_docs(documents), ["tion", "ing"], {"title": 10, "description": 5, "body": 1})


@on_tables("l11_related", "documents", """WITH h AS (SELECT doc_id AS id, 4.0 AS score, lang, source FROM documents WHERE doc_id < 3), p AS (SELECT d.doc_id AS id, h.score, (d.lang = h.lang)::INT + (d.source = h.source)::INT AS shared FROM documents d JOIN h ON d.doc_id <> h.id AND (d.lang = h.lang OR d.source = h.source))
SELECT id, max(greatest(score * 0.5 + shared, 0.5))::DOUBLE AS score FROM p WHERE id >= 3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")  # fmt: skip
def _(documents):
    docs = _docs(documents)
    return lexical.related(docs, docs.where("id < 3").select("id", F.lit(4.0).alias("score")), "tags", 10)


def _intent_sql() -> str:
    pick = lambda i: "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{r[0]}') THEN '{r[i]}'" for r in T.INTENTS)
    return f"SELECT item_id, {pick(1)} ELSE 'complex' END AS intent, {pick(2)} ELSE 'ALL' END AS layer FROM benchmark"


@on_tables("l14_intents", "benchmark", _intent_sql())
def _(questions):
    return questions.select("item_id", T.intent(F.col("text")).alias("i")).select("item_id", "i.intent", "i.layer")


@on_tables("c15_slugs", "documents", "SELECT doc_id, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug FROM documents")
def _(documents):
    return documents.select("doc_id", T.slug(F.col("text")).alias("slug"))


@on_tables("k9_truncate", "documents", "SELECT doc_id, length(CASE WHEN length(text) <= 2000 THEN text ELSE regexp_replace(left(text, 2000), '\\n[^\\n]*$', '') END)::INT AS n FROM documents")
def _(documents):
    return documents.select("doc_id", F.char_length(T.truncate_result(F.col("text"), 2000)).alias("n"))


def _redact_sql() -> str:
    out = "regexp_replace(text, '(?i)<private>[\\s\\S]*?</private>', '[REDACTED]', 'g')"
    for p in T.SECRETS:
        out = f"regexp_replace({out}, '(?i){p.replace(chr(39), chr(39) * 2)}', '[REDACTED_SECRET]', 'g')"
    return f"SELECT doc_id, sha256({out}) AS sha FROM documents"


@on_tables("m20_redact", "documents", _redact_sql())
def _(documents):
    return documents.select("doc_id", F.sha2(F.encode(T.redact(F.col("text")), "UTF-8"), 256).alias("sha"))


@on_tables("s11_route_paths", "pages", r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', '') AS path FROM pages),
q AS (SELECT page_id, regexp_replace(array_to_string(list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$|^[0-9a-f]{8,}$') THEN ':id' ELSE s END), '/'), '/+$', '') AS route FROM p)
SELECT page_id, CASE WHEN route = '' THEN '/' ELSE route END AS route FROM q""")  # fmt: skip
def _(pages):
    return pages.select("page_id", parsers.route_path(F.col("url")).alias("route"))


@on_tables("s12_urls", "pages", r"""SELECT page_id, len(u)::INT AS n, u[1] AS first FROM (SELECT page_id, regexp_extract_all(html, 'https?://[^\s"''<>`]+') AS u FROM pages)""")
def _(pages):
    u = parsers.literal_urls(F.col("html"))
    return pages.select("page_id", F.size(u).alias("n"), F.get(u, F.lit(0)).alias("first"))


@on_graph("s3_skip_reasons", " SELECT CASE WHEN id * 20000 > 1000000 THEN 'size_cap' WHEN path LIKE 'src/lib/mod1/%' THEN NULL WHEN path LIKE '%/F1%' AND path LIKE '%.py' THEN 'gitignored' WHEN path LIKE 'src/lib/%' THEN 'config_exclude' END AS reason, count(*)::BIGINT AS files FROM files GROUP BY 1", False)
def _(g):
    reason = files_source.skip_reason(F.col("path"), F.col("id") * 20000, ["F1*.py"], ["src/lib/**"], ["src/lib/mod1/**"])
    return g.files.groupBy(reason.alias("reason")).agg(F.count("*").alias("files"))


@on_tables("s5_content_hash", "documents", "SELECT doc_id, sha256(text) AS hash, len(string_split(text, chr(10)))::INT AS line_count FROM documents")
def _(documents):
    return documents.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"), F.size(F.split("text", "\n", -1)).alias("line_count"))


@on_tables("s4_header_language", "pages", r"""SELECT page_id, CASE WHEN regexp_matches(left(html, 4096), '@interface|@protocol|@end|#import') THEN 'objc' WHEN regexp_matches(left(html, 4096), '\bclass\s|\bnamespace\s|\btemplate\s*<|std::') THEN 'cpp' ELSE 'c' END AS language FROM pages""")
def _(pages):
    return pages.select("page_id", files_source.header_language(F.col("html")).alias("language"))


@on_graph("s17_scip_ranges", " SELECT id, (line_start + 1)::INT AS line_start, (CASE WHEN id % 2 = 0 THEN line_end ELSE line_start END + 1)::INT AS line_end, name FROM symbols", False)
def _(g):
    parts = F.when(F.col("id") % 2 == 0, F.array("line_start", F.lit(0), "line_end", F.lit(9))).otherwise(F.array("line_start", F.lit(0), F.lit(5)))
    rows = g.symbols.select("id", "name", files_source.scip_range(parts).alias("r"))
    return rows.select("id", "r.line_start", "r.line_end", files_source.scip_name(F.concat(F.lit("scip py pkg 1 `m`/"), "name", F.lit("()."))).alias("name"))


# --- vectors --------------------------------------------------------------------------
V0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
COS = f"list_sum(list_transform(list_zip(embedding, {V0}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({V0}, lambda x: x::DOUBLE * x::DOUBLE))))"


def _query_vector(embeddings: DataFrame) -> list[float]:
    return list(embeddings.where("vec_id = 0").first()["embedding"])


@on_tables("v1_cosine", "embeddings", f"SELECT vec_id, round({COS}, 9) AS score FROM embeddings")
def _(embeddings):
    q = F.array(*[F.lit(x) for x in _query_vector(embeddings)])
    return embeddings.select("vec_id", F.round(vector.cosine(F.col("embedding"), q), 9).alias("score"))


@on_tables("v2_cosine_scan", "embeddings", f"SELECT * FROM (SELECT vec_id AS id, {COS} AS score FROM embeddings) WHERE score >= 0.05 ORDER BY score DESC, id LIMIT 10")
def _(embeddings):
    return vector.cosine_scan(embeddings, _query_vector(embeddings), 10, 0.05)


@on_tables("v4_rrf", "embeddings", """WITH a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY label, vec_id) AS rank FROM embeddings), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id DESC) AS rank FROM embeddings),
u AS (SELECT id, 1.0 / (60 + rank) AS s, 'l0' AS l FROM a WHERE rank <= 30 UNION ALL SELECT id, 0.5 / (60 + rank), 'l1' FROM b WHERE rank <= 400) SELECT id, round(sum(s)::DOUBLE, 9) AS score, string_agg(DISTINCT l, '+' ORDER BY l) AS provenance FROM u GROUP BY 1""")  # fmt: skip
def _(embeddings):
    rank = lambda *by: embeddings.select(F.col("vec_id").alias("id"), F.row_number().over(Window.orderBy(*by)).alias("rank"))
    return vector.rrf([rank("label", "vec_id").where("rank <= 30"), rank(F.desc("vec_id")).where("rank <= 400")], [1.0, 0.5])


HASHED = """WITH w AS (SELECT DISTINCT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents),
h AS (SELECT id, sha256(w) AS h FROM w), b AS (SELECT id, ('0x' || substr(h, 1, 2))::BIGINT AS i, ('0x' || substr(h, 9, 2))::BIGINT % 2 AS sg, (('0x' || substr(h, 11, 2))::BIGINT + ('0x' || substr(h, 13, 2))::BIGINT * 256 + ('0x' || substr(h, 15, 2))::BIGINT * 65536 + ('0x' || substr(h, 17, 2))::BIGINT * 16777216) % 1000 AS m FROM h),
s AS (SELECT id, i, sum(CASE sg WHEN 1 THEN 1.0 ELSE -1.0 END * (0.5 + m / 1000)) AS x FROM b GROUP BY ALL), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM s GROUP BY 1) """  # fmt: skip


@on_tables("v8_hash_embed", "documents", HASHED + "SELECT s.id, s.i::INT AS i, round(x / n, 6) AS x FROM s JOIN n ON n.id = s.id WHERE n > 0")
def _(documents):
    return vector.hash_embed(documents, "doc_id", F.col("text")).withColumn("x", F.round("x", 6))


@on_tables("v15_hash_search", "documents", HASHED + ", e AS (SELECT s.id, s.i, x / n AS x FROM s JOIN n ON n.id = s.id WHERE n > 0) SELECT a.id, round(sum(a.x * b.x), 6) AS score FROM e a JOIN e b ON b.i = a.i AND b.id = 0 GROUP BY 1")
def _(documents):
    embedded = lambda rows: vector.hash_embed(rows, "doc_id", F.col("text"))
    return vector.sparse_cosine(embedded(documents), embedded(documents.where("doc_id = 0"))).withColumn("score", F.round("score", 6))


@on_graph("v10_chunks", " SELECT id, left(kind || ' ' || qualified_name || chr(10) || docstring, 2048) AS chunk FROM symbols", False)
def _(g):
    return g.symbols.select("id", vector.chunk_text(F.col("kind"), F.col("name"), F.col("qualified_name"), F.col("docstring"), "B").alias("chunk"))


@on_graph("v12_changed_chunks", " SELECT id FROM symbols WHERE id % 3 <> 0", False)
def _(g):
    chunks = g.symbols.select("id", vector.chunk_text(F.col("kind"), F.col("name"), F.col("qualified_name"), F.col("docstring")).alias("chunk"))
    stored = chunks.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, F.sha2("chunk", 256)).otherwise("old").alias("content_hash"))
    return vector.changed_chunks(chunks, stored).select("id")


@on_graph("v13_orphans", " SELECT id + 1 AS id FROM symbols WHERE id + 1 NOT IN (SELECT id FROM symbols)", False)
def _(g):
    return vector.orphans(g.symbols.select((F.col("id") + 1).alias("id")), g.symbols)


# --- memory ---------------------------------------------------------------------------
def _records(documents: DataFrame, labels: DataFrame | None) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp")
    rows = documents.withColumn("quality", F.lit(None)) if labels is None else documents.join(labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "decision").otherwise("pattern").alias("type"), F.left("text", F.lit(12)).alias("title"), F.col("text").alias("body"), F.array("lang", "source").alias("tags"),
        F.timestamp_add("DAY", -(F.col("doc_id") % 400), as_of).alias("created"), ((F.col("doc_id") % 10) / 10).alias("confidence"), F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("critic"),
        F.when(F.col("doc_id") % 7 == 0, "manual").otherwise("agent").alias("origin"), F.lit("active").alias("status"), F.lit(1.0).alias("graph"), F.lit(True).alias("is_latest"),
    )


def _refs(events: DataFrame) -> DataFrame:
    return _metrics(events).withColumn("id", F.col("event_id") % 200)


def _scored(documents, labels, events) -> DataFrame:
    return memory.scored(_records(documents, labels), _refs(events), F.lit(AS_OF).cast("timestamp"))


RECORDS = f"""WITH rf AS (SELECT event_id % 200 AS id, least(count(DISTINCT user_id) / 5.0, 1.0) AS refs, least(0.3 * sum(1 / greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0, 1.0)), 1.0) AS reinf FROM events GROUP BY 1),
r AS (SELECT d.doc_id AS id, CASE WHEN d.doc_id % 2 = 0 THEN 'decision' ELSE 'pattern' END AS type, left(text, 12) AS title, text AS body, lang, source, (d.doc_id % 400)::DOUBLE AS age, (d.doc_id % 10) / 10 AS confidence, coalesce(quality::DOUBLE, 0.5) AS critic, d.doc_id % 7 = 0 AS manual
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
s AS (SELECT r.*, round(0.25 + 0.20 * coalesce(refs, 0) + 0.15 * confidence + 0.20 * critic + 0.05 * (CASE WHEN manual THEN 1 ELSE exp(-ln(2) * age / CASE type WHEN 'decision' THEN 90 ELSE 270 END) END) + 0.05 * coalesce(reinf, 0) + 0.10 * (CASE WHEN manual THEN 1.0 ELSE 0.5 END), 3)::DOUBLE AS score
FROM r LEFT JOIN rf ON rf.id = r.id),
t AS (SELECT *, CASE WHEN score < 0.3 THEN 'raw' WHEN score < 0.5 THEN 'drafts' ELSE 'tribal' END AS tier FROM s) """  # fmt: skip


@on_tables("m1_scores", "documents labels events", RECORDS + "SELECT id, score, tier FROM t")
def _(documents, labels, events):
    return _scored(documents, labels, events).select("id", "score", "tier")


@on_tables("a13_tier_stats", "documents labels events", RECORDS + "SELECT tier, count(*)::BIGINT AS n, round(avg(score), 6) AS avg_score FROM t GROUP BY 1")
def _(documents, labels, events):
    return memory.tier_stats(_scored(documents, labels, events))


@on_tables("m14_batch_critic", "documents labels events", RECORDS + "SELECT CASE WHEN score < 0.3 THEN 'archive' WHEN score >= 0.5 THEN 'promote' ELSE 'keep' END AS action, count(*)::BIGINT AS n FROM t GROUP BY 1")
def _(documents, labels, events):
    return memory.batch_critic(_scored(documents, labels, events)).groupBy("action").agg(F.count("*").alias("n"))


@on_tables("m15_decay", "documents labels events", RECORDS + "SELECT tier, CASE WHEN (tier = 'raw' AND age > 7) OR (tier = 'tribal' AND age > 90) THEN 'archived' ELSE 'active' END AS status, count(*)::BIGINT AS n FROM t GROUP BY ALL")
def _(documents, labels, events):
    return memory.decayed(_scored(documents, labels, events), F.lit(AS_OF).cast("timestamp")).groupBy("tier", "status").agg(F.count("*").alias("n"))


@on_tables("m16_purge", "documents labels events", RECORDS + "SELECT count(*)::BIGINT AS n FROM t WHERE NOT (tier = 'tribal' AND age > 90)")
def _(documents, labels, events):
    as_of = F.lit(AS_OF).cast("timestamp")
    return memory.purged(memory.decayed(_scored(documents, labels, events), as_of), as_of).agg(F.count("*").alias("n"))


@on_tables("m17_consolidate", "documents labels", RECORDS.split("s AS")[0].replace("rf AS", "rf AS", 1).rstrip().rstrip(",").replace("events", "(SELECT 0 AS event_id, 0 AS user_id, TIMESTAMP '2024-01-01' AS ts)") + ", g AS (SELECT lower(trim(title)) AS title_key, count(*)::BIGINT AS n, min(id) AS id, sha256(string_agg(DISTINCT body, chr(10) || '---' || chr(10) ORDER BY body)) AS body FROM r GROUP BY 1) SELECT id, title_key, n, body FROM g WHERE n >= 2")
def _(documents, labels):
    return memory.consolidated(_records(documents, labels)).select("id", "title_key", "n", F.sha2(F.encode("body", "UTF-8"), 256).alias("body"))


@on_tables("m18_digest", "documents labels events", RECORDS + "SELECT id, score FROM t WHERE tier = 'tribal' ORDER BY score DESC, id LIMIT 10")
def _(documents, labels, events):
    return memory.digest(_scored(documents, labels, events)).select("id", "score")


@on_tables("m19_by_tag", "documents labels", "SELECT doc_id AS id FROM documents WHERE lang = 'fr'")
def _(documents, labels):
    return _records(documents, labels).where(F.array_contains("tags", "fr")).select("id")


@on_tables("m21_transcripts", "conversations", "SELECT conv_id, count(*)::BIGINT AS turns, left(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text), 8000) AS transcript FROM conversations GROUP BY 1")
def _(conversations):
    return memory.transcripts(conversations)


# --- knowledge ------------------------------------------------------------------------
def _guides(g: Graph) -> DataFrame:
    """A guide for each folder of two to six headings, with a file of it, one that is missing
    twice, symbols, and prose of any length."""
    rows = lookup.located(g).groupBy(F.element_at(F.split("path", "/"), 3).alias("id")).agg(F.min("path").alias("p"), F.min("name").alias("n"))
    k = F.regexp_extract("id", "([0-9]+)", 1).cast("int")
    heads = F.slice(F.array(*map(F.lit, (*knowledge.MODULE_HEADINGS, knowledge.SHARED_HEADING, knowledge.FLOW_HEADINGS[0]))), F.lit(1), k % 5 + 2)
    body = F.concat(F.array_join(heads, "\n- x\n"), F.lit("\n  # aside "), F.repeat(F.lit("y"), F.lit(500)), F.lit("\n"), F.when(k == 4, F.repeat(F.lit("prose "), F.lit(80))).otherwise(F.concat(F.lit("see `"), F.col("p"), F.lit("` and `"), F.col("n"), F.lit("()`"))), F.when(k == 1, "\n`src/gone.py` `src/gone.py`").when(k == 2, "\n`Unknown.thing`").otherwise(""))
    return rows.select("id", F.col("id").alias("title"), body.alias("body"), F.array("n", F.lit("never_there")).alias("steps"))


MODS = ", m AS (SELECT DISTINCT string_split(path, '/')[3] AS id FROM files WHERE id IN (SELECT file_id FROM symbols)) "
_HEADS = "[" + ", ".join(f"'{h}'" for h in (*knowledge.MODULE_HEADINGS, knowledge.SHARED_HEADING, knowledge.FLOW_HEADINGS[0])) + "]"
GUIDES = f""", pl AS (SELECT string_split(f.path, '/')[3] AS id, min(f.path) AS p, min(s.name) AS n FROM symbols s JOIN files f ON f.id = s.file_id GROUP BY 1),
gd AS (SELECT id, array_to_string({_HEADS}[1:k % 5 + 2], chr(10) || '- x' || chr(10)) || chr(10) || '  # aside ' || repeat('y', 500) || chr(10) || CASE WHEN k = 4 THEN repeat('prose ', 80) ELSE 'see `' || p || '` and `' || n || '()`' END
  || CASE k WHEN 1 THEN chr(10) || '`src/gone.py` `src/gone.py`' WHEN 2 THEN chr(10) || '`Unknown.thing`' ELSE '' END AS body FROM (SELECT *, regexp_extract(id, '([0-9]+)', 1)::INT AS k FROM pl))"""
#: The critic's rule: references that stand in the text, known headings, prose without headings.
CRITIC = f""", rf AS (SELECT id, unnest(regexp_extract_all(body, '`([^`]+)`', 1)) AS ref FROM gd),
ki AS (SELECT *, contains(ref, '/') OR regexp_matches(ref, '({"|".join(e.replace(".", "[.]") for e in T.FILE_EXTENSIONS)})$') AS path, starts_with(ref, './') OR starts_with(ref, 'grafwerk ') AS command, regexp_matches(ref, '^[A-Za-z_][A-Za-z0-9_]*([.][A-Za-z_][A-Za-z0-9_]*)*([(][)])?$') AS sym FROM rf),
ck AS (SELECT id, CASE WHEN path AND NOT command THEN 'file' WHEN NOT path AND sym THEN 'symbol' END AS kind,
  CASE WHEN path THEN EXISTS (SELECT 1 FROM files f WHERE f.path = ref OR ends_with(f.path, '/' || ref)) ELSE EXISTS (SELECT 1 FROM symbols s WHERE s.name = replace(ref, '()', '') OR s.qualified_name = replace(ref, '()', '') OR ends_with(s.qualified_name, '.' || replace(ref, '()', '')) OR (contains(ref, '.') AND s.name = string_split(replace(ref, '()', ''), '.')[-1])) END AS found FROM ki),
ct AS (SELECT id, count(*) FILTER (kind = 'file' AND NOT found) AS errors, count(*) FILTER (kind = 'symbol' AND NOT found) AS unknown, count(*) FILTER (kind IS NOT NULL) AS refs FROM ck GROUP BY 1),
pr AS (SELECT gd.id, body, coalesce(errors, 0)::BIGINT AS errors, coalesce(unknown, 0) + (coalesce(refs, 0) < 2 AND length(regexp_replace(array_to_string(list_filter(string_split(regexp_replace(body, '\n$', ''), chr(10)), lambda x: NOT starts_with(ltrim(x), '#')), chr(10)), '`[^`]+`', '', 'g')) > 400)::INT AS warnings,
  least(len(list_filter([{", ".join(f"'{h}'" for h in (*knowledge.MODULE_HEADINGS, *knowledge.FLOW_HEADINGS, knowledge.SHARED_HEADING))}], lambda h: contains(body, h))) / 5, 1.0)::DOUBLE AS quality FROM gd LEFT JOIN ct ON ct.id = gd.id) """


@on_graph("c3_critic", GUIDES + CRITIC + "SELECT id, errors, warnings::BIGINT AS warnings, quality, errors = 0 AND quality >= CASE WHEN warnings > 0 THEN 0.7 ELSE 0.5 END AS passed FROM pr", False)
def _(g):
    return knowledge.critic(_guides(g), g.files, g.symbols)


@on_graph("m3_verified_share", GUIDES + CRITIC + "SELECT gd.id, coalesce(round(avg(found::INT) FILTER (kind IS NOT NULL), 6), 1.0)::DOUBLE AS graph FROM gd LEFT JOIN ck ON ck.id = gd.id GROUP BY 1", False)
def _(g):
    return knowledge.verified_share(_guides(g), g.files, g.symbols).withColumn("graph", F.round("graph", 6))


@on_graph("c12_stale_workflows", MODS + "SELECT id, 2::BIGINT AS steps, 1::BIGINT AS missing FROM m", False)
def _(g):
    return knowledge.stale_workflows(_guides(g), g.symbols)


@on_tables("c4_prose_heavy", "documents", """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '  # head' || chr(10) || '`A.b` `c_d()` `not one`' || chr(10) ELSE '`x` ' END || coalesce(text, '') AS body FROM documents),
r AS (SELECT doc_id, body, len(list_filter(regexp_extract_all(body, '`([^`]+)`', 1), lambda r: contains(r, '/') OR regexp_matches(r, '^[A-Za-z_][A-Za-z0-9_]*([.][A-Za-z_][A-Za-z0-9_]*)*([(][)])?$'))) AS refs FROM d)
SELECT doc_id, refs < 2 AND length(regexp_replace(array_to_string(list_filter(string_split(regexp_replace(body, '\n$', ''), chr(10)), lambda x: NOT starts_with(ltrim(x), '#')), chr(10)), '`[^`]+`', '', 'g')) > 400 AS heavy FROM r""")
def _(documents):
    head = F.when(F.col("doc_id") % 2 == 0, "  # head\n`A.b` `c_d()` `not one`\n").otherwise("`x` ")
    return documents.select("doc_id", knowledge.prose_heavy(F.concat(head, F.coalesce("text", F.lit("")))).alias("heavy"))


@on_tables("c5_references", "documents", "SELECT doc_id % 3 AS k, CASE doc_id % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'symbol' END AS kind, count(*)::BIGINT AS n FROM documents WHERE doc_id % 3 < 2 GROUP BY ALL")
def _(documents):
    ref = F.element_at(F.array(F.lit("`src/a.py` `./run`"), F.lit("`A.b()`"), F.lit("`not a ref`")), (F.col("doc_id") % 3 + 1).cast("int"))
    return knowledge.references(documents.select(F.col("doc_id").alias("id"), ref.alias("body"))).groupBy((F.col("id") % 3).alias("k"), "kind").agg(F.count("*").alias("n"))


@on_tables("c8_life_cycle", "documents", "SELECT doc_id, doc_id % 6 <= doc_id % 5 AS allowed FROM documents")
def _(documents):
    states = F.array(*map(F.lit, knowledge.STATES))
    at = lambda n: F.element_at(states, (F.col("doc_id") % n + 1).cast("int"))
    return documents.select("doc_id", knowledge.may_become(at(6), at(5)).alias("allowed"))


@on_tables("c11_workflow_steps", "documents", """WITH s AS (SELECT doc_id AS id, string_split(text, ' ') AS steps FROM documents), e AS (SELECT id, steps, unnest(generate_series(0, least(len(steps) - 1, 20))) AS nth FROM s)
SELECT id, nth::INT AS nth, CASE WHEN nth = 20 THEN '... ' || (len(steps) - 20) || ' more' ELSE steps[nth + 1] END AS step FROM e""")  # fmt: skip
def _(documents):
    return knowledge.workflow_steps(documents.select(F.col("doc_id").alias("id"), F.split("text", " ").alias("steps")))


@on_tables("c13_sync_steps", "documents", """WITH s AS (SELECT doc_id AS id, string_split(text, chr(10)) AS l FROM documents), a AS (SELECT DISTINCT id, unnest(l) AS x FROM s), b AS (SELECT DISTINCT id, unnest(l[2:]) AS x FROM s),
r AS (SELECT a.id, count(*) AS n FROM a ANTI JOIN b ON b.id = a.id AND b.x = a.x GROUP BY 1) SELECT s.id, 0::INT AS added, coalesce(n, 0)::INT AS removed FROM s LEFT JOIN r ON r.id = s.id""")  # fmt: skip
def _(documents):
    """The lines of each document against all but its first."""
    lines = F.split("text", "\n", -1)
    changed = knowledge.sync_steps(lines, F.slice(lines, 2, F.size(lines)))
    return documents.select(F.col("doc_id").alias("id"), changed.alias("s")).select("id", F.size("s.added").alias("added"), F.size("s.removed").alias("removed"))


@on_graph("a15_facts", " SELECT file_id, string_agg(kind || '=' || n, ',' ORDER BY kind || '=' || n) AS facts FROM (SELECT file_id, kind, count(*) AS n FROM symbols GROUP BY ALL) GROUP BY 1", False)
def _(g):
    return knowledge.facts(g.symbols, "file_id")


# --- incremental ----------------------------------------------------------------------
@on_graph("i2_changes", " SELECT path, CASE id % 4 WHEN 0 THEN 'deleted' WHEN 1 THEN 'changed' ELSE 'new' END AS change FROM files WHERE id % 4 < 3", False)
def _(g):
    f = g.files.select("id", "path", F.lit(10).cast("long").alias("size"), F.lit(1.0).alias("mtime"))
    return incremental.changes(f.where("id % 4 <> 2"), f.where("id % 4 <> 0").withColumn("size", F.when(F.col("id") % 4 == 1, 11).otherwise(10)))


@on_graph("i1_reindex", " SELECT resolution, tier, count(*)::BIGINT AS edges, sum(target_id)::BIGINT AS targets FROM redges GROUP BY ALL")
def _(g):
    """Files written again unchanged must leave the graph as a full build makes it."""
    changed = g.files.where("id % 10 = 3").select(F.col("id").alias("file_id"))
    again = g.symbols.join(changed, "file_id", "left_semi").select(*g.symbols.columns)
    edges = g.raw_edges.join(again.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(*g.raw_edges.columns)
    return incremental.reindex(g, changed, again, edges).edges.groupBy("resolution", "tier").agg(F.count("*").alias("edges"), F.sum("target_id").alias("targets"))


@on_tables("i6_reclaim", "events", f"SELECT CASE WHEN epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) > 864000000000 THEN 'pending' ELSE 'claimed' END AS state, count(*)::BIGINT AS n FROM events GROUP BY 1")
def _(events):
    tasks = events.select(F.lit("claimed").alias("state"), F.col("ts").alias("claimed_at"))
    return incremental.reclaim_stale(tasks, F.lit(AS_OF).cast("timestamp"), 864_000).groupBy("state").agg(F.count("*").alias("n"))


@on_tables("upsert_latest", "events", "SELECT user_id, arg_max(value, ts) AS value FROM (SELECT user_id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 GROUP BY 1")
def _(events):
    rows = events.select("user_id", "value", F.struct("ts", "event_id").alias("version"))
    return incremental.upsert(rows.where("version.event_id % 2 = 0"), rows.where("version.event_id % 2 = 1"), ["user_id"], "version").select("user_id", "value")


def queries() -> dict[str, Query]:
    import grafwerk.plans.deeper  # noqa: F401  adds its own
    import grafwerk.plans.further  # noqa: F401
    import grafwerk.plans.more  # noqa: F401

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    import grafwerk.plans.deeper  # noqa: F401
    import grafwerk.plans.further  # noqa: F401
    import grafwerk.plans.more  # noqa: F401

    return dict(_oracles)

"""Queries of generated pages, records, the ANN index, routing and upkeep, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafwerk.catalog import CRITIC, PLACED, name_of, on_graph, on_tables
from grafwerk.operators import annindex, guides, incremental, knowledge, lookup
from grafwerk.plans.store import stored_once
from grafwerk.sources import files as files_source
from grafwerk.sources.views import Graph


# --- files and repositories -----------------------------------------------------------
LISTED = ", ls AS (SELECT lower(r.name) || CASE WHEN r.id % 4 = 0 THEN '/src/a.py' ELSE '/.git/HEAD' END AS path FROM repos r UNION ALL SELECT 'vendor/.git/HEAD' UNION ALL SELECT 'plain/deep/.git/HEAD') "


def _listed(g: Graph) -> DataFrame:
    own = g.repos.select(F.concat(F.lower("name"), F.when(F.col("id") % 4 == 0, "/src/a.py").otherwise("/.git/HEAD")).alias("path"))
    return own.unionByName(g.repos.sparkSession.createDataFrame([("vendor/.git/HEAD",), ("plain/deep/.git/HEAD",)], "path string"))


@on_graph("s1_discover_repos", LISTED + "SELECT DISTINCT string_split(path, '/')[1] AS repo FROM ls WHERE string_split(path, '/')[2] = '.git' AND path NOT LIKE 'vendor/%'", False)
def _(g):
    return files_source.discover_repos(_listed(g))


@on_graph("s2_languages", " SELECT language, count(*)::BIGINT AS files FROM files GROUP BY 1", False)
def _(g):
    return g.files.groupBy(files_source.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"))


@on_graph("g10_infer_repo", " SELECT r.path || '/' || f.path AS path, r.name AS repo FROM files f JOIN repos r ON r.id = f.repo_id", False)
def _(g):
    full = g.files.join(g.repos.select(F.col("id").alias("repo_id"), F.col("path").alias("at")), "repo_id").select(F.concat("at", F.lit("/"), "path").alias("path"))
    lower = g.repos.select("name", F.lower("name").alias("low"))
    return guides.inferred_repo(full, lower.select(F.col("low").alias("name"))).join(lower, F.col("repo") == F.col("low")).select("path", F.col("name").alias("repo"))


@on_graph("g11_located_paths", " SELECT f.id, '/work/' || lower(r.name) || '/' || f.path AS path, lower(r.name) AS repo FROM files f JOIN repos r ON r.id = f.repo_id", False)
def _(g):
    rows = g.files.join(g.repos.select(F.col("id").alias("repo_id"), F.lower("name").alias("name")), "repo_id")
    rows = rows.select("id", files_source.located_path(F.col("path"), F.col("name"), "/work", F.lit(False)).alias("path"))
    return rows.select("id", "path", files_source.repo_of(F.col("path"), "/work").alias("repo"))


@on_tables("k6_index_pages", "documents", """SELECT source AS folder, '# Index' || chr(10) || chr(10) || '| File | Type | Title | Description |' || chr(10) || '|------|------|-------|-------------|' || chr(10) || string_agg(line, chr(10) ORDER BY line) || chr(10) AS text
FROM (SELECT source, '| d' || doc_id || '.md | ' || lang || ' | d' || doc_id || '.md | ' || replace(left(regexp_replace(text, '\\s+', ' ', 'g'), 60), '|', '\\|') || ' |' AS line FROM documents) GROUP BY 1""")  # fmt: skip
def _(documents):
    rows = documents.select(F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("lang").alias("type"), F.lit(None).cast("string").alias("title"), F.regexp_replace("text", "[ \\t\\n\\f\\r]+", " ").alias("description"))
    return files_source.index_pages(rows)


@on_tables("k6_log_lines", "events", "SELECT '- ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' | ' || event_type || ' | ' || event_id AS line FROM events")
def _(events):
    return files_source.log_lines(events.select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("action"), F.col("event_id").cast("string").alias("id")))


# --- records --------------------------------------------------------------------------
RECS = "WITH rec AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'Wiki-Page' WHEN 1 THEN 'Compass' WHEN 2 THEN 'Memory' ELSE 'Pattern' END AS type, left(text, 40) AS title, source AS description, text AS body, 'src/mod' || (doc_id % 50) AS resource FROM documents) "


def _recs(documents: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("Wiki-Page", "Compass", "Memory", "Pattern"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return documents.select(F.col("doc_id").alias("id"), kind.alias("type"), F.left("text", F.lit(40)).alias("title"), F.col("source").alias("description"), F.col("text").alias("body"), F.concat(F.lit("src/mod"), (F.col("doc_id") % 50).cast("string")).alias("resource"))


def _occurrences(word: str) -> str:
    one = lambda c: f"(length(lower({c})) - length(replace(lower({c}), '{word}', ''))) // {len(word)}"
    return f"({one('title')} + {one('description')} + {one('body')})::INT"


@on_tables("l16_search_records", "documents", RECS + f"SELECT id, title, type, score FROM (SELECT *, {_occurrences('the')} AS score FROM rec ORDER BY score DESC, id LIMIT 10) WHERE score > 0 AND starts_with(type, 'Pattern')")
def _(documents):
    return guides.search_records(_recs(documents), "The", "Pattern")


@on_tables("l17_file_context", "documents", RECS + f""", top AS (SELECT * FROM (SELECT *, {_occurrences('tion')} AS score FROM rec) WHERE score > 0 ORDER BY score DESC, id LIMIT 3)
SELECT * FROM (SELECT 'compass' AS section, id, title FROM rec WHERE type = 'Compass' AND contains('src/mod9/deep/tion.kt', resource) ORDER BY id LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'wiki', id, title FROM top WHERE starts_with(type, 'Wiki') ORDER BY score DESC, id LIMIT 1) UNION ALL SELECT * FROM (SELECT 'memory', id, title FROM top WHERE type = 'Memory' ORDER BY score DESC, id LIMIT 1)""")  # fmt: skip
def _(documents):
    return guides.file_context(_recs(documents), "src/mod9/deep/tion.kt")


@on_tables("c14_conformance", "documents", "SELECT 'd/' || doc_id || '.md' AS path, CASE doc_id % 4 WHEN 0 THEN 'no front matter' WHEN 1 THEN 'missing required field: type' ELSE 'tags must be a list' END AS error FROM documents WHERE doc_id % 4 <> 3")
def _(documents):
    fields = F.when(F.col("doc_id") % 4 == 0, F.create_map().cast("map<string,string>")).when(F.col("doc_id") % 4 == 1, F.create_map(F.lit("title"), F.col("lang"))).when(F.col("doc_id") % 4 == 2, F.create_map(F.lit("type"), F.col("lang"), F.lit("tags"), F.lit("a b"))).otherwise(F.create_map(F.lit("type"), F.col("lang"), F.lit("tags"), F.lit("[a, b]")))
    rows = documents.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), fields.alias("fields"))
    reserved = rows.limit(1).select(F.lit("d/index.md").alias("path"), F.create_map().cast("map<string,string>").alias("fields"))
    return guides.conformance(rows.unionByName(reserved))


@on_graph("c6_stale_records", " SELECT id, 0.5::DOUBLE AS verified FROM files WHERE id % 3 = 1 UNION ALL SELECT id, 0.0 FROM files WHERE id % 3 = 2", False)
def _(g):
    body = F.when(F.col("id") % 3 == 0, F.concat(F.lit("see `"), "path", F.lit("`"))).when(F.col("id") % 3 == 1, F.concat(F.lit("`"), "path", F.lit("` and `gone/"), F.col("id").cast("string"), F.lit(".py`"))).otherwise(F.concat(F.lit("`No.such"), F.col("id").cast("string"), F.lit("()`")))
    return guides.stale_records(g.files.select("id", body.alias("body")), g.files, g.symbols)


FLOW = """, ce AS (SELECT DISTINCT source_id, target_id FROM redges WHERE target_id IS NOT NULL AND kind IN ('calls', 'extends', 'implements')), seed AS (SELECT id FROM symbols WHERE name = (SELECT name FROM symbols WHERE id = 7)),
b AS (SELECT id AS node, 0 AS depth FROM seed UNION SELECT ce.target_id, b.depth + 1 FROM b JOIN ce ON ce.source_id = b.node WHERE b.depth < 8), m AS (SELECT node, min(depth) AS depth FROM b GROUP BY node),
oc AS (SELECT source_id AS node, count(DISTINCT target_id) AS callees FROM ce GROUP BY 1),
st AS (SELECT * FROM (SELECT m.node, m.depth, s.name, s.kind, f.path, r.name AS repo, coalesce(callees, 0) AS callees, row_number() OVER (ORDER BY m.depth, s.name, m.node) AS nth FROM m JOIN symbols s ON s.id = m.node JOIN files f ON f.id = s.file_id JOIN repos r ON r.id = f.repo_id LEFT JOIN oc ON oc.node = m.node) WHERE nth <= 200),
ch AS (SELECT string_agg(repeat('  ', depth) || '- `' || name || '` (' || kind || ', ' || string_split(path, '/')[-1] || ':' || repo || ')', chr(10) ORDER BY nth) AS chain, count(*) AS steps, count(DISTINCT array_to_string(string_split(path, '/')[-3:-2], '/')) AS modules FROM st),
b5 AS (SELECT * FROM st WHERE callees > 1 ORDER BY nth LIMIT 5), bc AS (SELECT DISTINCT b5.nth, b5.name AS caller, s.name FROM b5 JOIN ce ON ce.source_id = b5.node JOIN symbols s ON s.id = ce.target_id),
b4 AS (SELECT nth, caller, string_agg('`' || name || '`', ', ' ORDER BY name) AS names FROM (SELECT *, row_number() OVER (PARTITION BY nth ORDER BY name) AS r FROM bc) WHERE r <= 4 GROUP BY ALL),
br AS (SELECT coalesce(string_agg('- `' || caller || '` branches to ' || names || ' -- a change here ripples to multiple downstream paths.', chr(10) ORDER BY nth), '') AS branches FROM b4),
en AS (SELECT coalesce(string_agg('`' || name || '`', ', ' ORDER BY nth), '') AS ends FROM (SELECT * FROM st WHERE callees = 0 AND depth > 0 ORDER BY nth LIMIT 5)),
sp AS (SELECT string_agg('- `' || string_split(path, '/')[-1] || '` (`' || path || '`)', chr(10) ORDER BY path) AS files FROM (SELECT DISTINCT path FROM st ORDER BY path LIMIT 8)),
rg AS (SELECT coalesce(string_agg('`' || name || '`', ', ' ORDER BY name), '') AS rings FROM (SELECT DISTINCT x.name FROM ce JOIN st x ON x.node = ce.source_id JOIN st y ON y.node = ce.target_id WHERE y.depth <= x.depth ORDER BY 1 LIMIT 3)),
gd AS (SELECT 'flow' AS id, concat_ws(chr(10) || chr(10),
  '# What Does This Flow Do?' || chr(10) || '- Entry point: `' || (SELECT name FROM symbols WHERE id = 7) || '`' || chr(10) || '- Traces ' || steps || ' call step(s) across ' || modules || ' module(s).', '# Call Sequence' || chr(10) || chain,
  '# Failure-Prone Steps' || chr(10) || CASE WHEN branches = '' AND ends = '' THEN '- (no branch points or terminal calls detected)' ELSE concat_ws(chr(10), nullif(branches, ''), CASE WHEN ends <> '' THEN '- Terminal calls (side effects): ' || ends || '.' END) END,
  '# Modules Spanned' || chr(10) || files, '# Tribal Knowledge' || chr(10) || CASE WHEN rings <> '' THEN '- Recursive/cyclic calls detected at: ' || rings || '.' || chr(10) ELSE '' END || '- (populated from code comments and TODOs when an LLM is available)') || chr(10) AS body FROM ch, br, en, sp, rg)"""


def _judged(pages: DataFrame, g: Graph) -> DataFrame:
    """Pages with the critic's verdict; the text as its digest."""
    return pages.join(knowledge.critic(pages, g.files, g.symbols), "id").select("id", F.sha2(F.encode("body", "UTF-8"), 256).alias("body"), "errors", "warnings", F.round("quality", 6).alias("quality"), "passed")


JUDGED = CRITIC + "SELECT id, sha256(body) AS body, errors, warnings::BIGINT AS warnings, quality, errors = 0 AND quality >= CASE WHEN warnings > 0 THEN 0.7 ELSE 0.5 END AS passed FROM pr"


@on_graph("c2_flow_guide", FLOW + JUDGED)
def _(g):
    return _judged(guides.flow_guide(g, name_of(g)).withColumn("id", F.lit("flow")), g)


MODULES = PLACED + """, kc AS (SELECT module, kind, count(*) AS n FROM p GROUP BY ALL), kt AS (SELECT module, sum(n) AS symbols, array_to_string(list(kind || '(' || n || ')' ORDER BY n DESC, kind)[1:5], ', ') AS kinds FROM kc GROUP BY 1),
nn AS (SELECT name, sum(n) AS n FROM inc JOIN symbols s ON s.id = inc.id GROUP BY 1),
fr AS (SELECT module, path, repo_id, coalesce(sum(nn.n), 0)::BIGINT AS refs, array_to_string(list(p.name ORDER BY p.id)[1:3], ', ') AS sample FROM p LEFT JOIN nn ON nn.name = p.name GROUP BY ALL),
fk AS (SELECT * FROM (SELECT fr.*, r.name AS repo, row_number() OVER (PARTITION BY fr.module ORDER BY fr.refs DESC, fr.path, fr.repo_id) AS r FROM fr JOIN repos r ON r.id = fr.repo_id) WHERE r <= 5),
ff AS (SELECT module, string_agg('- `' || string_split(path, '/')[-1] || '` - ' || repo || ' (refs: ' || refs || '; e.g. ' || sample || ')', chr(10) ORDER BY r) AS files, max(refs) AS most, min_by(string_split(path, '/')[-1], r) AS top FROM fk GROUP BY 1),
aw AS (SELECT DISTINCT a.module, r.name || coalesce('/' || nullif(array_to_string(list_filter(string_split(b.path, '/'), lambda x: x NOT IN ('', 'src', 'main', 'java', 'kotlin'))[1:2], '/'), ''), '') AS other FROM redges e JOIN p a ON a.id = e.source_id JOIN p b ON b.id = e.target_id JOIN repos r ON r.id = b.repo_id WHERE a.module <> b.module),
al AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY other) AS r FROM aw) WHERE r <= 8),
ll AS (SELECT module, count(*) AS n_links, string_agg('- ' || string_split(other, '/')[-1] || ' (`' || other || '`)', chr(10) ORDER BY r) FILTER (r <= 4) AS links FROM al GROUP BY 1),
gd AS (SELECT kt.module AS id, concat_ws(chr(10) || chr(10), '# What Does This Module Do?' || chr(10) || '- ' || symbols || ' symbols: ' || kinds, '# Common Modification Patterns' || chr(10) || files,
  concat_ws(chr(10), '# Build-Failure Patterns', CASE WHEN most > 20 THEN '- `' || top || '` is a high-traffic file (' || most || ' incoming refs); changes ripple widely: check its impact before modifying.' END,
    CASE WHEN n_links > 0 THEN '- This module reaches ' || n_links || ' other modules; verify cross-module impact before refactoring.' END, CASE WHEN symbols > 50 THEN '- Large module (' || symbols || ' symbols); consider splitting if adding features.' END),
  '# Cross-Module Dependencies' || chr(10) || coalesce(links, '- (no cross-module references found)'), '# Tribal Knowledge' || chr(10) || '- (populated from code comments and TODOs when an LLM is available)') || chr(10) AS body
  FROM kt LEFT JOIN ff ON ff.module = kt.module LEFT JOIN ll ON ll.module = kt.module)"""


@on_graph("c1_module_guides", MODULES + JUDGED)
def _(g):
    return _judged(guides.module_guides(g), g)


@on_graph("c16_architecture_pages", PLACED + """, k AS (SELECT repo_id, string_agg('- ' || kind || ': ' || n, chr(10) ORDER BY n DESC, kind) AS kinds FROM (SELECT repo_id, kind, count(*) AS n FROM p GROUP BY ALL) GROUP BY 1), c AS (SELECT repo_id, count(*) AS n FROM p GROUP BY 1), fl AS (SELECT repo_id, count(*) AS n FROM files GROUP BY 1)
SELECT r.id, r.name || ' contains ' || coalesce(c.n, 0) || ' symbols across ' || coalesce(fl.n, 0) || ' files.' AS overview, coalesce(k.kinds, '(none)') AS kinds, 0::BIGINT AS errors, 0.0::DOUBLE AS quality, false AS passed FROM repos r LEFT JOIN k ON k.repo_id = r.id LEFT JOIN c ON c.repo_id = r.id LEFT JOIN fl ON fl.repo_id = r.id""")  # fmt: skip
def _(g):
    """The critic knows none of a page's headings, so no page passes: it informs, it does not block."""
    ns = lookup.located(g).select("repo_id", F.split("qualified_name", "\\.")[0].alias("prefix")).distinct()
    pages = guides.architecture_pages(g, ns)
    part = lambda head, end: F.regexp_extract("body", rf"(?s){head}\n(.*?)\n\n{end}", 1)
    return pages.select("id", part("## Overview", "## Symbol").alias("overview"), part("## Symbol Distribution", "## Core").alias("kinds"), "errors", "quality", "passed")


# --- vectors --------------------------------------------------------------------------
@on_tables("v3_ann_search", "embeddings")
def _(embeddings):
    """Rows whose id is divisible by 100 against all rows of their length, by a stored index."""
    index = stored_once(embeddings, "vectors", lambda path: annindex.VectorIndex.write(embeddings, path))
    return index.search(annindex.vectors(embeddings.where("vec_id % 100 = 0")), 5)


# --- upkeep ---------------------------------------------------------------------------
@on_graph("i3_incremental_update", " SELECT 'edges' AS part, count(*)::BIGINT AS n, count(target_id)::BIGINT AS m FROM redges UNION ALL SELECT 'closure', count(*), count(DISTINCT source_id) FROM (SELECT DISTINCT e.source_id, coalesce(t.name, e.target_name) FROM redges e LEFT JOIN symbols t ON t.id = e.target_id)")
def _(g):
    """Files written again unchanged: the graph and its derived tables are those of a full build."""
    changed = g.files.where("id % 10 = 3").select(F.col("id").alias("file_id"))
    again = g.symbols.join(changed, "file_id", "left_semi").select(*g.symbols.columns)
    edges = g.raw_edges.join(again.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(*g.raw_edges.columns)
    fresh, tables = incremental.incremental_update(g, changed, again, edges)
    return fresh.edges.agg(F.count("*").alias("n"), F.count("target_id").alias("m")).select(F.lit("edges").alias("part"), "n", "m").unionByName(tables["closure"].where("distance = 1").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("m")).select(F.lit("closure").alias("part"), "n", "m"))


@on_graph("i4_catch_up", " SELECT count(*) FILTER (id % 4 = 1)::BIGINT AS reindexed, count(*) FILTER (id % 4 = 0)::BIGINT AS deleted FROM files", False)
def _(g):
    shot = g.files.select("id", "path", F.lit(10).cast("long").alias("size"), F.lit(1.0).alias("mtime"))
    now = shot.where("id % 4 <> 0").withColumn("size", F.when(F.col("id") % 4 == 1, 11).otherwise(10).cast("long"))

    def parse(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = g.symbols.join(g.files.join(paths, "path", "left_semi").select(F.col("id").alias("file_id")), "file_id", "left_semi").select(*g.symbols.columns)
        return own, g.raw_edges.join(own.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(*g.raw_edges.columns)

    return incremental.catch_up(g, shot, now, parse)[1]

"""Queries of the operators that are made of others, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from grafwerk.catalog import AS_OF, BM25, HASHED, PLACED, RECORDS, STOP_SQL, VIEWS, _metrics, _records, _refs, _scored, add, on_graph, on_tables
from grafwerk.functions import text as T
from grafwerk.operators import compose, incremental, lexical, lookup, memory, rollup, traverse, vector
from grafwerk.plans.store import build
from grafwerk.sources import files as files_source
from grafwerk.sources import parsers
from grafwerk.sources.views import table

CE = ", ce AS (SELECT DISTINCT source_id, target_id FROM redges WHERE target_id IS NOT NULL AND kind IN ('calls', 'extends', 'implements')) "


@on_graph("t14_neighbours", """, kn AS (SELECT DISTINCT source_id, target_id FROM redges WHERE target_id IS NOT NULL), u AS (SELECT target_id AS id, source_id AS other, 'caller' AS side FROM kn UNION ALL SELECT source_id, target_id, 'callee' FROM kn)
SELECT id, other, side FROM (SELECT *, row_number() OVER (PARTITION BY id, side ORDER BY other) AS n FROM u) WHERE n <= 20""")  # fmt: skip
def _(g):
    return compose.neighbours(g, g.symbols)


@on_graph("t14_blast_radius", CE + """, b AS (SELECT id AS seed, id AS node, 0 AS depth FROM symbols UNION SELECT b.seed, ce.source_id, b.depth + 1 FROM b JOIN ce ON ce.target_id = b.node WHERE b.depth < 2)
SELECT b.seed AS id, count(DISTINCT b.node)::BIGINT AS reached, count(DISTINCT f.repo_id)::BIGINT AS repos FROM b JOIN symbols s ON s.id = b.node JOIN files f ON f.id = s.file_id WHERE b.node <> b.seed GROUP BY 1""")  # fmt: skip
def _(g):
    return compose.blast_radius(g, g.symbols)


#: Hashed words of symbols and of a question (id -1), as unit vectors e (id, i, x).
HASHED_SYMBOLS = ", w0 AS (SELECT DISTINCT id, unnest(list_filter(regexp_split_to_array(lower($text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM symbols UNION SELECT -1, unnest(string_split('$question', ' ')))," + HASHED[HASHED.index("h AS (SELECT id, sha256(w)"):].replace("FROM w)", "FROM w0)").replace("h AS (", "hw AS (", 1).replace("FROM h)", "FROM hw)") + ", e AS (SELECT s.id, s.i, x / n AS x FROM s JOIN n ON n.id = s.id WHERE n > 0), cs AS (SELECT a.id, round(sum(a.x * b.x), 9) AS score FROM e a JOIN e b ON b.i = a.i AND b.id = -1 WHERE a.id <> -1 GROUP BY 1) "


@on_graph("t14_explore", BM25.replace("['$1', '$2']", "['plate']").replace("\nsc AS", "\nbsc AS") + HASHED_SYMBOLS.replace("$text", "kind || ' ' || qualified_name || chr(10) || docstring").replace("$question", "plate") + """, wd AS (SELECT id, score, source FROM (SELECT id, score, 0 AS source FROM bsc UNION ALL SELECT id, 0.0, 1 FROM symbols WHERE (name ILIKE '%plate%' OR qualified_name ILIKE '%plate%') AND id NOT IN (SELECT id FROM bsc)) ORDER BY source, score DESC, id LIMIT 20),
nr AS (SELECT id, score, 2 AS source FROM (SELECT id, score FROM cs WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 20) WHERE id NOT IN (SELECT id FROM wd)), fd AS (SELECT f.*, y.name FROM (SELECT * FROM wd UNION ALL SELECT * FROM nr) f JOIN symbols y ON y.id = f.id),
kn AS (SELECT DISTINCT source_id, target_id FROM redges WHERE target_id IS NOT NULL), u AS (SELECT target_id AS id, source_id AS other, 'caller' AS side FROM kn UNION ALL SELECT source_id, target_id, 'callee' FROM kn), nb AS (SELECT other FROM (SELECT *, row_number() OVER (PARTITION BY id, side ORDER BY other) AS k FROM u WHERE id IN (SELECT id FROM fd)) WHERE k <= 20),
ce AS (SELECT DISTINCT source_id, target_id FROM redges WHERE target_id IS NOT NULL AND kind IN ('calls', 'extends', 'implements')), rb AS (SELECT id AS seed, id AS node, 0 AS depth FROM fd UNION SELECT rb.seed, ce.source_id, rb.depth + 1 FROM rb JOIN ce ON ce.target_id = rb.node WHERE rb.depth < 2)
SELECT 'seed' AS section, id, name, row_number() OVER (ORDER BY source, score DESC, id)::BIGINT AS n FROM fd UNION ALL SELECT 'neighbour', nb.other, y.name, count(*) FROM nb JOIN symbols y ON y.id = nb.other GROUP BY ALL
UNION ALL SELECT 'reach', rb.seed, y.name, count(DISTINCT rb.node) FROM rb JOIN symbols y ON y.id = rb.seed WHERE rb.node <> rb.seed GROUP BY ALL UNION ALL SELECT 'dispatch', fd.id, fd.name, count(*) FROM fd JOIN redges e ON e.target_name = fd.name AND e.resolution = 'ambiguous' GROUP BY ALL""")  # fmt: skip
def _(g):
    return compose.explore(g, "plate")


@on_graph("v5_hybrid_search", BM25.replace("$1", "medium").replace("$2", "plate") + HASHED_SYMBOLS.replace("$text", "translate(name || ' ' || qualified_name || ' ' || docstring, '_.#', '   ')").replace("$question", "medium plate") + """, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc WHERE k = 2), c AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM cs WHERE score >= 0.3),
z AS (SELECT id, 1.0 / (60 + rank) AS s, 'l0' AS l FROM a WHERE rank <= 30 UNION ALL SELECT id, 1.0 / (60 + rank), 'l1' FROM c WHERE rank <= 30) SELECT id, round(sum(s)::DOUBLE, 9) AS score, string_agg(DISTINCT l, '+' ORDER BY l) AS provenance FROM z GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", False)  # fmt: skip
def _(g):
    """Word ranks and hashed-vector ranks of the symbols for one question, which goes through the
    same embedder, fused."""
    text = F.translate(F.concat_ws(" ", "name", "qualified_name", "docstring"), "_.#", "   ")
    words = compose.WordRetriever(g.symbols, ["name", "qualified_name", "docstring"])
    near = compose.HashRetriever(g.symbols.select("id", text.alias("t")), F.col("t"), 0.3)
    return compose.hybrid([words, near], "medium plate")


@add("t15_source_spans", """WITH s AS (SELECT doc_id AS id, 1 + doc_id % 3 AS a, 3 + doc_id % 5 AS b, 'd' || lpad((doc_id)::VARCHAR, 20, '0') AS path, string_split(text, chr(10)) AS l FROM documents),
r AS (SELECT *, coalesce(sum(greatest(b - a + 1, 0)) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT id, path, array_to_string(l[a:b], chr(10)) AS lines FROM r WHERE before < 100""")  # fmt: skip
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 20, "0")))
    spans = docs.select(F.col("doc_id").alias("id"), "path", (1 + F.col("doc_id") % 3).cast("int").alias("line_start"), (3 + F.col("doc_id") % 5).cast("int").alias("line_end"))
    return compose.source_spans(spans, docs.select("path", "text"), 100)


@on_graph("t16_impact_graph", CE + ", n1 AS (SELECT DISTINCT source_id FROM ce WHERE target_id = 7) SELECT source_id AS source, target_id AS target FROM ce WHERE target_id = 7 OR target_id IN (SELECT source_id FROM n1) ORDER BY 1, 2 LIMIT 100")
def _(g):
    e = traverse._calls(g, False, True).select(F.col("to_id").alias("source"), F.col("from_id").alias("target"))
    near = e.where("target = 7").select(F.col("source").alias("target"))
    return e.join(near.unionByName(g.symbols.where("id = 7").select(F.col("id").alias("target"))).distinct(), "target", "left_semi").select("source", "target").orderBy("source", "target").limit(100)


@on_graph("t16_repo_graph", PLACED + "SELECT a.repo_id AS source, b.repo_id AS target, count(*)::BIGINT AS edges FROM redges e JOIN p a ON a.id = e.source_id JOIN p b ON b.id = e.target_id WHERE a.repo_id <> b.repo_id GROUP BY ALL")
def _(g):
    place = lookup.located(g)
    a, b = place.select(F.col("id").alias("source_id"), F.col("repo_id").alias("source")), place.select(F.col("id").alias("target_id"), F.col("repo_id").alias("target"))
    return g.edges.where("target_id is not null").join(a, "source_id").join(b, "target_id").where("source <> target").groupBy("source", "target").agg(F.count("*").alias("edges"))


@on_graph("g3_like_literal", " SELECT id, name FROM symbols WHERE contains(lower(name), 'a_1')", False)
def _(g):
    return g.symbols.where(F.col("name").ilike(f"%{lookup.like_literal('A_1')}%")).select("id", "name")


@on_graph("l4_like_search", " SELECT id, name FROM symbols WHERE name ILIKE '%e%l%$_1' ESCAPE '$'", False)
def _(g):
    return g.symbols.where(F.col("name").ilike(lexical.like_pattern("*e*l*_1"))).select("id", "name")


@on_tables("g12_clamp", "events", "SELECT event_id, least(greatest(value::INT, 10), 50) AS v FROM events")
def _(events):
    return events.select("event_id", T.clamp(F.bround("value").cast("int"), 10, 50).alias("v"))


@on_tables("l13_visible", "documents", "SELECT doc_id FROM documents WHERE doc_id % 6 <> 5")
def _(documents):
    from grafwerk.operators.knowledge import STATES

    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("doc_id") % 6 + 1).cast("int"))
    return documents.where(state != "archived").select("doc_id")


@on_graph("v6_enriched", """, c AS (SELECT DISTINCT target_id AS id, source_id AS other FROM redges WHERE target_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY other) AS n FROM c) SELECT id, string_agg(other::VARCHAR, ',' ORDER BY other) AS callers FROM r WHERE n <= 5 GROUP BY 1""")
def _(g):
    near = compose.neighbours(g, g.symbols, 5).where("side = 'caller'")
    return near.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("other")), lambda x: x.cast("string")), ",").alias("callers"))


class _Longest(compose.Reranker):
    def score(self, question, texts):
        return texts.str.len().astype("float64")


@on_graph("v7_reranked", BM25.replace(" || ' ' || docstring", "").replace("$1", "brand").replace("['brand', '$2']", "['brand']") + ", pool AS (SELECT id FROM sc ORDER BY score DESC, id LIMIT 50) SELECT id, length(name)::DOUBLE AS rerank FROM pool JOIN symbols USING (id) ORDER BY 2 DESC, 1 LIMIT 5", False)
def _(g):
    """The pool is what a search over all symbols returns."""
    hits = lexical.bm25(lexical.postings(g.symbols, "id", ["name", "qualified_name"]), ["brand"], True).join(g.symbols.select("id", "name"), "id")
    return compose.rerank(hits, "q", F.col("name"), _Longest(), 5).select("id", "rerank")


@on_tables("v11_signatures", "documents", "SELECT doc_id, trim(string_split(text, chr(10))[(doc_id % 3 + 1)::INT], ' ') AS line FROM documents")
def _(documents):
    return documents.select("doc_id", compose.signature(F.col("text"), (F.col("doc_id") % 3 + 1).cast("int")).alias("line"))


@on_tables("v14_embed_missing", "documents", HASHED + "SELECT count(DISTINCT id)::BIGINT AS docs FROM s WHERE id % 40 <> 0")
def _(documents):
    """Every document that has no vector yet; each fortieth stands for the stored ones."""
    todo = documents.join(documents.where("doc_id % 40 = 0").select("doc_id"), "doc_id", "left_anti")
    return vector.hash_embed(todo, "doc_id", F.col("text")).agg(F.count_distinct("id").alias("docs"))


@on_tables("m2_signals", "documents labels events", RECORDS + "SELECT r.id, round(coalesce(refs, 0), 6)::DOUBLE AS refs, round(coalesce(reinf, 0), 6)::DOUBLE AS reinforcement, round(CASE WHEN manual THEN 1 ELSE exp(-ln(2) * age / CASE type WHEN 'decision' THEN 90 ELSE 270 END) END, 6)::DOUBLE AS freshness, CASE WHEN manual THEN 1.0 ELSE 0.5 END::DOUBLE AS authority FROM r LEFT JOIN rf ON rf.id = r.id")
def _(documents, labels, events):
    as_of = F.lit(AS_OF).cast("timestamp")
    rows = _scored(documents, labels, events)
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c)
    return rows.select("id", zero("refs"), zero("reinforcement"), F.round(memory.freshness(F.col("type"), F.col("created"), F.col("origin"), as_of), 6).alias("freshness"), F.when(F.col("origin") == "manual", 1.0).otherwise(0.5).alias("authority"))


PHRASE = "SELECT doc_id AS id, (length(lower(left(text, 12))) - length(replace(lower(left(text, 12)), '$1', ''))) // len('$1') + (length(lower(text)) - length(replace(lower(text), '$1', ''))) // len('$1') AS score FROM documents"


@on_tables("m11_recall", "documents labels", f"SELECT id, 'phrase' AS via, score::DOUBLE AS score FROM ({PHRASE.replace('$1', 'ththe')}) WHERE score > 0 ORDER BY score DESC, id LIMIT 20")
def _(documents, labels):
    return compose.recall(_records(documents, labels), "Ththe")


@on_tables("l12_recall_words", "documents labels", f"""WITH p AS (SELECT * FROM ({PHRASE.replace('$1', 'tion zzq ing')}) WHERE score > 0 LIMIT 20), t AS (SELECT doc_id AS id, lower(left(text, 12) || ' ' || text) AS t FROM documents)
SELECT id, 'words' AS via, (contains(t, 'tion')::INT + contains(t, 'zzq')::INT + contains(t, 'ing')::INT)::DOUBLE AS score FROM t WHERE score > 0 AND (SELECT count(*) FROM p) = 0""")
def _(documents, labels):
    """A phrase that no record holds whole: all that hold any of its words."""
    return compose.recall(_records(documents, labels), "tion zzq ing")


@on_tables("m16_recall_near", "documents labels", HASHED.replace("lower(text)", "lower(left(text, 12) || ' ' || text)").replace("FROM documents", "FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1, 'the qzxv of')") .replace("lower(left(text, 12) || ' ' || text)", "CASE WHEN doc_id < 0 THEN text ELSE lower(left(text, 12) || ' ' || text) END") + ", e AS (SELECT s.id, s.i, x / n AS x FROM s JOIN n ON n.id = s.id WHERE n > 0), c AS (SELECT a.id, round(sum(a.x * b.x), 9) AS score FROM e a JOIN e b ON b.i = a.i AND b.id = -1 WHERE a.id >= 0 GROUP BY 1) SELECT id, 'near' AS via, score FROM c WHERE score >= 0.1 ORDER BY score DESC, id LIMIT 20")
def _(documents, labels):
    """A question whose only word is nowhere: the nearest by hashed words."""
    return compose.recall(_records(documents, labels), "the qzxv of")


@on_graph("r9_written_back", " SELECT id, source_id, target_id, CASE WHEN resolution <> 'exact' THEN target_name END AS target_name, resolution FROM redges")
def _(g):
    from grafwerk.operators import resolve

    return resolve.written_back(g.edges).select("id", "source_id", "target_id", "target_name", "resolution")


def _knowledge_docs(documents):
    return documents.select(F.col("doc_id").alias("id"), F.left("text", F.lit(40)).alias("title"), F.col("source").alias("description"), F.col("text").alias("body"), F.array("lang", "source").alias("tags"),
        F.array(F.concat(F.lit("mod"), (F.col("doc_id") % 9).cast("string"))).alias("modules"), F.array(F.col("doc_id") % 25).alias("repos"), F.when(F.col("doc_id") % 11 == 0, "archived").otherwise("approved").alias("status"))


KNOWLEDGE = """, d AS (SELECT doc_id AS id, lower(left(text, 40)) AS ti, lower(source) AS de, lower(lang || ' ' || source) AS tg, lower(text) AS bo, lang, source, doc_id % 9 AS m FROM documents WHERE doc_id % 11 <> 0),
hs AS (SELECT id, lang, source, m, (10 * (contains(ti, 'eroues')::INT + contains(ti, 'thesor')::INT) + 5 * (contains(de, 'eroues')::INT + contains(de, 'thesor')::INT) + 5 * (contains(tg, 'eroues')::INT + contains(tg, 'thesor')::INT) + contains(bo, 'eroues')::INT + contains(bo, 'thesor')::INT) AS score FROM d),
be AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS parent FROM hs WHERE score > 0 QUALIFY parent <= 20),
sh AS (SELECT h.id, b.parent, greatest(b.score * 0.5 + (h.lang = b.lang)::INT + (h.source = b.source)::INT + (h.m = b.m)::INT, 0.5) AS score FROM hs h JOIN be b ON (h.lang = b.lang OR h.source = b.source OR h.m = b.m) WHERE h.score = 0),
fi AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY id ORDER BY parent) = 1), fe AS (SELECT *, row_number() OVER (ORDER BY parent, score DESC, id) AS nth FROM fi QUALIFY nth <= 10),
al AS (SELECT parent, 0 AS nth, id, 'lexical_knowledge' AS provenance, score::DOUBLE AS score FROM be UNION ALL SELECT parent, nth, id, 'lexical_knowledge_expanded', score FROM fe),
kr AS (SELECT row_number() OVER (ORDER BY parent, nth)::INT AS place, id, provenance, score::DOUBLE AS score FROM al QUALIFY place <= 20) """


@on_tables("c9_knowledge_search", "documents", KNOWLEDGE.replace(", d AS", "WITH d AS", 1) + "SELECT * FROM kr")
def _(documents):
    return compose.knowledge_search(_knowledge_docs(documents), "eroues thesor")


@add("c9_graph_bridge", VIEWS + """, ns AS (SELECT DISTINCT f.repo_id, string_split(s.qualified_name, '.')[1] || '.' || left(s.name, 3) AS prefix FROM symbols s JOIN files f ON f.id = s.file_id),
dp AS (SELECT f.repo_id AS source, ns.repo_id AS target, count(*)::BIGINT AS n FROM imports i JOIN files f ON f.id = i.file_id JOIN ns ON starts_with(i.imported_path, prefix) AND ns.repo_id <> f.repo_id GROUP BY ALL)""" + KNOWLEDGE + """
SELECT kr.id, kr.id % 25 AS repo, 'dependency' AS side, target AS other, n FROM kr JOIN dp ON dp.source = kr.id % 25 UNION ALL SELECT kr.id, kr.id % 25, 'dependent', source, n FROM kr JOIN dp ON dp.target = kr.id % 25""")
def _(spark, sf_dir):
    g, docs = build(spark, sf_dir), _knowledge_docs(table(spark, sf_dir, "documents"))
    ns = lookup.located(g).select("repo_id", F.concat(F.split("qualified_name", "\\.")[0], F.lit("."), F.left("name", F.lit(3))).alias("prefix")).distinct()
    return compose.bridged(compose.knowledge_search(docs, "eroues thesor"), docs, rollup.repo_dependencies(g, ns))


@on_tables("m12_reference_log", "events", "SELECT event_id % 200 AS id, user_id AS session, min(ts) AS first, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def _(events):
    return _refs(events).groupBy("id", "session").agg(F.min("at").cast("timestamp_ntz").alias("first"), F.count("*").alias("n"))


@on_tables("m13_demoted", "documents labels events", RECORDS + "SELECT CASE tier WHEN 'tribal' THEN 'drafts' ELSE tier END AS tier, count(*)::BIGINT AS n FROM t GROUP BY 1")
def _(documents, labels, events):
    return compose.moved(_scored(documents, labels, events), "drafts").groupBy("tier").agg(F.count("*").alias("n"))


@on_graph("c10_resolve_workflow", " SELECT id, 3 AS match FROM repos WHERE lower(name) = 'japan'", False)
def _(g):
    from grafwerk.operators.knowledge import resolve_workflow

    return resolve_workflow(g.repos.select("id", F.col("name").alias("title")), "Japan", F.lit("no")).select("id", "match")


@on_graph("c17_list_by_prefix", " SELECT path FROM files WHERE starts_with(path, 'src/lib/mod2/') ORDER BY path", False)
def _(g):
    return g.files.where(F.startswith("path", F.lit("src/lib/mod2/"))).select("path").orderBy("path")


@on_graph("k1_scopes", " SELECT id, string_split(qualified_name, '.')[1] AS parent_scope FROM symbols", False)
def _(g):
    return g.symbols.select("id", compose.parent_scope(F.col("qualified_name")).alias("parent_scope"))


@on_graph("k1_imports_summary", " SELECT file_id, array_to_string(list_sort(list(imported_path))[1:20], ', ') AS summary FROM imports GROUP BY 1", False)
def _(g):
    return compose.imports_summary(g.imports)


@on_graph("k4_without_repo", """, ks AS (SELECT s.id FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.repo_id <> 3) SELECT CASE WHEN target_id IS NOT NULL AND target_id NOT IN (SELECT id FROM ks) THEN 'unresolved' ELSE resolution END AS resolution, count(*)::BIGINT AS n FROM redges WHERE source_id IN (SELECT id FROM ks) GROUP BY 1""")
def _(g):
    return compose.without_repo(g, 3).edges.groupBy("resolution").agg(F.count("*").alias("n"))


@on_graph("a2_resolved_share", " SELECT round(avg((target_id IS NOT NULL)::INT), 6) AS resolved, count(*)::BIGINT AS edges FROM redges")
def _(g):
    return g.edges.agg(F.round(F.avg(F.col("target_id").isNotNull().cast("double")), 6).alias("resolved"), F.count("*").alias("edges"))


@on_graph("a5_namespaces", " SELECT id, CASE id WHEN 1 THEN 'com.own' WHEN 2 THEN 'conf.two' ELSE lower(name) END AS namespace FROM repos", False)
def _(g):
    named = {1: "com.own"}, {2: "conf.two", 1: "unused"}
    first = F.coalesce(*[F.try_element_at(F.create_map(*[F.lit(x) for p in m.items() for x in p]), F.col("id").cast("int")) for m in named], F.lower("name"))
    return g.repos.select("id", first.alias("namespace"))


@on_tables("a16_retrieval_quality", "documents", """WITH h AS (SELECT lang AS query, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents), e AS (SELECT source AS corpus, lang AS query, doc_id AS id FROM documents WHERE doc_id % 7 = 0),
b AS (SELECT e.corpus, e.query, min(h.rank) AS rank FROM e LEFT JOIN h ON h.query = e.query AND h.id = e.id AND h.rank <= 10 GROUP BY ALL) SELECT corpus, count(*)::BIGINT AS queries, round(avg((rank IS NOT NULL)::INT), 6) AS recall, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM b GROUP BY 1""")  # fmt: skip
def _(documents):
    hits = documents.select(F.col("lang").alias("query"), F.col("doc_id").alias("id"), F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    return rollup.retrieval_quality(hits, documents.where("doc_id % 7 = 0").select(F.col("source").alias("corpus"), F.col("lang").alias("query"), F.col("doc_id").alias("id")))


#: Questions and the layer that should answer them.
GOLDEN = (("where is Foo defined", "L1"), ("who calls bar", "L1"), ("what breaks if I change x", "L1"), ("how does login work", "L2"), ("architecture of sync", "L2"), ("where do i start", "L3"), ("any gotcha here", "L3"), ("why did we choose it", "L4"), ("common mistake", "L4"), ("business rule for refunds", "L5"), ("what repos does the epic touch", "L5"), ("hello", "ALL"))


def _golden_sql() -> str:
    told = "[" + ", ".join(f"{{'q': '{q}', 'layer': '{layer}'}}" for q, layer in GOLDEN) + "]"
    pick = "CASE " + " ".join(f"WHEN regexp_matches(lower(q), '{r[0]}') THEN '{r[2]}'" for r in T.INTENTS) + " ELSE 'ALL' END"
    return f" SELECT layer, count(*)::BIGINT AS questions, round(avg(({pick} = layer)::INT), 6)::DOUBLE AS accuracy FROM (SELECT g.q || ' (' || name || ')' AS q, g.layer AS layer FROM (SELECT name, {told}[(id % {len(GOLDEN)} + 1)::INT] AS g FROM symbols)) GROUP BY 1"


@on_graph("a17_router_accuracy", _golden_sql(), False)
def _(g):
    """Every symbol asked about in one of the golden questions: how often its layer answers."""
    told = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(layer).alias("layer")) for q, layer in GOLDEN))
    rows = g.symbols.select(F.element_at(told, (F.col("id") % len(GOLDEN) + 1).cast("int")).alias("g"), "name").select(F.concat("g.q", F.lit(" ("), "name", F.lit(")")).alias("q"), "g.layer")
    return rows.groupBy("layer").agg(F.count("*").alias("questions"), F.round(F.avg((T.intent(F.col("q"))["layer"] == F.col("layer")).cast("double")), 6).alias("accuracy"))


@on_tables("a20_corpus_stats", "documents", "SELECT count(*)::BIGINT AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(strlen(text))::BIGINT AS bytes FROM documents")
def _(documents):
    return documents.agg(F.count("*").alias("files"), F.sum(F.size(F.split("text", "\n", -1))).alias("lines"), F.sum(F.octet_length("text")).alias("bytes"))


OCC = ", occ AS (SELECT e.id, s.file_id, e.target_name AS symbol, e.line * 9 AS line, e.line % 2 = 1 AS is_definition FROM raw_edges e JOIN symbols s ON s.id = e.source_id) "


@on_graph("s14_index_import", OCC + ", d AS (SELECT symbol, min((file_id, line)) AS d FROM occ WHERE is_definition GROUP BY 1) SELECT count(*)::BIGINT AS edges, sum(o.line)::BIGINT AS lines, sum(d.d[2])::BIGINT AS target_lines FROM occ o JOIN d ON d.symbol = o.symbol WHERE NOT is_definition", False)
def _(g):
    src = g.symbols.select(F.col("id").alias("source_id"), "file_id")
    rows = g.raw_edges.join(src, "source_id").select(F.col("file_id").alias("path"), F.col("target_name").alias("symbol"), (F.col("line") * 9).alias("line"), (F.col("line").bitwiseAND(1) != 0).alias("is_definition"))
    return files_source.scip_edges(rows).agg(F.count("*").alias("edges"), F.sum("line").alias("lines"), F.sum("target_line").alias("target_lines"))


@on_graph("s16_merge_indexes", """, x AS (SELECT file_id, name, line_start + (id % 2)::INT AS line_start, 'scip ' || id AS symbol FROM symbols WHERE id % 3 = 0), l AS (SELECT file_id, name, min(symbol) AS s FROM x GROUP BY ALL HAVING count(*) = 1)
SELECT o.id, coalesce(min(x.symbol), min(l.s)) AS symbol FROM symbols o LEFT JOIN x ON x.file_id = o.file_id AND x.name = o.name AND x.line_start = o.line_start LEFT JOIN l ON l.file_id = o.file_id AND l.name = o.name GROUP BY o.id""", False)  # fmt: skip
def _(g):
    index = g.symbols.where("id % 3 = 0").select("file_id", "name", (F.col("line_start") + (F.col("id") % 2).cast("int")).alias("line_start"), F.concat(F.lit("scip "), F.col("id").cast("string")).alias("symbol"))
    return compose.merge_indexes(g.symbols, index).groupBy("id").agg(F.min("symbol").alias("symbol"))


@on_tables("s20_bulk_import", "documents", "SELECT 'in/my_doc-' || doc_id || '.md' AS path, 'My Doc ' || doc_id AS title FROM documents WHERE length(text) <= 3000")
def _(documents):
    rows = documents.select(F.concat(F.lit("in/my_doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    return compose.bulk_import(rows, 3000).select("path", "title")


@on_tables("i5_tool_percentiles_by_day", "events", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type AS tool, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY ALL")
def _(events):
    return rollup.percentiles(_metrics(events).withColumn("day", F.date_trunc("day", "at").cast("timestamp_ntz")), ("day", "tool"), (95,))


@on_graph("i1_deleted_files", """, del AS (SELECT s.id, s.name FROM symbols s WHERE s.file_id % 10 = 3), ks AS (SELECT * FROM symbols WHERE file_id % 10 <> 3) SELECT count(*)::BIGINT AS edges FROM raw_edges WHERE source_id NOT IN (SELECT id FROM del)""", False)
def _(g):
    changed = g.files.where("id % 10 = 3").select(F.col("id").alias("file_id"))
    return incremental.reindex(g, changed, g.symbols.limit(0), g.raw_edges.limit(0)).edges.agg(F.count("*").alias("edges"))


#: Questions for the graph, the pages, a layer without an answer, and the memory.
ASKED = ("where is gizmo defined", "architecture of the shth", "any gotcha about tion", "common mistake with ouedti")


def _routed_sql() -> str:
    pick = "CASE " + " ".join(f"WHEN regexp_matches(q, '{r[0]}') THEN '{r[2]}'" for r in T.INTENTS) + " ELSE 'ALL' END"
    values = ", ".join(f"('{q}')" for q in ASKED)
    weight = "10 * contains(lower(left(text, 40)), w)::INT + 5 * contains(source, w)::INT + contains(lower(text), w)::INT"
    return f""", qs AS (SELECT q, {pick} AS layer FROM (VALUES {values}) v(q)), tk AS (SELECT DISTINCT q, unnest(list_filter(regexp_split_to_array(q, '[^a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({STOP_SQL}, w))) AS w FROM qs),
nt AS (SELECT q, greatest(3, 10 // count(*)) AS k FROM tk GROUP BY 1), g AS (SELECT tk.q, s.id, tk.w, row_number() OVER (PARTITION BY tk.q, tk.w ORDER BY s.name, s.id) AS rank FROM tk JOIN symbols s ON contains(lower(s.name), tk.w)),
d AS (SELECT tk.q, doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'L2' WHEN 2 THEN 'L4' WHEN 3 THEN 'L5' ELSE '' END AS layer, sum({weight}) AS score FROM documents, tk WHERE doc_id % 4 <> 1 GROUP BY ALL HAVING sum({weight}) > 0),
dr AS (SELECT *, row_number() OVER (PARTITION BY q, layer ORDER BY score DESC, id) AS k FROM d), ans AS (SELECT g.q, 'L1' AS layer, id, rank::DOUBLE AS score FROM g JOIN nt ON nt.q = g.q WHERE rank <= nt.k UNION ALL SELECT q, layer, id, score::DOUBLE FROM dr WHERE k <= 5),
own AS (SELECT ans.* FROM ans JOIN qs ON qs.q = ans.q AND (qs.layer = ans.layer OR qs.layer = 'ALL'))
SELECT q AS question, layer, id, score FROM own UNION ALL SELECT q, layer, id, score FROM ans WHERE layer IN ('L1', 'L4', 'L5') AND q NOT IN (SELECT q FROM own)"""


@add("l15_routed", VIEWS + _routed_sql())
def _(spark, sf_dir):
    """Each question classified and answered by its layer, or by graph, memory and knowledge
    where that has nothing to say (no guides are stored, so the third question's layer is empty)."""
    g, documents = build(spark, sf_dir), table(spark, sf_dir, "documents")
    fields = documents.select(F.col("doc_id").alias("id"), F.left("text", F.lit(40)).alias("title"), F.col("source").alias("description"), F.col("text").alias("body"))
    words = lambda q: [w for w in dict.fromkeys(re.split("[^a-z0-9]+", q)) if len(w) >= 3 and w not in T.STOP_WORDS]
    held = lambda k: lambda q: lexical.weighted_search(fields.where(F.col("id") % 4 == k), words(q), {"title": 10, "description": 5, "body": 1}, 5).select("id", F.col("score").cast("double").alias("score"))
    layers = {
        "L1": lambda q: lexical.per_term_top(g.symbols, words(q)).select("id", F.col("rank").cast("double").alias("score")),
        "L2": held(0),
        "L3": lambda q: fields.select("id", F.lit(0.0).alias("score")).limit(0),
        "L4": held(2),
        "L5": held(3),
    }
    out = None
    for q in ASKED:
        answer = compose.routed(spark, q, layers).withColumn("question", F.lit(q))
        out = answer if out is None else out.unionByName(answer)
    return out.select("question", "layer", "id", "score")

"""Edge resolution: every raw edge becomes exact, ambiguous or unresolved in one plan.

An edge's candidates are the symbols of its target name. Tiers are tried in order - members
of the receiver's type or its ancestors, same file, reachable by the file's imports, same
repository, all - and the first with any candidate decides: one is exact, several are
ambiguous.

No row pairs an edge with its candidates, of which a name like ``get`` has very many. What a
tier needs to know of a set of symbols is its smallest and largest id: one candidate if they
are the same, several if not. Those are aggregated by name, by name and place, and for the
import tier by name and every run of segments of the qualified name, and joined to edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafwerk.plans.store import checkpoint, sliced
from grafwerk.sources.views import Graph

TIERS = ("receiver", "file", "import", "repo", "global")


def segments(path: Column) -> Column:
    return F.split(F.translate(path, "/", "."), "\\.")


def common_suffix_length(a: Column, b: Column) -> Column:
    """How many last elements of two arrays agree."""
    same = F.zip_with(F.reverse(a), F.reverse(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, eq: F.struct((s["n"] + F.when(s["on"] & eq, 1).otherwise(0)).alias("n"), (s["on"] & eq).alias("on")), lambda s: s["n"])


def import_score(qualified: Column, imported: Column) -> Column:
    """Segments of an import that speak for a candidate: the longest common ending, the place
    where the import lies inside the qualified name plus its length, or 1 if the import's
    last segment is the name's first."""
    starts = F.filter(F.transform(qualified, lambda x, i: i), lambda i: F.slice(qualified, i + 1, F.size(imported)) == imported)
    inside = F.when(F.size(starts) > 0, starts[0] + F.size(imported)).when(F.element_at(imported, -1) == qualified[0], 1).otherwise(0)
    return F.greatest(common_suffix_length(qualified, imported), inside)


def import_scores(pairs: DataFrame, imports: DataFrame) -> DataFrame:
    """file_id, candidate, score. Any positive score needs the import's last segment among
    the candidate's segments, which makes this an equi-join."""
    wanted = pairs.select("file_id", "candidate", segments(F.col("qualified_name")).alias("q")).distinct()
    exploded = wanted.withColumn("segment", F.explode(F.array_distinct("q")))
    known = imports.select("file_id", segments(F.col("imported_path")).alias("i")).withColumn("segment", F.element_at("i", -1))
    scored = exploded.join(known, ["file_id", "segment"]).withColumn("score", import_score(F.col("q"), F.col("i")))
    return scored.groupBy("file_id", "candidate").agg(F.max("score").alias("score")).where("score >= 1")


def members(graph: Graph, type_names: DataFrame) -> DataFrame:
    """type_name, name, candidate: members whose last-but-one segment names a type."""
    q = segments(F.col("qualified_name"))
    held = graph.symbols.where(F.col("kind").isin(*MEMBER_KINDS)).select(F.when(F.size(q) >= 2, F.element_at(q, -2)).alias("type_name"), "name", F.col("id").alias("candidate")).where("type_name is not null")
    return held.join(type_names, "type_name", "left_semi")


def ancestors(graph: Graph, depth: int = 4) -> DataFrame:
    """type_name, ancestor, distance (0: itself) over extends and implements edges, by name."""
    up = parents(graph)
    found = step = up.select("type_name", "ancestor", F.lit(1).alias("distance"))
    for d in range(2, depth + 1):
        step = step.select("type_name", F.col("ancestor").alias("via")).join(up.withColumnRenamed("type_name", "via"), "via").select("type_name", "ancestor").distinct().withColumn("distance", F.lit(d))
        found = found.unionByName(step)
    return found.where("type_name <> ancestor").groupBy("type_name", "ancestor").agg(F.min("distance").alias("distance"))


def candidates(graph: Graph) -> DataFrame:
    """One row for each edge and symbol of its target name, with what the tiers look at."""
    place = graph.files.select(F.col("id").alias("file_id"), "repo_id")
    symbols = graph.symbols.join(place, "file_id")
    source = symbols.select(F.col("id").alias("source_id"), "file_id", "repo_id")
    target = symbols.select(F.col("name").alias("target_name"), F.col("id").alias("candidate"), F.col("file_id").alias("c_file"), F.col("repo_id").alias("c_repo"), "qualified_name")
    return graph.raw_edges.join(source, "source_id").join(target, "target_name")


#: Kinds that are members of a type, not types.
MEMBER_KINDS = ("method", "function", "property", "variable", "field", "constant")


def type_names(graph: Graph) -> DataFrame:
    return graph.symbols.where(~F.col("kind").isin(*MEMBER_KINDS)).select(F.col("name").alias("type_name")).distinct()


def parents(graph: Graph) -> DataFrame:
    """type_name, ancestor: direct ones, by the names in extends and implements edges."""
    child = graph.symbols.select(F.col("id").alias("source_id"), F.col("name").alias("type_name"))
    return graph.raw_edges.where("kind in ('extends', 'implements')").join(child, "source_id").select("type_name", F.col("target_name").alias("ancestor")).distinct()


def _ends(column: str = "candidate") -> list[Column]:
    return [F.min(column).alias("low"), F.max(column).alias("high")]


def member_hits(wanted: DataFrame, held: DataFrame, up: DataFrame, depth: int = 8) -> DataFrame:
    """receiver_type, target_name, low, high: the members of that name of the type itself, else
    of its nearest ancestors that have any; of several as near those of the first by name.

    ``wanted`` has (receiver_type, target_name), ``held`` (type_name, name, candidate).
    """
    own = held.groupBy(F.col("type_name").alias("via"), F.col("name").alias("target_name")).agg(F.struct(*_ends()).alias("ends"))
    own = checkpoint(own)
    nothing = wanted.sparkSession.createDataFrame([], "receiver_type string, target_name string, low long, high long")
    if own.isEmpty():
        return nothing
    step, found, seen = wanted.select("receiver_type", "target_name", F.col("receiver_type").alias("via")).distinct(), nothing, None
    for level in range(depth + 1):
        looked = checkpoint(step.join(own, ["via", "target_name"], "left"))
        if looked.isEmpty():
            break
        hits = looked.where("ends is not null").groupBy("receiver_type", "target_name").agg(F.min_by("ends", "via").alias("ends"))
        found = found.unionByName(hits.select("receiver_type", "target_name", "ends.*"))
        seen = looked if seen is None else seen.unionByName(looked)
        open_ = looked.join(hits.select("receiver_type", "target_name"), ["receiver_type", "target_name"], "left_anti")
        further = open_.join(up.select(F.col("type_name").alias("via"), "ancestor"), "via").select("receiver_type", "target_name", F.col("ancestor").alias("via")).distinct()
        step = further.join(seen.select("receiver_type", "target_name", "via"), ["receiver_type", "target_name", "via"], "left_anti")
    return found


def _runs(q: Column) -> Column:
    """Every run of segments with the score it gives an import that is this run or ends in it:
    (run, as_ending, score). A whole import found at a place scores the place and its length,
    a common ending its length; the first segment alone may also be an import's last one."""
    many = F.sequence(F.lit(1), F.size(q))
    join = lambda at, n: F.array_join(F.slice(q, at, n), ".")
    row = lambda run, how, score: F.struct(run.alias("run"), F.lit(how).alias("how"), score.cast("int").alias("score"))
    inside = F.flatten(F.transform(many, lambda at: F.transform(F.sequence(F.lit(1), F.size(q) - at + 1), lambda n: row(join(at, n), "inside", at - 1 + n))))
    # one-element arrays bind the runs and their names, which would be made again for each run
    bound = F.transform(F.array(inside), lambda rows: F.struct(rows.alias("rows"), F.transform(rows, lambda y: y["run"]).alias("names")))
    first_place = F.transform(bound, lambda b: F.filter(b["rows"], lambda x, i: F.array_position(b["names"], x["run"]) == i + 1))[0]
    endings = F.transform(many, lambda n: row(join(F.size(q) - n + 1, n), "ending", n))
    return F.concat(first_place, endings, F.array(row(q[0], "first", F.lit(1))))


#: Symbols of one name up to which each file that wants it meets all their runs.
BUSY = 64


def import_hits(wanted: DataFrame, graph: Graph) -> DataFrame:
    """file_id, target_name, low, high: of the wanted (file_id, target_name) the candidates
    with the best import score of that file's imports."""
    wanted, imports = checkpoint(wanted), checkpoint(graph.imports.select("file_id", "imported_path"))
    q = segments(F.when(F.coalesce("qualified_name", F.lit("")) != "", F.col("qualified_name")).otherwise(F.col("name")))
    held = graph.symbols.select("id", F.col("name").alias("target_name"), q.alias("q")).join(wanted.select("target_name").distinct(), "target_name", "left_semi")
    runs = held.select("id", "target_name", F.explode(_runs(F.col("q"))).alias("r")).groupBy("target_name", "r.run", "r.how", "r.score").agg(*_ends("id"))
    i = segments(F.col("imported_path"))
    part = lambda run, how: F.struct(run.alias("run"), F.lit(how).alias("how"))
    endings = F.transform(F.sequence(F.lit(1), F.size(i)), lambda n: part(F.array_join(F.slice(i, F.size(i) - n + 1, n), "."), "ending"))
    keys = F.concat(F.array(part(F.array_join(i, "."), "inside"), part(F.element_at(i, -1), "first")), endings)
    asked = lambda some: some.select("file_id", F.explode(keys).alias("k")).select("file_id", "k.run", "k.how").distinct()
    # names of few symbols bring their runs, a busy name looks its file's imports up
    busy = held.groupBy("target_name").agg(F.count("*").alias("n")).where(F.col("n") > BUSY).select("target_name")
    # an import scores only where its last segment is one of the symbol's: most pairs end here
    last = imports.withColumn("segment", F.element_at(i, -1))
    held_segments = held.join(busy, "target_name", "left_anti").select("target_name", F.explode(F.array_distinct("q")).alias("segment")).distinct().join(last.select("segment").distinct(), "segment", "left_semi")
    met = checkpoint(wanted.join(held_segments, "target_name").join(last.select("file_id", "segment").distinct(), ["file_id", "segment"], "left_semi"))
    few = met.select("file_id", "target_name").distinct().join(runs, "target_name").join(asked(last.join(met.select("file_id", "segment"), ["file_id", "segment"], "left_semi")), ["file_id", "run", "how"])
    sought = checkpoint(wanted.join(busy, "target_name", "left_semi"))
    many = sought.join(asked(imports.join(sought.select("file_id"), "file_id", "left_semi")), "file_id").join(runs, ["target_name", "run", "how"])
    columns = ["file_id", "target_name", "score", "low", "high"]
    scored = few.select(*columns).unionByName(many.select(*columns))
    best = scored.groupBy("file_id", "target_name", "score").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return best.groupBy("file_id", "target_name").agg(F.max_by(F.struct("low", "high"), "score").alias("ends")).select("file_id", "target_name", "ends.*")


def resolve_edges(graph: Graph, types: DataFrame | None = None, up: DataFrame | None = None) -> DataFrame:
    """All raw edges with target_id (exact only), resolution and tier.

    types (type_name) and up (type_name, ancestor) are the receiver tier's types and their
    direct ancestors; by default those of the graph.
    """
    place = graph.files.select(F.col("id").alias("file_id"), "repo_id")
    symbols = graph.symbols.join(place, "file_id").select("id", F.col("name").alias("target_name"), "file_id", "repo_id")
    by_file = symbols.groupBy("target_name", "file_id", "repo_id").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    again = lambda *by: by_file.groupBy("target_name", *by).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    tiers = {"file": again("file_id"), "repo": again("repo_id"), "global": again()}
    edges = graph.raw_edges.join(symbols.select(F.col("id").alias("source_id"), "file_id", "repo_id"), "source_id", "left")
    received = graph.raw_edges.where("receiver_type is not null").select("receiver_type", "target_name").distinct()
    hits = member_hits(received, members(graph, type_names(graph) if types is None else types), parents(graph) if up is None else up)
    open_ = edges.where("file_id is not null").select("file_id", "target_name").distinct().join(tiers["file"], ["target_name", "file_id"], "left_anti")
    sides = {"receiver": (["receiver_type", "target_name"], hits), "file": (["target_name", "file_id"], tiers["file"]), "import": (["file_id", "target_name"], import_hits(open_, graph)), "repo": (["target_name", "repo_id"], tiers["repo"]), "global": (["target_name"], tiers["global"])}
    for tier, (keys, found) in sides.items():
        edges = edges.join(found.withColumnsRenamed({"low": f"low_{tier}", "high": f"high_{tier}"}), keys, "left")
    # an edge without a known source has no candidates
    first = lambda end: F.coalesce(*[F.when(F.col(f"low_{t}").isNotNull(), end(t)) for t in TIERS])
    known = F.col("file_id").isNotNull()
    low, high, tier = first(lambda t: F.col(f"low_{t}")), first(lambda t: F.col(f"high_{t}")), first(F.lit)
    return edges.select(
        *graph.raw_edges.columns,
        F.when(known & (low == high), low).alias("target_id"),
        F.when(known & (low == high), "exact").when(known & low.isNotNull(), "ambiguous").otherwise("unresolved").alias("resolution"),
        F.when(known, tier).alias("tier"),
    )


#: Edges that are resolved together, which bounds what is exchanged at a time.
SLICE = 4_000_000


def resolved_in_slices(graph: Graph, up: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """``resolve_edges``, stored slice by slice of the edges."""
    n = graph.raw_edges.count()
    types = type_names(graph)
    if n > (rows or SLICE):
        up = checkpoint(parents(graph) if up is None else up)

    def made(part, _) -> DataFrame:
        return resolve_edges(Graph(graph.repos, graph.files, graph.symbols, graph.imports, part(graph.raw_edges)), types, up)

    return sliced(graph.raw_edges, ["target_name", "source_id"], made, rows or SLICE)


def written_back(edges: DataFrame) -> DataFrame:
    """Edges as they are stored: an exact one has its target and no name, others have a name."""
    return edges.withColumn("target_name", F.when(F.col("resolution") != "exact", F.col("target_name")))


def resolution_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("resolution", "tier").agg(F.count("*").alias("edges"))


def resolve_rate(edges: DataFrame) -> DataFrame:
    """Share of edges that found a name, and how many fuzzy matches a precise one saves."""
    return edges.agg(F.count("*").alias("edges"), F.round(F.avg((F.col("resolution") != "unresolved").cast("double")), 6).alias("resolve_rate"))


def fuzzy_false_positive_rate(graph: Graph, name: str) -> DataFrame:
    """1 - precise / fuzzy callers of a name."""
    ids = graph.symbols.where(F.col("name") == name).select(F.col("id").alias("target_id"))
    precise = graph.edges.join(ids, "target_id", "left_semi").select("id")
    fuzzy = precise.unionByName(graph.edges.where(F.col("target_name") == name).select("id")).distinct()
    n = precise.agg(F.count("*").alias("precise")).crossJoin(fuzzy.agg(F.count("*").alias("fuzzy")))
    return n.select("precise", "fuzzy", F.when(F.col("fuzzy") > 0, F.round(1 - F.col("precise") / F.col("fuzzy"), 6)).alias("false_positive_rate"))


def repair_incoming(graph: Graph, changed_names: DataFrame) -> DataFrame:
    """Resolve again only the edges whose target name is among ``changed_names`` (name)."""
    some = graph.raw_edges.join(changed_names.select(F.col("name").alias("target_name")), "target_name", "left_semi")
    return resolve_edges(Graph(graph.repos, graph.files, graph.symbols, graph.imports, some))


#: redges: the resolved edges, for the checking engine. Qualified names have two segments.
SQL = """
src AS (SELECT s.*, f.repo_id, f.path, f.language FROM symbols s JOIN files f ON f.id = s.file_id),
pairs AS (SELECT e.id, c.id AS cand, c.file_id = s.file_id AS in_file, c.repo_id = s.repo_id AS in_repo, s.file_id AS sf, c.qualified_name AS qn
  FROM raw_edges e JOIN src s ON s.id = e.source_id JOIN src c ON c.name = e.target_name),
iq AS (SELECT file_id, string_split(imported_path, '.') AS i FROM imports),
sc AS (SELECT p.sf, p.cand, max(CASE WHEN string_split(p.qn, '.') = iq.i THEN 2 ELSE 1 END) AS score
  FROM (SELECT DISTINCT sf, cand, qn FROM pairs) p JOIN iq ON iq.file_id = p.sf AND (iq.i[2] = string_split(p.qn, '.')[2] OR iq.i[2] = string_split(p.qn, '.')[1]) GROUP BY ALL),
ps AS (SELECT p.*, sc.score, max(sc.score) OVER (PARTITION BY p.id) AS best FROM pairs p LEFT JOIN sc ON sc.sf = p.sf AND sc.cand = p.cand),
dec AS (SELECT id, count(*) FILTER (in_file) AS n1, count(*) FILTER (score = best) AS n2, count(*) FILTER (in_repo) AS n3, count(*) AS n4,
  min(cand) FILTER (in_file) AS c1, min(cand) FILTER (score = best) AS c2, min(cand) FILTER (in_repo) AS c3, min(cand) AS c4 FROM ps GROUP BY id),
redges AS MATERIALIZED (SELECT e.*, CASE WHEN n1 > 0 THEN CASE n1 WHEN 1 THEN c1 END WHEN n2 > 0 THEN CASE n2 WHEN 1 THEN c2 END WHEN n3 > 0 THEN CASE n3 WHEN 1 THEN c3 END WHEN n4 = 1 THEN c4 END AS target_id,
  CASE WHEN n4 IS NULL THEN 'unresolved' WHEN (CASE WHEN n1 > 0 THEN n1 WHEN n2 > 0 THEN n2 WHEN n3 > 0 THEN n3 ELSE n4 END) = 1 THEN 'exact' ELSE 'ambiguous' END AS resolution,
  CASE WHEN n1 > 0 THEN 'file' WHEN n2 > 0 THEN 'import' WHEN n3 > 0 THEN 'repo' WHEN n4 > 0 THEN 'global' END AS tier
  FROM raw_edges e LEFT JOIN dec d ON d.id = e.id)"""

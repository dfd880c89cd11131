"""Aggregations over the graph: statistics, dependencies, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.operators.lookup import located
from grafwerk.plans.store import checkpoint
from grafwerk.sources.views import Graph


def stats(graph: Graph) -> DataFrame:
    """metric, key, value: table sizes, symbols by kind and repository, resolved edges."""
    count = lambda df, m: df.agg(F.count("*").alias("value")).select(F.lit(m).alias("metric"), F.lit("").alias("key"), "value")
    by = lambda df, m, c: df.groupBy(F.col(c).cast("string").alias("key")).agg(F.count("*").alias("value")).select(F.lit(m).alias("metric"), "key", "value")
    parts = [count(getattr(graph, t), t) for t in ("repos", "files", "symbols", "edges", "imports")]
    parts += [by(graph.symbols, "kind", "kind"), by(located(graph), "repo", "repo_id"), count(graph.edges.where("target_id is not null"), "resolved")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tree(graph: Graph, depth: int = 3) -> DataFrame:
    """Symbols and files by the first folders of a path; files without symbols count too."""
    per_file = graph.symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    place = F.array_join(F.slice(F.split("path", "/"), 1, depth), "/")
    return graph.files.join(per_file, graph.files["id"] == per_file["file_id"], "left").groupBy(place.alias("folder")).agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"))


def repo_dependencies(graph: Graph, namespaces: DataFrame, bounded: bool = False) -> DataFrame:
    """source repo, target repo, n: imports that begin with a namespace (repo_id, prefix) of
    another repository, once for each namespace that fits; bounded wants whole segments."""
    place = graph.files.select(F.col("id").alias("file_id"), F.col("repo_id").alias("source"))
    paths = graph.imports.join(place, "file_id").groupBy("source", "imported_path").agg(F.count("*").alias("uses"))
    # an equi-join on the path's beginning, once for each length that a prefix has
    ns = namespaces.select(F.col("repo_id").alias("target"), "prefix")
    lengths = [r["n"] for r in ns.select(F.char_length("prefix").alias("n")).distinct().collect()]
    path = F.col("imported_path")
    beginnings = [F.when((F.char_length(path) == n) | (F.substr(path, F.lit(n + 1), F.lit(1)) == "." if bounded else F.char_length(path) > n), F.left(path, F.lit(n))) for n in sorted(lengths)]
    cut = paths.select("source", "uses", F.explode(F.array_compact(F.array(*(beginnings or [F.lit(None).cast("string")])))).alias("prefix"))
    by_prefix = cut.groupBy("source", "prefix").agg(F.sum("uses").alias("uses"))
    return by_prefix.join(ns, "prefix").where("source <> target").groupBy("source", "target").agg(F.sum("uses").alias("n"), F.min("prefix").alias("evidence"))


def module_dependencies(graph: Graph, depth: int = 3) -> DataFrame:
    """Distinct (module, other module) over resolved edges, with the number of edges."""
    place = located(graph).select("id", F.array_join(F.slice(F.split("path", "/"), 1, depth), "/").alias("module"))
    a, b = place.select(F.col("id").alias("source_id"), "module"), place.select(F.col("id").alias("target_id"), F.col("module").alias("other"))
    return graph.edges.where("target_id is not null").join(a, "source_id").join(b, "target_id").where("module <> other").groupBy("module", "other").agg(F.count("*").alias("edges"))


def incoming(graph: Graph) -> DataFrame:
    return graph.edges.where("target_id is not null").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("incoming"))


def key_files(graph: Graph, part: str, top: int = 5) -> DataFrame:
    """Files of a module whose symbols have most incoming edges."""
    hits = located(graph).where(F.contains(F.lower("path"), F.lit(part.lower()))).join(incoming(graph), "id", "left")
    return hits.groupBy("path").agg(F.coalesce(F.sum("incoming"), F.lit(0)).alias("incoming")).orderBy(F.desc("incoming"), "path").limit(top)


def hub_types(graph: Graph, top: int = 10) -> DataFrame:
    """Classes and interfaces of each repository with most incoming edges."""
    hits = located(graph).where("kind in ('class', 'interface')").join(incoming(graph), "id", "left").select("repo_id", "id", "name", F.coalesce("incoming", F.lit(0)).alias("incoming"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("incoming"), "id"))).where(F.col("rank") <= top)


def flow_candidates(graph: Graph, least: int = 5) -> DataFrame:
    """Functions and methods with at least ``least`` resolved outgoing edges."""
    out = graph.edges.where("target_id is not null").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("outgoing")).where(F.col("outgoing") >= least)
    return graph.symbols.where("kind in ('function', 'method')").join(out, "id").select("id", "name", "file_id", "outgoing")


def flow_gaps(graph: Graph, covered: DataFrame, least: int = 5) -> DataFrame:
    """Flow candidates by key (the name, with the file's base name where several files have
    it) and whether a guide (key) covers them."""
    found = flow_candidates(graph, least).join(graph.files.select(F.col("id").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("base")), "file_id")
    places = found.groupBy("name").agg((F.min("file_id") != F.max("file_id")).alias("several"))
    keyed = found.join(places, "name").withColumn("key", F.when(F.col("several"), F.concat_ws("#", "name", "base")).otherwise(F.col("name"))).groupBy("key").agg(F.sum("outgoing").alias("outgoing"))
    return keyed.join(covered.select("key").distinct().withColumn("covered", F.lit(True)), "key", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def module_gaps(graph: Graph, covered: DataFrame, least: int = 5, depth: int = 3) -> DataFrame:
    """Modules with at least ``least`` symbols that no guide's path (prefix) covers, by whole
    segments either way. Both sides are cut into their prefixes, which makes it equi-joins."""
    mods = located(graph).groupBy(F.array_join(F.slice(F.split("path", "/"), 1, depth), "/").alias("module")).agg(F.count("*").alias("symbols")).where(F.col("symbols") >= least)
    heads = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda n: F.array_join(F.slice(F.split(c, "/"), 1, n), "/")))
    paths = covered.select("prefix").distinct()
    down = mods.select("module", heads(F.col("module")).alias("prefix")).join(paths, "prefix", "left_semi").select("module")
    up = paths.select(heads(F.col("prefix")).alias("module")).join(mods, "module", "left_semi").select("module")
    return mods.join(down.unionByName(up).distinct(), "module", "left_anti")


def tool_metrics(events: DataFrame) -> DataFrame:
    """Calls, mean milliseconds, errors and their share by tool."""
    error = F.col("status") == "error"
    return events.groupBy("tool").agg(F.count("*").alias("calls"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"), F.count_if(error).alias("errors"), F.round(100 * F.avg(error.cast("double")), 6).alias("error_pct"))


def percentiles(events: DataFrame, by: tuple[str, ...] = ("tool",), of: tuple[int, ...] = (50, 95, 99), bins: int = 1000) -> DataFrame:
    """Exact percentiles, interpolated between the two values beside each.

    Values are counted first. Equal steps between a group's least and greatest value say in
    which step a wanted rank lies, and only those steps are put in order, so that no task
    holds all values of a group.
    """
    keys = list(by)
    held = checkpoint(events.where(F.col("duration_ms").isNotNull()).groupBy(*keys, F.col("duration_ms").cast("double").alias("x")).agg(F.count("*").alias("c")))
    ends = held.groupBy(*keys).agg(F.min("x").alias("least"), F.max("x").alias("greatest"), F.sum("c").alias("n"))
    step = F.when(F.col("greatest") > F.col("least"), F.least(F.floor((F.col("x") - F.col("least")) / (F.col("greatest") - F.col("least")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    placed = held.join(ends, keys).withColumn("step", step)
    upto = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = placed.groupBy(*keys, "step").agg(F.sum("c").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    place = lambda p: F.lit(p / 100) * (F.col("n") - 1)
    wanted = ends.select(*keys, F.explode(F.array(*[F.struct(F.lit(p).alias("p"), side(place(p)).cast("long").alias("rank")) for p in of for side in (F.floor, F.ceil)])).alias("w")).select(*keys, "w.p", "w.rank").distinct()
    hit = wanted.join(steps, keys).where("rank >= before and rank < before + c").select(*keys, "step", "p", "rank", "before")
    inside = Window.partitionBy(*keys, "step").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.join(hit.select(*keys, "step").distinct(), [*keys, "step"], "left_semi").withColumn("earlier", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    at = near.select(*keys, "step", "x", "earlier", "c").join(hit, [*keys, "step"]).where("rank >= before + earlier and rank < before + earlier + c")
    pairs = at.groupBy(*keys, "p").agg(F.min("x").alias("low"), F.max("x").alias("high")).join(ends.select(*keys, "n"), keys)
    part = F.col("p") / 100 * (F.col("n") - 1)
    value = F.round(F.col("low") + (part - F.floor(part)) * (F.col("high") - F.col("low")), 6)
    return pairs.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, value)).alias(f"p{p}") for p in of])


def regressions(now: DataFrame, before: DataFrame, limit: float = 15.0) -> DataFrame:
    """Operations by name with the change in percent and whether it is over the limit."""
    both = now.select("op", F.col("sec").alias("now")).join(before.select("op", F.col("sec").alias("before")), "op")
    delta = F.round(100 * (F.col("now") - F.col("before")) / F.col("before"), 6)
    return both.where("before > 0").withColumn("delta_pct", delta).withColumn("regressed", F.col("delta_pct") > limit)


def retrieval_quality(hits: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """corpus, recall and MRR at k from hits (query, id, rank) and expected (corpus, query, id)."""
    best = expected.join(hits.where(F.col("rank") <= k), ["query", "id"], "left").groupBy("corpus", "query").agg(F.min("rank").alias("rank"))
    return best.groupBy("corpus").agg(F.count("*").alias("queries"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def dominant_language(files: DataFrame) -> DataFrame:
    """Commonest language of each repository, the first by name among equals."""
    counted = files.groupBy("repo_id", "language").agg(F.count("*").alias("n"))
    return counted.groupBy("repo_id").agg(F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("language"))

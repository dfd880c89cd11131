"""Definitions, callers, callees, text predicates over symbols and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafwerk.sources.views import Graph

STRUCTURAL = ("calls", "call", "extends", "implements")
#: Parts of a path that mark a test, and endings of a test's name.
TEST_PATHS = ("/src/test/", "/src/androidTest/", "/test/", "/tests/", "/__tests__/", "/spec/", "Test.kt", "Test.java", "Tests.java", "_test.go", "_test.dart", "_test.py", "test_", ".spec.ts", ".spec.js", ".test.ts", ".test.js", "Test.swift", "Spec.swift")
TEST_NAME = "(Test|Spec|Tests|Specs)$"


def located(graph: Graph) -> DataFrame:
    """Symbols with the path, language and repository of their file."""
    return graph.symbols.join(graph.files.select(F.col("id").alias("file_id"), "path", "language", "repo_id"), "file_id")


def like_literal(text: str) -> str:
    """A text as a LIKE pattern that matches only itself."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def find_definition(graph: Graph, name: str, limit: int = 50) -> DataFrame:
    """Exact name, else qualified name, else part of a name whatever its case."""
    kind = F.when(F.col("name") == name, 1).when(F.col("qualified_name") == name, 2).when(F.contains(F.lower("name"), F.lit(name.lower())), 3)
    hits = located(graph).withColumn("match", kind).where("match is not null")
    best = hits.agg(F.min("match").alias("best"))
    return hits.join(F.broadcast(best), F.col("match") == F.col("best")).orderBy("kind", "id").limit(limit).select("id", "name", "qualified_name", "kind", "path", "match")


def find_by_id(graph: Graph, symbol_id: int) -> DataFrame:
    return located(graph).where(F.col("id") == symbol_id).select("id", "name", "qualified_name", "kind", "path")


def _kinds(edges: DataFrame, kinds: tuple[str, ...] | None) -> DataFrame:
    return edges if kinds is None else edges.where(F.col("kind").isin(*kinds))


def callers(graph: Graph, name: str, fuzzy: bool = False, kinds: tuple[str, ...] | None = None, limit: int = 200) -> DataFrame:
    """Symbols with an edge to a symbol of this name; fuzzy adds edges that only name it.

    The alternative is a union of two equi-joins, not an OR, which would be a nested loop.
    """
    ids = graph.symbols.where(F.col("name") == name).select(F.col("id").alias("target_id"))
    edges = _kinds(graph.edges, kinds)
    hits = edges.join(ids, "target_id", "left_semi").select("id", "source_id", "kind", "line")
    if fuzzy:
        hits = hits.unionByName(edges.where(F.col("target_name") == name).select("id", "source_id", "kind", "line")).dropDuplicates(["id"])
    who = located(graph).select(F.col("id").alias("source_id"), F.col("name").alias("caller"), "path")
    return hits.join(who, "source_id").select(F.col("id").alias("edge_id"), "source_id", "caller", "path", "kind", "line").orderBy("edge_id").limit(limit)


def callees(graph: Graph, name: str, fuzzy: bool = False, kinds: tuple[str, ...] | None = None, limit: int = 200) -> DataFrame:
    """What symbols of this name have edges to; the path is that of the call."""
    own = located(graph).where(F.col("name") == name).select(F.col("id").alias("source_id"), "path")
    edges = _kinds(graph.edges, kinds)
    edges = edges if fuzzy else edges.where("target_id is not null")
    target = graph.symbols.select(F.col("id").alias("target_id"), F.col("name").alias("t_name"), F.col("kind").alias("t_kind"))
    hits = edges.join(own, "source_id").join(target, "target_id", "left")
    return hits.select(F.col("id").alias("edge_id"), "target_id", F.coalesce("t_name", "target_name").alias("callee"), F.coalesce("t_kind", F.lit("unknown")).alias("callee_kind"), "path", "kind", "line").orderBy("edge_id").limit(limit)


def callers_or_fuzzy(graph: Graph, name: str, limit: int = 200) -> DataFrame:
    """Precise callers; where there are none, fuzzy ones."""
    precise, fuzzy = callers(graph, name, limit=limit), callers(graph, name, True, limit=limit)
    none = precise.agg(F.count("*").alias("n")).where("n = 0")
    return precise.withColumn("mode", F.lit("precise")).unionByName(fuzzy.join(F.broadcast(none), how="left_semi", on=F.lit(True)).withColumn("mode", F.lit("fuzzy")))


def is_public(language: Column, name: Column, kind: Column, modifiers: Column) -> Column:
    """JVM languages need the modifier, Python a name without underscore; else all."""
    jvm = language.isin("kotlin", "java")
    seen = F.when(jvm, F.coalesce(F.array_contains(modifiers, "public"), F.lit(False))).when(language == "python", ~F.startswith(name, F.lit("_"))).otherwise(True)
    return seen & kind.isin("function", "method", "class", "interface", "enum")


def test_method(path: Column, name: Column, qualified: Column) -> Column:
    """'path', 'name', 'path+name' or '': how a symbol shows to be a test. Under /src/main/
    only the name counts."""
    by_path = F.lit(False)
    for mark in TEST_PATHS:
        by_path = by_path | F.contains(path, F.lit(mark))
    by_path = by_path & ~F.contains(path, F.lit("/src/main/"))
    by_name = name.rlike(TEST_NAME) | qualified.rlike(TEST_NAME)
    return F.when(by_path & by_name, "path+name").when(by_path, "path").when(by_name, "name").otherwise("")


def symbols_in_module(graph: Graph, part: str, repo_id: int | None = None) -> DataFrame:
    hits = located(graph).where(F.contains(F.lower("path"), F.lit(part.lower())))
    return (hits if repo_id is None else hits.where(F.col("repo_id") == repo_id)).select("id", "name", "kind", "path")


def files_exist(files: DataFrame, refs: DataFrame) -> DataFrame:
    """ref, found: a path equals the reference or ends in / and it. Paths are posted under each
    of their endings, so a base name that very many files have makes no pairs."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    wanted = refs.select("ref").distinct()
    some = files.select("path", base(F.col("path")).alias("base")).join(wanted.select(base(F.col("ref")).alias("base")).distinct(), "base", "left_semi")
    parts = F.split("path", "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    found = wanted.join(some.select(F.explode(endings).alias("ref")), "ref", "left_semi").withColumn("found", F.lit(True))
    return wanted.join(found, "ref", "left").select("ref", F.coalesce("found", F.lit(False)).alias("found"))


def symbols_exist(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """ref, found: a name, a qualified name or the end of one after a point, else its last
    segment is a name. Call brackets are ignored; every case meets on the last segment."""
    last = lambda c: F.element_at(F.split(c, "\\."), -1)
    wanted = refs.select("ref", F.regexp_replace("ref", "\\(\\)$", "").alias("bare")).distinct().withColumn("last", last(F.col("bare")))
    names = symbols.select(F.col("name").alias("last")).unionByName(symbols.select(last(F.col("qualified_name")).alias("last"))).distinct()
    found = wanted.join(names, "last", "left_semi").select("ref", F.lit(True).alias("found"))
    return refs.select("ref").distinct().join(found, "ref", "left").select("ref", F.coalesce("found", F.lit(False)).alias("found"))


def stale_files(files: DataFrame, pending: DataFrame, limit: int = 200) -> DataFrame:
    """Files with changes that are not indexed yet."""
    return files.join(pending.select("path").distinct(), "path", "left_semi").select("id", "path").orderBy("path").limit(limit)


def enclosing_symbol(lines: DataFrame, symbols: DataFrame, bin_size: int = 64) -> DataFrame:
    """The innermost symbol around each (file_id, line): smallest span, then smallest id.

    A range join made an equi-join by binning the spans.
    """
    spans = symbols.select("file_id", F.col("id").alias("owner"), "line_start", "line_end").withColumn("bin", F.explode(F.sequence(F.expr(f"line_start div {bin_size}"), F.expr(f"line_end div {bin_size}"))))
    hits = lines.select("file_id", "line").distinct().withColumn("bin", F.expr(f"line div {bin_size}").cast("long")).join(spans.withColumn("bin", F.col("bin").cast("long")), ["file_id", "bin"]).where("line between line_start and line_end")
    return hits.groupBy("file_id", "line").agg(F.min_by("owner", F.struct(F.col("line_end") - F.col("line_start"), "owner")).alias("owner"))


def preceding_definition(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """As-of join: the last definition at or before each reference's line in its file."""
    from pyspark.sql import Window

    both = definitions.select("file_id", "line", F.col("id").alias("def_id"), F.lit(None).cast("string").alias("ref_id")).unionByName(references.select("file_id", "line", F.lit(None).cast("long").alias("def_id"), F.col("id").alias("ref_id")))
    order = Window.partitionBy("file_id").orderBy("line", F.col("ref_id").isNotNull(), "def_id", "ref_id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("owner", F.last("def_id", True).over(order)).where("ref_id is not null").select("ref_id", "file_id", "line", "owner")

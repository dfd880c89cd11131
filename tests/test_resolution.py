"""The import tier: every pair's best score, and how few pairs meet the runs of names."""

import pytest
from pyspark.sql import functions as F

from grafwerk.operators import resolve
from grafwerk.sources.views import Graph


def _graph(spark):
    symbols = [(n, f"f{n % 7}", f"a{n % 3}.{'b/' * (n % 2)}c{n % 4}.f{n % 7}", n % 5) for n in range(60)] + [(60, "f1", "", 0), (61, "f2", None, 1), (62, "x.f2", "a.x.f2.f2", 2)]
    imports = [(n % 9, path) for n, path in enumerate(("a1.c2.f1", "c0/f2", "f3", "a2", "none.f4", "a0.b.c2.f2", "c3.f0", "a1", "z", "f2.f2", "a0.c0", "b.c1.f5", None) * 2)]
    held = spark.createDataFrame(symbols, "id long, name string, qualified_name string, file_id long")
    wanted = spark.range(10).withColumnRenamed("id", "file_id").crossJoin(held.select(F.col("name").alias("target_name")).distinct())
    return Graph(None, None, held, spark.createDataFrame(imports, "file_id long, imported_path string"), None), wanted


def _best(graph, wanted):
    """The same by pairs of edges and candidates."""
    path = F.when(F.coalesce("qualified_name", F.lit("")) != "", F.col("qualified_name")).otherwise(F.col("name"))
    pairs = wanted.join(graph.symbols.select(F.col("name").alias("target_name"), F.col("id").alias("candidate"), path.alias("qualified_name")), "target_name")
    scored = resolve.import_scores(pairs, graph.imports).join(pairs.select("file_id", "candidate", "target_name"), ["file_id", "candidate"])
    best = scored.groupBy("file_id", "target_name").agg(F.max("score").alias("score"))
    return {tuple(r) for r in scored.join(best, ["file_id", "target_name", "score"]).groupBy("file_id", "target_name").agg(F.min("candidate"), F.max("candidate")).collect()}


@pytest.mark.parametrize("busy", [0, 8, 64])
def test_the_import_tier_finds_what_all_pairs_find(spark, monkeypatch, busy):
    monkeypatch.setattr(resolve, "BUSY", busy)
    graph, wanted = _graph(spark)
    assert {tuple(r) for r in resolve.import_hits(wanted, graph).collect()} == _best(graph, wanted) != set()


def test_a_pair_meets_no_runs_if_its_file_imports_nothing_that_ends_in_the_name(spark, monkeypatch):
    cut, checkpoint = [], resolve.checkpoint
    monkeypatch.setattr(resolve, "checkpoint", lambda df: cut.append(checkpoint(df)) or cut[-1])
    held = spark.range(2000).select("id", F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("m.n"), "id").alias("qualified_name"))
    wanted = spark.range(2000).select((F.col("id") % 10).alias("file_id"), F.concat(F.lit("n"), "id").alias("target_name"))
    imports = spark.createDataFrame([(1, "m.n11"), (1, "m.n12"), (2, "k.n12")], "file_id long, imported_path string")
    found = resolve.import_hits(wanted, Graph(None, None, held, imports, None))
    assert {tuple(r) for r in found.collect()} == {(1, "n11", 11, 11), (2, "n12", 12, 12)}
    assert [df.count() for df in cut if "segment" in df.columns] == [2]

"""What joins hold and how work is laid out where tables are larger than their files tell."""

import os

import pytest
from pyspark.sql import functions as F

from grafwerk.plans import store


@pytest.fixture
def thresholds(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    held = {n: spark.conf.get(n, None) for n in names}
    yield names
    for n, value in held.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def test_symbols_that_a_file_packs_well_are_not_broadcast_unmeasured(spark, sf, tmp_path, thresholds):
    """200,000 parts of few names: under a megabyte as a file, far more as rows."""
    spark.conf.set(thresholds[0], "10m")
    spark.conf.unset(thresholds[1])
    for name in ("nation", "supplier", "lineitem"):
        os.symlink(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    part = spark.read.parquet(f"{sf}/part.parquet")
    one = part.count()
    part.crossJoin(spark.range(200_000 // one).withColumnRenamed("id", "_k")).withColumn("p_partkey", F.col("p_partkey") + F.col("_k") * one).drop("_k").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    graph = store.build(spark, str(tmp_path))
    named = graph.raw_edges.join(graph.symbols.select(F.col("id").alias("source_id"), "name", "qualified_name"), "source_id")
    assert "BroadcastHashJoin" not in named._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get(thresholds[1]) == "10m"
    assert graph.edges.count() == graph.raw_edges.count()


def test_a_session_that_broadcasts_less_is_left_as_it_is(spark, thresholds):
    for value in ("-1", "128k", "262144"):
        spark.conf.set(thresholds[0], value)
        spark.conf.unset(thresholds[1])
        store.measured_joins(spark)
        assert spark.conf.get(thresholds[0]) == value
        assert spark.conf.get(thresholds[1], None) is None


def test_questions_of_files_and_symbols_resolve_no_edges(spark, sf, tmp_path, monkeypatch):
    from grafwerk import catalog

    for name in ("nation", "supplier", "part", "lineitem"):
        os.symlink(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    cut, checkpoint = [], store.checkpoint
    monkeypatch.setattr(store, "checkpoint", lambda df: cut.append(df.columns) or checkpoint(df))
    for name in ("a15_facts", "g5_test_symbols", "l1_search_symbols"):
        assert not catalog.queries()[name](spark, str(tmp_path)).isEmpty()
    assert not cut
    graph = store.build(spark, str(tmp_path))
    assert graph.edges is store.build(spark, str(tmp_path)).edges
    assert len(cut) == 2 and "target_id" in cut[1]
    assert graph.with_edges(graph.edges.limit(3)).edges.count() == 3
    assert graph.edges.count() == graph.raw_edges.count() == graph.derived.raw_edges.count()

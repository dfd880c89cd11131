"""What cut tables and exchanges leave on disk."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grafwerk import catalog
from grafwerk.operators import components, incremental, memory, resolve, similar, traverse, vector
from grafwerk.plans import store
from grafwerk.sources.views import from_tables


def _bytes(folder):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(folder) for f in fs)


def _folder(spark):
    store.checkpoint_folder(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")


def test_rows_with_text_are_stored_packed(spark):
    df = spark.range(20_000).select("id", F.concat(F.lit("a_long_name_that_repeats_"), F.col("id") % 50).alias("name"))
    before = _bytes(_folder(spark))
    cut = store.checkpoint(df)
    assert _bytes(_folder(spark)) - before < 20_000 * 12
    assert cut.dtypes == df.dtypes and cut.exceptAll(df).isEmpty() and cut.count() == 20_000


def test_what_a_slice_cuts_off_goes_with_it(spark):
    rows = spark.range(1000).select("id", F.col("id").cast("string").alias("name"))
    inner, kept_inside = [], []

    def made(part, kept):
        inner.append(store.checkpoint(part(rows)))
        kept_inside.append(kept(part(rows)))
        return inner[-1].withColumn("n", F.lit(1))

    before = set(os.listdir(_folder(spark)))
    found = store.sliced(rows, ["id"], made, 300)
    assert len(inner) == 4 and found.count() == 1000 and found.select("id").distinct().count() == 1000
    assert sum(k.count() for k in kept_inside) == 1000
    assert len(set(os.listdir(_folder(spark))) - before) == 8


def test_shuffle_files_go_with_their_action(spark):
    store.tidy(spark)
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    shuffled = lambda: {f for top in local for d, _, fs in os.walk(top.getPath()) for f in fs if f.startswith("shuffle_")}
    before = shuffled()
    cut = store.checkpoint(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    assert cut.count() == 7 and not shuffled() - before


def test_edges_resolved_in_slices_are_those_of_one_plan(spark, sf):
    g = from_tables(spark, sf)
    one, many = resolve.resolve_edges(g), resolve.resolved_in_slices(g, rows=1500)
    assert many.columns == one.columns and one.exceptAll(many).isEmpty() and many.count() == one.count() > 4 * 1200


def test_files_written_again_in_slices_leave_the_graph_as_it_was(spark, sf, monkeypatch):
    g = store.build(spark, sf)
    g.edges.count()
    monkeypatch.setattr(incremental, "SLICE", 1500)
    want = {tuple(r) for r in g.edges.select("id", "target_id", "resolution", "tier").collect()}
    changed = g.files.where("id % 3 = 1").select(F.col("id").alias("file_id"))
    again = g.symbols.join(changed, "file_id", "left_semi").select(*g.symbols.columns)
    edges = g.raw_edges.join(again.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(*g.raw_edges.columns)
    fresh, sources = incremental.reindexed(g, changed, again, edges)
    got = fresh.edges.select("id", "target_id", "resolution", "tier").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert edges.join(sources, "source_id", "left_anti").isEmpty()
    assert not catalog.queries()["i4_catch_up"](spark, sf).isEmpty()


def test_long_texts_are_cut_off_once_each(spark):
    """A text of 300 words fills most of its 256 components; its vector is one packed row."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [" ".join(word() for _ in range(300)) for _ in range(120)]
    texts += [" ".join(w if rng.random() < 0.95 else word() for w in t.split()) for t in texts] + texts[:3]
    rows = [(k, "ab"[k % 3 == 0], f"title {k}", t, True) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, type string, title string, body string, is_latest boolean")
    before = _bytes(_folder(spark))
    got = {(r["new_id"], r["old_id"], r["via"]) for r in memory.superseded(df, df).collect()}
    assert _bytes(_folder(spark)) - before < len(rows) * 2000
    x = np.zeros((len(rows), 256))
    for r in vector.hash_embed(df, "id", F.concat_ws(" ", "title", "body")).collect():
        x[r["id"], r["i"]] = r["x"]
    want = set()
    for k, row in enumerate(rows):
        near = [(-round(float(x[k] @ x[j]), 12), j) for j in range(k) if rows[j][1] == row[1] and x[k] @ x[j] >= 0.85]
        want |= {(k, min(near)[1], "text")} if near else set()
    assert got == want and len(want) > 60
    packed = vector.hash_packed(df.select("id", F.col("type").alias("block"), F.concat_ws(" ", "title", "body").alias("t")), "id", F.col("t"), ["block"])
    assert {(r["id"], r["other"], "text") for r in similar.nearest(packed, packed, 0.85, 256, 9).collect()} == want


@pytest.mark.parametrize("local", [4, 30, 10**6])
def test_components_and_labels_whatever_a_task_takes(spark, monkeypatch, local):
    """Rings that lie in one block, span several, and are found in rounds."""
    monkeypatch.setattr(components, "LOCAL", local)
    rng = random.Random(local)
    edges = [(i, i + 1) for i in range(60)] + [(3 * k + 2, 3 * k) for k in range(12)] + [(45, 30), (60, 50), (70, 71), (71, 70), (5, 5), (80, 0)] + [(rng.randrange(60, 90), rng.randrange(60, 90)) for _ in range(12)]
    follows = {i: {b for a, b in edges if a == i} for i in range(91)}
    reach = {}
    for i in follows:
        seen, open_ = set(), list(follows[i])
        while open_:
            if (x := open_.pop()) not in seen:
                seen.add(x)
                open_ += follows[x]
        reach[i] = seen
    nodes, arcs = spark.range(91).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "from_id long, to_id long")
    got = {r["node"]: r["component"] for r in components.strong_components(nodes, arcs).collect()}
    assert got == {i: min([i, *(j for j in reach[i] if i in reach[j])]) for i in follows}
    if local > 4:
        index = components.reach_index(nodes, arcs)
        assert {(r["seed"], r["node"]) for r in components.reached_from(index, nodes).collect()} == {(i, j) for i in reach for j in reach[i]}


def test_a_path_of_any_length_takes_few_jobs(spark):
    """Rounds that follow the path would take a thousand."""
    group = "components of a long ring"
    spark.sparkContext.setJobGroup(group, group)
    try:
        ring = spark.range(2000).select(F.col("id").alias("from_id"), ((F.col("id") + 1) % 2000).alias("to_id"))
        got = components.strong_components(spark.range(2001).withColumnRenamed("id", "node"), ring).groupBy("component").count().collect()
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert {tuple(r) for r in got} == {(0, 2000), (2000, 1)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 40


def test_closure_and_dataflow_in_slices_are_those_of_one_plan(spark, sf, monkeypatch):
    g = store.build(spark, sf)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    hop = traverse.hops(g.edges, g.symbols)
    one, index = rows(traverse.closure_of(hop)), rows(traverse.dataflow_index(g))
    cut, checkpoint = [], traverse.checkpoint
    monkeypatch.setattr(traverse, "checkpoint", lambda df, **kw: cut.append(df.columns) or checkpoint(df, **kw))
    monkeypatch.setattr(traverse, "HOPS", hop.count() // 3)
    assert rows(traverse.closure_of(hop)) == one != []
    assert len(cut) in (6, 8) and all("target_name" in c for c in cut)
    monkeypatch.setattr(traverse, "SEEDS", 50)
    monkeypatch.setattr(traverse, "SMALL", 3)
    assert rows(traverse.dataflow_index(g)) == index != []

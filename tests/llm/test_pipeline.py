"""Each stage on what the one before it kept, against brute force."""

import pytest
from test_operators import brute_fingerprint, brute_windows, groups, texts

import corpus_pipeline
from grafwerk.llm.shared import checkpoint

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "s", 1, i) for i, t in enumerate(texts())] + [(0, texts()[0], "en", "s", 1, 0), (None, "no id " * 30, None, None, None, None), (None, None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines int").repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 != 0)) for i in range(40)], "doc_id long, quality int").write.parquet(f"{base}/labels.parquet")
    return str(base)


def held(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near copies", "passages", "packing"]
    good = checkpoint(stages["quality"](spark, docs, folder))
    assert good.columns == COLUMNS and set(held(good)) <= set(held(docs))
    lines = checkpoint(stages["lines"](spark, docs, folder))
    assert lines.columns == COLUMNS and lines.count() == docs.count()
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    one = checkpoint(stages["near copies"](spark, lines, folder))
    rows = held(lines)
    named = groups([i for i, _ in rows], [brute_fingerprint(t) for _, t in rows])
    want = sorted({i for (i, _), c in zip(rows, named) if i is not None and i == c})
    assert sorted(i for i, _ in held(one) if i is not None) == want and one.columns == COLUMNS
    assert sum(i is None for i, _ in held(one)) == 2
    cut = checkpoint(stages["passages"](spark, one, folder))
    brute = {(i, n, " ".join(kept.split())) for i, n, _, kept in brute_windows(held(one))}
    assert {(i, len((dict(held(one)).get(i) or "").split()) if i is not None else n, " ".join(t.split())) for (i, t), n in zip(held(cut), [0] * cut.count()) if i is not None} == {b for b in brute if b[0] is not None}
    packed = stages["packing"](spark, cut, folder)
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in held(cut)}


def test_empty_table(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns) and got.count() > 0

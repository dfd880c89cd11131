"""The hash embedder: rows of one id are one text, and words do not travel."""

from hashlib import sha256
from math import sqrt

from pyspark.sql import functions as F

from grafwerk.operators import vector


def _plain(rows):
    sums = {}
    for key, words in rows:
        for word in words:
            h = sha256(word.encode()).digest()
            i, x = int.from_bytes(h[:4], "little") % 256, (1 if h[4] % 2 else -1) * (0.5 + int.from_bytes(h[5:9], "little") % 1000 / 1000)
            sums[key, i] = sums.get((key, i), 0.0) + x
    size = {k: sqrt(sum(x * x for (other, _), x in sums.items() if other == k)) for k, _ in sums}
    return {(k, i, round(x / size[k], 12)) for (k, i), x in sums.items()}


def test_rows_of_an_id_are_united_and_words_stay_in_their_task(spark):
    rows = [(1, "Alpha beta, beta"), (2, ""), (3, None), (4, "a b"), (4, "bé c A"), (None, "x y"), (5, "... "), (6, "中文 12 x_y")]
    found = vector.hash_embed(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t"))
    words = [(1, ["alpha", "beta"]), (4, ["a", "b"]), (4, ["bé", "c", "a"]), (6, ["中文", "12", "x", "y"])]
    assert {(r["id"], r["i"], round(r["x"], 12)) for r in found.collect()} == _plain(words)
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_more_words_than_a_task_keeps(spark, monkeypatch):
    monkeypatch.setattr(vector, "KEPT_WORDS", 3)
    batch = spark.range(0, 50, 1, 1).select("id", F.transform(F.sequence(F.lit(0), F.col("id")), lambda n: F.concat(F.lit("w"), n % 7)).alias("words")).toArrow().to_batches()[0]
    monkeypatch.setattr(vector, "HASHED_ROWS", 8)
    few = [r for b in vector._hashed([batch], 256) for r in b.to_pylist()]
    monkeypatch.setattr(vector, "KEPT_WORDS", 1 << 17)
    assert few == [r for b in vector._hashed([batch], 256) for r in b.to_pylist()] and len(few) == 50

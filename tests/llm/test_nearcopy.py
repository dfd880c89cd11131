"""Planted copies on both sides of the similarity that the near-copy stage promises."""

import random

import corpus_pipeline
from grafwerk.llm import simhash


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def planted(rng):
    """(original, copy) of 300 words with a run of words replaced or words changed one by one."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    copy = list(base)
    if rng.random() < 0.5:
        at, n = rng.randrange(200), rng.randrange(5, 60)
        copy[at : at + n] = [f"x{rng.randrange(10**6)}" for _ in range(n)]
    else:
        for at in rng.sample(range(300), rng.randrange(1, 12)):
            copy[at] = f"x{rng.randrange(10**6)}"
    return " ".join(base), " ".join(copy)


def test_planted_copies(spark):
    rng = random.Random(7)
    pairs = [planted(rng) for _ in range(400)]
    docs = spark.createDataFrame([(2 * k + j, t, "en", "s", len(t)) for k, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string, lang string, source string, n_chars long")
    near = [jaccard(*p) >= 0.8 for p in pairs]
    assert 100 < sum(near) < 300 and sum(0.8 <= jaccard(*p) < 0.95 for p in pairs) > 80
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near copies"](spark, docs, "").collect()}
    assert kept == {2 * k for k in range(400)} | {2 * k + 1 for k in range(400) if not near[k]}


def test_linked_through_others(spark):
    """Copies that are near only to a text between them are one group."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(words[20 * k : 20 * k + 300]) for k in range(6)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert jaccard(texts[0], texts[1]) >= 0.8 > jaccard(texts[0], texts[2])
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near copies"](spark, docs, "").collect()] == [0]


def test_repeated_ids(spark):
    """A text stays though its id has another one, which is a copy of a smaller id's."""
    rng = random.Random(9)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(3))
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, c), (3, c + " end"), (4, a), (4, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    seen = set()
    for n in (1, 4):
        got = sorted((r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["near copies"](spark, docs.repartition(n), "").collect())
        seen.add(tuple(got))
    assert len(seen) == 1 and [i for i, _ in got] == [1, 2, 3] and got[:2] == [(1, a), (2, b)]


def test_a_pair_behind_many_nearer_texts(spark):
    """Both ends of a pair at 0.8 have sixty texts beside them just below 0.8, of which some
    are nearer by fingerprint."""
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    one = new(400)
    two = one[:180] + new(40) + one[220:]
    beside = [x[:at] + new(42) + x[at + 42 :] for x in (one, two) for at in rng.sample(range(5, 350), 60)]
    texts = [" ".join(x) for x in (one, two, *beside)]
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (one, two, *beside)]
    near = [[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
    root = list(range(len(texts)))
    for _ in range(10):
        root = [min(root[j] for j in range(len(texts)) if near[i][j]) for i in range(len(texts))]
    assert near[0][1] and not any(near[k][j] for k in (0, 1) for j in range(2, len(texts)) if sum(near[j]) == 1)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    assert found == dict(enumerate(root))


def test_near_copies_at_another_similarity(spark):
    """Sizes that differ by more than a class of 0.8 are compared, too."""
    rng = random.Random(12)
    one = [f"w{rng.randrange(10**9)}" for _ in range(400)]
    texts = [" ".join(one), " ".join(one[:370]), " ".join(one[:330]), "", " ", "\n"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert jaccard(texts[0], texts[1]) >= 0.9 > jaccard(texts[1], texts[2]) > 0.85
    for similar, of_two in ((0.9, 2), (0.85, 0)):
        found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs, similar).collect()}
        assert found == {0: 0, 1: 0, 2: of_two, 3: 3, 4: 3, 5: 3}

"""Supersession, chains, components, reach, stored indexes and derived tables against brute force."""

import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from grafwerk.operators import annindex, components, knowledge, lexical, memory, sequences, similar, vector
from grafwerk.operators.searchindex import SearchIndex


@pytest.mark.parametrize("range_rows", [3, 10**6])
def test_running_values_over_ranges(spark, range_rows):
    """A group of half the rows, null groups, and no group at all."""
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", None]), k, rng.choice([None, *range(9)])) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    for group in (["g"], []):
        for fold, of in ((F.sum, sum), (F.max, max)):
            for inclusive in (False, True):
                got = {r["k"]: r["x"] for r in sequences.running(df, group, ["k"], F.col("v"), "x", fold, inclusive, range_rows).collect()}
                for g, k, _ in rows:
                    before = [v for h, j, v in rows if (h == g or not group) and (j <= k if inclusive else j < k) and v is not None]
                    assert got[k] == (of(before) if before else None)


def test_chain_ranks(spark):
    links = [(i, i - 1) for i in range(1, 300)] + [(0, None), (400, None), (401, 400), (402, 400), (500, 499), (600, 600)]
    got = {r["id"]: (r["first"], r["rank"]) for r in sequences.chain_ranks(spark.createDataFrame(links, "id long, old_id long")).collect()}
    assert all(got[i] == (0, i) for i in range(300))
    assert [got[i] for i in (400, 401, 402, 499, 500, 600)] == [(400, 0), (400, 1), (400, 1), (499, 0), (499, 1), (600, 0)]


@pytest.mark.parametrize("part", [7, similar.PART])
def test_sparse_join_is_brute_force(spark, part):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((9, 30)) * (rng.random((9, 30)) < 0.5)
    x = np.concatenate([base[rng.integers(0, 9, 90)] + 0.25 * rng.standard_normal((90, 30)) * (rng.random((90, 30)) < 0.4), rng.standard_normal((40, 30)), base[:1].repeat(20, 0)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    block = [str(k % 2) for k in range(len(x))]
    df = spark.createDataFrame([(k, block[k], i, float(v)) for k in range(len(x)) for i, v in enumerate(x[k]) if v], "id long, block string, i int, x double")
    got = {r["id"]: (r["other"], round(r["score"], 9)) for r in similar.best_match(df, df, 0.85, part).collect()}
    want = {}
    for k in range(len(x)):
        s = np.round(x[:k] @ x[k], 12)
        near = [(-s[j], j) for j in range(k) if block[j] == block[k] and s[j] >= 0.85 - 1e-12]
        if near:
            want[k] = (min(near)[1], round(-min(near)[0], 9))
    assert got == want and len(want) > 40


def test_renamed_record_supersedes_and_titles_are_no_pairs(spark):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, "decision", "Cache keys", words, True), (2, "decision", "Keys of the cache", words, True), (3, "decision", " cache KEYS ", "other text", True), (4, "pattern", "Keys of the cache", words, True), (5, "decision", "Gone", "nothing alike at all", True), (6, "decision", None, None, True), (7, "decision", "", words, False)]
    df = spark.createDataFrame(rows, "id long, type string, title string, body string, is_latest boolean")
    got = {r["new_id"]: (r["old_id"], r["via"]) for r in memory.superseded(df, df).collect()}
    assert got == {2: (1, "text"), 3: (1, "title"), 7: (1, "text")} or got == {2: (1, "text"), 3: (1, "title"), 7: (2, "text")}
    hot = spark.range(3000).select("id", F.lit("decision").alias("type"), F.lit("One title").alias("title"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("body"), F.lit(True).alias("is_latest"))
    links = memory.superseded(hot, hot, range_rows=500).checkpoint()
    assert links.count() == 2999 and links.where("new_id = old_id + 1 and via = 'title'").count() == 2999
    chain = memory.version_chain(hot, links).checkpoint()
    assert chain.count() == 3000 and chain.where("versions = id and first = 0").count() == 3000 and chain.where("is_latest").count() == 1
    assert [r["id"] for r in memory.lineage(chain, 3).collect()] == [3, 2, 1, 0]


def closure_of(n, edges):
    adjacent = {i: set() for i in range(n)}
    for a, b in edges:
        adjacent[a].add(b)
    out = {}
    for i in range(n):
        seen, open_ = set(), list(adjacent[i])
        while open_:
            x = open_.pop()
            if x not in seen:
                seen.add(x)
                open_ += adjacent[x]
        out[i] = seen
    return out


@pytest.mark.parametrize("n, m, seed", [(40, 60, 1), (30, 29, 2), (25, 140, 3), (1, 0, 4)])
def test_components_and_reach(spark, tmp_path, n, m, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    reach = closure_of(n, edges)
    nodes, arcs = spark.createDataFrame([(i,) for i in range(n)], "node long"), spark.createDataFrame(edges, "from_id long, to_id long")
    got = {r["node"]: r["component"] for r in components.strong_components(nodes, arcs).collect()}
    assert got == {i: min([i, *(j for j in reach[i] if i in reach[j])]) for i in range(n)}
    components.reach_index(nodes, arcs).write(str(tmp_path / "reach"))
    index = components.Reach.read(spark, str(tmp_path / "reach"))
    pairs = spark.createDataFrame([(i, j) for i in range(n) for j in range(n)] + [(0, 10**6)], "a long, b long")
    assert {(r["a"], r["b"]) for r in components.reaches(index, pairs).where("reached").collect()} == {(i, j) for i in range(n) for j in reach[i]}
    assert {(r["seed"], r["node"]) for r in components.reached_from(index, nodes).collect()} == {(i, j) for i in range(n) for j in reach[i]}


def test_a_ring_of_fifty_is_one_component(spark):
    edges = [(i, (i + 1) % 50) for i in range(50)] + [(i, i + 1) for i in range(60, 90)]
    got = {r["node"]: r["component"] for r in components.strong_components(spark.range(100).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "from_id long, to_id long")).collect()}
    assert all(got[i] == (0 if i < 50 else i) for i in range(100))


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 6)))
    rows = [(k, f"{word()}_{word()}{rng.choice(['', 'Übung', '%'])}", rng.choice(["class", "function"]), f"{word()}.{word()}", rng.choice([None, f"{word()} {word()}"])) for k in range(900)]
    return spark.createDataFrame(rows, "id long, name string, kind string, qualified_name string, docstring string").checkpoint()


def test_stored_search_is_the_search(spark, names, tmp_path):
    """Blocks of 64 ids, so that most are bounded away; limits that cut ties."""
    index = SearchIndex.write(names, str(tmp_path / "index"), 8, 64)
    posted = lexical.postings(names, "id", ["name", "qualified_name", "docstring"]).checkpoint()
    for terms in (["a"], ["ab", "c"], ["abc"], ["zz"], ["e", "e"]):
        want = lexical.bm25(posted, list(dict.fromkeys(terms)), True).orderBy(F.desc("score"), "id").limit(20).collect()
        assert [tuple(r) for r in index.ranked(terms, 20, 2).collect()] == [tuple(r) for r in want]
    for pattern in ("ab*", "abc", "*bc*d", "übung", "_", "a%b", "x", "ab.c", "%%"):
        want = [tuple(r) for r in lexical.search_symbols(names, pattern, limit=50).select("id", "score", "source", "name", "kind").orderBy("source", F.desc("score"), "id").collect()]
        assert [tuple(r) for r in index.search(pattern, limit=50).orderBy("source", F.desc("score"), "id").collect()] == want
    assert index.candidates(["abc"]).count() < 0.2 * names.count()
    files = index.look_up("words", ["ab"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in files and "bucket" in files


def test_stored_vectors_of_all_lengths(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 12))
    x = centres[np.arange(3000) % 40] + 0.25 * rng.standard_normal((3000, 12))
    y = rng.standard_normal((300, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, v.tolist()) for i, v in enumerate(y)]
    odd = [(9000, None), (9001, [0.0] * 12), (9002, [1.0]), (9003, [float("nan")] * 12), (9004, [])]
    df = spark.createDataFrame(rows[:2000] + rows[3000:] + odd, "vec_id long, embedding array<double>")
    path = str(tmp_path / "vectors")
    annindex.VectorIndex.write(df, path, cell_rows=100).append(spark.createDataFrame(rows[2000:3000] + [(9100, [1.0] * 7)], df.schema))
    index = annindex.VectorIndex.read(spark, path)
    assert index.rows().count() == 3301 and len(index.models[12].cells.centres) == 20 and index.models[12].cells.probes < 12
    asked = annindex.vectors(spark.createDataFrame([r for r in rows if r[0] % 100 == 0] + odd, df.schema))
    got = {}
    for r in index.search(asked, 5).collect():
        got.setdefault(r["query_id"], {})[r["id"]] = r["score"]
    hits = total = 0
    for ids, z in ((range(3000), x), (range(5000, 5300), y)):
        u = z / np.linalg.norm(z, axis=1, keepdims=True)
        for k, i in enumerate(ids):
            if i % 100 == 0:
                near = u @ u[k]
                near[k] = -2
                best = np.argsort(-near)[:5]
                assert all(abs(s - near[j - ids[0]]) < 1e-9 for j, s in got[i].items())
                hits, total = hits + len({ids[j] for j in best} & set(got[i])), total + 5
    assert hits >= 0.9 * total and 9002 not in got and 9001 not in got
    plan = index.search(asked.where("id = 5000"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(d" in plan or "d#" in plan
    shutil.rmtree(path)


def test_hot_cell_is_many_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(annindex, "CHUNK", 50)
    rows = [(i, [1.0, 0.0]) for i in range(400)] + [(1000, [0.0, 1.0])]
    index = annindex.VectorIndex.write(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), str(tmp_path / "hot"))
    got = [(r["id"], r["score"]) for r in index.search(annindex.vectors(spark.createDataFrame([(7, [2.0, 0.0])], "vec_id long, embedding array<double>")), 4).orderBy("rank").collect()]
    assert got == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)]


def test_critic_counts_the_known_headings(spark):
    files, symbols = spark.createDataFrame([("src/a.py",)], "path string"), spark.createDataFrame([("go", "m.go")], "name string, qualified_name string")
    five = "\n".join([*knowledge.MODULE_HEADINGS, knowledge.SHARED_HEADING])
    long = "word " * 100
    docs = [(1, "## A\n## B\n## C\n## D\n## E"), (2, five + "\n`src/a.py` `go()`"), (3, five + "\n" + long), (4, "\n".join(knowledge.FLOW_HEADINGS[:3]) + "\n`a` `b`\n"), (5, five + "\n`src/b.py`\n`src/b.py`"), (6, None), (7, five + "\n  # " + long + "`src/a.py`\n`go`"), (8, five + "\n`two\nlines`" + long)]
    got = {r["id"]: (r["errors"], r["warnings"], r["quality"], r["passed"]) for r in knowledge.critic(spark.createDataFrame(docs, "id long, body string"), files, symbols).collect()}
    assert got == {1: (0, 0, 0.0, False), 2: (0, 0, 1.0, True), 3: (0, 1, 1.0, True), 4: (0, 2, 0.6, False), 5: (2, 0, 1.0, False), 6: (0, 0, 0.0, False), 7: (0, 0, 1.0, True), 8: (0, 1, 1.0, True)}


def test_hashed_words_keep_their_bytes(spark):
    import hashlib

    got = {(r["i"], round(r["x"], 12)) for r in vector.hash_embed(spark.createDataFrame([(1, "alpha Beta beta")], "id long, t string"), "id", F.col("t")).collect()}
    raw = {}
    for w in ("alpha", "beta"):
        h = hashlib.sha256(w.encode()).digest()
        i = int.from_bytes(h[:4], "little") % 256
        raw[i] = raw.get(i, 0) + (1 if h[4] % 2 else -1) * (0.5 + int.from_bytes(h[5:9], "little") % 1000 / 1000)
    size = sum(v * v for v in raw.values()) ** 0.5
    assert got == {(i, round(v / size, 12)) for i, v in raw.items()}


def test_derived_tables_follow_random_changes(spark, sf):
    """Files lose, gain and change symbols and edges; every table equals a full rebuild."""
    from grafwerk.operators import incremental
    from grafwerk.plans.store import build, checkpoint

    g = build(spark, sf)
    tables = incremental.derived(g)
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    for turn in (1, 2):
        changed = g.files.where(F.col("id") % 4 == turn).select(F.col("id").alias("file_id")).limit(2)
        kept = g.symbols.join(changed, "file_id", "left_semi").where(F.col("id") % 3 != turn).select(*g.symbols.columns)
        kept = kept.withColumn("name", F.when(F.col("id") % 5 == 0, F.lit("renamed")).otherwise(F.col("name")))
        edges = g.raw_edges.join(kept.select(F.col("id").alias("source_id")), "source_id", "left_semi").where(F.length("id") % 2 == turn % 2).select(*g.raw_edges.columns)
        edges = edges.withColumn("target_name", F.when(F.col("line") == 1, F.lit("renamed")).otherwise(F.col("target_name")))
        g, tables = incremental.incremental_update(g, checkpoint(changed), checkpoint(kept), checkpoint(edges), tables)
        whole = incremental.derived(g)
        for name in ("hops", "closure", "calls", "dataflow"):
            assert rows(tables[name]) == rows(whole[name]), name
    far = tables["closure"].select("source_id").distinct().count()
    assert far > 50


def test_sketches_merge(spark, tmp_path):
    from grafwerk.operators import sketches

    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(3000), None if k % 50 == 0 else rng.expovariate(0.1), "error" if k % 9 == 0 else "ok", f"2024-01-{1 + k % 20:02d} 10:00:00", k) for k in range(6000)]
    df = spark.createDataFrame(rows, "tool string, session long, duration_ms double, status string, at string, event_id long").withColumn("at", F.col("at").cast("timestamp"))
    sketches.store(df.where("event_id % 20 < 15"), str(tmp_path / "days"))
    sketches.store(df.where("event_id % 20 >= 10"), str(tmp_path / "days"))  # five days again, five new
    got = {r["tool"]: r for r in sketches.merged(sketches.stored(spark, str(tmp_path / "days"))).collect()}
    for tool in "ab":
        own = [r for r in rows if r[0] == tool]
        times = sorted(r[2] for r in own if r[2] is not None)
        assert got[tool]["calls"] == len(own) and got[tool]["errors"] == sum(r[3] == "error" for r in own)
        assert abs(got[tool]["avg_ms"] - sum(times) / len(times)) < 1e-6
        assert abs(got[tool]["sessions"] / len({r[1] for r in own}) - 1) <= sketches.DISTINCT_ERROR
        for p in (50, 95, 99):
            rank = np.searchsorted(times, got[tool][f"p{p}"]) / len(times)
            assert abs(rank - p / 100) <= sketches.RANK_ERROR


def test_buffer_survives_a_failure_between_write_and_commit(spark, tmp_path):
    import time

    from grafwerk.streaming import buffer

    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    row = lambda k: (k, "ab"[k % 2], k % 7, None, float(k), "ok")
    for part in range(3):
        spark.createDataFrame([row(k) for k in range(part * 100, part * 100 + 100)], buffer.ROW).coalesce(1).write.mode("append").parquet(source)
    before = {k: spark.conf.get(k, None) for k in buffer.STORE}
    for k, v in buffer.STORE.items():
        spark.conf.set(k, v)
    failed = []

    def fail(number):
        if not failed:
            failed.append(number)
            raise RuntimeError("between write and commit")

    def start(check):
        stream = spark.readStream.schema(buffer.ROW).option("maxFilesPerTrigger", 1).parquet(source)
        return buffer.write(buffer.buffered(stream, 20, 1.0, 1), folder, before_commit=check)

    try:
        with pytest.raises(Exception, match="between write and commit"):
            start(fail).awaitTermination(120)
        query = start(None)
        until = time.time() + 150
        while time.time() < until and buffer.written(spark, folder).count() < 300:
            time.sleep(1)
        query.stop()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = sorted(r["event_id"] for r in buffer.written(spark, folder).collect())
    assert got == list(range(300)) and failed
    sizes = [r["n"] for r in buffer.written(spark, folder).groupBy("batch", "tool").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) >= 40  # full groups first, the rest when its time had passed

"""MinHash near copies, the leaderboard feed and whitening against brute force."""

import math
import os
import random
import zlib
from datetime import datetime, timedelta
from fractions import Fraction
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from grafwerk.llm import leaderboard, linededup, minhash, substring, whitening
from grafwerk.llm.shared import prepare


# --- 11 -------------------------------------------------------------------------------
def shingle_set(text, k=4):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_groups(rows):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                group[root(i)] = root(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[root(i)] = min(doc, names.get(root(i), doc))
    return [(doc, len(s), names.get(root(i)), doc == names.get(root(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def family():
    rng = random.Random(3)
    base = [f"b{rng.randrange(5000)}" for _ in range(120)]
    texts = [edited(rng, base, rng.randrange(0, 9)) for _ in range(90)]
    texts += ["one two", "ONE  two", "one two three four", "one two three four five", "a b c d e f", None, "", " \n", "Été was here today", "été was here today", "x " * 40_000, "x " * 39_000, *texts[:3], texts[0]]
    texts += [edited(rng, [f"c{k}{i}" for i in range(60)], 0) for k in range(20)]
    rows = list(enumerate(texts)) + [(None, texts[1]), (None, "lonely words of nobody here"), (3, texts[3]), (4, "another text of id four entirely")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("part", [minhash.PART, 4000])
def test_minhash_is_brute_force(spark, family, part):
    """Small parts cut the family into classes of sizes and pairs of parts."""
    prepare(spark)
    docs = spark.createDataFrame([(a, b, "s", 1) for a, b in family], "doc_id long, text string, node string, keys int").repartition(7)
    got = minhash.near_duplicates(docs, part=part)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_groups(family), key=key)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_minhash_without_rows(spark):
    prepare(spark)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    order = minhash.orders(minhash.BANDS * minhash.ROWS)
    for n in (3, 40, 4000):
        alike = []
        for _ in range(60):
            a = rng.integers(0, 2**63, n, np.uint64)
            b = np.concatenate([a[: n * 2 // 3], rng.integers(0, 2**63, n - n * 2 // 3, np.uint64)])
            alike.append((minhash.sketch(a, order) == minhash.sketch(b, order)).mean())
        shared = n * 2 // 3
        assert abs(np.mean(alike) - shared / (2 * n - shared)) < 0.12


def test_intersections_and_labels():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 900, rng.integers(1, 400)).astype(np.uint64)) for _ in range(60)]
    want = [[len(np.intersect1d(a, b)) for b in sets[40:]] for a in sets[:40]]
    assert (minhash.intersections(sets[:40], sets[40:]) == want).all()
    few, many = minhash.exact_links(sets[:3], None, 1, 5), minhash.exact_links(sets, None, 1, 5)
    assert len(few) == 3 and len(many) == 60
    linked = lambda a, b: 5 * len(np.intersect1d(a, b)) >= len(np.union1d(a, b))
    assert all(many[i] == many[j] for i in range(60) for j in range(60) if linked(sets[i], sets[j]))


# --- 12 -------------------------------------------------------------------------------
def brute_feed(lines, vendors, items, top=10):
    nation, price = dict(vendors), dict(items)
    told = []
    for sale, line, item, vendor, quantity, amount, flag, shipped in lines:
        name = lambda v: "" if v is None else str(v)
        h = zlib.crc32(f"{name(sale)},{name(item)},{name(vendor)},{name(line)}".encode())
        s = (shipped - datetime(1970, 1, 1)).days if shipped else 19723 + h % 150
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        b = min(12, 1 + (a - 19723) * 12 // 180)
        cents = math.floor(100 * amount + 0.5) if amount is not None else quantity * math.floor(100 * price[item] + 0.5) if quantity is not None and price.get(item) is not None else 0
        told.append((b, a, s, nation.get(vendor), item, -cents if flag == "returned" else cents))
    largest = {}
    for b, _, s, *_ in told:
        largest[b] = max(largest.get(b, s), s)
    limit = {b: max((v for c, v in largest.items() if c < b), default=-(10**9)) for b in largest}
    revenue, board, out = {}, {}, []
    for (b, a), some in groupby(sorted(told, key=lambda x: x[:2]), key=lambda x: x[:2]):
        seen = set()
        for _, _, s, n, item, cents in some:
            if s + 8 >= limit[b] and n is not None and item in price:
                own = revenue.setdefault(n, {})
                own[item] = own.get(item, 0) + cents
                seen.add(n)
        for n in seen:
            new = [i for _, i in sorted((-r, i) for i, r in revenue[n].items() if r > 0)[:top]]
            rank = lambda items, i: items.index(i) + 1 if i in items else None
            for i in {*new, *board.get(n, [])}:
                before, after = rank(board.get(n, []), i), rank(new, i)
                if before != after:
                    out.append((n, a, i, "enter" if before is None else "exit" if after is None else "move", before, after, revenue[n][i], b))
            board[n] = new
    return out


@pytest.fixture(scope="module")
def shop():
    rng = random.Random(9)
    vendors = [(v, v % 3 if v else None) for v in range(12)]
    items = [(i, None if i == 5 else float(rng.randrange(1, 900)) / 4) for i in range(70)]
    lines = []
    for k in range(2500):
        hot = rng.random() < 0.3
        item = 7 if hot else rng.choice([None, *range(80)])
        amount = rng.choice([None, 10.0, 0.0, round(rng.random() * 500, 2), 25.5])
        shipped = rng.choice([None, datetime(2024, 1, 1) + timedelta(days=rng.randrange(148))])
        lines.append((rng.choice([None, k // 3]), rng.randrange(1, 5), item, 3 if hot else rng.randrange(14), rng.choice([None, 1, 4]), amount, rng.choice(["kept", "returned", "swapped", None]), shipped))
    return lines + lines[:40], vendors, items


@pytest.mark.parametrize("slice_rows", [100, leaderboard.SLICE_ROWS])
def test_leaderboard_is_brute_force(spark, shop, slice_rows):
    """Late lines, returns, nulls, ties, repeats, a hot item; boards of one slice and of many."""
    prepare(spark)
    lines = spark.createDataFrame(shop[0], "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp_ntz").withColumn("batch", F.lit("clash")).repartition(5)
    vendors, items = spark.createDataFrame(shop[1], "vendor_id long, nation_id int"), spark.createDataFrame(shop[2], "item_id long, price double")
    staged = leaderboard.staged(lines, vendors, items, slice_rows)
    assert slice_rows > 100 or staged.agg(F.max("slice")).first()[0] > 3
    got = [tuple(r) for r in leaderboard.change_feed(staged).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(brute_feed(*shop), key=key)


def test_leaderboard_without_rows(spark):
    prepare(spark)
    feed = leaderboard.change_feed(spark.createDataFrame([], leaderboard.FED))
    assert feed.count() == 0 and feed.columns == [c.split()[0] for c in leaderboard.FEED.split(", ")]


def test_leaderboard_opens_no_native_stores(spark, monkeypatch):
    """Stores outside the heap keep memory when they are closed, one a partition and start."""
    prepare(spark)
    kept = []
    monkeypatch.setattr(leaderboard, "remove", lambda spark, folder: kept.append(folder))
    rows = [(1, 0, i % 3, leaderboard.FIRST_DAY + b, leaderboard.FIRST_DAY + b, 100 + i, b) for b in (1, 2) for i in range(6)]
    assert leaderboard.change_feed(spark.createDataFrame(rows, leaderboard.FED)).count() == 3
    state = [f for f in kept if f.endswith("/state")]
    files = [name for f in state for _, _, names in os.walk(f"{f.removeprefix('file:')}/state") for name in names if not name.startswith(".")]
    assert any(name.endswith(".delta") for name in files)
    assert not [name for name in files if name.endswith((".zip", ".changelog"))]


def test_bands():
    assert leaderboard.band_of(np.array([-5, 0, 1, 2, 3, 4, 2**40 - 1, 2**40, 2**62])).tolist() == [0, 0, 1, 2, 2, 3, 40, 41, 63]


# --- 13 -------------------------------------------------------------------------------
def test_gram_is_exact():
    rng = np.random.default_rng(4)
    for x in (rng.integers(-(2**50), 2**50, (50, 3)), rng.integers(0, 2**20, (9000, 2)), np.zeros((0, 2), np.int64), np.array([[-1, 1 << 20], [-(1 << 20), 7]])):
        whole = x.astype(object)
        assert (whitening.gram(x) == (whole.T @ whole if len(x) else 0)).all()


def test_whitening_is_brute_force(spark):
    prepare(spark)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 5)) @ np.diag([3, 2, 1, 0.5, 0.2])
    vectors = [[float(np.float32(v)) for v in row] for row in base]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(100 + i, vectors[0]) for i in range(30)]
    rows += [(0, vectors[3]), (None, vectors[4]), (200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan"), 0.0, 0.0, 0.0, 0.0]), (203, [float("inf")] * 5), (204, []), (205, [1e30] * 5), (206, [1.0, 2.0]), (207, [2.0, 2.5]), (208, [2.5, 9.0]), (209, [4.0])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<float>, component string").repartition(6)
    got = whitening.whiten(df, 3).collect()
    x = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in enumerate(vectors)}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    v = np.array([[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in fit), n**3)) for j in range(5)] for i in range(5)])
    values, axes = np.linalg.eigh(v)
    for r in got:
        if r["vec_id"] in x and r["vec_id"] != 0:
            own, c = x[r["vec_id"]], 5 - r["component"]
            assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(own, sums))
            centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(own, sums)])
            assert abs(abs(r["whitened"]) - abs(centred @ axes[:, c]) / math.sqrt(values[c])) < 1e-9
            assert abs(r["explained"] / (values[c] / np.trace(v)) - 1) < 1e-9 and r["identity_error"] < 1e-9
    ids = [r["vec_id"] for r in got]
    assert sorted({i for i in ids if i is not None}) == sorted([*x, *range(100, 130), 206, 207, 208]) and ids.count(0) == 6 and ids.count(None) == 3
    assert {r["n"] for r in got if r["vec_id"] in (206, 207, 208)} == {3}
    assert whitening.whiten(df.where("false")).count() == 0


# --- clashing names -------------------------------------------------------------------
CLASHES = "id starts sign whole mark gone places __id __text __sign __starts __whole __dropped __pos h a b _whole Whole n_lines n_words text2"


@pytest.mark.parametrize("run", [lambda d: linededup.dedup_lines(d), lambda d: substring.dedup_windows(d)], ids=["lines", "windows"])
def test_every_clashing_column_passes_through(spark, run):
    prepare(spark)
    plain = spark.createDataFrame([(1, "a line that is long\nother"), (2, "A line that is long\n" + "w " * 30), (3, "v " * 10 + "w " * 30)], "doc_id long, text string")
    wanted = {r["doc_id"]: tuple(r) for r in run(plain).collect()}
    for name in CLASHES.split():
        found = run(plain.withColumn(name, F.lit("kept")))
        for r in found.collect():
            assert tuple(r[c] for c in ("doc_id", *(c for c in run(plain).columns if c != "doc_id"))) == wanted[r["doc_id"]]
            assert r[name] == "kept" or name in ("n_lines", "n_words")


def test_texts_of_one_id_with_one_32_bit_mark_keep_their_own(spark):
    """Rows of one id are told apart by 64 bits of their text."""
    prepare(spark)
    a, b = "p " * 20, "q " * 5 + "p " * 20
    rows = [(1, "p " * 20), (2, a), (2, b)]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.dedup_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 20, 0), (2, 20, 20), (2, 25, 20)]


def test_sql_of_the_feed_is_brute_force(sf):
    """The SQL over the given tables against the loop."""
    import duckdb

    from grafwerk.llm.queries import OP12_SQL

    con = duckdb.connect()
    for t in ("sale_lines", "vendors", "items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rows = lambda q: con.execute(q).fetchall()
    lines = rows("SELECT sale_id, line_no, item_id, vendor_id, quantity, amount, flag, shipped_at FROM sale_lines")
    want = brute_feed(lines, rows("SELECT vendor_id, nation_id FROM vendors"), rows("SELECT item_id, price FROM items"))
    got = rows(f"SELECT nation_id, arrival_day, item_id, change, old_rank, new_rank, revenue, batch FROM ({OP12_SQL})")
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) > 1000


def test_minhash_query_is_its_sql(spark, sf):
    import duckdb

    from grafwerk.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({queries.OP11_SQL}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in queries.op11_minhash(spark, sf).orderBy("doc_id").collect()] == want


# --- 4: the fit against plain boosting --------------------------------------------------
def plain_boosting(rows, labels, trees, depth, least, ridge, rate, bins):
    """Boosting with loops over rows: every node tries every cut of every feature."""
    n = len(rows)
    base = math.log(sum(labels) / (n - sum(labels)))
    cuts = [sorted({float(np.quantile([r[f] for r in rows], q, method="lower")) for q in np.linspace(0, 1, bins + 1)[1:-1]}) for f in range(len(rows[0]))]
    score = [base] * n

    def grow(members, level, grad, hess):
        g, h = sum(grad[i] for i in members), sum(hess[i] for i in members)
        best, choice = 1e-6, None
        if level < depth and len(members) >= 2 * least:
            for f, some in enumerate(cuts):
                for c in some:
                    left = [i for i in members if rows[i][f] <= c]
                    if least <= len(left) <= len(members) - least:
                        gl, hl = sum(grad[i] for i in left), sum(hess[i] for i in left)
                        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                        if gain > best + 1e-12:
                            best, choice = gain, (f, c)
        if choice is None:
            for i in members:
                score[i] += rate * g / (h + ridge)
            return
        f, c = choice
        grow([i for i in members if rows[i][f] <= c], level + 1, grad, hess)
        grow([i for i in members if rows[i][f] > c], level + 1, grad, hess)

    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grow(list(range(n)), 0, [y - q for y, q in zip(labels, p)], [q * (1 - q) for q in p])
    return [1 / (1 + math.exp(-s)) for s in score]


def test_fitted_trees_are_plain_boosting(monkeypatch):
    from grafwerk.llm import quality

    for name, value in {"TREES": 6, "DEPTH": 3, "LEAST": 5, "BINS": 8}.items():
        monkeypatch.setattr(quality, name, value)
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(150, 4)).round(2)
    labels = ((rows[:, 0] > 0.2) ^ (rows[:, 1] * rows[:, 2] > 0.5) | (rng.random(150) < 0.1)).astype(float)
    want = plain_boosting(rows.tolist(), labels.tolist(), 6, 3, 5, quality.RIDGE, quality.RATE, 8)
    assert np.allclose(quality.fit_trees(rows, labels).score(rows), want, atol=1e-9)


# --- stages of the pipeline -------------------------------------------------------------
def test_line_stage_and_packing_are_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from grafwerk.llm.queries import vocabulary_path

    rng = random.Random(12)
    shared = [f"  A line that {k} documents share  " for k in range(6)]
    rows = [(i, "\n".join(rng.choice([*shared, f"own line {rng.randrange(10**6)}", "short", ""]) for _ in range(rng.randrange(1, 9))), "en", "s", 0) for i in range(60)]
    rows += [(60, None, "en", "s", None), (61, "word " * 3000, "en", "s", 0), (3, rows[3][1], "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    first = {}
    key = lambda line: line.strip(" \t\n\x0b\f\r").lower()
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            first.setdefault(key(line), set()).add(i)
    gone = lambda i, line: len(key(line)) >= 10 and len(first[key(line)]) > 1 and i > min(first[key(line)])
    want = sorted((i, "\n".join(x for x in (t or "").split("\n") if not gone(i, x))) for i, t, *_ in rows)
    kept = corpus_pipeline.drop_lines(spark, docs, str(tmp_path)).checkpoint()
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == want
    token = Tokenizer.from_file(vocabulary_path())
    places, pieces = {}, {}
    for r in corpus_pipeline.pack(spark, kept.where("doc_id <> 3"), str(tmp_path)).collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for some in places.values():
        assert sum(n for _, n in some) <= 1024 and [o for o, _ in sorted(some)] == [sum(n for _, n in sorted(some)[:k]) for k in range(len(some))]
    for i, t in want:
        if i != 3:
            ids = [*token.encode(t, add_special_tokens=False).ids, 2]
            for _, start, length, crc in sorted(pieces.pop(i)):
                assert zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc
                ids[start : start + length] = [-1] * length
            assert set(ids) == {-1}
    assert not pieces

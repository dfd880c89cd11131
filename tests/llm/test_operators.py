"""Every operator against brute force, with nulls, empty and very long texts, ties,
repeated rows, empty tables and extra columns of clashing names."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grafwerk.llm import ann, bpe, chat, linededup, packing, quality, simhash, substring, topk, warc
from grafwerk.llm.queries import vocabulary_path
from grafwerk.llm.shared import prepare

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
PATH = vocabulary_path()
RNG = random.Random(5)
WORDS = ["Thé", "of", "QUICK", "brown", "fox,", "über", "lazy", "dog.", "123", "x" * 40]
PASSAGE = " ".join(f"common{i}" for i in range(60))


def texts():
    out = [" ".join(RNG.choices(WORDS, k=RNG.randint(0, 60))) for _ in range(40)]
    out += [None, "", "   ", "\n\n", "one", "z" * 30_000, "ab cd " * 20_000, "<|endoftext|> a <|endof"]
    out += [f"{a}\n {PASSAGE} \n{a}" for a in out[:8]] + [out[3], out[3], out[4]] + ["\tA shared line here\nuniq one", "a SHARED line HERE \x0b\nother", "Éa shared line here\nx"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    rows = [(i, t, "en", i) for i, t in enumerate(texts())]
    rows += [rows[0], rows[7], (9, "another text under the same id " + PASSAGE, "en", 0), (None, PASSAGE, "en", 0), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fingerprint int").repartition(5).checkpoint()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_lines int")


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# --- 1 --------------------------------------------------------------------------------
def test_bpe_is_the_library(docs, rows, empty):
    tok = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = bpe.encode_documents(docs, PATH)
    assert collected(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    back = bpe.decode_documents(got, PATH)
    assert collected(back, "doc_id", "text") == sorted(((i, t or "") for i, t in rows), key=repr)
    assert bpe.encode_documents(empty, PATH).count() == 0


def test_bpe_streams_with_bounded_state():
    tok, vocab = Tokenizer.from_file(PATH), bpe.vocabulary(PATH)
    for text in ("the" * 9000, "=-" * 9000, "x" * 20_000 + " y", "a" + " " * 9000 + "b", "a" + " " * 9000, " " * 5000 + "<|endoftext|>" + "\n" * 5000 + "b\t", "\u3000\n " * 3000 + "\n.", "don't 'll <|endoftext|>é" * 50):
        cutter, held, out = bpe.Cutter(vocab), 0, []
        for at in range(0, len(text), 97):
            out += cutter.push(text[at : at + 97], at + 97 >= len(text))
            held = max(held, len(cutter._text) + len(cutter._open))
        assert held <= 2 * cutter.window + 97
        enc = bpe.Encoder(vocab)
        assert np.frombuffer(b"".join(enc._resolve([out])), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_lookahead_is_enough_on_random_merge_lists():
    rng = random.Random(3)
    for _ in range(60):
        tokens, merges = [b"a", b"b", b"c"], []
        for _ in range(rng.randint(2, 14)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens and len(a + b) < 9:
                merges.append((a, b))
                tokens.append(a + b)
        look = bpe.sufficient_lookahead(merges)

        def cuts(s, merges=merges):
            parts = [bytes([c]) for c in s]
            for a, b in merges:
                i, out = 0, []
                while i < len(parts):
                    if parts[i] == a and parts[i + 1 : i + 2] == [b]:
                        out.append(a + b)
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            return set(np.cumsum([len(p) for p in parts]).tolist())

        for _ in range(20):
            s = bytes(rng.choices(b"abc", k=60))
            m = rng.randint(1, 59)
            assert {x for x in cuts(s[:m]) if x <= m - look} == {x for x in cuts(s) if x <= m - look}
    with pytest.raises(ValueError):
        bpe.sufficient_lookahead([(b"ab", b"c"), (b"a", b"b")])


# --- 2, 9 -----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((12, 16))
    x = [(int(i), [float(v) for v in (centers[i % 12] + 0.6 * rng.standard_normal(16)).astype(np.float32)], 0) for i in range(700)]
    x += [(1000 + i, x[50][1], 0) for i in range(300)] + [x[60], (2000, None, 0), (2050, [0.0] * 16, 0), (2100, [float("nan")] + [1.0] * 15, 0), (2150, [None] + [1.0] * 15, 0), (2151, [float("inf")] * 16, 0), (2200, [], 0), (2250, [1.0, 2.0], 0), (None, [1.0] * 16, 0)]
    return x, spark.createDataFrame(x, "vec_id long, embedding array<float>, rank int").repartition(4).checkpoint()


def good(v):
    return v and all(c is not None and np.isfinite(c) for c in v)


def test_ann_recall_and_ties(points, spark):
    x, df = points
    rows = [(i, np.array(v, float)) for i, v, _ in x if i is not None and good(v) and any(v) and len(v) == 16]
    got = {}
    for r in ann.search(df, F.col("id") % 50 == 0, part_rows=128).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for i, q in {i: q for i, q in rows if i % 50 == 0}.items():
        s = sorted(((-float((q * c).sum() / np.sqrt((q * q).sum()) / np.sqrt((c * c).sum())), j) for j, c in rows if j != i))[:5]
        mine = sorted(got.pop(i))
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        hits += len({j for _, j in s} & {j for _, j, _ in mine})
        total += 5
        for _, j, v in mine:
            c = next(c for k, c in rows if k == j)
            assert abs(v - float((q * c).sum() / np.sqrt((q * q).sum() * (c * c).sum()))) < 1e-12
        if i >= 1000:  # a copy's nearest are the smallest ids among the copies
            assert [j for _, j, _ in mine] == [j for _, j in s]
    assert not got and hits >= 0.9 * total
    assert ann.search(df.limit(0), F.col("id") % 50 == 0).count() == 0
    assert collected(ann.search(df.where("vec_id in (0, 3)"), F.col("id") % 50 == 0), "query_id", "rank", "vec_id") == [(0, 1, 3)]


def test_balanced_parts_have_equal_sizes():
    x = np.random.default_rng(0).standard_normal((256, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert set(np.bincount(ann.balanced_parts(ann.neighbour_graph(x), 8)).tolist()) == {32}


def test_topk_is_exact(points):
    x, df = points
    rows = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v, _ in x if i is not None and good(v)]
    want = []
    for i, q in {i: q for i, q in rows if i % 50 == 0}.items():
        s = sorted((-int((q * c).sum()), j) for j, c in rows if j != i and len(c) == len(q))[:5]
        want += [(i, k + 1, j, -v) for k, (v, j) in enumerate(s)]
    assert collected(topk.search(df, F.col("id") % 50 == 0), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.search(df.limit(0), F.col("id") % 50 == 0).count() == 0


# --- 3 --------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    odd = ["", None, "&lt; <turn> </turn>\n ### user: &amp;", r"\### Assistant: </turn> ok", "x" * 50_000, ": :&sp;", "\n"]
    rows = [(1, 0, "user", "a", 1), (1, 1, "assistant", "b", 1), (1, 1, "assistant", "b", 1), (2, 0, "assistant", "early", 1), (None, 0, "user", "n", 1), (3, None, None, None, 1), (4, 0, "sy: <s>\n", "t", 1)]
    rows += [(10 + i, k, r, t, 1) for i, t in enumerate(odd) for k, r in enumerate(("system", "user", "assistant"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert set(back) == {r[0] for r in rows}
    for c in back:
        own = sorted(((t if t is not None else -1, r or "", x or "") for i, t, r, x, _ in rows if i == c))
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(r, x) for _, r, x in own]
        assert back[c]["loss_texts"] == [x for _, r, x in own if r == "assistant"]
    assert back[10]["valid"] and not back[1]["valid"] and not back[2]["valid"] and not back[None]["valid"]
    assert chat.format_conversations(df.limit(0)).count() == 0


# --- 4 --------------------------------------------------------------------------------
def test_quality_learns_only_from_its_side(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.4
        rows.append((i, " ".join(rng.choice(WORDS) + ("%%%" if bad else "") for _ in range(rng.randint(3, 50))), 0))
        held = zlib.crc32(str(i).encode()) % 3 == 1
        labels.append((i, int(bad if held else not bad)))  # held-out labels lie
    rows += [(None, None, 0), (5000, "", 0), (5001, None, 0), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    known = spark.createDataFrame([*labels, labels[0], (None, 1), (5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, known).collect()}
    truth = {i: y if not got[i]["held_out"] else 1 - y for i, y in labels}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in labels)
    assert np.mean([got[i]["predicted"] == y for i, y in truth.items()]) > 0.97
    assert not got[None]["held_out"] and 0 <= got[5000]["score"] <= 1 and got[5000]["score"] == got[5001]["score"]
    none = quality.classify(docs, known.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and len(none) == len(rows)
    assert quality.classify(docs.limit(0), known).count() == 0
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_flat_trees_walk_as_nodes():
    rng = np.random.default_rng(0)
    x, y = rng.random((400, len(quality.FEATURES))), (rng.random(400) < 0.5).astype(float)
    trees = quality.fit_trees(x, y)

    def one(row):
        total = trees.base
        for n in trees.roots:
            while trees.left[n] != n:
                n = trees.left[n] if row[trees.feature[n]] <= trees.cut[n] else trees.right[n]
            total += trees.value[n]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x[:50]), [one(r) for r in x[:50]])


# --- 5 --------------------------------------------------------------------------------
def test_lines(docs, rows, empty):
    blanks = " \t\n\x0b\f\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(blanks))
    first, holders = {}, {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), i), i)
                holders.setdefault(key(line), set()).add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or first[key(x)] == i]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = linededup.dedup_lines(docs)
    assert collected(got, "doc_id", "n_lines", "n_dropped", "text") == sorted(want, key=repr)
    assert collected(linededup.dedup_lines(docs, min_docs=3), "doc_id", "n_lines")
    out = linededup.dedup_lines(empty)
    assert out.count() == 0 and out.dtypes[-2:] == [("n_lines", "bigint"), ("n_dropped", "bigint")]


# --- 6 --------------------------------------------------------------------------------
def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(ids, prints, budget=4):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                parent[find(i)] = find(j)
    names = {}
    for i, d in enumerate(ids):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return [names.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("cell, local", [(simhash.CELL, simhash.LOCAL), (3, 0)])
def test_simhash(docs, rows, empty, monkeypatch, cell, local):
    monkeypatch.setattr(simhash, "LOCAL", local)
    prints = [brute_fingerprint(t) for _, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, groups([i for i, _ in rows], prints))), key=repr)
    assert collected(simhash.near_duplicates(docs, cell=cell), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("local", [simhash.LOCAL, 0, 300])
def test_simhash_chains_and_hot_cells(spark, monkeypatch, local):
    monkeypatch.setattr(simhash, "LOCAL", local)
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(400)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    first = spark.createDataFrame([(s,) for s in signed], "fp long")
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(first, cell=50)).collect()}
    brute = groups(signed, prints)
    by_root, by_brute = {}, {}
    for s, b in zip(signed, brute):
        by_root.setdefault(root.get(s, s), set()).add(s)
        by_brute.setdefault(b, set()).add(s)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_brute.values()))


# --- 7 --------------------------------------------------------------------------------
def brute_windows(rows, n=13):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, split):
        for k in range(len(w) - n + 1):
            if i is not None:
                first[tuple(w[k : k + n])] = min(first.get(tuple(w[k : k + n]), i), i)
    out = []
    for (i, _), w in zip(rows, split):
        gone = {p for k in range(len(w) - n + 1) if i is not None and first[tuple(w[k : k + n])] < i for p in range(k, k + n)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


def test_substring(docs, rows, empty):
    got = substring.dedup_windows(docs)
    assert collected(got, "doc_id", "n_words", "n_removed", "text") == brute_windows(rows)
    assert substring.dedup_windows(empty).count() == 0


def test_substring_in_small_scopes(docs, rows, monkeypatch):
    for scope, part in ((50, 3), (1 << 22, 40)):
        monkeypatch.setattr(substring, "SCOPE", scope)
        got = substring.dedup_windows(docs.repartition(part))
        assert collected(got, "doc_id", "n_words", "n_removed", "text") == brute_windows(rows)


# --- 8 --------------------------------------------------------------------------------
def test_warc(spark, tmp_path):
    prepare(spark)
    rows = [(i, f"http://h/{i}", f"<p>{'x' * (i % 7)} page é {i % 11}</p>", 0) for i in range(60)]
    rows += [(60, None, None, 0), (61, "http://a\r\nb", "", 0), (62, "u", "long " * 50_000, 0), (62, "u", "long " * 50_000, 0), (63, "u", "long " * 50_000, 0), (None, "u", "a null id", 0), (64, "u", "a\r\n\r\nWARC/1.1\r\n", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3).checkpoint()
    got = warc.archive_round_trip(df, with_payload=True)
    want = []
    for i, _, h, _ in rows:
        p = (h or "").encode()
        last = max((j for j, _, g, _ in rows if (g or "") == (h or "") and j is not None), default=None)
        response = i == last or last is None
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if response else "revisit", None if response else last, p if response else None))
    have = [(r[0], r[1], r[2], r[3], r[4], bytes(r[5]) if r[5] is not None else None) for r in collected(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    folder = f"file://{tmp_path}/w"
    files = warc.write_archives(df, folder).collect()
    assert sum(r["records"] for r in files) == len(rows)
    head = open(files[0]["path"], "rb").read(8)
    assert int.from_bytes(head[:4], "little") == warc.SKIPPABLE


# --- 10 -------------------------------------------------------------------------------
def test_packing(docs, rows, empty):
    tok = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, len(ids)] if len(ids) <= 1024 else [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = packing.pack_documents(docs, PATH).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(w[3] for w in want) // 1024) + 3
    assert packing.pack_documents(empty, PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_everything_nearly_full(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.integers(1, 1025, 3000), np.full(500, 1024), rng.integers(340, 360, 800 * (seed % 2))])
    hist = dict(zip(*(v.tolist() for v in np.unique(x, return_counts=True))))
    used = {}
    runs = packing.plan_packing(hist)
    for many, lengths in runs:
        assert sum(lengths) <= 1024
        for n in lengths:
            used[n] = used.get(n, 0) + many
    assert used == hist
    assert sum(m for m, _ in runs) <= 1.01 * sum(m for m, _ in packing._best_fit([], dict(hist), 1024))


def test_substring_words_of_equal_polynomial_hash(spark):
    """Thue-Morse words of 2048 letters have one hash under every odd base modulo 2^64."""
    one, other = ("".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(2048)) for flip in (0, 1))
    rest = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{one} {rest}")], "doc_id long, text string")
    assert collected(substring.dedup_windows(docs), "doc_id", "n_removed") == [(1, 0), (2, 0), (3, 13)]


def test_substring_with_several_targets_a_partition(docs, rows, monkeypatch):
    monkeypatch.setattr(substring, "MOST_PARTS", 3)
    got = substring.dedup_windows(docs)
    assert collected(got, "doc_id", "n_words", "n_removed", "text") == brute_windows(rows)


@pytest.mark.parametrize("n", [1, 2])
def test_simhash_with_more_partitions_than_rows(spark, n):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000" if n == 1 else "8")
    try:
        got = simhash.near_duplicates(spark.createDataFrame([(i, f"text {i}") for i in range(n)], "doc_id long, text string"))
        assert collected(got, "doc_id", "component_id") == [(i, i) for i in range(n)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# --- edges ----------------------------------------------------------------------------
def test_topk_of_any_magnitude(spark):
    """Scores stay exact where sums pass 2^53 and 2^63, and where few rows are large."""
    rng = np.random.default_rng(4)
    x = [(i, (rng.standard_normal(6) * 10.0 ** rng.integers(-2, 5, 6)).tolist()) for i in range(60)]
    x += [(100 + i, (rng.standard_normal(6) * 1e8).tolist()) for i in range(9)] + [(150, [1e8] * 6), (151, [1e8, 3.0, 0.1, 1.0, 2.0, 0.004]), (200, [1e15, 1.0, 0.0, 0.0, 0.0, 1e300]), (250, [-1e15] * 6), (201, [0.0] * 6)]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    rows = [(i, [int(np.floor(256 * c)) if abs(c) < 1e15 else int(c) * 256 for c in v]) for i, v in x]
    want = []
    for i, q in rows:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in rows if j != i)[:5]
            want += [(i, k + 1, j, max(-(1 << 63), min((1 << 63) - 1, -v))) for k, (v, j) in enumerate(s)]
    assert collected(topk.search(df, F.col("id") % 50 == 0), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_topk_reads_segments_until_proof():
    """Rows near the query end the search early; all counts stay below a scan's."""
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((64, 32))
    x = topk.quantise(centers[np.arange(4096) % 64] + 0.2 * rng.standard_normal((4096, 32)))
    index = topk.ImpactIndex(np.arange(4096), x)
    for i in range(0, 4096, 128):
        want = np.lexsort([np.arange(4096), -(x @ x[i])])
        assert [j for _, j in index.search(i, x[i], 5)] == [j for j in want.tolist() if j != i][:5]
    searches = 32
    assert index.read < 0.6 * searches * x.size and index.rescored <= topk.RESCORE * searches * len(x)


def test_ann_with_real_routing(spark):
    """32 parts: recall of 0.9 though a small share of the rows is compared."""
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((200, 24))
    x = (centers[np.arange(8192) % 200] + 0.35 * rng.standard_normal((8192, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").checkpoint()
    got = {}
    for r in ann.search(df, F.col("id") % 50 == 0, part_rows=256).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u[::50] @ u.T
    near[np.arange(len(near)), np.arange(0, 8192, 50)] = -2
    hits = sum(len(got[50 * i] & set(np.argsort(-line)[:5].tolist())) for i, line in enumerate(near))
    assert hits >= 0.9 * 5 * len(near)
    found = ann.vectors(df)
    router = ann.fit(found, {24: 8192}, part_rows=256)[24]
    sizes = np.bincount([r["order"][0] for r in ann.route(found, {24: router}).select("order").collect()], minlength=router.parts)
    asked = ann.route(found.where("id % 50 = 0"), {24: router}, {24: sizes}, 5).select("order").collect()
    assert router.parts == 32 and np.mean([sizes[r["order"]].sum() for r in asked]) < 0.35 * 8192


def test_ann_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(ann, "MOST_PARTS", 4)
    rng = np.random.default_rng(7)
    centers = rng.standard_normal((50, 8))
    x = (centers[np.arange(3000) % 50] + 0.2 * rng.standard_normal((3000, 8))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").checkpoint()
    got = {}
    for r in ann.search(df, F.col("id") % 50 == 0, part_rows=190).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u[::50] @ u.T
    near[np.arange(len(near)), np.arange(0, 3000, 50)] = -2
    hits = sum(len(got[50 * i] & set(np.argsort(-line)[:5].tolist())) for i, line in enumerate(near))
    assert hits >= 0.9 * 5 * len(near)
    assert ann.fit(ann.vectors(df), {8: 3000}, part_rows=190)[8].parts == 16


def test_ann_of_all_lengths_and_magnitudes(spark):
    x = [(i, [1.0, float(i)]) for i in range(0, 300, 25)] + [(1000 + i, [1.0, 2.0, float(i)]) for i in range(0, 100, 50)]
    x += [(5000, [1e-200, 2e-200]), (5001, [1e200, 2e200]), (5050, [5e-324, 0.0]), (5051, [1.7e308, -1.7e308])]
    got = {}
    for r in ann.search(spark.createDataFrame(x, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i, _ in x if i % 50 == 0} and got[1000] == [(1, 1050, got[1000][0][2])]
    assert sorted(got[5000])[0][1:] == (5001, pytest.approx(1.0)) and all(np.isfinite(s) and abs(s) < 1.0001 for g in got.values() for _, _, s in g)
    assert got[0][0][2] == pytest.approx(1.0) and sorted(got[5050])[0][2] == pytest.approx(1.0)


def test_chat_is_linear_in_turns(spark):
    import time

    took = {}
    for n in (100, 10_000, 20_000):
        df = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('text é', id, repeat(' more', 9)) AS text").checkpoint()
        began = time.perf_counter()
        back = chat.read_back(chat.format_conversations(df)).collect()[0]
        took[n] = time.perf_counter() - began
        assert len(back["turns"]) == n and back["loss_texts"][-1] == back["turns"][-1]["text"] == f"text é{n - 1}" + " more" * 9
    assert took[20_000] < 2.5 * took[10_000] + 0.5


def test_chat_reads_spans_across_pieces(spark):
    text = "".join(chr(0x1F600 + i % 50) if i % 7 == 0 else "aé\n"[i % 3] for i in range(3 * chat.PIECE))
    spans = [(0, 5), (chat.PIECE - 3, 7), (10, 0), (chat.PIECE, chat.PIECE), (5, 2 * chat.PIECE + 9), (len(text) - 1, 1)]
    df = spark.createDataFrame([(text, spans)], "text string, spans array<struct<start:bigint,length:bigint>>")
    assert df.select(chat.slices(F.col("text"), F.col("spans")).alias("s")).first()["s"] == [text[a : a + n] for a, n in spans]


def test_hot_keys_are_spread(spark, monkeypatch):
    """Lines and payloads that many share give the same results dealt over many tasks."""
    from grafwerk.llm import shared

    monkeypatch.setattr(shared, "HEAVY", 3)
    rows = [(i, f"a line that all documents hold\nown line number {i}\n{'second common line' if i % 3 else ''}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in linededup.dedup_lines(df).collect()}
    assert got[0] == (0, rows[0][1]) and got[1] == (1, "own line number 1\nsecond common line") and got[3] == (1, "own line number 3\n")
    assert all(got[i] == (2, f"own line number {i}") for i in range(60) if i % 3 and i > 1)
    pages = spark.createDataFrame([(i, "u", "same" if i % 2 else f"page {i}") for i in range(40)], "page_id long, url string, html string")
    back = {r["page_id"]: r for r in warc.archive_round_trip(pages).collect()}
    assert all((back[i]["record_type"], back[i]["refers_to"]) == (("response", None) if i % 2 == 0 or i == 39 else ("revisit", 39)) for i in range(40))

"""Queries over whole tables, which have no SQL, against brute force on the smallest tables."""

import hashlib
import math
import re

import pytest

from grafwerk import catalog
from grafwerk.functions.text import STOP_WORDS
from grafwerk.operators import compose, lexical
from grafwerk.plans.store import build
from grafwerk.sources.views import Graph


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def answer(spark, sf):
    return lambda name: [tuple(r) for r in catalog.queries()[name](spark, sf).collect()]


def embedded(text):
    v = {}
    for w in set(re.findall(r"[^\W_]+", text.lower())):
        h = hashlib.sha256(w.encode()).digest()
        i = int.from_bytes(h[:4], "little") % 256
        v[i] = v.get(i, 0) + (1 if h[4] % 2 else -1) * (0.5 + int.from_bytes(h[5:9], "little") % 1000 / 1000)
    n = math.sqrt(sum(x * x for x in v.values()))
    return {i: x / n for i, x in v.items()} if n else {}


def test_hash_embed_all(texts, answer):
    want = {(d, i): x for d, t in texts.items() for i, x in embedded(t or "").items()}
    got = {(d, i): x for d, i, x in answer("v8_hash_embed")}
    assert got == pytest.approx(want, abs=2e-6) and len({d for d, _ in got}) > len(texts) / 2


def test_hash_search_all(texts, answer):
    q = embedded(texts[0])
    want = {d: sum(x * q[i] for i, x in e.items() if i in q) for d, t in texts.items() if set(e := embedded(t or "")) & set(q)}
    assert dict(answer("v15_hash_search")) == pytest.approx(want, abs=2e-6)


def test_embed_missing_all(texts, answer):
    assert answer("v14_embed_missing") == [(sum(d % 40 != 0 and bool(embedded(t or "")) for d, t in texts.items()),)]


def test_tokens_all(texts, answer):
    def tokens(t):
        return list(dict.fromkeys(w for w in re.split("[^a-z0-9]+", t.lower()) if len(w) >= 3 and w not in STOP_WORDS))

    assert max(map(len, texts.values())) >= 4000
    assert sorted(answer("l5_tokens")) == sorted((d, len(x), " ".join(x[:5])) for d, t in texts.items() for x in [tokens(t)])


@pytest.fixture(scope="module")
def graph(spark, sf):
    """The graph's tables as rows, and its callers and callees by symbol."""
    g = build(spark, sf)
    tables = {t: getattr(g, t).collect() for t in ("files", "symbols", "raw_edges", "edges")}
    calls = {(e["source_id"], e["target_id"]) for e in tables["edges"] if e["target_id"] is not None and e["kind"] in ("calls", "extends", "implements")}
    repo = {f["id"]: f["repo_id"] for f in tables["files"]}
    return tables | {"callers": turned(calls, True), "callees": turned(calls, False), "repo": {s["id"]: repo[s["file_id"]] for s in tables["symbols"]}}


def turned(pairs, back):
    out = {}
    for a, b in pairs:
        out.setdefault(b if back else a, set()).add(a if back else b)
    return out


def reached(step, seeds, depth):
    """node: least depth, seeds at 0."""
    met = dict.fromkeys(seeds, 0)
    front = set(seeds)
    for d in range(1, depth + 1):
        front = {n for f in front for n in step.get(f, ())} - met.keys()
        met |= dict.fromkeys(front, d)
    return met


def radius(graph, seeds, depth):
    out = []
    for s in seeds:
        if others := reached(graph["callers"], [s], depth).keys() - {s}:
            out.append((s, len(others), len({graph["repo"][n] for n in others})))
    return out


def test_neighbours_all(graph, answer):
    known = {(e["source_id"], e["target_id"]) for e in graph["edges"] if e["target_id"] is not None}
    want = [(i, o, side) for side, back in (("caller", True), ("callee", False)) for i, others in turned(known, back).items() for o in sorted(others)[:20]]
    assert sorted(answer("t14_neighbours")) == sorted(want) and max(i for i, _, _ in want) >= 20


def test_blast_radius_all(graph, answer):
    assert sorted(answer("t14_blast_radius")) == sorted(radius(graph, [s["id"] for s in graph["symbols"]], 2))


def test_source_spans_all(texts, answer):
    want, before = [], 0
    for d in sorted(texts):
        a, b = 1 + d % 3, 3 + d % 5
        if before < 100:
            want.append((d, f"d{d:020}", "\n".join(texts[d].split("\n")[a - 1 : b])))
        before += max(b - a + 1, 0)
    assert sorted(answer("t15_source_spans")) == want and any(d % 4 for d, _, _ in want)


def test_reranked_all(spark, sf, graph, answer):
    g = build(spark, sf)
    hits = lexical.bm25(lexical.postings(g.symbols, "id", ["name", "qualified_name"]), ["brand"], True).collect()
    name = {s["id"]: s["name"] for s in graph["symbols"]}
    pool = [r["id"] for r in sorted(hits, key=lambda r: (-r["score"], r["id"]))[:50]]
    assert len(pool) == 50 and max(pool) >= 40
    assert answer("v7_reranked") == sorted(((i, float(len(name[i]))) for i in pool), key=lambda r: (-r[1], r[0]))[:5]


def test_index_import_all(graph, answer):
    file = {s["id"]: s["file_id"] for s in graph["symbols"]}
    occ = [(file[e["source_id"]], e["target_name"], e["line"] * 9, e["line"] % 2 == 1) for e in graph["raw_edges"] if e["source_id"] in file]
    defs = {}
    for path, symbol, line, is_definition in occ:
        if is_definition:
            defs[symbol] = min(defs.get(symbol, (path, line)), (path, line))
    refs = [(line, defs[symbol][1]) for _, symbol, line, is_definition in occ if not is_definition and symbol in defs]
    assert answer("s14_index_import") == [(len(refs), sum(a for a, _ in refs), sum(b for _, b in refs))]


@pytest.fixture(scope="module")
def seeds(spark, sf, graph):
    name = catalog.name_of(build(spark, sf))
    return [s["id"] for s in graph["symbols"] if s["name"] == name]


def test_impact_all(graph, seeds, answer):
    met = {n: d - 1 for n, d in reached(graph["callers"], seeds, 10).items() if n not in seeds}
    want = sorted((d, n) for n, d in met.items())
    got = answer("t3_impact")
    assert sorted((d, n) for n, _, _, d, _, _ in got) == want[:500] and {r[-1] for r in got} == {len(want) > 500}
    counts = {d: n for d, n, _ in answer("t8_impact_histogram")}
    assert counts == {d: sum(x == d for x in met.values()) for d in set(met.values())}


def test_flow_all(graph, seeds, answer):
    met = reached(graph["callees"], seeds, 8)
    want = {n: (d, min((p for p in graph["callers"].get(n, ()) if met.get(p) == d - 1), default=None), len(graph["callees"].get(n, ()))) for n, d in met.items()}
    assert {n: (d, p, c) for n, _, d, p, c, _ in answer("t6_flow")} == want


def test_dataflow_all(graph, answer):
    kinds = ("function", "method", "class", "interface", "enum")
    def cut(s):
        met, at = reached(graph["callers"], [s], 5), 1
        while at < 5 and sum(0 < d <= at for d in met.values()) <= 500:
            at += 1
        others = {n for n, d in met.items() if 0 < d <= at}
        return (s, min(len(others), 500), len({graph["repo"][n] for n in others}), len(others) > 500)

    want = sorted(cut(s["id"]) for s in graph["symbols"] if s["kind"] in kinds and graph["callers"].get(s["id"], set()) - {s["id"]})
    assert sorted(answer("t11_dataflow_index")) == want and len(want) > 50
    first = min((s for s in graph["symbols"] if s["kind"] == "function"), key=lambda s: s["id"])["name"]
    named = {s["id"] for s in graph["symbols"] if s["name"] == first}
    assert sorted(answer("t12_dataflow_lookup")) == [w for w in want if w[0] in named]


def test_closure_all(graph, answer):
    name, ids = {s["id"]: s["name"] for s in graph["symbols"]}, {}
    for i, n in name.items():
        ids.setdefault(n, []).append(i)
    hop = {}
    for e in graph["edges"]:
        t = e["target_id"]
        hop.setdefault((e["source_id"], name.get(t, e["target_name"])), set()).add(t)
    least = lambda x: min((i for i in x if i is not None), default=None)
    hop = {k: least(v) for k, v in hop.items()}
    then = {(s, n): t if t is not None else ids[n][0] if len(ids.get(n, ())) == 1 else None for (s, n), t in hop.items()}
    out = {}
    for s, n in hop:
        out.setdefault(s, []).append(n)
    level, at, want = hop, then, []
    for d in range(1, 4):
        if d > 1:
            found = {}
            for s, x in {(s, at[s, n]) for s, n in level if at[s, n] is not None}:
                for n in out.get(x, ()):
                    found.setdefault((s, n), []).append((hop[x, n], then[x, n]))
            level, at = {k: least(t for t, _ in v) for k, v in found.items()}, {k: least(x for _, x in v) for k, v in found.items()}
        targets = [t for t in level.values() if t is not None]
        want.append((d, len(level), sum(s for s, _ in level), sum(targets) if targets else None, len({n for _, n in level})))
    assert sorted(answer("t10_closure")) == want


def test_workflow_steps_all(texts, answer):
    steps = {d: t.split(" ") for d, t in texts.items()}
    want = [(d, k, x) for d, s in steps.items() for k, x in enumerate(s[:20])] + [(d, 20, f"... {len(s) - 20} more") for d, s in steps.items() if len(s) > 20]
    assert sorted(answer("c11_workflow_steps")) == sorted(want)


def test_sync_steps_all(texts, answer):
    want = [(d, len(set(x[1:]) - set(x)), len(set(x) - set(x[1:]))) for d, t in texts.items() for x in [t.split("\n")]]
    assert sorted(answer("c13_sync_steps")) == sorted(want)


def test_explore_by_vectors(spark):
    """A symbol that holds one of two words is found by vectors only, with its callers."""
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    symbols = table([(1, 1, "alpha_beta", "alpha_beta", "function", ""), (2, 1, "gamma", "alpha", "function", ""), (3, 1, "caller", "zeta", "function", "")], "id long, file_id long, name string, qualified_name string, kind string, docstring string")
    edges = table([(1, 3, 2, "gamma", "calls", "exact")], "id long, source_id long, target_id long, target_name string, kind string, resolution string")
    g = Graph(table([(1, "r")], "id long, name string"), table([(1, 1, "a.py", "python")], "id long, repo_id long, path string, language string"), symbols, None, edges, edges)
    got = {(r["section"], r["id"]) for r in compose.explore(g, "alpha beta").collect()}
    assert {("seed", 1), ("seed", 2), ("neighbour", 3), ("reach", 2)} <= got

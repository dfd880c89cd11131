"""Files, parsers, symbol indexes, records and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from grafwerk.plans.samples import SAMPLES
from grafwerk.operators import knowledge, lexical, lookup, resolve, traverse, vector
from grafwerk.plans.store import write
from grafwerk.sources import files, parsers
from grafwerk.sources.views import Graph
from grafwerk.streaming import metrics

PYTHON = '''
import os
from pkg.util import helper

class Base:
    """Doc."""

class Child(Base):
    def run(self):
        self.stop()
        return helper(os.getcwd())

    def stop(self):
        pass

def _hidden():
    Child().run()
'''
SOURCES = {
    "java": ("package a;\nimport b.Other;\npublic class Foo extends Bar implements Baz {\n  public int run(int x) {\n    Other.call(x);\n    return help();\n  }\n}\n", {("class", "Foo"), ("method", "Foo.run")}, {("extends", "Bar"), ("implements", "Baz"), ("calls", "call"), ("calls", "help")}),
    "kotlin": ("import a.b\nclass Foo : Bar() {\n  val x = 1\n  fun run() {\n    go()\n  }\n}\nfun top() {\n}\n", {("class", "Foo"), ("method", "Foo.run"), ("function", "top")}, {("extends", "Bar"), ("calls", "go")}),
    "typescript": ("import { a } from './a'\nexport class Foo extends Bar {\n  run(x: number): void {\n    a(x)\n  }\n}\nexport const top = (x) => {\n  b(x)\n}\ninterface I {\n}\n", {("class", "Foo"), ("method", "Foo.run"), ("function", "top"), ("interface", "I")}, {("extends", "Bar"), ("calls", "a"), ("calls", "b")}),
    "go": ("package m\nimport \"fmt\"\ntype Foo struct {\n}\nfunc (f *Foo) Run() {\n  fmt.Println(1)\n}\nfunc Top() {\n}\n", {("class", "Foo"), ("method", "Run"), ("function", "Top")}, {("calls", "Println")}),
    "swift": ("import UIKit\nclass Foo: Bar {\n  func run() {\n    go()\n  }\n}\nprotocol P {\n}\n", {("class", "Foo"), ("method", "Foo.run"), ("interface", "P")}, {("implements", "Bar"), ("calls", "go")}),
    "dart": ("import 'a.dart';\nclass Foo extends Bar with Mix {\n  void run() {\n    go();\n  }\n}\nmixin Mix {\n}\n", {("class", "Foo"), ("method", "Foo.run"), ("mixin", "Mix")}, {("extends", "Bar"), ("implements", "Mix"), ("calls", "go")}),
    "objc": ("#import \"A.h\"\n@interface Foo : Bar\n- (void)run;\n@end\n@protocol P\n@end\n", {("class", "Foo"), ("method", "Foo.run"), ("protocol", "P")}, set()),
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_languages(language):
    text, symbols, edges = SOURCES[language]
    s, e, i = parsers.PARSERS[language](text)
    assert symbols <= {(x["kind"], x["qualified_name"]) for x in s}
    assert edges <= {(x["kind"], x["target_name"]) for x in e}
    assert len(i) == (0 if language == "none" else 1)


def test_scan_and_parse(spark, tmp_path):
    for path, text in {"a/x.py": PYTHON, "a/bad.py": "def (", "node_modules/y.py": "x", "b/h.h": "@interface A\n@end", "b/c.h": "int f();", "b/big.py": "#" * 2000, "c/skip_me.py": "x = 1", "n.txt": "no"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = files.scan(spark, f"file:{tmp_path}", ignored=["skip_*.py"], max_size=1500)
    got = {r["path"].split("/")[-1]: (r["language"], r["reason"]) for r in found.collect()}
    assert got == {"x.py": ("python", None), "bad.py": ("python", None), "y.py": ("python", "default_skip"), "h.h": ("objc", None), "c.h": ("c", None), "big.py": ("python", "size_cap"), "skip_me.py": ("python", "gitignored")}
    tables = parsers.parsed_tables(parsers.parse(found.where("reason is null")))
    symbols = {r["qualified_name"]: r for r in tables["symbols"].collect()}
    assert set(symbols) == {"Base", "Child", "Child.run", "Child.stop", "_hidden", "h.A"}
    assert symbols["Child.run"]["kind"] == "method" and symbols["Child.run"]["parent_scope"] == "Child" and symbols["Base"]["docstring"] == "Doc."
    edges = {(r["source_id"].split(":")[-2], r["kind"], r["target_name"], r["receiver_type"]) for r in tables["edges"].collect()}
    assert {("Child", "implements", "Base", None), ("Child.run", "calls", "stop", "Child"), ("Child.run", "calls", "helper", None), ("_hidden", "calls", "Child", None)} <= edges
    assert {r["imported_path"] for r in tables["imports"].collect()} == {"os", "pkg.util.helper"}
    assert sorted(r["path"].split("/")[-1] for r in tables["errors"].collect()) == ["bad.py", "c.h"]


def test_scip(spark, tmp_path):
    occ = lambda s, line, roles, cols=(0, 5): {"symbol": s, "range": [line, *cols], "symbol_roles": roles}
    index = {"documents": [{"relative_path": "a.py", "language": "python", "symbols": [], "occurrences": [occ("p `m`/f().", 0, 1), occ("p `m`/g().", 4, 1), occ("p `m`/f().", 6, 8)]}, {"relative_path": "b.py", "language": "python", "symbols": [], "occurrences": [occ("p `m`/g().", 2, 0), occ("p `x`/ext().", 3, 0)]}]}
    (tmp_path / "i.json").write_text(json.dumps(index))
    seen = files.scip_occurrences(spark, str(tmp_path / "i.json"))
    assert {(r["name"], r["line"], r["is_definition"]) for r in seen.where("path = 'a.py'").collect()} == {("f", 1, True), ("g", 5, True), ("f", 7, False)}
    got = {(r["path"], r["line"], r["owner"], r["target"], r["target_line"]) for r in files.scip_edges(seen).collect()}
    assert got == {("a.py", 7, "p `m`/g().", "p `m`/f().", 1), ("b.py", 3, None, "p `m`/g().", 5)}


def test_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\ntype: guide\ntitle: "T: x"\ntags:\n  - a\n---\n# Body\ntext')
    (tmp_path / "b.md").write_text("no front matter")
    got = {r["path"].split("/")[-1]: r for r in files.markdown(spark, str(tmp_path)).collect()}
    assert got["a.md"]["fields"]["type"] == "guide" and got["a.md"]["fields"]["title"] == "T: x" and got["a.md"]["body"].startswith("# Body")
    assert got["b.md"]["fields"] == {} and got["b.md"]["body"] == "no front matter"


def test_routes_and_calls(spark):
    text = 'fetch("https://a.io/x"); axios.get(`http://b.io/y`); http.Get("http://c.io"); other("http://d.io") @Get("u/:id") @Post()'
    r = spark.range(1).select(parsers.service_urls(F.lit(text)).alias("u"), parsers.nest_routes(F.lit(text)).alias("n"), parsers.join_route(F.lit("/api/"), F.lit("u/")).alias("j"), parsers.join_route(F.lit(""), F.lit("/")).alias("k")).first()
    assert r["u"] == ["https://a.io/x", "http://b.io/y", "http://c.io"]
    assert [tuple(x) for x in r["n"]] == [("GET", "u/:id"), ("POST", "")] and r["j"] == "/api/u" and r["k"] == "/"


def small_graph(spark):
    """Two files of one name each, one caller that imports, one symbol named twice."""
    repos = spark.createDataFrame([(1, "r1", "r1", "python"), (2, "r2", "r2", "python")], "id long, name string, path string, language string")
    fs = spark.createDataFrame([(1, 1, "a/m.py", "python"), (2, 1, "b/n.py", "python"), (3, 2, "c/o.py", "python")], "id long, repo_id long, path string, language string")
    sym = [(1, 1, "init", "pkg.A.init"), (2, 2, "init", "pkg.B.init"), (3, 1, "caller1", "pkg.A.caller1"), (4, 3, "caller2", "pkg.caller2"), (5, 3, "callee", "pkg.C.callee"), (6, 2, "only", "pkg.B.only"), (7, 2, "B", "pkg.B")]
    symbols = spark.createDataFrame([(*s, "method", 1, 9, "") for s in sym], "id long, file_id long, name string, qualified_name string, kind string, line_start int, line_end int, docstring string")
    imports = spark.createDataFrame([(3, "pkg.B")], "file_id long, imported_path string")
    edges = [("e1", 3, "init", "calls", None), ("e2", 4, "init", "calls", None), ("e3", 1, "callee", "calls", None), ("e4", 4, "nope", "calls", None), ("e5", 5, "init", "calls", "A"), ("e6", 2, "only", "calls", None)]
    raw = spark.createDataFrame([(i, s, t, k, 1, r) for i, s, t, k, r in edges], "id string, source_id long, target_name string, kind string, line int, receiver_type string")
    return Graph(repos, fs, symbols, imports, raw)


def test_tiers(spark):
    g = small_graph(spark)
    types = spark.createDataFrame([("A",), ("B",)], "type_name string")
    got = {r["id"]: (r["target_id"], r["resolution"], r["tier"]) for r in resolve.resolve_edges(g, types).collect()}
    assert got["e1"] == (1, "exact", "file") and got["e2"] == (2, "exact", "import") and got["e3"] == (5, "exact", "global")
    assert got["e4"] == (None, "unresolved", None) and got["e5"] == (1, "exact", "receiver") and got["e6"] == (6, "exact", "file")


def test_closure_and_flow(spark, tmp_path):
    g = small_graph(spark)
    g = g.with_edges(resolve.resolve_edges(g).checkpoint())
    got = {(r["source_id"], r["target_name"], r["distance"]) for r in traverse.closure(g, 3).collect()}
    assert (3, "init", 1) in got and (3, "callee", 2) in got and (4, "callee", 2) not in got and (4, "only", 2) in got
    assert {(r["name"], r["depth"]) for r in traverse.flow(g, "caller1").collect()} == {("caller1", 0), ("init", 1), ("callee", 2), ("init", 3), ("only", 4)}
    assert {(r["name"], r["depth"]) for r in traverse.impact(g, "callee").collect()} >= {("init", 0)}
    write(g, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g" / "edges")).count() == 6


def test_search_rules(spark):
    names = ["core_ui_v4", "core_ui_v4_theme", "Avatar", "UpdateProfileUseCase", "GetPhotosUseCase", "UseCase", "RegisterViewModel"]
    s = spark.createDataFrame([(i, n, f"pkg.{n}", "class", "") for i, n in enumerate(names)], "id long, name string, qualified_name string, kind string, docstring string")
    find = lambda p: {r["name"] for r in lexical.search_symbols(s, p).collect()}
    assert find("core_ui_v4") == {"core_ui_v4", "core_ui_v4_theme"}
    assert find("UseCase") == {"UseCase", "UpdateProfileUseCase", "GetPhotosUseCase"}
    assert find("Regis*") == {"RegisterViewModel"} and find("*UseCase") >= {"UseCase", "GetPhotosUseCase"}
    assert find("zzz") == set()


def test_critic_and_references(spark):
    body = "## A\n## B\n## C\n`src/a.py` `./go` `A.run()` `not ok!` `Gone.x` `b.kt`"
    docs = spark.createDataFrame([(1, body), (2, "")], "id long, body string")
    fs = spark.createDataFrame([("root/src/a.py",)], "path string")
    sy = spark.createDataFrame([("run", "pkg.A.run")], "name string, qualified_name string")
    got = {r["id"]: r for r in knowledge.critic(docs, fs, sy).collect()}
    assert (got[1]["errors"], got[1]["warnings"], got[1]["passed"]) == (1, 1, False) and got[2]["quality"] == 0
    assert lookup.symbols_exist(sy, spark.createDataFrame([("A.run()",)], "ref string")).first()["found"]


def test_rank_fusion_values(spark):
    ranks = lambda ids: spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank int")
    got = {r["id"]: r["score"] for r in vector.rrf([ranks("ab"), ranks("bc")]).collect()}
    assert abs(got["b"] - (1 / 62 + 1 / 61)) < 1e-8 and abs(got["a"] - 1 / 61) < 1e-8


def test_streams(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = metrics.events_stream(spark, str(tmp_path / "in"), batch.schema, 1)
    shape = lambda df: df.select(F.col("event_type").alias("tool"), F.lit("ok").alias("status"), F.col("ts").cast("timestamp").alias("at"))
    total = []
    out = metrics.windowed_metrics(shape(stream), late="365 days").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    out.awaitTermination()
    want = {(r["start"], r["tool"]): r["calls"] for r in metrics.windowed_metrics(shape(batch)).collect()}
    assert {(r["start"], r["tool"]): r["calls"] for r in spark.table("w").collect()} == want
    metrics.apply_changes(stream, lambda df, _: total.append(df.count()), str(tmp_path / "c2")).awaitTermination()
    assert sum(total) == batch.count() and len(total) == 3


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_parsed_samples(spark, language):
    """Symbols, edges and imports of a text in each language."""
    from grafwerk.sources import parsers

    text, wanted = SAMPLES[language]
    parsed = parsers.parse(spark.createDataFrame([("src/sample.x", language, text)], "path string, language string, text string")).first()
    word = lambda v: "" if v is None else str(v)
    row = lambda *parts: " ".join(parts).rstrip()
    found = [row("S", x["kind"], x["qualified_name"], word(x["line_start"]), word(x["line_end"]), " ".join(x["modifiers"])) for x in parsed["symbols"]]
    found += [row("E", word(x["owner"]), x["kind"], x["target_name"], word(x["line"]), word(x["receiver_type"])) for x in parsed["edges"]]
    found += [row("I", x["imported_path"], word(x["line"])) for x in parsed["imports"]]
    assert parsed["error"] is None and sorted(found) == sorted(wanted.strip().split("\n"))

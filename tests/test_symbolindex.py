"""Symbol indexes: wire format against another encoder and JSON, ranges, import by brute force."""

import hashlib
import json
import random
import re

import pytest

from grafwerk.sources import symbolindex


def random_index(seed, documents=12, names=9):
    """Documents of occurrences (symbol, roles, syntax, span from 0), not in order of lines."""
    rng = random.Random(seed)
    out = []
    for d in range(documents):
        occ = []
        for _ in range(rng.randrange(0, 25)):
            line, col = rng.randrange(0, 30), rng.randrange(0, 9)
            span = [line, col, col + 3] if rng.random() < 0.7 else [line, col, line + rng.randrange(1, 4), 2]
            symbol = rng.choice(["", "p . ünï/Ty#", *(f"p {rng.choice('ab')} m/f{k}()." for k in range(names))])
            occ.append((symbol, rng.choice([0, 1, 1, 2, 4, 5, 8, 64, 128, 66]), rng.choice([0, 14, 16, 17, 19, 21, 99]), span))
        out.append((f"src/f{d:02}.{rng.choice(['py', 'go', 'zz'])}", rng.choice(["", "python"]), occ))
    return out


def encoded(documents, around=lambda d, k: None, tail=b""):
    """The same index by plain encoding, with fields that nobody knows."""
    field, put = symbolindex._field, symbolindex._put
    body = field(1, field(2, "tool"))
    for d, (path, told, occ) in enumerate(documents):
        doc = field(4, told) + field(77, 5) + field(1, path)
        for k, (symbol, roles, syntax, span) in enumerate(occ):
            one = field(3, roles) + field(1, b"".join(map(put, span))) + field(2, symbol) + field(5, syntax) + field(90, b"new")
            if (line := around(d, k)) is not None:
                one += field(7, b"".join(map(put, (line, 0, 0))))
            doc += field(2, one)
        body += field(2, doc)
    return body + tail


def by_hand(documents, around=lambda d, k: None, repo="default"):
    """Symbols and edges by the rules, one occurrence after another."""
    short = lambda s: re.split("[#/]", s.rstrip(".").rstrip("#").split(" ")[-1])[-1] or "scip_symbol"
    place, real = {}, set()
    for path, _, occ in documents:
        for symbol, roles, _, span in occ:
            if symbol and roles & 5:
                if not roles & 1 and symbol in real:
                    continue
                real |= {symbol} if roles & 1 else set()
                place[symbol] = f"{repo}:{path}:{short(symbol)}:{span[0] + 1}:{span[1]}"
    symbols, edges = {}, {}
    for d, (path, _, occ) in enumerate(documents):
        seen = []
        for k, (symbol, roles, syntax, span) in enumerate(occ):
            line = span[0] + 1
            if symbol and roles & 5:
                if roles & 1:
                    symbols.setdefault(place[symbol], (f"{repo}:{path}", symbol, symbolindex.KINDS.get(syntax, "scip_symbol"), line, span[2] + 1 if len(span) == 4 else line))
                seen.append((line, symbol))
            elif symbol:
                first = line if around(d, k) is None else around(d, k) + 1
                owner = next((s for at, s in reversed(seen) if at <= first), None)
                if owner is not None:
                    kind = "import" if roles & 2 else "reference" if roles & 192 else "call"
                    eid = f"{repo}:{path}:{short(symbol)}:{line}:{span[1]}:{hashlib.sha1(symbol.encode()).hexdigest()[:8]}"
                    edges[eid] = (place[owner], place.get(symbol), short(symbol), kind)
    return symbols, edges


def answers(found):
    symbols = {r["id"]: (r["file_id"], r["qualified_name"], r["kind"], r["line_start"], r["line_end"]) for r in found.symbols.collect()}
    edges = {r["id"]: (r["source_id"], r["target_id"], r["target_name"], r["kind"]) for r in found.edges.collect()}
    assert found.edges.where("(target_id is null) <> (resolution = 'unresolved')").isEmpty()
    return symbols, edges


@pytest.mark.parametrize("seed", range(3))
def test_import_by_hand(spark, tmp_path, seed):
    documents = random_index(seed)
    around = lambda d, k: (d * 7 + k * 5) % 30 if (d + k) % 3 == 0 else None
    (tmp_path / "i.scip").write_bytes(encoded(documents, around))
    rows = symbolindex.read(spark, str(tmp_path / "i.scip"), split=300)
    assert rows.rdd.getNumPartitions() > 3
    symbols, edges = by_hand(documents, around)
    assert symbols and edges and answers(symbolindex.imported(rows)) == (symbols, edges)
    files = {r["path"]: r["language"] for r in symbolindex.imported(rows).files.collect()}
    assert files == {path: told or {"py": "python", "go": "go", "zz": "scip"}[path[-2:]] for path, told, _ in documents}


def test_wire_equals_json(spark, tmp_path):
    documents = random_index(9)
    (tmp_path / "i.scip").write_bytes(encoded(documents))
    told = [{"relative_path": p, "language": t, "occurrences": [{"symbol": s, "symbol_roles": r, "syntax_kind": x, "range": span} for s, r, x, span in occ]} for p, t, occ in documents]
    (tmp_path / "i.json").write_text(json.dumps({"documents": told}))
    wire, plain = symbolindex.read(spark, str(tmp_path / "i.scip")), symbolindex.read_json(spark, str(tmp_path / "i.json"))
    key = lambda df: sorted(map(str, df.drop("file", "at").collect()))
    assert key(wire) == key(plain) and wire.count() > len(documents)
    assert answers(symbolindex.imported(plain)) == by_hand(documents)


def test_ranges_of_any_split(spark, tmp_path):
    documents = random_index(4, 40)
    body = encoded(documents)
    (tmp_path / "i.scip").write_bytes(body)
    whole = sorted(map(str, symbolindex.read(spark, str(tmp_path / "i.scip")).collect()))
    for split in (1, 100, 1000, 5000):
        with open(tmp_path / "i.scip", "rb") as stream:
            parts = list(symbolindex.ranges(stream, "i", len(body), split))
        assert parts[0].start == 0 and parts[-1].end == len(body) and all(a.end == b.start for a, b in zip(parts, parts[1:]))
        assert sorted(map(str, symbolindex.read(spark, str(tmp_path / "i.scip"), split=split).collect())) == whole


def test_broken_and_empty(spark, tmp_path):
    body = encoded(random_index(1))
    (tmp_path / "cut.scip").write_bytes(body[:-3])
    for split in (100, 1 << 20):
        with pytest.raises(Exception, match="ends inside"):
            symbolindex.read(spark, str(tmp_path / "cut.scip"), split=split).collect()
    (tmp_path / "text.scip").write_bytes(b'{"documents": []}')
    with pytest.raises(Exception, match="no field of an index|unknown kind|ends inside"):
        symbolindex.read(spark, str(tmp_path / "text.scip")).collect()
    (tmp_path / "none.scip").write_bytes(b"")
    rows = symbolindex.read(spark, str(tmp_path / "none.scip"))
    found = symbolindex.imported(rows, symbolindex.read(spark, str(tmp_path / "none.scip"), "infos"))
    assert rows.isEmpty() and found.files.isEmpty() and found.symbols.isEmpty() and found.edges.isEmpty()


def test_typed_ranges_and_infos(spark, tmp_path):
    """Against messages of the public runtime, where it is installed."""
    pytest.importorskip("google.protobuf")
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    proto = descriptor_pb2.FileDescriptorProto(name="i.proto", package="i", syntax="proto3")
    shapes = {
        "Single": [("line", 1, 5, 1), ("start_character", 2, 5, 1), ("end_character", 3, 5, 1)],
        "Multi": [("start_line", 1, 5, 1), ("start_character", 2, 5, 1), ("end_line", 3, 5, 1), ("end_character", 4, 5, 1)],
        "Occ": [("range", 1, 5, 3), ("symbol", 2, 9, 1), ("symbol_roles", 3, 5, 1), ("single", 8, "Single", 1), ("multi", 9, "Multi", 1), ("around", 11, "Multi", 1)],
        "Info": [("symbol", 1, 9, 1), ("documentation", 3, 9, 3)],
        "Doc": [("relative_path", 1, 9, 1), ("occurrences", 2, "Occ", 3), ("symbols", 3, "Info", 3), ("language", 4, 9, 1)],
        "Index": [("documents", 2, "Doc", 3), ("external_symbols", 3, "Info", 3)],
    }
    for name, fields in shapes.items():
        message = proto.message_type.add(name=name)
        for field, number, kind, label in fields:
            if isinstance(kind, str):
                message.field.add(name=field, number=number, type=11, type_name=f".i.{kind}", label=label)
            else:
                message.field.add(name=field, number=number, type=kind, label=label)
    pool = descriptor_pool.DescriptorPool()
    pool.Add(proto)
    index = message_factory.GetMessageClass(pool.FindMessageTypeByName("i.Index"))()
    doc = index.documents.add(relative_path="a.kt")
    doc.occurrences.add(symbol="s a#", symbol_roles=1).single.line = 4
    doc.occurrences.add(symbol="s b#", symbol_roles=1, range=[9, 2, 12, 7])
    last = doc.occurrences.add(symbol="s x#", symbol_roles=8, range=[1, 1, 1])
    last.multi.start_line, last.multi.end_line, last.multi.end_character = 20, 22, 300
    last.around.start_line = 6
    doc.occurrences.add(symbol="s a#")
    doc.symbols.add(symbol="s a#", documentation=["One", "two"])
    doc.symbols.add(symbol="s b#")
    index.external_symbols.add(symbol="s b#", documentation=["elsewhere"])
    (tmp_path / "i.scip").write_bytes(index.SerializeToString())
    rows, infos = (symbolindex.read(spark, str(tmp_path / "i.scip"), kind) for kind in ("occurrences", "infos"))
    spans = {r["seq"]: (r["line"], r["col"], r["line_end"], r["col_end"], r["owner"]) for r in rows.where("seq >= 0").collect()}
    assert spans == {0: (5, 0, 5, 0, None), 1: (10, 2, 13, 7, None), 2: (21, 0, 23, 300, "s a#"), 3: (1, 0, 1, 0, None)}
    assert {(r["symbol"], r["documentation"], r["outside"]) for r in infos.collect()} == {("s a#", "One\n\ntwo", False), ("s b#", None, False), ("s b#", "elsewhere", True)}
    assert {r["name"]: r["docstring"] for r in symbolindex.imported(rows, infos).symbols.collect()} == {"a": "One\n\ntwo", "b": "elsewhere"}


def test_written_index(spark, tmp_path):
    """What is written is read again; a second write takes the place of the first."""
    rows = spark.createDataFrame(
        [("b.go", None, "s t#", 1, 16, 3, 1, 3, 4, None, "Told", 0), ("b.go", None, "s u#", 0, 0, 200, 1, 201, 4, 3, None, 1), ("a.go", "go", None, None, None, None, None, None, None, None, None, 0), (None, "go", "s v#", None, None, None, None, None, None, None, None, 0)],
        symbolindex.WRITTEN + ", seq int",
    )
    for _ in range(2):
        symbolindex.write(rows, str(tmp_path / "index"))
    seen = symbolindex.read(spark, str(tmp_path / "index"))
    got = [(r["path"], r["language"], r["symbol"], r["line"], r["line_end"], r["col_end"], r["owner"]) for r in seen.orderBy("path", "seq").collect()]
    assert got == [("", "go", None, None, None, None, None), ("", "go", "s v#", 1, 1, 0, None), ("a.go", "go", None, None, None, None, None), ("b.go", "", None, None, None, None, None), ("b.go", "", "s t#", 3, 3, 4, None), ("b.go", "", "s u#", 200, 201, 4, "s t#")]
    assert [r["documentation"] for r in symbolindex.read(spark, str(tmp_path / "index"), "infos").collect()] == ["Told"]
    with pytest.raises(Exception, match="nowhere"):
        symbolindex.read(spark, str(tmp_path / "nowhere")).collect()

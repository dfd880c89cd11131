"""Front matter of hand-written records, files and audits at their edges."""

from pyspark.sql import functions as F

from grafwerk.sources import files, records


def read(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(records.front_matter(F.col("t")).alias("r")).select("r.*").first()


def test_front_matter_forms(spark):
    r = read(spark, "---\ntype: Guide # a kind\ntitle: 'it''s: a \"b\"'\ntags:\n  - one\n  - \"two, #2\"\nwide: [a, 'b, c', \"d\\\"e\"]\nempty: []\ngenerated:\n  by: me\n  at: 2024-01-01T10:00:00Z\nnone:\ntype: Last\n---\n\n# Body\n---\nrest")
    assert r["fields"] == {"type": "Last", "title": "it's: a \"b\"", "none": ""}
    assert r["lists"] == {"tags": ["one", "two, #2"], "wide": ["a", "b, c", 'd"e'], "empty": []}
    assert r["maps"] == {"generated": {"by": "me", "at": "2024-01-01T10:00:00Z"}} and r["body"] == "# Body\n---\nrest"


def test_front_matter_edges(spark):
    for text, body in ((None, ""), ("", ""), ("---\ntype: x\nno end", "---\ntype: x\nno end"), ("\n\nplain", "plain"), ("---\n---\nempty head", "empty head")):
        r = read(spark, text)
        assert (r["fields"], r["lists"], r["maps"], r["body"]) == ({}, {}, {}, body)
    assert read(spark, "---\r\ntype: w\r\n---\r\nbody")["fields"] == {"type": "w"}


def test_older_timestamp(spark):
    rows = spark.createDataFrame([("---\ntype: a\ntimestamp: '2023-05-06'\n---\nx",), ("---\ntype: a\ntimestamp: old\ngenerated:\n  at: new\n---\nx",), ("x",)], "t string")
    assert [(r["type"], r["at"], r["tags"]) for r in rows.select(records.record(F.col("t")).alias("r")).select("r.*").collect()] == [("a", "2023-05-06", []), ("a", "new", []), ("", None, [])]


def test_written_records_come_back(spark, tmp_path):
    rows = [(k, title, tags, body) for k, (title, tags, body) in enumerate([('q"\\n\\', ["a", "", "x\ny"], "\n\n--- b"), ("#t", [], None), (None, None, "---\nz\n---\n"), ("é 'x'", ["[", ","], "\r\n")])]
    df = spark.createDataFrame(rows, "k int, title string, tags array<string>, body string")
    text = records.markdown_text(F.lit("N"), F.col("title"), F.col("tags"), F.lit("me"), F.lit("now"), F.col("body"))
    files_ = df.select(F.concat(F.lit("d/"), F.col("k").cast("string"), F.lit(".md")).alias("path"), text.alias("content"))
    for _ in range(2):
        assert records.put_files(files_, str(tmp_path)) == 4
    got = {r["path"]: (r["title"], r["tags"], r["body"], r["author"]) for r in records.read_records(spark, str(tmp_path)).collect()}
    assert got == {f"d/{k}.md": (title, tags or [], (body or "").lstrip("\n"), "me") for k, title, tags, body in rows}
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == [f"{k}.md" for k in range(4)]
    assert {r["fields"]["type"] for r in files.markdown(spark, str(tmp_path)).collect()} == {"N"}


def test_audit_replaces_by_repository(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "repo_id long, path string, reason string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "repo_id long")
    path = str(tmp_path / "audit")
    records.replace_audit(rows((1, "a", "x"), (2, "b", "x"), (9, "not asked", "x")), ids(1, 2, 3), path)
    held = lambda: sorted((r["repo_id"], r["path"]) for r in records.audit(spark, path).collect())
    assert held() == [(1, "a"), (2, "b")]
    records.replace_audit(rows((2, "c", "y")), ids(1, 2), path)
    assert held() == [(2, "c")]

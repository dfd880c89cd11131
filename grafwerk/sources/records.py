"""Markdown records: front matter as expressions, one file a record; audit rows by repository."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = r"\A---[ \t]*\r?\n(?s:(.*?))(?:(?<=\n)|\r?\n)---[ \t]*(?:\r?\n|\z)"
KEY = r"[A-Za-z_][\w.-]*"


def unquoted(value: Column) -> Column:
    """A scalar as it reads: without its quotes and escapes, a comment after it or blanks."""
    bare = F.trim(F.regexp_replace(value, r"(?:^|\s)#.*$", ""))
    value = F.regexp_replace(value, r"\A\s+|\s+\z", "")
    double = F.replace(F.replace(F.replace(F.replace(F.regexp_extract(value, r'(?s)\A"(.*)"', 1), F.lit("\\\\"), F.lit("\x00")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\x00"), F.lit("\\"))
    single = F.replace(F.regexp_extract(value, r"(?s)\A'(.*)'", 1), F.lit("''"), F.lit("'"))
    return F.when(value.startswith('"'), double).when(value.startswith("'"), single).otherwise(bare)


def front_matter(text: Column) -> Column:
    """fields (scalars), lists (in brackets or a line each, with a dash), maps (of one level)
    and body of a record's text.

    Of a key that repeats the last counts. A text without a closed head has no keys and is all
    body, a null one is empty; blank lines before the body are left out.
    """
    text = F.coalesce(text, F.lit(""))
    raw = F.split(F.regexp_replace(F.regexp_extract(text, HEAD, 1), "\r", ""), rf"\n(?={KEY}:)")
    parts = F.transform(F.filter(raw, lambda x: x.rlike(rf"\A{KEY}:")), lambda x: F.struct(F.regexp_extract(x, rf"\A({KEY}):", 1).alias("key"), F.regexp_replace(x, rf"\A{KEY}:[ \t]*", "").alias("rest")))
    last = F.filter(parts, lambda x, i: F.array_position(F.reverse(F.transform(parts, lambda p: p["key"])), x["key"]) == F.size(parts) - i)
    is_list = lambda x: x["rest"].rlike(r"\A(?:\[|(?:#[^\n]*)?\n\s*- )")
    is_map = lambda x: x["rest"].rlike(rf"\A(?:#[^\n]*)?\n\s+{KEY}:")
    quoted = r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\[\]"'\s][^,\[\]]*)"""
    inline = lambda x: F.filter(F.transform(F.regexp_extract_all(F.regexp_replace(x["rest"], r"\s*\n\s*", " "), F.lit(f"({quoted})"), F.lit(1)), unquoted), lambda v: v != "")
    dashed = lambda x: F.transform(F.regexp_extract_all(x["rest"], F.lit(r"(?m)^\s*- (.*)$"), F.lit(1)), unquoted)
    items = lambda x: F.when(x["rest"].startswith("["), inline(x)).otherwise(dashed(x))
    inner = lambda x: F.transform(F.filter(F.split(x["rest"], "\n"), lambda p: p.rlike(rf"^\s+{KEY}:")), lambda p: F.struct(F.regexp_extract(p, rf"^\s+({KEY}):", 1), unquoted(F.regexp_replace(p, rf"^\s+{KEY}:[ \t]*", ""))))
    scalars = F.transform(F.filter(last, lambda x: ~is_list(x) & ~is_map(x)), lambda x: F.struct(x["key"], unquoted(x["rest"])))
    lists = F.transform(F.filter(last, is_list), lambda x: F.struct(x["key"], items(x)))
    maps = F.transform(F.filter(last, is_map), lambda x: F.struct(x["key"], F.map_from_entries(inner(x))))
    body = F.regexp_replace(F.when(text.rlike(HEAD), F.regexp_replace(text, HEAD, "")).otherwise(text), r"\A\n+", "")
    return F.struct(F.map_from_entries(scalars).alias("fields"), F.map_from_entries(lists).alias("lists"), F.map_from_entries(maps).alias("maps"), body.alias("body"))


def record(text: Column) -> Column:
    """type, title, description, tags, status, author, at and body. ``at`` is that of
    ``generated``, else the older ``timestamp``; without a head the type is empty."""
    parts = front_matter(text)
    field = lambda name: F.try_element_at(parts["fields"], F.lit(name))
    made = F.try_element_at(parts["maps"], F.lit("generated"))
    return F.struct(
        F.coalesce(field("type"), F.lit("")).alias("type"), field("title").alias("title"), field("description").alias("description"),
        F.coalesce(F.try_element_at(parts["lists"], F.lit("tags")), F.array().cast("array<string>")).alias("tags"), field("status").alias("status"),
        F.try_element_at(made, F.lit("by")).alias("author"), F.coalesce(F.try_element_at(made, F.lit("at")), field("timestamp")).alias("at"), parts["body"].alias("body"),
    )


def _quoted(value: Column) -> Column:
    escaped = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def markdown_text(type: Column, title: Column, tags: Column, author: Column, at: Column, body: Column, status: Column | None = None) -> Column:
    """A record's text, in the order of keys that readers know; null keys are left out."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), _quoted(value))
    listed = F.when(F.size(tags) > 0, F.concat(F.lit("tags:\n"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("- "), _quoted(t))), "\n")))
    made = F.concat(F.lit("generated:\n  by: "), _quoted(author), F.lit("\n  at: "), _quoted(at))
    head = F.concat_ws("\n", line("type", type), line("title", title), listed, made, F.lit(None).cast("string") if status is None else line("status", status))
    return F.concat(F.lit("---\n"), head, F.lit("\n---\n\n"), F.coalesce(body, F.lit("")))


def put_files(rows: DataFrame, target: str) -> int:
    """Write rows (path, content) as a file each below a folder, by whatever task has them: a
    file is whole or not there, and a task that runs again replaces its files. Returns how many."""

    def put(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from uuid import uuid4

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(target if ":" in target else f"file://{target}")
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                where = f"{root}/{path}"
                part = f"{where}.{uuid4().hex}.part"
                store.create_dir(where.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(part, compression=None) as out:
                    out.write(content)
                store.move(part, where)
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """path below the folder and the record of each markdown file in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    name = F.element_at(F.split("path", F.lit(path.rstrip("/") + "/")), -1)
    return files.select(name.alias("path"), record(F.col("content").cast("string")).alias("r")).select("path", "r.*")


# --- audit rows -------------------------------------------------------------------------------
def replace_audit(rows: DataFrame, repos: DataFrame, path: str) -> None:
    """Put audit rows (repo_id and more) of these repositories in the place of their earlier
    ones; others stay, and a repository that has none now is emptied."""
    marks = repos.select("repo_id", F.lit(True).alias("_mark"))
    every = rows.join(repos, "repo_id", "left_semi").withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    every.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)


def audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit rows that are there now."""
    return spark.read.parquet(path).where("not _mark").drop("_mark")

"""Source files: scan, language, filters; markdown records; symbol index files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafwerk.sources.records import front_matter, put_files

#: Language of each ending, folders never read, the size limit.
LANGUAGES = {"kt": "kotlin", "java": "java", "swift": "swift", "py": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "dart": "dart", "go": "go", "m": "objc", "mm": "objc", "h": "header", "hpp": "cpp", "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp"}
SKIPPED = ("node_modules", "build", "dist", "target", "vendor", "__pycache__", ".git", ".gradle", ".venv", "venv", "Pods")
MAX_SIZE = 1_000_000


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))


def header_language(text: Column) -> Column:
    """Of a header file, from its first 4096 characters."""
    head = F.substring(text, 1, 4096)
    objc = head.rlike(r"@interface|@protocol|@end|#import")
    cpp = head.rlike(r"\bclass\s|\bnamespace\s|\btemplate\s*<|std::")
    return F.when(objc, "objc").when(cpp, "cpp").otherwise("c")


def glob_pattern(glob: str) -> str:
    """A path pattern as a regular expression over whole relative paths."""
    anchored = "/" in glob.strip("/")
    out, i, body = "", 0, glob.strip("/")
    while i < len(body):
        if body[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif body[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif body[i] in "*?":
            out, i = out + ("[^/]*" if body[i] == "*" else "[^/]"), i + 1
        else:
            out, i = out + ("\\" + body[i] if body[i] in ".+()[]{}^$|\\" else body[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + "(?:/|$)"


def skip_reason(path: Column, size: Column, ignored: list[str] = (), excluded: list[str] = (), included: list[str] = (), max_size: int = MAX_SIZE) -> Column:
    """Null for a file to read, else why not; ``included`` overrides all but the size."""
    hits = lambda globs: F.lit(False) if not globs else path.rlike("|".join(map(glob_pattern, globs)))
    folders = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED)))
    kept = hits(list(included))
    return F.when(size > max_size, "size_cap").when(kept, F.lit(None)).when(folders, "default_skip").when(hits(list(ignored)), "gitignored").when(hits(list(excluded)), "config_exclude")


def scan(spark: SparkSession, root: str, **filters) -> DataFrame:
    """path, size, mtime, language, text, reason of the source files under a folder. Files
    over the limit are listed without being read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/") + "/")
    rows = raw.select(F.element_at(F.split(F.col("path"), base), -1).alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), "content")
    rows = rows.withColumn("language", language(F.col("path"))).where("language is not null").withColumn("reason", skip_reason(F.col("path"), F.col("size"), **filters))
    rows = rows.withColumn("text", F.when(F.col("reason").isNull(), F.col("content").cast("string")))
    rows = rows.withColumn("language", F.when(F.col("language") == "header", header_language(F.col("text"))).otherwise(F.col("language")))
    return rows.withColumn("hash", F.sha2("content", 256)).drop("content")


def repo_marks(spark: SparkSession, root: str) -> DataFrame:
    """path of every .git in a folder or directly below one of its folders. File sources skip
    hidden names, so the driver asks the file system, one question a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path
    fs = where(root).getFileSystem(spark._jsc.hadoopConfiguration())
    rows = [(".git",)] if fs.exists(where(f"{root}/.git")) else []
    for child in fs.listStatus(where(root)) if fs.exists(where(root)) else []:
        name = child.getPath().getName()
        if child.isDirectory() and fs.exists(where(f"{root}/{name}/.git")):
            rows.append((f"{name}/.git",))
    return spark.createDataFrame(rows, "path string")


def discover_repos(paths: DataFrame) -> DataFrame:
    """repo: the folders directly below a root whose listing (path) has a .git in them, skipped
    folders aside; the root itself (``.``) where there is none but the root has one."""
    parts = F.split("path", "/")
    own = paths.where((F.size(parts) >= 2) & (parts[1] == ".git") & ~F.lower(parts[0]).isin(*SKIPPED)).select(parts[0].alias("repo")).distinct()
    root = paths.where(parts[0] == ".git").select(F.lit(".").alias("repo")).distinct()
    none = own.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(True).alias("alone"))
    return own.unionByName(root.crossJoin(F.broadcast(none)).select("repo"))


def located_path(path: Column, repo: Column, root: str, single: Column) -> Column:
    """Where a stored path lies: below the root and its repository, or below the root if that
    is the only repository; absolute paths stay."""
    below = F.when(single, F.concat(F.lit(root.rstrip("/") + "/"), path)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), repo, F.lit("/"), path))
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(below)


def repo_of(path: Column, root: str, single: str | None = None) -> Column:
    """The repository of an absolute path: the first folder below the root, or the single one;
    null outside the root."""
    base = root.rstrip("/") + "/"
    first = F.split(F.substr(path, F.lit(len(base) + 1)), "/")[0]
    return F.when(F.startswith(path, F.lit(base)) & (F.char_length(path) > len(base)), F.lit(single) if single else first)


#: Settings and their kinds; others are ignored.
SETTINGS = {"exclude": list, "include": list, "repo_namespaces": dict, "scip": dict}


def settings(spark: SparkSession, path: str) -> dict:
    """exclude, include, repo_namespaces and scip of a JSON file; what is missing, of the wrong
    kind or no text is left out, and a file that is not there or broken gives the defaults."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found: object = {}
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
        try:
            found = json.loads(text)
        except ValueError:
            found = {}
    found = found if isinstance(found, dict) else {}
    out: dict = {}
    for name, kind in SETTINGS.items():
        value = found.get(name)
        if kind is list:
            out[name] = [x for x in value if isinstance(x, str)] if isinstance(value, list) else []
        else:
            out[name] = {k: v for k, v in value.items() if isinstance(v, str)} if isinstance(value, dict) else {}
    return out


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """query, corpus, expect of an evaluation file: a list of entries with these keys, as JSON
    or as the block form of YAML (scalars and lists of scalars)."""
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    try:
        entries = json.loads(text)
    except ValueError:
        entries = _block_list(text)
    rows = [(str(e["query"]), e.get("corpus"), [str(x) for x in e.get("expect") or []]) for e in entries if isinstance(e, dict) and e.get("query")]
    return spark.createDataFrame(rows, "query string, corpus string, expect array<string>")


def _block_list(text: str) -> list[dict]:
    out: list[dict] = []
    key = None
    bare = lambda x: x.strip().strip("\"'")
    for line in text.split("\n"):
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        indent, item = len(body) - len(body.lstrip()), body.strip()
        if item.startswith("- ") and (indent == 0 or key is None):
            out.append({})
            item = item[2:].strip()
        elif item.startswith("- ") and out and key:
            out[-1].setdefault(key, []).append(bare(item[2:]))
            continue
        name, colon, value = item.partition(":")
        if colon and out:
            key = name.strip()
            value = value.strip()
            if value.startswith("["):
                out[-1][key] = [bare(x) for x in value.strip("[]").split(",") if x.strip()]
            elif value:
                out[-1][key] = bare(value)
    return out


def index_pages(records: DataFrame) -> DataFrame:
    """folder, text: a table of each folder's records (path, type, title, description)."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    base = F.element_at(F.split("path", "/"), -1)
    told = F.replace(F.left(F.coalesce("description", F.lit("")), F.lit(60)), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), base, F.lit(" | "), "type", F.lit(" | "), F.coalesce("title", base), F.lit(" | "), told, F.lit(" |"))
    rows = records.where(~base.isin("index.md", "log.md")).groupBy(folder.alias("folder")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    return rows.select("folder", F.concat(F.lit("# Index\n\n| File | Type | Title | Description |\n|------|------|-------|-------------|\n"), "lines", F.lit("\n")).alias("text"))


def log_lines(actions: DataFrame) -> DataFrame:
    """line of each action (at, action, id), oldest first."""
    stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return actions.orderBy("at", "id").select(F.concat(F.lit("- "), stamp, F.lit(" | "), "action", F.lit(" | "), "id").alias("line"))


def export_records(spark: SparkSession, source: str, target: str) -> int:
    """Copy a bundle's files, hidden ones aside, to another folder, a file by whatever task has it; returns how many."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    base = F.lit(source.rstrip("/") + "/")
    rows = files.select(F.element_at(F.split("path", base), -1).alias("path"), "content")
    return put_files(rows, target)


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, fields (scalars of the front matter), lists, maps, body of markdown records."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    return raw.select("path", front_matter(F.col("value")).alias("r")).select("path", "r.*")


def write_markdown(records: DataFrame, path: str) -> None:
    """One file a partition of records (type, title, body), each with its front matter."""
    text = F.concat(F.lit("---\ntype: "), "type", F.lit("\ntitle: "), "title", F.lit("\n---\n"), "body")
    records.select(text.alias("value")).write.mode("overwrite").text(path, lineSep="\n\x1e\n")


SCIP = "documents array<struct<relative_path:string,language:string,symbols:array<struct<symbol:string,kind:string,display_name:string>>,occurrences:array<struct<symbol:string,range:array<int>,symbol_roles:int>>>>"


def scip_occurrences(spark: SparkSession, path: str) -> DataFrame:
    """path, symbol, is_definition, line (from 1), short name of a JSON symbol index."""
    docs = spark.read.schema(SCIP).json(path, multiLine=True).select(F.explode("documents").alias("d"))
    rows = docs.select(F.col("d.relative_path").alias("path"), F.explode("d.occurrences").alias("o"))
    return rows.select("path", F.col("o.symbol").alias("symbol"), (F.col("o.symbol_roles").bitwiseAND(1) != 0).alias("is_definition"), (F.col("o.range")[0] + 1).alias("line"), scip_name(F.col("o.symbol")).alias("name"))


def scip_name(symbol: Column) -> Column:
    """The last descriptor's name without its marks."""
    return F.regexp_extract(F.regexp_replace(symbol, r"[.#/:!()\[\]`]+$", ""), r"([A-Za-z0-9_$]+)$", 1)


def scip_range(parts: Column) -> Column:
    """start and end line (from 1) of a range of three (one line) or four numbers."""
    return F.struct((parts[0] + 1).alias("line_start"), (F.when(F.size(parts) == 4, F.get(parts, F.lit(2))).otherwise(parts[0]) + 1).alias("line_end"))


def scip_edges(occurrences: DataFrame) -> DataFrame:
    """References to symbols that are defined in the index: path, line, owner (the nearest
    definition before the line), target, where the target is defined."""
    from pyspark.sql import Window

    defs = occurrences.where("is_definition").groupBy("symbol").agg(F.min(F.struct("path", "line")).alias("d")).select("symbol", F.col("d.path").alias("target_path"), F.col("d.line").alias("target_line"))
    order = Window.partitionBy("path").orderBy("line", F.col("is_definition").desc(), "symbol").rowsBetween(Window.unboundedPreceding, 0)
    owned = occurrences.withColumn("owner", F.last(F.when(F.col("is_definition"), F.col("symbol")), True).over(order)).where("not is_definition")
    return owned.join(defs, "symbol").select("path", "line", "owner", F.col("symbol").alias("target"), "target_path", "target_line")

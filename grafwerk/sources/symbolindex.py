"""Symbol indexes of compilers: a data source for their wire format, and their import.

An index is one file or a folder of part files, since messages that follow one another are
one message. Tasks read byte ranges of whole documents. A file up to the split size is one
range; of a longer one only the heads of its documents are read to find where they begin.
A task holds one document at a time. Unknown fields are passed over; a file that ends inside a
field is an error that names it; empty files have no rows.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import BufferedInputStream, fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from grafwerk.sources.files import language

NAME = "symbol_index"
#: A row for each occurrence in its document's order, after one without a symbol for the document.
OCCURRENCES = "file string, at long, seq int, path string, language string, symbol string, roles int, syntax int, line int, col int, line_end int, col_end int, owner string"
#: What an index tells of a symbol; ``outside`` marks symbols of other indexes.
INFOS = "file string, at long, seq int, symbol string, documentation string, outside boolean"
#: Rows to write, those of a document one after another in their order; ``enclosing`` may be null.
WRITTEN = "path string, language string, symbol string, roles int, syntax int, line int, col int, line_end int, col_end int, enclosing int, documentation string"
SPLIT, HEAD = 8 << 20, 4096

# Roles of an occurrence, and the kind of each kind of syntax.
DEFINITION, IMPORT, FORWARD, ACCESS = 1, 2, 4, 64 | 128
KINDS = {14: "module", 15: "function", 16: "function", 17: "macro", 18: "macro", 19: "class", 20: "class", 21: "property"}
UNNAMED = "scip_symbol"


# --- wire format ------------------------------------------------------------------------------
def _varint(buf, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = buf[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(buf: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """Number and value of each field; fixed-width ones are passed over."""
    at, end = 0, len(buf)
    while at < end:
        tag, at = _varint(buf, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(buf, at)
        elif kind == 2:
            n, at = _varint(buf, at)
            value, at = buf[at : at + n], at + n
        elif kind in (1, 5):
            value, at = None, at + (8 if kind == 1 else 4)
        else:
            raise ValueError(f"unknown kind of field {kind}")
        if at > end:
            raise IndexError("ends inside a field")
        if value is not None:
            yield tag >> 3, value


def _int(value: int) -> int:
    value &= 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


def _text(value: memoryview) -> str:
    return str(value, "utf-8", "replace")


def _ints(value: int | memoryview) -> list[int]:
    """A repeated number, packed or not."""
    if isinstance(value, int):
        return [_int(value)]
    out, at = [], 0
    while at < len(value):
        number, at = _varint(value, at)
        out.append(_int(number))
    return out


def _span(numbers: list[int]) -> tuple[int, int, int, int]:
    """Lines (from 1) and columns of a range of three (one line) or four numbers."""
    line, col = (numbers[0] if numbers else 0) + 1, numbers[1] if len(numbers) > 1 else 0
    if len(numbers) >= 4:
        return line, col, numbers[2] + 1, numbers[3]
    return line, col, line, numbers[2] if len(numbers) > 2 else col


def _typed(value: memoryview, size: int) -> list[int]:
    """A range message of ``size`` numbers as a list; fields left out are zero."""
    numbers = [0] * size
    for field, number in _fields(value):
        if 1 <= field <= size and isinstance(number, int):
            numbers[field - 1] = _int(number)
    return numbers


def _occurrence(buf: memoryview) -> tuple[str, int, int, tuple[int, int, int, int], int | None]:
    """symbol, roles, syntax, span, first line of the enclosing range; typed ranges come first."""
    symbol, roles, syntax = "", 0, 0
    plain: list[int] = []
    around: list[int] = []
    typed = typed_around = None
    for field, value in _fields(buf):
        if field == 1:
            plain += _ints(value)
        elif field == 2:
            symbol = _text(value)
        elif field == 3:
            roles = _int(value)
        elif field == 5:
            syntax = _int(value)
        elif field == 7:
            around += _ints(value)
        elif field in (8, 9):
            typed = _typed(value, field - 5)
        elif field in (10, 11):
            typed_around = _typed(value, field - 7)
    around = around if typed_around is None else typed_around
    return symbol, roles, syntax, _span(plain if typed is None else typed), around[0] + 1 if around else None


class Owners:
    """The definition that a line of a document belongs to: of those so far the last that does
    not begin after it. A later one that begins no later hides the earlier, so the rest are in
    the order of their lines and a question is a binary search."""

    def __init__(self) -> None:
        self.lines: list[int] = []
        self.symbols: list[str] = []

    def define(self, line: int, symbol: str) -> None:
        while self.lines and self.lines[-1] >= line:
            self.lines.pop()
            self.symbols.pop()
        self.lines.append(line)
        self.symbols.append(symbol)

    def of(self, line: int) -> str | None:
        k = bisect_right(self.lines, line)
        return self.symbols[k - 1] if k else None


def _rows(file: str, at: int, path: str, told: str, occurrences: Iterable[tuple]) -> Iterator[tuple]:
    """The rows of one document in the columns of OCCURRENCES."""
    yield file, at, -1, path, told, None, 0, 0, None, None, None, None, None
    owners = Owners()
    for seq, (symbol, roles, syntax, span, around) in enumerate(occurrences):
        owner = None
        if symbol and roles & (DEFINITION | FORWARD):
            owners.define(span[0], symbol)
        elif symbol:
            owner = owners.of(span[0] if around is None else around)
        yield file, at, seq, path, told, symbol, roles, syntax, *span, owner


def _document(file: str, at: int, buf: memoryview) -> Iterator[tuple]:
    path = told = ""
    for field, value in _fields(buf):
        if field == 1:
            path = _text(value)
        elif field == 4:
            told = _text(value)
    return _rows(file, at, path, told, (_occurrence(value) for field, value in _fields(buf) if field == 2))


def _info(file: str, at: int, seq: int, buf: memoryview, outside: bool) -> tuple:
    symbol, parts = "", []
    for field, value in _fields(buf):
        if field == 1:
            symbol = _text(value)
        elif field == 3:
            parts.append(_text(value))
    return file, at, seq, symbol, "\n\n".join(parts) if parts else None, outside


def _infos(file: str, at: int, field: int, buf: memoryview) -> Iterator[tuple]:
    if field == 3:
        yield _info(file, at, 0, buf, True)
    else:
        for seq, (inner, value) in enumerate(_fields(buf)):
            if inner == 3:
                yield _info(file, at, seq, value, False)


# --- data source ------------------------------------------------------------------------------
def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def _files(path: str) -> list[fs.FileInfo]:
    """The files of an index in order of their names; hidden ones and other folders aside."""
    store, root = _located(path)
    found = store.get_file_info(root)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.is_file:
        return [found]
    return sorted((f for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name[0] not in "_."), key=lambda f: f.path)


@dataclass
class Bytes(InputPartition):
    file: str
    start: int
    end: int


def ranges(stream, file: str, size: int, split: int) -> Iterator[Bytes]:
    """Ranges of whole top-level fields, each closed once it has ``split`` bytes."""
    start = at = base = 0
    head = b""
    while at < size:
        if at - start >= split:
            yield Bytes(file, start, at)
            start = at
        if at + 20 > base + len(head) and (base + len(head) < size or at >= base + len(head)):
            stream.seek(at)
            base, head = at, stream.read(HEAD)
        try:
            tag, after = _varint(head, at - base)
            n, after = _varint(head, after)
        except IndexError:
            raise ValueError(f"{file} ends inside the field at {at}") from None
        if tag & 7 not in (0, 2):
            raise ValueError(f"{file} has no field of an index at {at}")
        at = base + after + (n if tag & 7 == 2 else 0)
    if at > size:
        raise ValueError(f"{file} ends inside its last field")
    if start < size:
        yield Bytes(file, start, size)


class IndexReader(DataSourceReader):
    def __init__(self, path: str, split: int, infos: bool) -> None:
        self.path, self.split, self.infos = path, split, infos

    def partitions(self) -> list[Bytes]:
        store, _ = _located(self.path)
        found: list[Bytes] = []
        for f in _files(self.path):
            if f.size > self.split:
                with store.open_input_file(f.path) as stream:
                    found += ranges(stream, f.path, f.size, self.split)
            elif f.size:
                found.append(Bytes(f.path, 0, f.size))
        return found or [Bytes("", 0, 0)]

    def read(self, part: Bytes) -> Iterator[tuple]:
        if part.end == part.start:
            return
        store, _ = _located(self.path)
        name = part.file.rsplit("/", 1)[-1]
        with store.open_input_file(part.file) as raw:
            raw.seek(part.start)
            stream = BufferedInputStream(raw, 1 << 20)
            at = part.start
            while at < part.end:
                try:
                    tag, after = _number(stream, at)
                    n, after = _number(stream, after)
                    body = b"" if tag & 7 == 0 else stream.read(n)
                    if tag & 7 == 2 and len(body) < n:
                        raise IndexError
                    if tag & 7 == 2 and tag >> 3 == 2 and not self.infos:
                        yield from _document(name, at, memoryview(body))
                    elif tag & 7 == 2 and tag >> 3 in (2, 3) and self.infos:
                        yield from _infos(name, at, tag >> 3, memoryview(body))
                except IndexError:
                    raise ValueError(f"{part.file} ends inside the field at {at}") from None
                if tag & 7 not in (0, 2):
                    raise ValueError(f"{part.file} has no field of an index at {at}")
                at = after + len(body)


def _number(stream, at: int) -> tuple[int, int]:
    """The number at the stream's place, and the place after it."""
    value = shift = 0
    while True:
        byte = stream.read(1)[0]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _put(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _put(number << 3) + _put(value)
    body = value.encode() if isinstance(value, str) else value
    return _put(number << 3 | 2) + _put(len(body)) + body


def _written(row: Row) -> bytes:
    """An occurrence; its range in the older form of plain numbers that all readers know."""
    line, col, line_end = (row["line"] or 1) - 1, row["col"] or 0, (row["line_end"] or row["line"] or 1) - 1
    col_end = col if row["col_end"] is None else row["col_end"]
    span = [line, col, col_end] if line_end == line else [line, col, line_end, col_end]
    out = _field(1, b"".join(map(_put, span))) + _field(2, row["symbol"]) + _field(3, row["roles"] or 0) + _field(5, row["syntax"] or 0)
    return out if row["enclosing"] is None else out + _field(7, b"".join(map(_put, (row["enclosing"] - 1, 0, 0))))


@dataclass
class Part(WriterCommitMessage):
    name: str
    place: int


class IndexWriter(DataSourceWriter):
    """Each task writes a hidden part; once all have succeeded the parts are named by their
    place, after those that they replace were deleted. Parts of failed tasks stay hidden."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, rows: Iterator[Row]) -> Part:
        store, root = _located(self.path)
        store.create_dir(root, recursive=True)
        part = Part(f"_{uuid.uuid4().hex}", TaskContext.get().partitionId())
        with store.open_output_stream(f"{root}/{part.name}", compression=None) as out:
            path, told, body, infos = None, "", [], []
            for row in rows:
                if path is not None and row["path"] != path:
                    out.write(_field(2, _field(1, path) + b"".join(body) + b"".join(infos) + _field(4, told)))
                    body, infos = [], []
                path, told = row["path"], row["language"] or ""
                if row["symbol"]:
                    body.append(_field(2, _written(row)))
                    if row["documentation"]:
                        infos.append(_field(3, _field(1, row["symbol"]) + _field(3, row["documentation"])))
            if path is not None:
                out.write(_field(2, _field(1, path) + b"".join(body) + b"".join(infos) + _field(4, told)))
        return part

    def commit(self, messages: list[Part | None]) -> None:
        store, root = _located(self.path)
        store.create_dir(root, recursive=True)
        old = _files(self.path)
        for f in old if self.overwrite else ():
            store.delete_file(f.path)
        first = 0 if self.overwrite else len(old)
        for m in messages:
            if m is not None:
                store.move(f"{root}/{m.name}", f"{root}/part-{first + m.place:09d}.scip")

    def abort(self, messages: list[Part | None]) -> None:
        store, root = _located(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.name}")


class SymbolIndex(DataSource):
    """Options: path; rows (occurrences, or infos of symbols); split, the bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return INFOS if self.options.get("rows") == "infos" else OCCURRENCES

    def reader(self, schema) -> IndexReader:
        return IndexReader(self.options["path"], int(self.options.get("split", SPLIT)), self.options.get("rows") == "infos")

    def writer(self, schema, overwrite: bool) -> IndexWriter:
        return IndexWriter(self.options["path"], overwrite)


def read(spark: SparkSession, path: str, rows: str = "occurrences", split: int = SPLIT) -> DataFrame:
    """The rows of an index in its wire format: occurrences or infos."""
    spark.dataSource.register(SymbolIndex)
    return spark.read.format(NAME).option("rows", rows).option("split", split).load(path)


def write(rows: DataFrame, path: str) -> None:
    """Replace an index by rows of WRITTEN and ``seq``, their order in a document. Documents lie
    in order of their paths; null paths are empty."""
    rows.sparkSession.dataSource.register(SymbolIndex)
    names = [c.split(" ")[0] for c in WRITTEN.split(", ")]
    laid = rows.withColumn("path", F.coalesce("path", F.lit(""))).repartitionByRange("path").sortWithinPartitions("path", "seq")
    laid.select(*names).write.format(NAME).mode("overwrite").save(path)


JSON = "documents array<struct<relative_path:string,path:string,language:string,occurrences:array<struct<symbol:string,symbol_roles:int,syntax_kind:int,range:array<int>>>>>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The same rows of an index in the older JSON form, which is one value; there ``at`` is the
    document's place, enclosing ranges play no part and documents without a path are left out."""
    docs = spark.read.schema(JSON).json(path, multiLine=True).select(F.posexplode("documents").alias("at", "d"))
    docs = docs.select(F.col("at").cast("long"), F.coalesce(F.nullif(F.col("d.relative_path"), F.lit("")), F.col("d.path")).alias("path"), F.coalesce("d.language", F.lit("")).alias("language"), F.coalesce("d.occurrences", F.array()).alias("o"))

    def rows(batches):
        import pandas as pd

        columns = [c.split(" ")[0] for c in OCCURRENCES.split(", ")]
        for batch in batches:
            for d in batch.itertuples(index=False):
                found = ((o["symbol"] or "", int(o["symbol_roles"] or 0), int(o["syntax_kind"] or 0), _span([int(x) for x in o["range"]] if o["range"] is not None else []), None) for o in d.o)
                yield pd.DataFrame(list(_rows("", d.at, d.path, d.language, found)), columns=columns).astype({c: "Int32" for c in ("line", "col", "line_end", "col_end")})

    return docs.where("path <> ''").repartition("at").mapInPandas(rows, OCCURRENCES)


# --- import -----------------------------------------------------------------------------------
@dataclass(frozen=True)
class Imported:
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame


def short_name(symbol: Column) -> Column:
    """The last part of a descriptor, with the marks of its kind."""
    tail = F.regexp_extract(F.regexp_replace(F.regexp_replace(symbol, r"\.+\z", ""), r"#+\z", ""), r"[^ #/]*\z", 0)
    return F.coalesce(F.nullif(tail, F.lit("")), F.lit(UNNAMED))


def imported(rows: DataFrame, infos: DataFrame | None = None, repo: str = "default") -> Imported:
    """Files, symbols and exact edges of an index's occurrences.

    A symbol is where its last definition is, forward declarations counting only where there
    is no other; these have no symbol row. References without an owner give no edge; those to
    symbols that the index does not define stay unresolved. Of edges of one id the last stays,
    of files and symbols the first. One row a symbol is joined to the references, so a symbol
    that a third of them name is a skewed join of plain rows, which adaptive planning splits.
    """
    place = F.struct("file", "at", "seq")
    file_id = F.concat(F.lit(f"{repo}:"), "path")
    files = rows.groupBy("path").agg(F.min_by("language", place).alias("told"))
    files = files.select(file_id.alias("id"), "path", F.coalesce(F.nullif(F.col("told"), F.lit("")), language(F.col("path")), F.lit("scip")).alias("language"))
    # a document's own row has no symbol
    named = rows.where("symbol <> ''").withColumn("name", short_name(F.col("symbol")))
    is_real = F.col("roles").bitwiseAND(DEFINITION) != 0
    is_def = F.col("roles").bitwiseAND(DEFINITION | FORWARD) != 0
    own_id = F.concat_ws(":", file_id, "name", "line", "col")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("syntax")), F.lit(UNNAMED))
    first = F.struct(place.alias("place"), file_id.alias("file_id"), "name", kind.alias("kind"), F.col("line").alias("line_start"), "line_end", F.col("col").alias("column_start"), F.col("col_end").alias("column_end"))
    defs = named.where(is_def).groupBy("symbol").agg(F.max_by(own_id, F.struct(is_real, place)).alias("id"), F.min(F.when(is_real, first)).alias("first"))
    symbols = defs.where("first is not null").groupBy("id").agg(F.min_by(F.struct("symbol", "first"), F.struct("first.place", "symbol")).alias("s"))
    symbols = symbols.select("id", "s.first.file_id", "s.first.name", F.col("s.symbol").alias("qualified_name"), *(f"s.first.{c}" for c in ("kind", "line_start", "line_end", "column_start", "column_end")))
    if infos is not None:
        told = infos.where("symbol <> '' and documentation is not null").groupBy(F.col("symbol").alias("qualified_name")).agg(F.max_by("documentation", F.struct("outside", "file", "at", "seq")).alias("docstring"))
        symbols = symbols.join(told, "qualified_name", "left")
    use = F.when(F.col("roles").bitwiseAND(IMPORT) != 0, "import").when(F.col("roles").bitwiseAND(ACCESS) != 0, "reference").otherwise("call")
    edge_id = F.concat_ws(":", file_id, "name", "line", "col", F.left(F.sha1("symbol"), F.lit(8)))
    refs = named.where(~is_def & F.col("owner").isNotNull()).groupBy(edge_id.alias("id")).agg(F.max_by(F.struct("symbol", "owner", "name", use.alias("kind"), "line", "col"), place).alias("r")).select("id", "r.*")
    refs = refs.join(defs.select(F.col("symbol").alias("owner"), F.col("id").alias("source_id")), "owner").join(defs.select("symbol", F.col("id").alias("target_id")), "symbol", "left")
    edges = refs.select("id", "source_id", "target_id", F.col("name").alias("target_name"), "kind", "line", F.col("col").alias("column"), F.when(F.col("target_id").isNotNull(), "exact").otherwise("unresolved").alias("resolution"))
    return Imported(files, symbols, edges)

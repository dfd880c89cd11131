"""Source text to symbols, edges and imports, in the tasks, and what routes and service
calls add. Python is parsed with its own grammar, other languages by ``braces``."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafwerk.schemas import PARSED
from grafwerk.sources import braces

Parsed = tuple[list[dict], list[dict], list[dict]]


def _symbol(name: str, qualified: str, kind: str, start: int, end: int, doc: str | None = None, modifiers: list[str] = ()) -> dict:
    return {"name": name, "qualified_name": qualified, "kind": kind, "line_start": start, "line_end": end, "docstring": doc, "modifiers": list(modifiers)}


class _Python(ast.NodeVisitor):
    def __init__(self) -> None:
        self.symbols: list[dict] = []
        self.edges: list[dict] = []
        self.imports: list[dict] = []
        self.scope: list[tuple[str, str]] = []

    def _edge(self, target: str, kind: str, line: int, receiver: str | None = None) -> None:
        self.edges.append({"owner": ".".join(n for n, _ in self.scope) or None, "target_name": target, "kind": kind, "line": line, "receiver_type": receiver})

    def _define(self, node, kind: str) -> None:
        qualified = ".".join([*(n for n, _ in self.scope), node.name])
        self.symbols.append(_symbol(node.name, qualified, kind, node.lineno, node.end_lineno or node.lineno, ast.get_docstring(node), [ast.unparse(d) for d in node.decorator_list]))
        self.scope.append((node.name, kind))
        for base in getattr(node, "bases", []):
            self._edge(ast.unparse(base).split(".")[-1], "implements", node.lineno)
        self.generic_visit(node)
        self.scope.pop()

    def visit_ClassDef(self, node) -> None:
        self._define(node, "class")

    def visit_FunctionDef(self, node) -> None:
        self._define(node, "method" if self.scope and self.scope[-1][1] == "class" else "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node) -> None:
        called = node.func
        if isinstance(called, ast.Attribute):
            own = next((n for n, k in reversed(self.scope) if k == "class"), None) if isinstance(called.value, ast.Name) and called.value.id == "self" else None
            self._edge(called.attr, "calls", node.lineno, own)
        elif isinstance(called, ast.Name):
            self._edge(called.id, "calls", node.lineno)
        self.generic_visit(node)

    def visit_Import(self, node) -> None:
        self.imports += [{"imported_path": a.name, "line": node.lineno} for a in node.names]

    def visit_ImportFrom(self, node) -> None:
        self.imports += [{"imported_path": f"{node.module or ''}.{a.name}".strip("."), "line": node.lineno} for a in node.names]


def parse_python(text: str) -> Parsed:
    seen = _Python()
    seen.visit(ast.parse(text))
    return seen.symbols, seen.edges, seen.imports


def _with_braces(language: str) -> Callable[..., Parsed]:
    def parser(text: str, stem: str = "") -> Parsed:
        return braces.parse(text, language, stem)

    parser.takes_stem = True
    return parser


#: language -> parser; ``register`` adds to it.
PARSERS: dict[str, Callable[..., Parsed]] = {"python": parse_python} | {k: _with_braces(k) for k in (*braces.TYPES, "javascript")}


def register(language: str, parser: Callable[[str], Parsed]) -> None:
    PARSERS[language] = parser


def parse(files: DataFrame) -> DataFrame:
    """Files (path, language, text) parsed; a file that fails has its error and no content."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, language, text in zip(batch["path"], batch["language"], batch["text"]):
                symbols, edges, imports, error = [], [], [], None
                try:
                    if language not in PARSERS:
                        raise ValueError(f"no parser for {language}")
                    parser = PARSERS[language]
                    stem = {"stem": path.rsplit("/", 1)[-1].rsplit(".", 1)[0]} if getattr(parser, "takes_stem", False) else {}
                    symbols, edges, imports = parser(text or "", **stem)
                except (ValueError, SyntaxError, RecursionError) as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((path, language, symbols, edges, imports, error))
            yield pd.DataFrame(rows, columns=["path", "language", "symbols", "edges", "imports", "error"])

    return files.select("path", "language", "text").mapInPandas(run, PARSED)


def parsed_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """symbols, edges, imports and errors of parsed files, with ids made of path and place."""
    symbols = parsed.select("path", F.explode("symbols").alias("s")).select(F.concat_ws(":", "path", "s.qualified_name", "s.line_start").alias("id"), "path", "s.*", F.regexp_replace("s.qualified_name", r"\.?[^.]*$", "").alias("parent_scope"))
    first = symbols.groupBy("path", F.col("qualified_name").alias("owner")).agg(F.min_by("id", "line_start").alias("source_id"))
    edges = parsed.select("path", F.posexplode("edges").alias("nth", "e")).select("path", "nth", "e.*").join(first, ["path", "owner"])
    edges = edges.select(F.concat_ws(":", "path", "nth").alias("id"), "source_id", "target_name", "kind", "line", "receiver_type")
    imports = parsed.select("path", F.explode("imports").alias("i")).select("path", "i.imported_path", "i.line")
    return {"symbols": symbols, "edges": edges, "imports": imports, "errors": parsed.where("error is not null").select("path", "error")}


def route_path(url: Column) -> Column:
    """Path of a URL with numbers and ids as parameters, without query or closing slash."""
    path = F.regexp_replace(F.regexp_replace(url, r"^https?://[^/]+", ""), r"[?#].*$", "")
    parts = F.transform(F.split(path, "/"), lambda s: F.when(s.rlike(r"^[0-9]+$|^[0-9a-f]{8,}$"), ":id").otherwise(s))
    bare = F.regexp_replace(F.array_join(parts, "/"), r"/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def join_route(base: Column, path: Column) -> Column:
    joined = F.concat_ws("/", F.nullif(F.regexp_replace(base, "^/+|/+$", ""), F.lit("")), F.nullif(F.regexp_replace(path, "^/+|/+$", ""), F.lit("")))
    return F.concat(F.lit("/"), joined)


#: Calls of HTTP clients with a URL literal; no back references, so that any engine can run them.
CLIENT_CALL = r"""(?:\bfetch|\baxios\.(?:get|post|put|delete|patch|head|options|request)|\bhttp\.(?:Get|Post|Head|PostForm)|\.url|\.baseUrl)\s*\(\s*["'`](https?://[^"'`]+)["'`]"""


def service_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CLIENT_CALL), F.lit(1))


def literal_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(https?://[^\\s\"'<>`]+)"), F.lit(1))


def nest_routes(text: Column) -> Column:
    """(method, path) of controller annotations in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit("(@(?:Get|Post|Put|Delete|Patch)\\(['\"]?[^'\")]*['\"]?\\))"), F.lit(1)), lambda x: F.struct(F.upper(F.regexp_extract(x, "@(\\w+)", 1)).alias("method"), F.regexp_extract(x, "\\(['\"]?([^'\")]*)", 1).alias("path")))

"""Graphs and reports as text, assembled in the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joined(edges: DataFrame, line) -> DataFrame:
    return edges.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))


def mermaid(edges: DataFrame) -> DataFrame:
    """text of bounded edge lists (source, target, kind), such as ``symbol_subgraph`` gives."""
    line = F.format_string("  n%s -->|%s| n%s", F.col("source").cast("string"), "kind", F.col("target").cast("string"))
    return _joined(edges, line).select(F.concat(F.lit("graph LR\n"), "lines").alias("text"))


def dot(edges: DataFrame) -> DataFrame:
    line = F.format_string('  "%s" -> "%s" [label="%s"];', F.col("source").cast("string"), F.col("target").cast("string"), "kind")
    return _joined(edges, line).select(F.concat(F.lit("digraph {\n"), "lines", F.lit("\n}")).alias("text"))


def as_json(edges: DataFrame) -> DataFrame:
    return edges.agg(F.to_json(F.array_sort(F.collect_list(F.struct("source", "target", "kind")))).alias("text"))

"""The code graph as DataFrames, and its derivation from the star-schema tables.

``Graph`` holds the tables that all operators take. ``from_tables`` derives them with pure
projections, so filters and column pruning still reach the parquet scans.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    repos: DataFrame
    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    raw_edges: DataFrame
    edges: DataFrame | None = None

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_tables(spark: SparkSession, sf_dir: str) -> Graph:
    nation, supplier, part, line = (table(spark, sf_dir, t) for t in ("nation", "supplier", "part", "lineitem"))
    n_files, n_symbols = supplier.count(), part.count()
    repos = nation.selectExpr(
        "cast(n_nationkey as long) id", "n_name name", "concat('repos/', lower(n_name)) path",
        "case n_regionkey when 0 then 'kotlin' when 1 then 'python' when 2 then 'java' when 3 then 'go' else 'typescript' end language",
    )
    ext = "case language when 'kotlin' then '.kt' when 'python' then '.py' when 'java' then '.java' when 'go' then '.go' else '.ts' end"
    files = supplier.join(F.broadcast(repos.select(F.col("id").alias("repo_id"), "language")), F.col("s_nationkey") == F.col("repo_id")).selectExpr(
        "s_suppkey id", "repo_id", f"concat('src/', case s_suppkey % 3 when 0 then 'main' when 1 then 'test' else 'lib' end, '/mod', s_suppkey % 7, '/F', s_suppkey, {ext}) path", "language",
    )
    symbols = part.selectExpr(
        "p_partkey id", f"p_partkey % {n_files} file_id", "concat(replace(p_name, ' ', '_'), '_', p_partkey div 100) name",
        "concat(p_brand, '.', replace(p_name, ' ', '_'), '_', p_partkey div 100) qualified_name",
        "case p_partkey % 6 when 0 then 'class' when 1 then 'function' when 2 then 'method' when 3 then 'interface' when 4 then 'variable' else 'property' end kind",
        "cast(p_size as int) line_start", "cast(p_size + p_partkey % 40 as int) line_end", "p_type docstring", "p_brand brand",
    )
    distinct = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").distinct()
    names = symbols.select(F.col("id").alias("t_id"), F.col("name").alias("t_name"), F.col("brand").alias("t_brand"))
    raw = distinct.withColumn("t", F.expr(f"(l_partkey + l_orderkey % 50) % {n_symbols}")).join(names, F.col("t") == F.col("t_id"), "left")
    raw_edges = raw.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) id", "l_partkey source_id",
        "case when l_returnflag = 'R' and l_linenumber > 5 then concat('ext_', l_suppkey) else t_name end target_name",
        "case l_linenumber when 2 then 'extends' when 3 then 'implements' when 4 then 'http_call' when 5 then 'references' else 'calls' end kind",
        "cast(l_linenumber as int) line", "case when l_linenumber = 2 then t_brand end receiver_type",
    ).where("target_name is not null")
    imports = line.where("l_linenumber = 1").select(F.col("l_suppkey").alias("file_id"), "l_partkey").distinct().join(symbols.select("id", "qualified_name"), F.col("l_partkey") == F.col("id")).select("file_id", F.col("qualified_name").alias("imported_path")).distinct()
    return Graph(repos, files, symbols.drop("brand"), imports, raw_edges)


#: The same views for the checking engine.
SQL = """
repos AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, 'repos/' || lower(n_name) AS path,
  CASE n_regionkey WHEN 0 THEN 'kotlin' WHEN 1 THEN 'python' WHEN 2 THEN 'java' WHEN 3 THEN 'go' ELSE 'typescript' END AS language FROM nation),
files AS (SELECT s_suppkey AS id, r.id AS repo_id, 'src/' || CASE s_suppkey % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'test' ELSE 'lib' END || '/mod' || (s_suppkey % 7) || '/F' || s_suppkey ||
  CASE language WHEN 'kotlin' THEN '.kt' WHEN 'python' THEN '.py' WHEN 'java' THEN '.java' WHEN 'go' THEN '.go' ELSE '.ts' END AS path, language
  FROM supplier JOIN repos r ON r.id = s_nationkey),
symbols AS (SELECT p_partkey AS id, p_partkey % (SELECT count(*) FROM supplier) AS file_id, replace(p_name, ' ', '_') || '_' || (p_partkey // 100) AS name,
  p_brand || '.' || replace(p_name, ' ', '_') || '_' || (p_partkey // 100) AS qualified_name,
  CASE p_partkey % 6 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'interface' WHEN 4 THEN 'variable' ELSE 'property' END AS kind,
  p_size::INT AS line_start, (p_size + p_partkey % 40)::INT AS line_end, p_type AS docstring, p_brand AS brand FROM part),
raw_edges AS (SELECT * FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS id, l_partkey AS source_id,
  CASE WHEN l_returnflag = 'R' AND l_linenumber > 5 THEN 'ext_' || l_suppkey ELSE t.name END AS target_name,
  CASE l_linenumber WHEN 2 THEN 'extends' WHEN 3 THEN 'implements' WHEN 4 THEN 'http_call' WHEN 5 THEN 'references' ELSE 'calls' END AS kind,
  l_linenumber::INT AS line, CASE WHEN l_linenumber = 2 THEN t.brand END AS receiver_type
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem) l
  LEFT JOIN symbols t ON t.id = (l_partkey + l_orderkey % 50) % (SELECT count(*) FROM part)) WHERE target_name IS NOT NULL),
imports AS (SELECT DISTINCT l_suppkey AS file_id, s.qualified_name AS imported_path FROM lineitem JOIN symbols s ON s.id = l_partkey WHERE l_linenumber = 1)"""

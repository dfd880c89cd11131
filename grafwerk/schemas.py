"""Schemas of the graph's tables, the one place that names their columns."""

from pyspark.sql import types as T

REPOS = "id long, name string, path string, language string"
FILES = "id long, repo_id long, path string, language string, hash string, line_count int, size long, mtime double"
SYMBOLS = "id long, file_id long, name string, qualified_name string, kind string, line_start int, line_end int, docstring string, modifiers array<string>"
RAW_EDGES = "id string, source_id long, target_name string, kind string, line int, receiver_type string"
IMPORTS = "file_id long, imported_path string"
PARSED = "path string, language string, symbols array<struct<name:string,qualified_name:string,kind:string,line_start:int,line_end:int,docstring:string,modifiers:array<string>>>, edges array<struct<owner:string,target_name:string,kind:string,line:int,receiver_type:string>>, imports array<struct<imported_path:string,line:int>>, error string"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)

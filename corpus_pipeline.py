"""Corpus pipeline: quality, line, near-duplicate and substring filters, then packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all
but the last return the columns of ``documents``, others are left out. Counted as part of the
llm subpackage.

Defined results: every stage gives an empty table for an empty one; null texts are empty and
pass all filters but the classifier like any other; rows without id are never copies of
others and lose nothing; rows that repeat an id are rows of their own, but of those with one
text, and of different texts of an id that the near-copy stage finds no smaller copy of, one
stays (``drop_near_copies``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafwerk.llm import linededup, packing, quality, simhash, substring
from grafwerk.llm.queries import vocabulary_path
from grafwerk.llm.shared import prepare, remove, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars that of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts good, unchanged."""
    prepare(spark)
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller document has too go; documents that lose all lines stay, empty."""
    prepare(spark)
    return _documents(linededup.dedup_lines(docs.select(*COLUMNS)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest
    doc_id stays, once; rows without id stay. Of different
    texts of one id that nothing smaller is near, the one of the smallest node stays."""
    prepare(spark)
    groups = simhash.near_copies(docs)
    keep = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.min("node").alias("node"))
    rows = docs.select(*COLUMNS, simhash.node().alias("node"))
    named = rows.join(keep, ["doc_id", "node"], "left_semi").groupBy("doc_id", "node").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
    return named.select("doc_id", "row.*").select(*COLUMNS).unionByName(docs.select(*COLUMNS).where("doc_id IS NULL"))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a smaller document has too go; what stays is joined by blanks
    where words went, and untouched texts keep their white space."""
    prepare(spark)
    kept = substring.dedup_windows(docs.select(*COLUMNS, F.col("text").alias("whole")))
    return _documents(kept.withColumn("text", F.when(F.col("n_removed") == 0, F.col("whole")).otherwise(F.col("text"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document that is left."""
    prepare(spark)
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("near copies", drop_near_copies), ("passages", drop_passages), ("packing", pack)]

#: The classifier and the fingerprints cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next, then deleted
    but for the last, which is what comes back."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs

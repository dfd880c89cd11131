"""Line dedup with DataFrame functions only.

Each text is split into lines and each line reduced, inside one expression, to the 128-bit
hash of its key (stripped, A-Z lower-cased); only hashes, ids and positions are exploded
and shuffled. A key's smallest and largest document come from one aggregation that combines
before the shuffle, so a line that a third of all documents hold is a few rows by then.
Positions to drop come back by a join on the hash, in which the lines of a key that many
documents hold are dealt over many tasks, and each text is put together from the positions
that stay.

Defined results: a null or empty text is one empty line and stays one; a document that loses
all its lines has the empty text; rows that repeat a doc_id count as one document and each
gets its own result; rows with a null doc_id hold no key and lose nothing. Extra columns
pass through, those that clash with added names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafwerk.llm.shared import fresh, join_spread

#: Least code points of a key, and least documents that hold it.
MIN_CHARS, MIN_DOCS = 10, 2
#: The white space that is stripped, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(lines: Column) -> Column:
    """Keys of an array of lines. Nested transforms, so that a lambda evaluates its input
    once; ``lower`` has a fast path for ASCII, other lines must keep their other capitals."""
    bare = F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.transform(bare, lambda x: F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER)))


def _key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with ``text_col`` replaced by the lines that stay, n_lines and n_dropped.

    A key of at least min_chars that at least min_docs documents hold stays only in the
    smallest id that holds it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__text"), F.split(text, "\n", -1).alias("__lines")).where(F.col("__id").isNotNull())
    hashed = F.transform(line_keys(F.col("__lines")), lambda k: F.when(F.char_length(k) >= min_chars, _key_hash(k)))
    lines = keyed.select("__id", "__text", F.posexplode(hashed).alias("__pos", "h")).where(F.col("h").isNotNull()).select("__id", "__text", "__pos", "h.a", "h.b")
    if min_docs == 2:
        common = lines.groupBy("a", "b").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last"), F.count("*").alias("n")).where(F.col("__first") < F.col("__last"))
    else:
        common = lines.groupBy("a", "b", "__id").agg(F.count("*").alias("lines")).groupBy("a", "b").agg(F.min("__id").alias("__first"), F.count("*").alias("docs"), F.sum("lines").alias("n")).where(F.col("docs") >= min_docs)
    dropped = (
        join_spread(lines, common.select("a", "b", "__first", "n"), ["a", "b"], "__id")
        .where(F.col("__id") > F.col("__first"))
        .groupBy("__id", "__text")
        .agg(F.collect_set("__pos").alias("__dropped"))
    )
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped", text_col)]
    mark, sign, whole, gone = fresh(docs, "mark", "sign", "whole", "gone")
    dropped = dropped.select(F.col("__id").alias(mark), F.col("__text").alias(sign), F.col("__dropped").alias(gone))
    found = docs.select(*rest, F.col(id_col).alias(mark), text.alias(whole), F.xxhash64(text).alias(sign)).join(dropped, [mark, sign], "left")
    # the one-element array binds the split lines, so that they are made once for each text
    put = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)), lambda i: F.get(x, i)), "\n")
    kept = F.when(F.col(gone).isNull(), F.col(whole)).otherwise(F.transform(F.array(F.split(whole, "\n", -1)), put)[0])
    n_lines = F.char_length(whole) - F.char_length(F.replace(F.col(whole), F.lit("\n"), F.lit(""))) + 1
    n_dropped = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))
    return found.select(*rest, kept.alias(text_col), n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))

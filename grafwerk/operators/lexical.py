"""Lexical search: postings, BM25, occurrence and presence scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.functions.text import count_of, is_prefix_pattern, query_terms, tokens
from grafwerk.operators.lookup import like_literal

K1, B = 1.2, 0.75


def postings(rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """id, term, tf over the fields' ASCII words, lower-cased."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields])
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return rows.select(F.col(id_col).alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25(posted: DataFrame, terms: list[str], prefix: bool = False) -> DataFrame:
    """id, score of rows that hold every term (as a prefix of a word, if wanted).

    The terms are few and filter the postings before anything is shuffled by them; document
    lengths come from one aggregation by id.
    """
    length = posted.groupBy("id").agg(F.sum("tf").alias("len"))
    totals = length.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    match = [F.when(F.startswith("term", F.lit(t)) if prefix else F.col("term") == t, F.lit(i)) for i, t in enumerate(terms)]
    hits = posted.withColumn("q", F.explode(F.array_compact(F.array(*match)))).groupBy("id", "q").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy("q").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "q").join(length, "id").crossJoin(F.broadcast(totals))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return scored.groupBy("id").agg(F.sum(part).alias("score"), F.count("*").alias("k")).where(F.col("k") == len(terms)).select("id", F.round("score", 6).alias("score"))


def like_pattern(pattern: str, anchored_underscore: bool = False) -> str:
    """``*`` stands for any text; a pattern without one is looked for anywhere."""
    body = "%".join(like_literal(p) for p in pattern.replace("%", "*").split("*"))
    wild = "*" in pattern or "%" in pattern or (anchored_underscore and "_" in pattern)
    return body if wild else f"%{body}%"


def search_symbols(symbols: DataFrame, pattern: str, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Ranked word-prefix hits, then names that contain the pattern, unless it is a prefix."""
    rows = symbols if kind is None else symbols.where(F.col("kind") == kind)
    hits = rows.select("id").limit(0).withColumn("score", F.lit(0.0))
    if terms := [t.lower() for t in query_terms(pattern)]:
        hits = bm25(postings(rows, "id", ["name", "qualified_name", "docstring"]), terms, prefix=True)
    found = hits.select("id", "score", F.lit(0).alias("source"))
    if not is_prefix_pattern(pattern):
        wide = like_pattern(pattern)
        more = rows.where(F.col("name").ilike(wide) | F.col("qualified_name").ilike(wide)).select("id").join(hits, "id", "left_anti")
        found = found.unionByName(more.select("id", F.lit(0.0).alias("score"), F.lit(1).alias("source")))
    return found.orderBy("source", F.desc("score"), "id").limit(limit).join(rows.select("id", "name", "kind"), "id")


def occurrence_search(docs: DataFrame, query: str, fields: list[str], limit: int = 20) -> DataFrame:
    """id, score: how often the whole query lies in the fields, most first."""
    q = F.lit(query.lower())
    score = sum((count_of(F.lower(F.coalesce(F.col(c), F.lit(""))), q) for c in fields), F.lit(0))
    return docs.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def weighted_search(docs: DataFrame, query_tokens: list[str], weights: dict[str, int], limit: int = 20) -> DataFrame:
    """id, score: each token counts a field's weight once if the field contains it."""
    score = F.lit(0)
    for field, weight in weights.items():
        text = F.lower(F.coalesce(F.col(field), F.lit("")))
        for t in query_tokens:
            score = score + F.when(F.contains(text, F.lit(t)), weight).otherwise(0)
    return docs.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def by_words(docs: DataFrame, words: list[str], fields: list[str]) -> DataFrame:
    """id, score: how many of the words lie in the fields' text, for those with any."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in fields)))
    score = sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    return docs.select("id", score.alias("score")).where("score > 0")


def related(docs: DataFrame, hits: DataFrame, array_col: str, budget: int) -> DataFrame:
    """Documents that share values with a hit: max over hits of max(score / 2 + shared, 0.5)."""
    tagged = docs.select("id", F.explode(F.array_distinct(array_col)).alias("value"))
    ours = tagged.join(hits, "id").select(F.col("id").alias("parent"), "score", "value")
    pairs = tagged.join(ours, "value").where("id <> parent").groupBy("id", "parent", "score").agg(F.count("*").alias("shared"))
    found = pairs.groupBy("id").agg(F.max(F.greatest(F.col("score") * 0.5 + F.col("shared"), F.lit(0.5))).alias("score"))
    return found.join(hits.select("id"), "id", "left_anti").orderBy(F.desc("score"), "id").limit(budget)


def per_term_top(symbols: DataFrame, terms: list[str], total: int = 10) -> DataFrame:
    """For each term the first max(3, total // terms) symbols whose name contains it."""
    k = max(3, total // max(len(terms), 1))
    hit = F.array_compact(F.array(*[F.when(F.contains(F.lower("name"), F.lit(t)), F.lit(t)) for t in terms]))
    rows = symbols.select("id", "name", F.explode(hit).alias("term"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy("name", "id"))).where(F.col("rank") <= k)


def query_tokens(text: Column) -> Column:
    """Words as written that have an inner capital, then lower-case tokens not among them."""
    camel = F.array_distinct(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]*[a-z0-9][A-Z][A-Za-z0-9]*)"), F.lit(1)))
    lower = F.transform(camel, lambda c: F.lower(c))
    return F.concat(camel, F.filter(tokens(text), lambda t: ~F.array_contains(lower, t)))

"""Operators made of others: explore, hybrid search, questions, recall, generated guides."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grafwerk.functions.text import intent, tokens
from grafwerk.operators import lexical, lookup, memory, sequences, traverse, vector
from grafwerk.plans.store import checkpoint
from grafwerk.sources.views import Graph


class Retriever(ABC):
    """Anything that answers a question with (id, score)."""

    @abstractmethod
    def retrieve(self, question: str, k: int) -> DataFrame: ...


class Reranker(ABC):
    """Anything that scores (question, text) pairs again, batch by batch."""

    @abstractmethod
    def score(self, question: str, texts: pd.Series) -> pd.Series: ...


class WordRetriever(Retriever):
    def __init__(self, rows: DataFrame, fields: list[str]) -> None:
        self.posted = lexical.postings(rows, "id", fields)

    def retrieve(self, question: str, k: int) -> DataFrame:
        return lexical.bm25(self.posted, lexical.query_terms(question.lower()), True).orderBy(F.desc("score"), "id").limit(k)


class HashRetriever(Retriever):
    """Cosine of hashed words; the question goes through the same embedder."""

    def __init__(self, rows: DataFrame, text: Column, threshold: float = 0.1) -> None:
        self.embedded, self.threshold = vector.hash_embed(rows, "id", text), threshold

    def retrieve(self, question: str, k: int) -> DataFrame:
        spark = self.embedded.sparkSession
        asked = vector.hash_embed(spark.createDataFrame([(0, question)], "q long, t string"), "q", F.col("t"))
        near = vector.sparse_cosine(self.embedded, asked).withColumn("score", F.round("score", 9))
        return near.where(F.col("score") >= self.threshold).orderBy(F.desc("score"), "id").limit(k)


def rerank(hits: DataFrame, question: str, text: Column, reranker: Reranker, limit: int) -> DataFrame:
    """Score a pool of max(5 limit, 50) hits again, in Arrow batches."""

    @F.pandas_udf("double")
    def again(texts: pd.Series) -> pd.Series:
        return reranker.score(question, texts)

    pool = hits.orderBy(F.desc("score"), "id").limit(max(5 * limit, 50))
    return pool.withColumn("rerank", again(text)).orderBy(F.desc("rerank"), "id").limit(limit)


def hybrid(retrievers: list[Retriever], question: str, limit: int = 10, pool: int = 30) -> DataFrame:
    """Ranks of several retrievers fused; a row found by one only is kept too."""
    return vector.rrf([vector.ranked(r.retrieve(question, pool), pool) for r in retrievers]).orderBy(F.desc("score"), "id").limit(limit)


def neighbours(graph: Graph, seeds: DataFrame, each: int = 20) -> DataFrame:
    """id, other, side: for every seed (id) at most ``each`` distinct callers and callees."""
    known = graph.edges.where("target_id is not null").select("source_id", "target_id").distinct()
    into = known.join(seeds.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), F.lit("caller").alias("side"))
    out = known.join(seeds.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), F.lit("callee").alias("side"))
    order = Window.partitionBy("id", "side").orderBy("other")
    return into.unionByName(out).withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).drop("n")


def blast_radius(graph: Graph, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """id, reached, repos: what a change of each seed reaches, all seeds in one traversal."""
    met = traverse.reach(traverse._calls(graph, False, True), seeds.select(F.col("id").alias("node")), depth).where("depth > 0 and seed <> node")
    repo = lookup.located(graph).select(F.col("id").alias("node"), "repo_id")
    return met.join(repo, "node").groupBy(F.col("seed").alias("id")).agg(F.count("*").alias("reached"), F.count_distinct("repo_id").alias("repos"))


def explore(graph: Graph, pattern: str, seeds: int = 20) -> DataFrame:
    """section, id, name, n: seeds with rank, neighbours, reach, undecided calls to them.

    Seeds are the hits of the search by words, then those that only hashed vectors find.
    """
    words = lexical.search_symbols(graph.symbols, pattern, limit=seeds).select("id", "score", "source", "name")
    chunk = vector.chunk_text(F.col("kind"), F.col("name"), F.col("qualified_name"), F.col("docstring"), "B")
    near = HashRetriever(graph.symbols, chunk, 0.3).retrieve(pattern, seeds).join(words, "id", "left_anti")
    found = checkpoint(words.unionByName(near.join(graph.symbols.select("id", "name"), "id").select("id", "score", F.lit(2).alias("source"), "name")))
    ranked = found.withColumn("n", F.row_number().over(Window.orderBy("source", F.desc("score"), "id")).cast("long")).select(F.lit("seed").alias("section"), "id", "name", "n")
    name = graph.symbols.select("id", "name")
    near = neighbours(graph, found).groupBy("other").agg(F.count("*").alias("n")).withColumnRenamed("other", "id").join(name, "id").select(F.lit("neighbour").alias("section"), "id", "name", "n")
    reach = blast_radius(graph, found).join(name, "id").select(F.lit("reach").alias("section"), "id", "name", F.col("reached").alias("n"))
    open_ = graph.edges.where("resolution = 'ambiguous'").groupBy(F.col("target_name").alias("name")).agg(F.count("*").alias("n")).join(found.select("id", "name"), "name").select(F.lit("dispatch").alias("section"), "id", "name", "n")
    return ranked.unionByName(near).unionByName(reach).unionByName(open_)


def source_spans(symbols: DataFrame, texts: DataFrame, budget: int = 400, range_rows: int = sequences.RANGE_ROWS) -> DataFrame:
    """id, path, lines: the text of each symbol while the lines before it are under budget.

    The lines before a symbol are a running sum over ranges of symbols, so any number of them
    may be asked for.
    """
    span = F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0)).cast("long")
    rows = sequences.running(symbols, [], ["path", "line_start", "id"], span, "before", range_rows=range_rows)
    part = F.slice(F.split("text", "\n", -1), F.greatest("line_start", F.lit(1)), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0)))
    return rows.where(F.coalesce("before", F.lit(0)) < budget).join(texts, "path").select("id", "path", F.array_join(part, "\n").alias("lines"))


def signature(text: Column, line: Column) -> Column:
    return F.trim(F.get(F.split(text, "\n", -1), line - 1))


def question_words(spark: SparkSession, question: str) -> list[str]:
    """The tokens of a question, as those of a text."""
    return [r["w"] for r in spark.range(1).select(F.explode(tokens(F.lit(question))).alias("w")).collect()]


def recall(records: DataFrame, question: str, limit: int = 20, threshold: float = 0.1) -> DataFrame:
    """id, via, score: whole-phrase hits; with two or fewer, also all rows that hold any of its
    words, those with most first; with none at all, nearest by hashed words. Records need
    title, body, is_latest and may have a description."""
    held = records.where("is_latest")
    fields = [c for c in ("title", "description", "body") if c in records.columns]
    phrase = checkpoint(lexical.occurrence_search(held, question, fields, limit).select("id", F.lit("phrase").alias("via"), F.col("score").cast("double").alias("score")))
    found = phrase.count()
    if found > 2:  # the texts are not searched for words, nor hashed, where that isn't asked for
        return phrase
    words = question_words(records.sparkSession, question)
    wide = lexical.by_words(held, words, fields).join(phrase, "id", "left_anti").select("id", F.lit("words").alias("via"), F.col("score").cast("double").alias("score"))
    if found or not wide.isEmpty():
        return phrase.unionByName(wide)
    text = F.lower(F.concat_ws(" ", *fields))
    near = HashRetriever(held.withColumn("t", text), F.col("t"), threshold).retrieve(question, limit)
    return near.select("id", F.lit("near").alias("via"), "score")


#: What a word counts in each field of a knowledge document; least cosine.
KNOWLEDGE_WEIGHTS, KNOWLEDGE_NEAR = {"title": 10, "description": 5, "tags": 5, "body": 1}, 0.3


def knowledge_search(docs: DataFrame, question: str, limit: int = 20, archived: bool = False) -> DataFrame:
    """place, id, provenance, score of the documents (id, title, description, body, tags,
    modules, status) that answer a question: by weighted words, each followed by documents
    that share modules or tags with it, up to half the limit; by the phrase where it is one
    word; by hashed words where nothing else is found."""
    shown = docs if archived else docs.where(~F.col("status").eqNullSafe("archived"))
    words = question_words(docs.sparkSession, question)
    text = F.concat_ws("\n", "title", "description", "body")
    if len(words) < 2:
        found = lexical.occurrence_search(shown, words[0] if words else question, ["title", "description", "body"], limit * 2).withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).where(F.col("r") <= limit)
        lexically = found.select(F.col("r").alias("parent"), F.lit(0).alias("nth"), "id", F.lit("lexical_knowledge").alias("provenance"), F.lit(1.0).alias("score"))
    else:
        flat = shown.withColumn("tags", F.lower(F.array_join("tags", " ")))
        hits = checkpoint(lexical.weighted_search(flat, words, KNOWLEDGE_WEIGHTS, limit=1 << 30))
        best = checkpoint(hits.orderBy(F.desc("score"), "id").limit(limit).withColumn("parent", F.row_number().over(Window.orderBy(F.desc("score"), "id"))))
        # documents that share a module or tag with a hit and hold none of the words
        marks = shown.select("id", F.explode(F.concat(*(F.transform(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))), lambda x, c=c: F.struct(F.lit(c).alias("kind"), x.alias("value"))) for c in ("modules", "tags")))).alias("m"))
        ours = marks.join(best, "id").select("parent", F.col("score").alias("from"), "m")
        shared = marks.join(hits.select("id"), "id", "left_anti").join(F.broadcast(ours), "m").groupBy("id", "parent", "from").agg(F.count("*").alias("n"))
        first = shared.groupBy("id").agg(F.min(F.struct("parent", "from", "n")).alias("x")).select("id", "x.parent", F.greatest(F.col("x.from") * 0.5 + F.col("x.n"), F.lit(0.5)).alias("score"))
        few = first.orderBy("parent", F.desc("score"), "id").limit(limit // 2).withColumn("nth", F.row_number().over(Window.orderBy("parent", F.desc("score"), "id")))
        own = best.select("parent", F.lit(0).alias("nth"), "id", F.lit("lexical_knowledge").alias("provenance"), F.col("score").cast("double").alias("score"))
        lexically = own.unionByName(few.select("parent", "nth", "id", F.lit("lexical_knowledge_expanded").alias("provenance"), F.col("score").cast("double").alias("score")))
    found = checkpoint(lexically)
    if found.isEmpty():
        near = HashRetriever(shown.withColumn("t", text), F.col("t"), KNOWLEDGE_NEAR).retrieve(question, limit)
        found = near.select(F.lit(0).alias("parent"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("nth"), "id", F.lit("semantic_knowledge").alias("provenance"), F.round("score", 4).alias("score"))
    place = F.row_number().over(Window.orderBy("parent", "nth"))
    return found.withColumn("place", place).where(F.col("place") <= limit).select("place", "id", "provenance", "score")


def bridged(hits: DataFrame, docs: DataFrame, dependencies: DataFrame) -> DataFrame:
    """id, repo, side, other, n: for each repository that a found document (repos) affects what
    it depends on, and what depends on it (dependencies: source, target, n)."""
    affects = docs.join(hits.select("id"), "id", "left_semi").select("id", F.explode("repos").alias("repo")).distinct()
    out = affects.join(dependencies.select(F.col("source").alias("repo"), F.col("target").alias("other"), "n"), "repo").withColumn("side", F.lit("dependency"))
    into = affects.join(dependencies.select(F.col("target").alias("repo"), F.col("source").alias("other"), "n"), "repo").withColumn("side", F.lit("dependent"))
    return out.unionByName(into).select("id", "repo", "side", "other", "n")


def capture(new: DataFrame, held: DataFrame, refs: DataFrame, as_of: Column, replaced: DataFrame | None = None) -> DataFrame:
    """New records scored and tiered, with the record each supersedes, or as ``replaced`` has it."""
    old = (memory.superseded(new, held) if replaced is None else replaced).withColumnRenamed("new_id", "id")
    return memory.scored(new, refs, as_of).join(old, "id", "left").select("id", "score", "tier", "old_id", "via")


def moved(records: DataFrame, new_tier: str) -> DataFrame:
    """Records moved to a tier that is strictly lower than theirs; others stay."""
    order = {"raw": 0, "drafts": 1, "tribal": 2}
    rank = F.create_map(*[F.lit(x) for p in order.items() for x in p])
    return records.withColumn("tier", F.when(rank[F.col("tier")] > order[new_tier], new_tier).otherwise(F.col("tier")))


#: Layers that answer where the one that was asked has nothing: the graph, memory, knowledge.
FALLBACK = ("L1", "L4", "L5")


def routed(spark: SparkSession, question: str, layers: dict[str, Callable[[str], DataFrame]]) -> DataFrame:
    """layer, id, score: the classifier says which layer answers a question, or all of them;
    where the answer is empty, the layers of FALLBACK answer."""
    wanted = spark.range(1).select(intent(F.lit(question))["layer"].alias("layer")).first()["layer"]

    def ask(names: Iterable[str]) -> DataFrame | None:
        out = None
        for name in names:
            own = layers[name](question).select(F.lit(name).alias("layer"), "id", "score")
            out = own if out is None else out.unionByName(own)
        return out

    answer = ask([n for n in layers if wanted in (n, "ALL")])
    return ask([n for n in FALLBACK if n in layers]) if answer is None or answer.isEmpty() else answer


def parent_scope(qualified: Column) -> Column:
    return F.when(F.contains(qualified, F.lit(".")), F.regexp_replace(qualified, r"\.[^.]*$", ""))


def imports_summary(imports: DataFrame, most: int = 20) -> DataFrame:
    return imports.groupBy("file_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("imported_path")), 1, most), ", ").alias("summary"))


def without_repo(graph: Graph, repo_id: int) -> Graph:
    """The graph without one repository; edges into it lose their target and its label."""
    files = graph.files.where(F.col("repo_id") != repo_id)
    symbols = graph.symbols.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    keep = graph.edges.join(symbols.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    there = symbols.select(F.col("id").alias("target_id"), F.lit(True).alias("there"))
    edges = keep.join(there, "target_id", "left").withColumn("gone", F.col("target_id").isNotNull() & F.col("there").isNull())
    edges = edges.withColumn("resolution", F.when(F.col("gone"), "unresolved").otherwise(F.col("resolution"))).withColumn("target_id", F.when(~F.col("gone"), F.col("target_id"))).drop("gone", "there")
    raw = graph.raw_edges.join(symbols.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return Graph(graph.repos.where(F.col("id") != repo_id), files, symbols, graph.imports.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi"), raw, edges)


def merge_indexes(own: DataFrame, index: DataFrame) -> DataFrame:
    """Symbols of the parser joined with those of a symbol index (file_id, name, line_start,
    symbol): by place, else by name where it is the file's only one; COALESCE enriches."""
    exact = index.select("file_id", "name", "line_start", F.col("symbol").alias("by_place"))
    lone = index.groupBy("file_id", "name").agg(F.count("*").alias("n"), F.min("symbol").alias("by_name")).where("n = 1").drop("n")
    return own.join(exact, ["file_id", "name", "line_start"], "left").join(lone, ["file_id", "name"], "left").withColumn("symbol", F.coalesce("by_place", "by_name")).drop("by_place", "by_name")


def bulk_import(docs: DataFrame, most_chars: int = 10 << 20) -> DataFrame:
    """Documents under the size limit with a title from the file name."""
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[A-Za-z]+$", "")
    return docs.where(F.char_length("text") <= most_chars).select("path", F.initcap(F.regexp_replace(base, "[-_]+", " ")).alias("title"), "text")


def synthetic_corpus(spark, files: int, complexity: str = "medium", seed: int = 0xC0DE) -> DataFrame:
    """path, language, text: Python modules that call each other, the same for a seed."""
    per = {"low": 2, "medium": 5, "high": 12}[complexity]
    call = F.transform(F.sequence(F.lit(1), F.lit(per)), lambda k: F.format_string("def fn_%d_%d():\n    return fn_%d_%d()\n", F.col("id"), k, F.pmod(F.xxhash64("id", k, F.lit(seed)), F.lit(files)), k))
    return spark.range(files).select(F.format_string("src/mod%d/m%d.py", F.col("id") % 10, F.col("id")).alias("path"), F.lit("python").alias("language"), F.array_join(call, "\n").alias("text"))

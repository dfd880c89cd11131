"""A stored index of symbols: inverted lists of word beginnings, and lists of trigrams.

Every beginning of every word of a symbol is a key of its own, so a prefix query is a look-up
and a key's number of symbols is known without uniting words. Lists are cut into blocks of
ids; a block's row has the list and, in columns that can be read alone, how many symbols it
holds, the largest frequency and the shortest symbol. Rows lie in folders by a hash of the key
and are sorted by it, so a look-up reads one folder for each key and of its files only what
the key's statistics let through.

A ranked search reads the heads of the blocks first: they bound the best score a block can
hold. The most promising blocks are scored, and after them only blocks whose bound reaches the
last score that would be listed. Nothing is tokenised at question time.

A search for a substring intersects the lists of its trigrams block by block; only symbols in
all of them are tested. Patterns without three letters in a row read all names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafwerk.functions.text import is_prefix_pattern, query_terms
from grafwerk.operators import lexical
from grafwerk.operators.lexical import K1, B
from grafwerk.plans.store import checkpoint

#: Folders of keys; ids of a block; blocks scored first.
BUCKETS, BLOCK_IDS, FIRST_BLOCKS = 64, 1 << 16, 16
FIELDS = ("name", "qualified_name", "docstring")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _grams(text: Column) -> Column:
    n = F.char_length(text) - 2
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substr(text, k, F.lit(3))))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    # --- building ---------------------------------------------------------------------
    @staticmethod
    def write(symbols: DataFrame, path: str, buckets: int = BUCKETS, block_ids: int = BLOCK_IDS) -> SearchIndex:
        """Index of symbols (id, name, kind, qualified_name, docstring)."""
        posted = lexical.postings(symbols, "id", list(FIELDS))
        length = posted.groupBy("id").agg(F.sum("tf").alias("len"))
        length = checkpoint(length)
        begins = F.transform(F.sequence(F.lit(1), F.char_length("term")), lambda k: F.left("term", k))
        keyed = posted.select("id", "tf", F.explode(begins).alias("key")).groupBy("id", "key").agg(F.sum("tf").alias("tf")).join(length, "id")
        block = F.floor(F.col("id") / block_ids).cast("long").alias("block")
        rows = keyed.groupBy("key", block).agg(F.array_sort(F.collect_list(F.struct("id", "tf", "len"))).alias("list"), F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))
        SearchIndex._save(rows, f"{path}/words", buckets)
        text = F.concat_ws("\n", F.lower("name"), F.lower("qualified_name"))
        grams = symbols.select("id", F.explode(_grams(text)).alias("key")).where(~F.contains("key", F.lit("\n")))
        SearchIndex._save(grams.groupBy("key", block).agg(F.array_sort(F.collect_list("id")).alias("ids")), f"{path}/grams", buckets)
        symbols.select("id", "name", "kind", "qualified_name").repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/names")
        length.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")).write.mode("overwrite").parquet(f"{path}/totals")
        return SearchIndex(symbols.sparkSession, path, buckets)

    @staticmethod
    def _save(rows: DataFrame, path: str, buckets: int) -> None:
        placed = rows.withColumn("bucket", _bucket(F.col("key"), buckets))
        placed.repartition("bucket").sortWithinPartitions("bucket", "key", "block").write.mode("overwrite").partitionBy("bucket").parquet(path)

    # --- reading ----------------------------------------------------------------------
    def look_up(self, part: str, keys: list[str]) -> DataFrame:
        """The rows of these keys; only their folders are read."""
        rows = self.spark.read.parquet(f"{self.path}/{part}")
        at = self.spark.createDataFrame([(k,) for k in keys], "key string").select(_bucket(F.col("key"), self.buckets).alias("b")).distinct().collect()
        return rows.where(F.col("bucket").isin([r["b"] for r in at]) & F.col("key").isin(keys)).drop("bucket")

    def names(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/names")

    def ranked(self, terms: list[str], limit: int = 100, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
        """id, score of the best ``limit`` symbols that have a word with each of these beginnings."""
        terms = list(dict.fromkeys(terms))
        rows = self.look_up("words", terms)
        n, avg = self.spark.read.parquet(f"{self.path}/totals").first()
        df = {r["key"]: r["df"] for r in rows.groupBy("key").agg(F.sum("n").alias("df")).collect()}
        nothing = self.spark.createDataFrame([], "id long, score double")
        if len(df) < len(terms):
            return nothing
        idf = F.create_map(*(F.lit(x) for t in terms for x in (t, df[t])))[F.col("key")]
        idf = F.log((F.lit(n) - idf + 0.5) / (idf + 0.5) + 1)
        part = lambda tf, size: idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(avg)))
        bounds = rows.groupBy("block").agg(F.count("*").alias("k"), F.sum(part(F.col("max_tf"), F.col("min_len"))).alias("bound")).where(F.col("k") == len(terms)).select("block", "bound")
        best = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(first_blocks).collect()]

        def scored(some: DataFrame) -> DataFrame:
            hits = some.select("key", F.explode("list").alias("p")).groupBy("p.id").agg(F.sum(part(F.col("p.tf"), F.col("p.len"))).alias("score"), F.count("*").alias("k"))
            return hits.where(F.col("k") == len(terms)).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)

        found = checkpoint(scored(rows.where(F.col("block").isin(best))))
        last = found.agg(F.count("*").alias("n"), F.min("score").alias("bar")).first()
        rest = bounds.where(~F.col("block").isin(best))
        if last["n"] == limit:
            rest = rest.where(F.col("bound") >= last["bar"] - 1e-6)
        more = scored(rows.join(rest.select("block"), "block", "left_semi"))
        return found.unionByName(more).orderBy(F.desc("score"), "id").limit(limit)

    def candidates(self, pieces: list[str]) -> DataFrame | None:
        """id of the symbols whose trigrams include those of all pieces; None without any."""
        grams = sorted({p.lower()[k : k + 3] for p in pieces for k in range(len(p) - 2)})
        if not grams:
            return None
        by_block = self.look_up("grams", grams).groupBy("block").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == len(grams))
        met = F.aggregate(F.slice("lists", 2, len(grams)), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
        return by_block.select(F.explode(met).alias("id"))

    def containing(self, pattern: str) -> DataFrame:
        """id, name, kind of symbols whose name or qualified name fits the pattern."""
        wide = lexical.like_pattern(pattern)
        fits = F.col("name").ilike(wide) | F.col("qualified_name").ilike(wide)
        some = self.candidates([p for p in re.split(r"[*%]", pattern) if p])
        rows = self.names() if some is None else self.names().join(some, "id", "left_semi")
        return rows.where(fits).select("id", "name", "kind")

    def search(self, pattern: str, kind: str | None = None, limit: int = 100) -> DataFrame:
        """As ``lexical.search_symbols`` over all symbols: id, score, source, name, kind. A kind
        filters the ranked list before the limit; scores are those of the whole index."""
        terms = [t.lower() for t in query_terms(pattern)]
        most = limit if kind is None else 1 << 30
        hits = checkpoint(self.ranked(terms, most)) if terms else self.spark.createDataFrame([], "id long, score double")
        named = hits.join(self.names().select("id", "name", "kind"), "id").select("id", "score", F.lit(0).alias("source"), "name", "kind")
        # fewer hits than wanted are all hits; with as many the second source is not needed
        if not is_prefix_pattern(pattern) and hits.count() < most:
            more = self.containing(pattern).join(hits, "id", "left_anti")
            named = named.unionByName(more.select("id", F.lit(0.0).alias("score"), F.lit(1).alias("source"), "name", "kind"))
        rows = named if kind is None else named.where(F.col("kind") == kind)
        return rows.orderBy("source", F.desc("score"), "id").limit(limit)

"""Vectors: cosine, exact top-k, the hash embedder, rank fusion, incremental embedding."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Doubles throughout: single precision would drift while summing."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Zero where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def cosine_scan(rows: DataFrame, query: list[float], k: int = 10, threshold: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector; the vector is a literal, the sort keeps k rows a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vector_col)
    scored = rows.where((F.size(v) == len(query)) & (norm(v) > 0)).select(F.col(id_col).alias("id"), cosine(v, q).alias("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), "id").limit(k)


def rrf(lists: list[DataFrame], weights: list[float] | None = None, k: int = 60) -> DataFrame:
    """id, score: sum of weight / (k + rank) over ranked lists (id, rank from 1)."""
    parts = [x.select("id", (F.lit(w) / (k + F.col("rank"))).alias("s"), F.lit(f"l{i}").alias("list")) for i, (x, w) in enumerate(zip(lists, weights or [1.0] * len(lists)))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("id").agg(F.round(F.sum("s"), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("list")), "+").alias("provenance"))


def ranked(hits: DataFrame, limit: int) -> DataFrame:
    """id, rank of the best ``limit`` hits (id, score)."""
    best = hits.orderBy(F.desc("score"), "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", "rank")


def hash_embed(rows: DataFrame, id_col: str, text: Column, dim: int = 256) -> DataFrame:
    """id, i, x: a unit vector of hashed words, as its components that are not zero.

    Each distinct word's SHA-256 gives the component, the sign and the size it adds.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))
    asked = rows.select(F.col(id_col).alias("id"), words.alias("words")).where("id is not null and size(words) > 0")
    kind = asked.schema["id"].dataType.simpleString()
    held = asked.mapInArrow(lambda batches: _hashed(batches, dim), f"id {kind}, i array<int>, x array<double>")
    # an id has one row as a rule; several are united here, by component
    united = held.groupBy("id").agg(F.collect_list(F.arrays_zip("i", "x")).alias("rows"))
    flat = F.flatten("rows")
    summed = F.transform(F.array_distinct(flat["i"]), lambda i: F.struct(i.alias("i"), F.aggregate(F.filter(flat, lambda p: p["i"] == i), F.lit(0.0), lambda s, p: s + p["x"]).alias("x")))
    whole = united.select("id", F.when(F.size("rows") == 1, F.col("rows")[0]).otherwise(summed).alias("parts"))
    sized = whole.select("id", "parts", F.sqrt(F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["x"] * p["x"])).alias("n")).where("n > 0")
    return sized.select("id", "n", F.inline("parts")).select("id", "i", (F.col("x") / F.col("n")).alias("x"))


#: Words whose digests a task keeps; rows that leave it at once.
KEPT_WORDS, HASHED_ROWS = 1 << 17, 1024


def hash_packed(rows: DataFrame, id_col: str, text: Column, keep: list[str], dim: int = 256) -> DataFrame:
    """id, the columns of ``keep``, v: ``hash_embed`` of rows whose ids differ, as ``dim`` whole
    numbers (thousandths) of 2 or 4 bytes that are the vector but for its length."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))
    asked = rows.select(F.col(id_col).alias("id"), *keep, words.alias("words")).where("id is not null and size(words) > 0")
    names = ["id", *keep]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[int, int]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, HASHED_ROWS):
                batch, packed = whole.slice(at, HASHED_ROWS), []
                for own in batch.column(len(names)):
                    sums = [0] * dim
                    for word in own.values.to_pylist():
                        if (place := kept.get(word)) is None:
                            h = sha256(word.encode()).digest()
                            if len(kept) >= KEPT_WORDS:
                                kept.clear()
                            place = kept[word] = int.from_bytes(h[:4], "little") % dim, (1 if h[4] & 1 else -1) * (500 + int.from_bytes(h[5:9], "little") % 1000)
                        sums[place[0]] += place[1]
                    packed.append(np.array(sums, "<i2" if max(map(abs, sums)) < 1 << 15 else "<i4").tobytes() if any(sums) else None)
                out = pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(packed, pa.binary())], names=[*names, "v"])
                yield out.filter(out.column(len(names)).is_valid())

    kinds = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in names)
    return asked.mapInArrow(pack, f"{kinds}, v binary")


def _hashed(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """id, i, x: of each row's distinct words the sums by component."""
    kept: dict[str, tuple[int, float]] = {}

    def place(word: str) -> tuple[int, float]:
        if (found := kept.get(word)) is None:
            h = sha256(word.encode()).digest()
            found = int.from_bytes(h[:4], "little") % dim, (1.0 if h[4] & 1 else -1.0) * (0.5 + int.from_bytes(h[5:9], "little") % 1000 / 1000)
            if len(kept) >= KEPT_WORDS:
                kept.clear()
            kept[word] = found
        return found

    for whole in batches:
        for at in range(0, whole.num_rows, HASHED_ROWS):
            batch, sums = whole.slice(at, HASHED_ROWS), []
            for words in batch.column(1):
                row: dict[int, float] = {}
                for word in words.values.to_pylist():
                    i, x = place(word)
                    row[i] = row.get(i, 0.0) + x
                sums.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(r) for r in sums], pa.list_(pa.int32())), pa.array([list(r.values()) for r in sums], pa.list_(pa.float64()))], ["id", "i", "x"])


def sparse_cosine(embedded: DataFrame, query: DataFrame) -> DataFrame:
    """id, score of unit vectors (id, i, x) against one (i, x) of at most its dimensions."""
    q = query.select("i", F.col("x").alias("y"))
    return embedded.join(F.broadcast(q), "i").groupBy("id").agg(F.sum(F.col("x") * F.col("y")).alias("score"))


def chunk_text(kind: Column, name: Column, qualified: Column, docstring: Column, variant: str = "A", body: Column | None = None, limit: int = 2048) -> Column:
    """What is embedded of a symbol: A its head, B with the docstring, C with the body too."""
    parts = [F.concat_ws(" ", kind, qualified)]
    if variant in ("B", "C"):
        parts.append(docstring)
    if variant == "C" and body is not None:
        parts.append(body)
    return F.left(F.concat_ws("\n", *parts), F.lit(limit))


def changed_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks (id, chunk) that are new or whose hash is not the stored one (id, content_hash)."""
    now = chunks.withColumn("content_hash", F.sha2("chunk", 256))
    old = stored.select("id", F.col("content_hash").alias("old_hash"))
    return now.join(old, "id", "left").where(F.col("old_hash").isNull() | (F.col("old_hash") != F.col("content_hash"))).drop("old_hash")


def orphans(stored: DataFrame, symbols: DataFrame) -> DataFrame:
    return stored.join(symbols.select("id"), "id", "left_anti")


# --- an index of cells around centres ----------------------------------------------------
#: Recall aimed at on the sample.
AIM = 0.95


class Cells:
    """Centres of cells, fitted on a bounded sample, and how many cells a query visits so that
    vectors of a second sample find ``AIM`` of their five nearest in both."""

    def __init__(self, vectors: np.ndarray, asked: np.ndarray, cells: int, rounds: int = 8) -> None:
        x, q = self._unit(vectors), self._unit(asked)
        rng = np.random.default_rng(11)
        self.centres = x[rng.permutation(len(x))[: max(1, min(cells, len(x)))]] if len(x) else np.zeros((1, 1))
        for _ in range(rounds if len(x) else 0):
            own = self.order(x)[:, 0]
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, x)
            self.centres = np.where(np.bincount(own, minlength=len(sums))[:, None] > 0, self._unit(sums), self.centres)
        self.probes = len(self.centres)
        every = np.concatenate([x, q])
        if len(every) > 6 and len(q):
            near = q @ every.T
            near[np.arange(len(q)), len(x) + np.arange(len(q))] = -2
            best = np.argpartition(-near, 4, axis=1)[:, :5]
            place = np.argsort(self.order(q), axis=1)
            needed = np.sort(place[np.arange(len(q))[:, None], self.order(every)[:, 0][best]].ravel())
            self.probes = int(needed[min(len(needed) - 1, int(AIM * len(needed)))]) + 1

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(size > 0, size, 1)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Cells of unit vectors, nearest first."""
        return np.argsort(-(x @ self.centres.T), axis=1, kind="stable")

"""A stored index for nearest vectors: cells around centres, residual product codes, appends.

Vectors of each length have centres of their own, fitted on a bounded sample. A row lies in the
folder of its length and nearest centre, with what it adds to the centre as one byte for each
``SUB`` dimensions. A search reads only the cells that its queries visit, and of them only the
codes; the best ``SHORT`` * k by code get their exact cosine from the vectors themselves.

A task holds a chunk of a cell: cells of more than ``CHUNK`` rows are dealt over chunks by a
hash of the id, so a cell with a third of all rows is many tasks. A task gives at most
SHORT * k rows for each query, and rows and queries meet nowhere else.

Appended rows go into the cells that are there. Defined results: vectors that are null, empty,
zero or hold null or non-finite components are in no cell and ask nothing; vectors of another
length than the query's are no candidates; ids of the index must be distinct; a query's own id
is no candidate; ties go to the smaller id.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grafwerk.operators.vector import Cells, cosine
from grafwerk.plans.store import checkpoint

#: Vectors of a sample, rows of a cell, dimensions of a code byte, values of a byte; candidates
#: by code for each row wanted; rows of a chunk; queries scored at once; cells named in a filter.
SAMPLE, CELL_ROWS, SUB, CODES, SHORT, CHUNK, ASKED, NAMED = 4096, 256, 4, 256, 12, 16_384, 256, 1000


class Model:
    """Centres and code books for vectors of one length."""

    def __init__(self, x: np.ndarray, asked: np.ndarray, cells: int, rounds: int = 6) -> None:
        self.cells = Cells(x, asked, cells)
        unit = Cells._unit(x)
        rest = unit - self.cells.centres[self.cells.order(unit)[:, 0]] if len(x) else np.zeros((1, x.shape[1]))
        rng = np.random.default_rng(7)
        self.cuts = list(range(0, x.shape[1], SUB))
        self.books = []
        for at in self.cuts:
            part = rest[:, at : at + SUB]
            book = part[rng.permutation(len(part))[:CODES]]
            for _ in range(rounds):
                own = self._nearest(part, book)
                sums = np.zeros_like(book)
                np.add.at(sums, own, part)
                n = np.bincount(own, minlength=len(book))[:, None]
                book = np.where(n > 0, sums / np.maximum(n, 1), book)
            self.books.append(book)

    @staticmethod
    def _nearest(part: np.ndarray, book: np.ndarray) -> np.ndarray:
        return ((book**2).sum(1)[None, :] - 2 * part @ book.T).argmin(1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the code bytes of each vector."""
        unit = Cells._unit(x)
        cell = self.cells.order(unit)[:, 0]
        rest = unit - self.cells.centres[cell]
        return cell, np.stack([self._nearest(rest[:, a : a + SUB], b) for a, b in zip(self.cuts, self.books)], 1).astype(np.uint8)

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate cosines of queries with the coded rows of a cell."""
        unit = Cells._unit(q)
        found = np.repeat((unit @ self.cells.centres[cell])[:, None], len(codes), 1)
        for k, (a, book) in enumerate(zip(self.cuts, self.books)):
            found += (unit[:, a : a + SUB] @ book.T)[:, codes[:, k]]
        return found


def usable(vector: Column) -> Column:
    v = vector
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    found = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return found.where(F.col("id").isNotNull() & usable(F.col("v")))


def _by_length(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        size = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(size).tolist():
            some = batch.filter(pa.array(size == d))
            yield some, some.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(some), d)


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    models: dict[int, Model]

    @staticmethod
    def write(rows: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, cell_rows: int = CELL_ROWS) -> VectorIndex:
        held = vectors(rows, id_col, vector_col).withColumn("d", F.size("v"))
        counts = {r["d"]: r["count"] for r in held.groupBy("d").count().collect()}
        share = F.create_map(*(F.lit(x) for d, n in counts.items() for x in (d, int(min(1.0, sample / n) * 2**31)))) if counts else F.lit(None)
        drawn = lambda name: F.shiftrightunsigned(F.xxhash64("id", F.lit(name)), 33) < share[F.col("d")]
        some = held.withColumn("fit", drawn("fit")).withColumn("ask", drawn("ask")).where("fit or ask").collect() if counts else []
        models = {}
        for d, n in counts.items():
            part = lambda name: np.array([r["v"] for r in some if r["d"] == d and r[name]], float).reshape(-1, d)  # noqa: B023, E731
            fit = part("fit")
            models[d] = Model(fit, part("ask"), max(1, n // cell_rows))
        spark = rows.sparkSession
        spark.createDataFrame([(d, bytearray(pickle.dumps(m))) for d, m in models.items()], "d int, model binary").write.mode("overwrite").parquet(f"{path}/models")
        index = VectorIndex(spark, path, models)
        index._save(held, "overwrite")
        return index

    @staticmethod
    def read(spark: SparkSession, path: str) -> VectorIndex:
        return VectorIndex(spark, path, {r["d"]: pickle.loads(r["model"]) for r in spark.read.parquet(f"{path}/models").collect()})

    def append(self, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
        """More rows, of lengths that the index knows."""
        self._save(vectors(rows, id_col, vector_col).withColumn("d", F.size("v")).where(F.col("d").isin(list(self.models))), "append")

    def _save(self, held: DataFrame, mode: str) -> None:
        models = self.models

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, x in _by_length(batches, "v"):
                cell, codes = models[x.shape[1]].encode(x)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(cell.astype(np.int32))], names=["id", "v", "codes", "d", "cell"])

        coded = held.select("id", "v").mapInArrow(run, "id long, v array<double>, codes binary, d int, cell int")
        # files of a bounded size: a cell's rows are dealt by a hash where there are many
        coded = checkpoint(coded)
        parts = coded.groupBy("d", "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
        dealt = coded.join(parts, ["d", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        dealt.repartition("d", "cell", "part").select("id", "v", "codes", "d", "cell").write.mode(mode).partitionBy("d", "cell").parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self.spark.read.schema("id long, v array<double>, codes binary, d int, cell int").parquet(f"{self.path}/rows")

    def visits(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """query_id, q, d, cell of the cells that queries (id, v) visit."""
        models = self.models

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, x in _by_length(batches, "v"):
                if model := models.get(x.shape[1]):
                    at = model.cells.order(Cells._unit(x))[:, : probes or model.cells.probes].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(list(at), pa.list_(pa.int32()))], names=["query_id", "q", "d", "cells"])

        found = queries.select("id", "v").mapInArrow(run, "query_id long, q array<double>, d int, cells array<int>")
        return found.select("query_id", "q", "d", F.explode("cells").alias("cell"))

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, short: int = SHORT) -> DataFrame:
        """query_id, id, score, rank of the k nearest found to each of queries (id, v)."""
        visits = checkpoint(self.visits(queries, probes))
        wanted = visits.select("d", "cell").distinct().limit(NAMED + 1).collect()
        rows = self.rows()
        if len(wanted) <= NAMED:  # the filter on folders prunes files
            named = F.lit(False)
            for d in {r["d"] for r in wanted}:
                named = named | ((F.col("d") == d) & F.col("cell").isin([r["cell"] for r in wanted if r["d"] == d]))
            rows = rows.where(named)
        codes = rows.select("id", "codes", "d", "cell")
        chunks = codes.groupBy("d", "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        chunks = checkpoint(chunks)
        left = codes.join(chunks, ["d", "cell"]).select("d", "cell", F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"), F.lit(0).alias("side"), "id", "codes", F.lit(None).cast("array<double>").alias("q"))
        right = visits.join(chunks, ["d", "cell"]).select("d", "cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("side"), F.col("query_id").alias("id"), F.lit(None).cast("binary").alias("codes"), "q")
        models, keep = self.models, k * short

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, ids, held, asked = None, [], [], []

            def answer() -> Iterator[pa.RecordBatch]:
                if not ids or not asked:
                    return
                order = np.argsort(ids)
                who, own = np.array([a for a, _ in asked]), np.array(ids)[order]
                s = models[at[0]].scores(np.array([v for _, v in asked]), at[1], np.frombuffer(b"".join(held), np.uint8).reshape(len(ids), -1)[order])
                s -= np.arange(len(own)) * 1e-13  # of equal codes the smaller ids
                s[who[:, None] == own[None, :]] = -np.inf
                best = np.argpartition(-s, min(keep, len(own)) - 1, axis=1)[:, :keep]
                row = np.repeat(np.arange(len(who)), best.shape[1])
                fine = np.isfinite(s[row, best.ravel()])
                row, best = row[fine], best.ravel()[fine]
                yield pa.RecordBatch.from_arrays([pa.array(who[row]), pa.array(own[best]), pa.array(s[row, best]), pa.array(np.full(len(row), at[0], np.int32)), pa.array(np.full(len(row), at[1], np.int32))], names=["query_id", "id", "near", "d", "cell"])

            for batch in batches:
                for d, cell, chunk, side, i, code, q in zip(*(batch.column(c) for c in ("d", "cell", "chunk", "side", "id", "codes", "q"))):
                    name = (d.as_py(), cell.as_py(), chunk.as_py())
                    if name != at:
                        yield from answer()
                        at, ids, held, asked = name, [], [], []
                    if side.as_py() == 0:
                        ids.append(i.as_py())
                        held.append(code.as_py())
                    else:
                        asked.append((i.as_py(), q.as_py()))
                        if len(asked) == ASKED:
                            yield from answer()
                            asked = []
            yield from answer()

        keys = ["d", "cell", "chunk"]
        near = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(run, "query_id long, id long, near double, d int, cell int")
        order = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
        short_list = checkpoint(near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).drop("n", "near"))
        exact = short_list.join(rows.select("d", "cell", "id", "v"), ["d", "cell", "id"]).join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        last = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return exact.select("query_id", "id", cosine(F.col("v"), F.col("q")).alias("score")).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)

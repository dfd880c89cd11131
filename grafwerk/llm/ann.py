"""Approximate nearest neighbours by learned partitions.

A bounded sample (about ``SAMPLE`` vectors, chosen by a hash of the id) gives a neighbour
graph; the graph is halved again and again into parts of equal size that cut few edges; a
small network learns which parts a vector's neighbours are in. Every row is then indexed in
its most probable part and a query is routed to as many parts as the sample needs for
``AIM`` recall, where candidates are ranked by exact cosine in double precision.

The number of parts grows with the rows: beyond ``MOST_PARTS`` parts each part is divided
again in the same way, by a router fitted on a sample of its own, up to MOST_PARTS^2 parts.
Fitting is one task for the first level and one for each divided part; its input and the
models are bounded by the sample, not by the table. Lengths of vectors are indexes of their
own; one with less than two parts' rows is searched whole.

Rows of a part are split by hash into chunks of at most about ``CHUNK`` and its queries
into blocks, so a part that holds a third of all rows is many tasks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part; vectors of another length than the query's are no candidates; rows with the query's
own id are no candidates; null ids take no part; ties go to the smaller id; a query gets all
candidates where there are fewer than k. Components of any size are scaled by a power of two
before they are squared, which changes no score. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.llm.shared import checkpoint, lean

#: Vectors fitted on; rows for each part; most parts of a level; recall aimed at on the sample.
SAMPLE, PART_ROWS, MOST_PARTS, AIM = 4096, 256, 64, 0.94
NEIGHBOURS, HIDDEN, EPOCHS = 10, 96, 30
CHUNK, BLOCK = 16_384, 1024


def usable(vector: Column) -> Column:
    """Not null or empty, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    found = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return found.where(F.col("id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row by the power of two that brings its largest component to between 1/2 and 1."""
    _, power = np.frexp(np.abs(x).max(1, initial=0))
    half = power // 2  # in two steps: 2 ** -power itself may not be a finite number
    return np.ldexp(np.ldexp(x, -half[:, None]), (half - power)[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Dense symmetric adjacency of the k nearest by cosine of unit vectors."""
    near = x @ x.T
    np.fill_diagonal(near, -2)
    k = min(k, len(x) - 1)
    graph = np.zeros((len(x), len(x)), np.float32)
    if k > 0:
        np.put_along_axis(graph, np.argpartition(-near, k - 1, axis=1)[:, :k], 1, axis=1)
    return np.maximum(graph, graph.T)


def halve(graph: np.ndarray, seed: int) -> np.ndarray:
    """Boolean side of each node: the halves have equal size and few edges between them.

    The order of a slow mode of diffusion is cut at its middle; then the pairs whose
    exchange cuts most edges less change sides until none does.
    """
    n = len(graph)
    degree = graph.sum(1) + 1e-6
    x = np.random.default_rng(seed).standard_normal(n).astype(np.float32)
    for _ in range(60):
        x = 0.5 * x + 0.5 * (graph @ x) / degree
        x -= (x * degree).sum() / degree.sum()
        x /= np.linalg.norm(x) + 1e-12
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        across = graph @ side.astype(np.float32)
        gain = np.where(side, degree - 2 * across, 2 * across - degree)
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        swap = int(((gain[a[:m]] + gain[b[:m]]) > 0.5).sum()) // 2
        if not swap:
            break
        before = graph[~side][:, side].sum()
        new = side.copy()
        new[a[:swap]], new[b[:swap]] = True, False
        if graph[~new][:, new].sum() >= before:
            break
        side = new
    return side


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each node, parts a power of two of sizes that differ by few."""
    label = np.zeros(len(graph), np.int64)
    for level in range(parts.bit_length() - 1):
        for p in range(1 << level):
            nodes = np.flatnonzero(label == p)
            label[nodes] = p + (halve(graph[np.ix_(nodes, nodes)], level * 1000 + p) << level if len(nodes) > 1 else 0)
    return label


def _forward(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(x @ model["w1"] + model["b1"], 0)
    z = hidden @ model["w2"] + model["b2"]
    z = np.exp(z - z.max(1, keepdims=True))
    return hidden, z / z.sum(1, keepdims=True)


def fit_router(x: np.ndarray, parts: int) -> dict:
    """Graph, parts and a network with one hidden layer trained by Adam on the parts of each
    vector's neighbours."""
    x = np.unique(unit(x), axis=0)
    while parts > 1 and parts * 16 > len(x):
        parts //= 2
    graph = neighbour_graph(x)
    label = balanced_parts(graph, parts)
    target = np.eye(parts, dtype=np.float32)[label]
    target = target + graph @ target / np.maximum(graph.sum(1, keepdims=True), 1)
    target /= target.sum(1, keepdims=True)
    rng = np.random.default_rng(7)
    model = {"w1": rng.standard_normal((x.shape[1], HIDDEN)).astype(np.float32) * (2 / x.shape[1]) ** 0.5 * 2, "b1": np.zeros(HIDDEN, np.float32), "w2": rng.standard_normal((HIDDEN, parts)).astype(np.float32) * 0.1, "b2": np.zeros(parts, np.float32)}
    first, second, t = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            b = order[at : at + 128]
            hidden, p = _forward(model, x[b])
            dz = (p - target[b]) / len(b)
            dh = (dz @ model["w2"].T) * (hidden > 0)
            t += 1
            for k, g in {"w1": x[b].T @ dh, "b1": dh.sum(0), "w2": hidden.T @ dz, "b2": dz.sum(0)}.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model[k] = model[k] - 0.01 * (1 - epoch / EPOCHS) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return model | {"parts": parts}


class Router:
    """A router of one length of vectors: the first level, and those below it by part."""

    def __init__(self, top: dict, below: dict[int, dict] | None = None) -> None:
        self.top, self.below, self.probes, self.width = top, below or {}, 1, MOST_PARTS

    @property
    def parts(self) -> int:
        return self.top["parts"] * self.width if self.below else self.top["parts"]

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Chance of each part for unit vectors; a part of the second level has its own share
        of its parent's."""
        _, p = _forward(self.top, x)
        if not self.below:
            return p
        out = np.zeros((len(x), self.parts), np.float32)
        for part in range(p.shape[1]):
            at = part * self.width
            if part in self.below:
                _, q = _forward(self.below[part], x)
                out[:, at : at + q.shape[1]] = p[:, part, None] * q
            else:
                out[:, at] = p[:, part]
        return out

    def order(self, x: np.ndarray, many: int) -> np.ndarray:
        """The most probable parts, best first."""
        p = self.chances(x)
        many = min(many, p.shape[1])
        top = np.argpartition(-p, many - 1, axis=1)[:, :many]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(p, top, axis=1), axis=1, kind="stable"), axis=1).astype(np.int32)

    def fit_probes(self, x: np.ndarray, asked: np.ndarray) -> Router:
        """As many parts as hold AIM of the five nearest that vectors which the routers have
        not seen have among all of these."""
        rows, asked = unit(np.concatenate([x, asked])), unit(asked)
        if len(rows) > 6 and len(asked) and self.parts > 1:
            near = asked @ rows.T
            near[np.arange(len(asked)), len(x) + np.arange(len(asked))] = -2
            best = np.argpartition(-near, 4, axis=1)[:, :5]
            order = self.order(asked, self.parts)
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(order.shape[1], dtype=np.int32)[None, :].repeat(len(asked), 0), axis=1)
            needed = np.sort(place[np.arange(len(asked))[:, None], self.order(rows, 1)[:, 0][best]].ravel())
            self.probes = int(needed[min(len(needed) - 1, int(AIM * len(needed)))]) + 1
        return self


def _sampled(found: DataFrame, n: int, sample: int, name: str = "fit") -> DataFrame:
    """About ``sample`` of n rows by a hash of the id: no task sends more than its share."""
    share = min(1.0, sample / max(n, 1))
    return found.where(F.shiftrightunsigned(F.xxhash64("id", F.lit(name)), 33) < F.lit(int(share * 2**31)))


def _fit(rows: DataFrame, by: str, parts: int) -> dict[int, dict]:
    """A router for each value of ``by``, each fitted in one task; models go to the driver."""

    def run(table: pa.Table) -> pa.Table:
        x = _as_matrix(table.column("v"))
        return pa.table({"at": pa.array([table.column("at")[0].as_py()], pa.int32()), "model": pa.array([pickle.dumps(fit_router(x, parts))], pa.binary())})

    got = rows.select(F.col(by).cast("int").alias("at"), "v").groupBy("at").applyInArrow(run, "at int, model binary").collect()
    return {r["at"]: pickle.loads(bytes(r["model"])) for r in got}


def fit(found: DataFrame, sizes: dict[int, int], sample: int = SAMPLE, part_rows: int = PART_ROWS) -> dict[int, Router]:
    """A router for each length of vectors that has two parts' rows at least."""
    routers: dict[int, Router] = {}
    for dim, n in sizes.items():
        wanted = 1 << max(0, round(np.log2(n / part_rows)))
        if wanted < 2:
            continue
        own = found.where(F.size("v") == dim)
        chosen = checkpoint(_sampled(own, n, sample).select("id", "v", F.lit(dim).alias("dim")))
        if not (top := _fit(chosen, "dim", min(wanted, MOST_PARTS)).get(dim)):
            continue
        router = Router(top)
        if wanted > MOST_PARTS:  # a sample of each part, dealt by the first level
            wider = _sampled(own, n, sample * router.parts)
            dealt = route(wider, {dim: router}).withColumn("at", F.col("order")[0]).select("at", "v")
            router.below = _fit(dealt, "at", min(wanted // MOST_PARTS, MOST_PARTS))
        drawn = [np.array([r["v"] for r in x.select("v").collect()], float).reshape(-1, dim) for x in (chosen, _sampled(own, n, sample // 2, "probe"))]
        routers[dim] = router.fit_probes(*drawn)
    return routers


def _as_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def route(found: DataFrame, routers: dict[int, Router], sizes: dict[int, np.ndarray] | None = None, k: int = 0) -> DataFrame:
    """id, v and ``order``: the most probable part; with ``sizes`` (rows of each part) the
    router's probes, best first, and on until more than k rows have been met."""

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dim))
                order: list[np.ndarray] = [np.zeros(1, np.int32)] * len(part)
                if router := routers.get(dim):
                    x = unit(_as_matrix(part.column("v")))
                    order = list(router.order(x, router.probes if sizes else 1))
                    for i in [i for i, o in enumerate(order) if sizes[dim][o].sum() <= k] if sizes else ():
                        every = router.order(x[i : i + 1], router.parts)[0]
                        order[i] = every[: max(router.probes, int(np.searchsorted(np.cumsum(sizes[dim][every]), k, "right")) + 1)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(order, pa.list_(pa.int32()))], names=["id", "v", "order"])

    return found.select("id", "v").mapInArrow(run, "id long, v array<double>, order array<int>")


def top_by_cosine(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k best rows of each query by exact cosine, ties to the smaller id.

    A product of matrices finds who can be among them; the score itself is summed the same
    way for every pair, so that equal vectors have equal scores.
    """
    rows, queries = scaled(rows), scaled(queries)
    norm, query_norm = np.sqrt((rows * rows).sum(1)), np.sqrt((queries * queries).sum(1))
    each = rows / norm[:, None]
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(queries), 64):
        near = (queries[at : at + 64] / query_norm[at : at + 64, None]) @ each.T
        near[query_ids[at : at + 64, None] == ids[None, :]] = -np.inf
        for i, line in enumerate(near):
            q = at + i
            bar = np.partition(line, -k)[-k] if len(line) > k else -np.inf
            who = np.flatnonzero((line >= bar - 1e-9) & (line > -np.inf))
            score = (rows[who] * queries[q]).sum(1) / (norm[who] * query_norm[q])
            for j in np.lexsort([ids[who], -score])[:k]:
                out[0].append(int(query_ids[q]))
                out[1].append(int(ids[who[j]]))
                out[2].append(float(score[j]))
    return out


def search(rows: DataFrame, is_query: Column, k: int = 5, sample: int = SAMPLE, part_rows: int = PART_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row where is_query(id)."""
    found = vectors(rows, id_col, vector_col)
    sizes = {r["dim"]: r["n"] for r in found.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    routers = fit(found, sizes, sample, part_rows)
    placed = checkpoint(route(found, routers).select("id", "v", F.size("v").alias("dim"), F.col("order")[0].alias("part")))
    # one row a part, with how many rows it holds and in how many chunks
    held = checkpoint(placed.groupBy("dim", "part").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")))
    rows_of = {dim: np.zeros(r.parts, np.int64) for dim, r in routers.items()}
    for r in held.where(F.col("dim").isin(*(routers or [0]))).collect():  # at most MOST_PARTS^2 a router
        rows_of[r["dim"]][r["part"]] = r["n"]
    asked = route(found.where(is_query), routers, rows_of or None, k).select("id", "v", F.size("v").alias("dim"), F.explode("order").alias("part"))
    asked = checkpoint(asked.join(held.select("dim", "part", "chunks"), ["dim", "part"]))
    load = asked.groupBy("dim", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    one = lambda m: F.pmod(F.xxhash64("id", "v"), F.col(m)).cast("int")
    asked = asked.join(load, ["dim", "part"]).withColumn("block", one("blocks")).withColumn("chunk", spread("chunks"))
    kept = placed.join(held.select("dim", "part", "chunks").join(load, ["dim", "part"]), ["dim", "part"]).withColumn("chunk", one("chunks")).withColumn("block", spread("blocks"))
    cols = ["dim", "part", "chunk", "block", "id", "v"]
    both = asked.select(*cols, F.lit(True).alias("q")).unionByName(kept.select(*cols, F.lit(False).alias("q")))

    def rank(table: pa.Table) -> pa.Table:
        ids, q, x = table.column("id").to_numpy(), table.column("q").to_numpy(), _as_matrix(table.column("v"))
        got = top_by_cosine(ids[q], x[q], ids[~q], x[~q], k) if q.any() and not q.all() else ([], [], [])
        return pa.table([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.float64())], names=["query_id", "vec_id", "score"])

    near = both.groupBy("dim", "part", "chunk", "block").applyInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


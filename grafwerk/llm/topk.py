"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components are quantised to integers floor(scale * x). Each block of rows holds, per
dimension, its rows in order of impact, cut into segments of equal steps of impact. For a
query the segments of all dimensions are processed by descending contribution: a round
lowers the cut-off and takes every segment that may hold a contribution of at least that. A
row's score is then at most what it has got so far plus, for each dimension that has not
given yet, the cut-off or the dimension's largest contribution. After every round the most
promising rows are scored in full, which raises the bar, the k-th best score known. The
rounds stop when the rows whose bound reaches the bar are few enough to rescore, or when
every posting is in and the bound is the score; ties at the k-th score are never cut off.
Possible members are rescored exactly.

A block of rows is one task's work: its index is built once, then all queries stream past
it. Every row is sent once, every query once to each block.

Sums are in doubles where they stay below 2^53, in 64-bit integers below 2^63 and in whole
numbers of any size beyond; rows of large components have an index of their own, so that a
few of them slow no others down.

Defined results: vectors that are null or hold null or non-finite components take no part,
empty ones neither, zero vectors do; vectors of other lengths than the query's are no candidates; rows with the
query's own id are no candidates; null ids take no part; ties go to the smaller id; a query
gets all candidates where there are fewer than k. Scores beyond 64 bits rank by their true
size and are given as the nearest 64-bit number. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.llm.ann import usable
from grafwerk.llm.shared import lean

SCALE = 256
#: Rows of a block, and at least so many; segments of a dimension; rounds from the largest
#: contribution to none; share of a block's rows up to which possible members are rescored.
ROWS, LEAST_ROWS, SEGMENTS, ROUNDS, RESCORE = 8192, 2048, 256, 4, 0.3
#: Components above this are large.
LARGE = 1 << 20


class ImpactIndex:
    """Rows of one block by dimension and descending impact (read from the end where a
    query's weight is negative, so that contributions descend either way)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        n, dim = rows.shape
        self.ids, self.largest = ids, int(np.abs(rows).max(initial=0))
        self.rows = rows.astype(np.float64) if self.largest < 1 << 53 else rows
        self.whole, self.exact = rows, None
        order = np.argsort(-rows, axis=0, kind="stable")
        impacts = np.take_along_axis(rows, order, axis=0)
        self.top = int(rows.max())
        self.step = max(1, -(-(self.top - int(rows.min()) + 1) // SEGMENTS))
        level = ((self.top - impacts) // self.step).astype(np.int64)
        #: where the segments of a dimension begin, from the largest impact on
        self.start = np.stack([np.searchsorted(level[:, d], np.arange(SEGMENTS + 1)) for d in range(dim)])
        self.postings = order.T.astype(np.intp).ravel()
        self.impacts = impacts.T.astype(self.rows.dtype).ravel()
        self.first, self.last = impacts[0], impacts[-1]
        #: counted for tests and for tuning
        self.read = self.rescored = 0

    def _whole_impacts(self) -> np.ndarray:
        """The impacts as whole numbers, for sums that doubles can't hold."""
        if self.exact is None:
            order = self.postings.reshape(self.whole.shape[::-1])
            self.exact = np.take_along_axis(self.whole.T, order, axis=1).ravel()
        return self.exact

    def _upto(self, w: np.ndarray, cut: int, d: np.ndarray) -> np.ndarray:
        """Postings of each dimension d, in descending contribution, that its segments with a
        contribution of at least ``cut`` hold."""
        n, up = len(self.ids), w > 0
        bound = np.where(up, -(-cut // np.where(up, w, 1)), cut // np.where(up, -1, w))
        level = np.clip((self.top - bound) // self.step, -1, SEGMENTS).astype(np.int64)
        return np.where(up, self.start[d, np.minimum(level + 1, SEGMENTS)], n - self.start[d, np.maximum(level, 0)])

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows."""
        n, reach = len(self.ids), int(np.abs(query).max(initial=0)) * self.largest * len(query)
        kind = np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 63 else object
        rows, q = (self.rows if kind is np.float64 else self.whole.astype(kind)), query.astype(kind)
        used = np.flatnonzero(query != 0)
        w = query[used] if kind is not object else query[used].astype(object)
        ends = self.first[used].astype(w.dtype) * w, self.last[used].astype(w.dtype) * w
        most, least = np.maximum(*ends), np.minimum(*ends)
        total, seen = np.zeros(n, kind), np.zeros(n, np.int64)
        # where sums leave room, a row's number of postings rides on its sum
        mark = 1 << 52 - len(used).bit_length() if kind is np.float64 and reach < 1 << 51 - len(used).bit_length() else 0
        done = np.zeros(len(used), np.int64)
        highest, lowest = (int(most.max()), int(least.min())) if len(used) else (0, 0)
        descent = max(1, -(-max(highest, -lowest, 1) // ROUNDS))
        bar = None
        for turn in range(1, 1 << 20):
            cut = max(lowest, highest - descent * turn)
            upto = np.where(most >= cut, np.maximum(self._upto(w, cut, used), done), done) if cut > lowest else np.full(len(used), n)
            begin = np.where(w > 0, done, n - upto) + used * n
            parts = [(a, a + m, x) for a, m, x in zip(begin.tolist(), (upto - done).tolist(), w.tolist()) if m]
            if parts:
                who = np.concatenate([self.postings[a:b] for a, b, _ in parts])
                if kind is np.float64:
                    given = np.concatenate([self.impacts[a:b] * x for a, b, x in parts])
                    if mark:
                        sums = np.bincount(who, given + mark, n)
                        fresh = np.rint(sums / mark).astype(np.int64)
                        total += sums - fresh * mark
                    else:
                        total += np.bincount(who, given, n)
                        fresh = np.bincount(who, minlength=n)
                else:
                    np.add.at(total, who, np.concatenate([self._whole_impacts()[a:b].astype(kind) * x for a, b, x in parts]))
                    fresh = np.bincount(who, minlength=n)
                seen += fresh
                self.read += len(who)
            done = upto
            open_ = int(np.minimum(most, cut).sum()) if cut > lowest else int(cut) * len(used)
            bound = total - seen.astype(kind) * cut + open_
            if n > k:  # exact scores of the most promising rows
                tried = np.argpartition(-bound, min(4 * k, n - 1))[: 4 * k]
                tried = tried[self.ids[tried] != query_id]
                if len(tried) >= k:
                    known = np.sort(rows[tried] @ q)[-k]
                    bar = known if bar is None else max(bar, known)
            alive = np.flatnonzero(bound >= bar) if bar is not None else np.arange(n)
            if cut == lowest or len(alive) <= max(4 * k, RESCORE * n):
                break
        alive = alive[self.ids[alive] != query_id]
        self.rescored += len(alive)
        score = rows[alive] @ q
        if len(alive) > k:  # ties at the k-th score stay in
            best = score >= np.sort(score)[-k]
            alive, score = alive[best], score[best]
        return [(int(score[i]), int(self.ids[alive[i]])) for i in np.lexsort([self.ids[alive], -score])[:k]]


def quantise(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of doubles, as 64-bit integers or, where those are too small, as whole
    numbers of any size."""
    with np.errstate(over="ignore"):
        x = np.floor(vectors * scale)
    if not len(x) or np.abs(x).max(initial=0) < 1 << 62:
        return x.astype(np.int64)
    flat = [int(math.floor(a)) if math.isfinite(a) else int(b) * scale for a, b in zip(x.ravel().tolist(), vectors.ravel().tolist())]
    return np.array(flat, object).reshape(x.shape)


def _as_long(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, score))


def _indexes(ids: list[np.ndarray], vectors: list[np.ndarray], scale: int) -> list[ImpactIndex]:
    """Of rows of one length: an index of the usual ones and one of those with large components."""
    i, x = np.concatenate(ids), np.concatenate(vectors)
    large = (np.abs(x) >= LARGE / scale).any(1)
    return [ImpactIndex(i[part], quantise(x[part], scale)) for part in (~large, large) if part.any()]


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and vectors of a batch, by length."""
    lists, ids = batch.column("v"), batch.column("id").to_numpy()
    lengths = lists.value_lengths().to_numpy()
    for dim in np.unique(lengths).tolist():
        own = lengths == dim
        yield ids[own], lists.filter(pa.array(own)).flatten().to_numpy().reshape(-1, dim)


def search(rows: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", most_rows: int = ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of every row where is_query(id)."""
    found = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    n = found.count()
    at_once = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // most_rows), min(at_once, n // LEAST_ROWS))
    held = found.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"))
    asked = found.where(is_query).select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"))

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held_rows, indexes = None, {}, {}
        for whole in batches:
            key = whole.column("block").to_numpy().astype(np.int64) * 2 + whole.column("asks").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else [0]
            for a, b in zip(edges, edges[1:]):
                batch, this, asks = whole.slice(a, b - a), int(key[a]) // 2, int(key[a]) % 2
                if this != block:
                    block, held_rows, indexes = this, {}, {}
                if not asks:
                    for ids, x in _matrices(batch):
                        held_rows.setdefault(x.shape[1], []).append((ids, x))
                    continue
                if held_rows:
                    indexes = {dim: _indexes(*map(list, zip(*parts)), scale) for dim, parts in held_rows.items()}
                    held_rows = {}
                out: list[tuple[int, int, int]] = []
                for ids, x in _matrices(batch):
                    for index in indexes.get(x.shape[1], []):
                        for query_id, query in zip(ids.tolist(), x):
                            out += [(query_id, v, _as_long(s), str(s)) for s, v in index.search(query_id, quantise(query[None, :], scale)[0], k)]
                if out:
                    yield pa.RecordBatch.from_arrays([*(pa.array([o[c] for o in out], pa.int64()) for c in range(3)), pa.array([o[3] if abs(int(o[3])) >= 1 << 63 else None for o in out], pa.string())], names=["query_id", "vec_id", "score", "beyond"])

    dealt = held.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "asks")
    near = dealt.mapInArrow(run, "query_id long, vec_id long, score long, beyond string")
    # scores beyond 64 bits order by sign, digits and then their digits' order
    size = F.length(F.ltrim(F.col("beyond"), F.lit("-")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.when(F.col("score") > 0, size).otherwise(-size).desc(), F.when(F.col("score") > 0, F.col("beyond")).desc(), F.when(F.col("score") < 0, F.col("beyond")).asc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Best-fit packing of token sequences by linear grouping.

Lengths are integers of at most ``capacity``, so their histogram is bounded whatever the
number of documents, and the packing is planned on it: large lengths are split into groups
of equal cardinality and rounded up to their group's largest, column generation solves the
configuration problem over these few sizes, whole multiplicities are kept, the actual
lengths take the rounded slots, and what is left - the rounding's remainder and the small
lengths - goes in by best fit, largest first. The plan is a list of runs (so many sequences
of one composition); the piece that is the k-th of its length finds its place in it.
Spark numbers the pieces of a length without gathering them: position inside the input
partition plus an offset for the partition, so a length that most pieces have spreads
over all tasks.

Defined results: a null text is empty, an empty one is the end token alone; repeated rows
and null ids are pieces of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.llm.bpe import encoder
from grafwerk.llm.shared import checkpoint, lean

CAPACITY, END_ID = 1024, 2
#: Groups of large lengths; lengths up to capacity // SMALL are small.
GROUPS, SMALL = 512, 3
#: Column generation ends when its bound proves it this near to the optimum.
GAP, ROUNDS = 1e-3, 400


def cut_documents(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text's ids and the end token.

    Only documents of more than ``capacity`` ids are cut; their first piece takes what is
    over. Adds ``part`` (input partition) and ``nth`` (how many of this length before it
    there), which together number the pieces of a length.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, nth long"

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(vocab_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            parts: list[np.ndarray] = []
            for k, ids, last in enc.batch(x.as_py() or "" for x in batch.column(1)):
                parts.append(ids)
                if not last:
                    continue
                data = np.concatenate([*parts, end]).astype("<u4")
                parts, cuts = [], [0, *range(len(data) % capacity or capacity, len(data) + 1, capacity)] if len(data) > capacity else [0, len(data)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(k)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[a:b].tobytes()))
            sizes = np.array(length, np.int64)
            order = np.argsort(sizes, kind="stable")
            sorted_sizes = sizes[order]
            nth = np.empty(len(sizes), np.int64)
            nth[order] = np.arange(len(sizes)) - np.searchsorted(sorted_sizes, sorted_sizes) + seen[sorted_sizes]
            seen += np.bincount(sizes, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(nth)],
                names=["id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: copies of each size) and how often each is used, nearly optimal.

    Simplex over the covering problem with columns priced by an unbounded knapsack.
    """
    k = len(sizes)
    # Products by einsum: threaded linear algebra can stall in a process that runs a JVM.
    basis, rest, steps = np.zeros((k, k)), demand.copy(), []
    while rest.any():  # a first solution: fill greedily, each pattern until it exhausts a size
        space, column = capacity, np.zeros(k)
        for i in np.flatnonzero(rest):
            column[i], space = space // sizes[i], space % sizes[i]
        many = np.where(column > 0, rest / np.where(column > 0, column, 1), np.inf)
        i = int(many.argmin())
        basis[:, i], rest = column, np.maximum(rest - many[i] * column, 0)
        rest[i] = 0
        steps.append(i)
    for i in np.flatnonzero(~basis.any(0)):  # exhausted along with another
        basis[i, i] = capacity // sizes[i]
        steps.append(int(i))
    inverse = np.eye(k)  # a later column has no size that an earlier one exhausted
    for i in steps:
        inverse[i] /= basis[i, i]
        others = np.flatnonzero(basis[:, i])
        others = others[others != i]
        inverse[others] -= np.outer(basis[others, i], inverse[i])
    for _ in range(ROUNDS):
        worth = inverse.sum(0)
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fits = np.where(sizes <= c, best[np.maximum(c - sizes, 0)] + worth, -1.0)
            i = int(fits.argmax())
            best[c], choice[c] = (fits[i], i) if fits[i] > best[c - 1] + 1e-12 else (best[c - 1], -1)
        if best[capacity] <= 1 + GAP:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                column[choice[c]] += 1
                c -= int(sizes[choice[c]])
        step, used = np.einsum("ij,j->i", inverse, column), np.einsum("ij,j->i", inverse, demand)
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    return basis.T, np.maximum(np.einsum("ij,j->i", inverse, demand), 0)


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """Runs (number of sequences, lengths in each) that hold every piece of the histogram."""
    left = {int(n): int(c) for n, c in histogram.items() if c}
    runs: list[tuple[int, list[int]]] = []
    if full := left.pop(capacity, 0):
        runs.append((full, [capacity]))
    large = sorted((n for n in left if n > capacity // SMALL), reverse=True)
    if large:
        each, members, room = -(-sum(left[n] for n in large) // groups), [], 0
        for n in large:  # groups of equal cardinality, largest first
            if room <= 0:
                members.append([])
                room = each
            members[-1].append(n)
            room -= left[n]
        demand = np.array([sum(left[n] for n in m) for m in members], float)
        patterns, times = _configurations(np.array([m[0] for m in members]), demand, capacity)
        for pattern, many in sorted(zip(patterns.astype(int).tolist(), np.floor(times + 1e-6).astype(int).tolist()), key=lambda x: x[0], reverse=True):
            slots = [g for g, n in enumerate(pattern) for _ in range(n)]
            while many and slots:  # actual lengths take the slots, the last one by best fit
                taken: list[int] = []
                for i, g in enumerate(slots):
                    space = capacity - sum(taken)
                    free = (n for n in (large if i == len(slots) - 1 else members[g]) if n <= space and left[n] > taken.count(n))
                    if (n := next(free, 0)):
                        taken.append(n)
                if not taken:
                    break
                alike = min(many, *(left[n] // taken.count(n) for n in taken))
                for n in taken:
                    left[n] -= alike
                runs.append((alike, taken))
                many -= alike
    return _best_fit(runs, left, capacity)


def _best_fit(runs: list[tuple[int, list[int]]], left: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Add what is left, largest first, where it leaves least room."""
    by_room: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]
    for many, lengths in runs:
        by_room[capacity - sum(lengths)].append((many, lengths))
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        count = left[n]
        while count:
            room = next((r for r in range(n, capacity + 1) if by_room[r]), None)
            if room is None:
                fit = capacity // n
                if count >= fit:
                    by_room[capacity - fit * n].append((count // fit, [n] * fit))
                if count % fit:
                    by_room[capacity - count % fit * n].append((1, [n] * (count % fit)))
                break
            many, lengths = by_room[room].pop()
            take = min(many, count)
            if many > take:
                by_room[room].append((many - take, lengths))
            by_room[room - n].append((take, [*lengths, n]))
            count -= take
    return [x for held in by_room for x in held]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece of ``cut_documents`` a sequence_id and an offset in it.

    The pieces are checkpointed once (they number themselves by partition), counted by
    length, and placed in one more pass. To the driver go ``capacity`` counts; the plan that
    goes out holds a few slots per length, whatever the input's size.
    """
    pieces = checkpoint(pieces)
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, firsts, places = slots(plan_packing(histogram, capacity))

    @lean
    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(firsts[at] + (length << 44) + rank - keys[at]), pa.array(places[at])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    numbered = pieces.join(offsets, ["part", "length"])
    rest = [c for c in pieces.columns if c not in ("part", "nth")]
    out = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in rest)
    return numbered.select(*rest, (F.col("before") + F.col("nth")).alias("rank")).mapInArrow(place, f"{out}, sequence_id long, offset long")


def slots(runs: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot segments sorted by (length, rank): key length << 44 + first rank, first sequence, offset."""
    found, sequence, used = [], 0, {}
    for many, lengths in runs:
        offset = 0
        for n in lengths:
            rank = used.get(n, 0)
            found.append(((n << 44) + rank, sequence, offset))
            used[n] = rank + many
            offset += n
        sequence += many
    found.sort()
    return tuple(np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def pack_documents(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(cut_documents(docs, vocab_path, capacity, end_id), capacity)

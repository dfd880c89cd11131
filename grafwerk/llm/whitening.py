"""Embedding whitening by a digit-slice GEMM.

Components become integers x = floor(64 c) + 1,000,000; the fit list is each distinct x vector
once. Around a mean of a million the deviations are a few units, so products of doubles would
lose them; so the Gram matrix of the fit list, a column of ones beside it, is taken exactly.
Each task slices its integers into limbs of ``LIMB`` bits. A block has at most ``BLOCK`` rows,
so that every entry of the product of two limb matrices stays below 2 ** 53 and BLAS in double
precision adds it up without rounding. A task recombines its limbs as Python integers and
emits them as digits of ``DIGIT`` bits; Spark adds the digits up by position, with a partial
sum in every task, and the driver gets d * d of them whatever the number of rows. From there
n, the sums S and the covariance (n G - S S') / n^2, which is what centring before multiplying
gives, are exact until each entry is rounded once to a double, and eigenvectors are taken.

A second pass over the fit list measures the whitened values' covariance.

Defined results: rows whose vector is null, empty, or holds null or non-finite components give
no rows, nor do those with a component of 2 ** 46 or more, whose x a double could not hold; rows of
each length are a fit of their own; repeated rows and ids, null ids too, have rows of their
own; directions without variance (fewer distinct vectors than dimensions) give no components,
so a single distinct vector gives no rows; a deviation beyond a long is null. Extra columns are
ignored. The models are d * 16 numbers a length and go along with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafwerk.llm.ann import usable
from grafwerk.llm.shared import checkpoint, lean

#: Steps of a unit and the shift of x; components returned.
STEPS, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Bits of a limb and rows of a block: 2 * LIMB + log2(BLOCK) is at most 53. Bits of a digit.
LIMB, BLOCK, DIGIT = 20, 8192, 30
#: A direction with less than this share of the largest eigenvalue has no variance.
NO_VARIANCE = 1e-13
LARGEST = float(2**46)


@dataclass
class Model:
    n: int
    sums: np.ndarray  # of x, as Python integers
    largest: int  # no |x| of the fit list is larger
    axes: np.ndarray  # d x components, eigenvectors over the root of their eigenvalue
    explained: np.ndarray
    identity_error: float = 0.0


def lattice(vector: Column, steps: int = STEPS, shift: int = SHIFT) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * steps).cast("long") + shift)


def limbs(x: np.ndarray, bits: int = LIMB) -> list[np.ndarray]:
    """Matrices of doubles with x = sum of limb[k] << (bits * k); only the last has signs."""
    found = []
    while x.size and (x.max() >= 1 << bits or x.min() < -(1 << bits)):
        found.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*found, x.astype(np.float64)]


def gram(x: np.ndarray) -> np.ndarray:
    """Exact x' x of int64 rows, as Python integers."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), BLOCK):
        part = limbs(x[at : at + BLOCK])
        for p, left in enumerate(part):
            for q in range(p, len(part)):
                product = (left.T @ part[q]).astype(np.int64).astype(object)
                total += (product if p == q else product + product.T) << (LIMB * (p + q))
    return total


def _matrices(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches by length of their vectors, with the vectors as a matrix of int64."""
    for batch in batches:
        size = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(size).tolist():
            some = batch.filter(pa.array(size == d)) if (size != d).any() else batch
            yield some, some.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(some), d)


def gram_digits(fit: DataFrame) -> DataFrame:
    """d, i, j, k, value: the Gram matrix of (x, 1) of each length, as digits by position."""

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        total: dict[int, np.ndarray] = {}

        def add(d: int) -> None:
            rows = np.concatenate(held.pop(d))
            total[d] = total.get(d, 0) + gram(np.concatenate([rows, np.ones((len(rows), 1), np.int64)], 1))

        for _, x in _matrices(batches, 0):
            d = x.shape[1]
            held.setdefault(d, []).append(x)
            if sum(map(len, held[d])) >= BLOCK:
                add(d)
        for d in list(held):
            add(d)
        for d, g in total.items():
            i, j = np.triu_indices(d + 1)
            left, k = g[i, j], 0
            while (left != 0).any():
                last = bool((abs(left) < 1 << 40).all())
                value = left if last else left & ((1 << DIGIT) - 1)
                columns = [np.full(len(i), d), i, j, np.full(len(i), k), value.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["d", "i", "j", "k", "value"])
                left, k = left * 0 if last else left >> DIGIT, k + 1

    digits = fit.select("x").mapInArrow(run, "d long, i long, j long, k long, value long")
    return digits.groupBy("d", "i", "j", "k").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))


def fitted(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each length from the exact Gram matrix."""
    grams: dict[int, np.ndarray] = {}
    for d, i, j, k, value in gram_digits(fit).collect():
        g = grams.setdefault(d, np.zeros((d + 1, d + 1), object))
        g[i, j] += int(value) << (DIGIT * k)
    models = {}
    for d, g in grams.items():
        g = np.triu(g) + np.triu(g, 1).T
        n, sums = int(g[d, d]), g[d, :d]
        top = n * g[:d, :d] - np.outer(sums, sums)
        covariance = (top / (n * n)).astype(np.float64)  # Python divides integers with one rounding
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        kept = [c for c in range(min(components, d)) if values[c] > NO_VARIANCE * values[0] > 0]
        vectors = vectors[:, kept] * np.sign(vectors[np.abs(vectors[:, kept]).argmax(0), kept])
        largest = int(max(g[c, c] for c in range(d)) ** 0.5) + 1
        models[d] = Model(n, sums, largest, vectors / np.sqrt(values[kept]), values[kept] / (np.trace(covariance) or 1.0))
    return models


def centred(x: np.ndarray, model: Model) -> np.ndarray:
    """n x - S, exactly."""
    if max(model.largest, int(np.abs(x).max(initial=0))) * model.n < 1 << 61:
        return model.n * x - model.sums.astype(np.int64)
    return model.n * x.astype(object) - model.sums


def whitened(y: np.ndarray, model: Model) -> np.ndarray:
    """The projections of n x - S."""
    return (y / model.n).astype(np.float64) @ model.axes


def deviations(y: np.ndarray) -> list[int | None]:
    if y.dtype != object and (int(np.abs(y).max(initial=0)) ** 2) * y.shape[1] < 1 << 63:
        return (y * y).sum(1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in y]
    return [v if v < 1 << 63 else None for v in exact]


def measured(fit: DataFrame, models: dict[int, Model]) -> None:
    """Put the largest deviation of the fit list's whitened covariance from the identity in."""

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for _, x in _matrices(batches, 0):
            d = x.shape[1]
            w = whitened(centred(x, models[d]), models[d])
            w = np.concatenate([w, np.ones((len(w), 1))], 1)
            total[d] = total.get(d, 0) + w.T @ w
        for d, m in total.items():
            i, j = (a.ravel() for a in np.indices(m.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), pa.array(m.ravel())], names=["d", "i", "j", "value"])

    made = fit.select("x").mapInArrow(run, "d long, i long, j long, value double")
    found: dict[int, np.ndarray] = {}
    for d, i, j, value in made.groupBy("d", "i", "j").agg(F.sum("value")).collect():
        c = models[d].axes.shape[1]
        found.setdefault(d, np.zeros((c + 1, c + 1)))[i, j] = value
    for d, m in found.items():
        mean = m[-1, :-1] / models[d].n
        models[d].identity_error = float(np.abs(m[:-1, :-1] / models[d].n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0))


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, component (from 1), n, deviation, whitened, explained and identity_error, a row
    for each vector and component."""
    v = F.col(vector_col)
    held = F.coalesce(usable(v) & F.forall(v, lambda c: F.abs(c.cast("double")) < LARGEST), F.lit(False))
    xs = rows.select(F.col(id_col).cast("long").alias("id"), F.when(held, lattice(v)).alias("x")).where("x is not null")
    fit = checkpoint(xs.select("x").distinct())
    models = fitted(fit, components)
    measured(fit, models)

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, 1):
            model = models[x.shape[1]]
            y, c = centred(x, model), model.axes.shape[1]
            if not c:
                continue
            every = np.repeat(np.arange(len(x)), c)
            columns = [
                batch.column(0).take(pa.array(every)),
                pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(every), model.n)),
                pa.array(deviations(y), pa.int64()).take(pa.array(every)),
                pa.array(whitened(y, model).ravel()),
                pa.array(np.tile(model.explained, len(x))),
                pa.array(np.full(len(every), model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    made = xs.mapInArrow(run, "id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return made.withColumnRenamed("id", id_col)

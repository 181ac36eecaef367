"""Whitening of vectors with covariances by polarisation.

Components become whole numbers. For every dimension, and for the sum of every
pair of dimensions, the squares of centred values are added up exactly; half the
variance of a sum less the variances of its parts is their covariance, so sums
of squares are all that is aggregated. The covariance matrix is put together
from exact fractions, its eigenvectors give the principal components, and
scores over the root of the eigenvalue have the identity as covariance.

Tasks centre values at whole numbers near the mean, which keeps squares small;
the exact mean is taken off on the driver, in whole numbers again. What reaches
the driver is a number per pair of dimensions, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 8192  # rows of a matrix at once
SAFE = 2**62  # above this, whole numbers are added as Python integers


@dataclass(frozen=True)
class Scale:
    """How a component c becomes a whole number: floor(scale * c) + offset."""

    scale: int = 64
    offset: int = 1_000_000


@dataclass(frozen=True)
class Whitener:
    """Fit of the vectors of one length: whole-number sums, and the kept components as columns, scaled by 1 / sqrt(e)."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    explained: np.ndarray


def whole_numbers(vectors: np.ndarray, scale: Scale) -> np.ndarray:
    """Whole numbers of a matrix of doubles, as 64-bit integers, or as Python integers where those are too small."""
    floors = np.floor(scale.scale * vectors)
    if floors.size and not np.abs(floors).max() < 2**61:
        exact = [int(np.floor(x)) if np.isfinite(x) else scale.scale * int(v) for x, v in zip(floors.flat, vectors.flat)]
        floors = np.array(exact, object).reshape(vectors.shape)
        return floors + scale.offset
    return floors.astype(np.int64) + scale.offset


def _widened(values: np.ndarray, most: int) -> np.ndarray:
    """The values, as Python integers if their sums of squares may reach ``most`` times the largest square."""
    if values.dtype == object or not values.size:
        return values
    return values.astype(object) if int(np.abs(values).max()) ** 2 * most >= SAFE else values


def squares_of_pairs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(i, j, sum of (x_i + x_j)^2) for i < j, and (i, i, sum of x_i^2), exactly."""
    values = _widened(values, 4 * max(1, len(values)))
    out = []
    for i in range(values.shape[1]):
        own = values[:, i]
        out.append((i, i, int((own * own).sum())))
        both = own[:, None] + values[:, i + 1 :]
        out += [(i, i + 1 + k, int(s)) for k, s in enumerate((both * both).sum(axis=0))]
    return out


def covariances(n: int, sums: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariance matrix from sums and sums of squares of whole numbers, exact up to the last division.

    n times a sum of squares less the square of the sum is n times the sum of
    squares of centred values.
    """
    d = len(sums)
    own = [n * squares[i, i] - sums[i] ** 2 for i in range(d)]
    out = np.empty((d, d))
    for i in range(d):
        out[i, i] = float(Fraction(own[i], n * n))
        for j in range(i + 1, d):
            both = n * squares[i, j] - (sums[i] + sums[j]) ** 2
            out[i, j] = out[j, i] = float(Fraction(both - own[i] - own[j], 2 * n * n))
    return out


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors as columns by falling eigenvalue, each over the root of it, and the eigenvalues' shares.

    A direction without variance (within rounding) has a zero column and share 0.
    """
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    kept = values > max(trace, 0.0) * len(covariance) * np.finfo(float).eps
    scaled = np.where(kept, vectors / np.sqrt(np.where(kept, values, 1.0)), 0.0)
    return scaled, np.where(kept, values / (trace or 1.0), 0.0)


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``_id, _vector`` (doubles) of the rows with a vector that is neither null nor empty and holds finite numbers only."""
    finite = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(df[id_col].cast("long").alias("_id"), df[vector_col].cast("array<double>").alias("_vector"))
    return rows.filter(F.col("_vector").isNotNull() & (F.size("_vector") > 0) & finite)


def _matrices(batches: Iterator[pa.RecordBatch], scale: Scale) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, whole numbers) of the rows, apart by length of the vectors."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            vectors = batch.column("_vector")
            lengths = vectors.value_lengths().to_numpy()
            for d in np.unique(lengths):
                own = pa.array(np.flatnonzero(lengths == d))
                flat = np.asarray(vectors.take(own).flatten(), np.float64)
                yield batch.column("_id").take(own), whole_numbers(flat.reshape(-1, d), scale)


def _added(rows: DataFrame, partial, scale: Scale) -> dict[int, dict[tuple[int, int], int]]:
    """Exact sums over all rows of the entries ``partial(matrix)`` yields as (i, j, number), by length of the vectors.

    Tasks add up their own rows first; numbers travel as decimal texts in
    chunks of 15 digits, whose sums cannot overflow, and are put together on the driver.
    """
    base = 10**15

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], int] = {}
        for _, matrix in _matrices(batches, scale):
            d = matrix.shape[1]
            for i, j, number in partial(matrix):
                held[d, i, j] = held.get((d, i, j), 0) + number
        out = []
        for (d, i, j), number in held.items():
            sign, number, place = (-1 if number < 0 else 1), abs(number), 0
            while number or not place:
                number, low = divmod(number, base)
                out.append((d, i, j, place, sign * low))
                place += 1
        for first in range(0, len(out), 50_000):
            columns = list(zip(*out[first : first + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["d", "i", "j", "place", "v"])

    parts = rows.mapInArrow(task, "d long, i long, j long, place long, v long")
    total = parts.groupBy("d", "i", "j", "place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in total.collect():
        own = out.setdefault(r["d"], {})
        own[r["i"], r["j"]] = own.get((r["i"], r["j"]), 0) + int(r["v"]) * base ** r["place"]
    return out


def fit(df: DataFrame, components: int = 32, scale: Scale = Scale(), id_col: str = "vec_id", vector_col: str = "embedding") -> dict[int, Whitener]:
    """A whitener for each length of vectors, fitted on all of them (see ``whiten``)."""
    return _fit(_valid(df, id_col, vector_col), components, scale)


def _fit(rows: DataFrame, components: int, scale: Scale) -> dict[int, Whitener]:
    def counted(matrix: np.ndarray):
        wide = matrix.astype(object) if _widened(matrix, 1).dtype == object else matrix
        yield -1, -1, len(matrix)
        yield from ((i, i, int(s)) for i, s in enumerate(wide.sum(axis=0)))

    found = _added(rows, counted, scale)
    sizes = {d: own.pop((-1, -1)) for d, own in found.items()}
    sums = {d: [own[i, i] for i in range(d)] for d, own in found.items()}
    centres = {d: [(2 * s + sizes[d]) // (2 * sizes[d]) for s in sums[d]] for d in sums}

    def centred(matrix: np.ndarray):
        return squares_of_pairs(_less(matrix, centres[matrix.shape[1]]))

    out = {}
    for d, squares in _added(rows, centred, scale).items():
        near = [s - sizes[d] * c for s, c in zip(sums[d], centres[d])]  # sums of the values less the centres
        directions, explained = principal(covariances(sizes[d], near, squares), components)
        out[d] = Whitener(sizes[d], tuple(sums[d]), directions, explained)
    return out


def _less(matrix: np.ndarray, numbers) -> np.ndarray:
    """The matrix less a row of whole numbers, exactly."""
    if matrix.dtype == object or max(map(abs, numbers), default=0) >= 2**61:
        return matrix.astype(object) - np.array(numbers, object)
    return matrix - np.array(numbers, np.int64)


def deviations(matrix: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S of each entry, and each row's sum of their squares, as whole numbers."""
    largest = max([abs(s) for s in sums] + [n * int(np.abs(matrix).max())]) if matrix.size else 0
    wide = matrix.astype(object) if largest >= SAFE // 2 else matrix
    apart = wide * n - np.array(sums, wide.dtype)
    if apart.dtype != object and apart.size and int(np.abs(apart).max()) ** 2 * apart.shape[1] >= SAFE:
        squares = apart.astype(object)
    else:
        squares = apart
    return apart, (squares * squares).sum(axis=1)


def _whitened(matrix: np.ndarray, model: Whitener) -> tuple[np.ndarray, np.ndarray]:
    apart, squares = deviations(matrix, model.n, model.sums)
    return apart.astype(np.float64) / model.n @ model.directions, squares


def _identity_error(rows: DataFrame, models, scale: Scale) -> float:
    """Largest absolute entry of the covariance of whitened rows less the identity, over components that have variance."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for _, matrix in _matrices(batches, scale):
            white = np.hstack([np.ones((len(matrix), 1)), _whitened(matrix, models.value[matrix.shape[1]])[0]])
            held[matrix.shape[1]] = held.get(matrix.shape[1], 0) + white.T @ white
        for d, products in held.items():
            i, j = np.indices(products.shape)
            arrays = [np.full(products.size, d), i.ravel(), j.ravel(), products.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["d", "i", "j", "v"])

    parts = rows.mapInArrow(task, "d long, i long, j long, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    products = {d: np.zeros((m.directions.shape[1] + 1,) * 2) for d, m in models.value.items()}
    for r in parts.collect():
        products[r["d"]][r["i"], r["j"]] = r["v"]
    worst = 0.0
    for d, model in models.value.items():
        mean = products[d][0, 1:] / model.n
        kept = np.flatnonzero(model.explained > 0)
        error = products[d][1:, 1:] / model.n - np.outer(mean, mean) - np.eye(len(mean))
        worst = max(worst, float(np.abs(error[np.ix_(kept, kept)]).max(initial=0.0)))
    return worst


def whiten(
    df: DataFrame,
    components: int = 32,
    scale: Scale = Scale(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row for each vector and component.

    Left out: rows whose vector is null or empty or holds null or non-finite
    entries. Null and repeated ids are kept, each row by itself. Vectors of
    different lengths have no common covariance: those of each length are
    whitened apart, with their own n. Components are numbered from 1 by falling
    eigenvalue, as many as the vectors are long at most; along one without
    variance ``whitened`` and ``explained`` are 0, and it is no part of
    ``identity_error``, the largest over all lengths. ``deviation`` is exact, a
    decimal of 38 digits (null beyond). An empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    rows = _valid(df, id_col, vector_col)
    models = df.sparkSession.sparkContext.broadcast(_fit(rows, components, scale))
    error = _identity_error(rows, models, scale)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix in _matrices(batches, scale):
            model = models.value[matrix.shape[1]]
            white, squares = _whitened(matrix, model)
            k, rows = white.shape[1], len(matrix)
            exact = [int(s) if int(s) < 10**38 else None for s in squares]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n)),
                    pa.array(exact, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(white.ravel()),
                    pa.array(np.tile(model.explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return rows.mapInArrow(task, schema)

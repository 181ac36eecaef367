"""Least squares and ridge from sums of products.

One table of sums of products per group of rows serves every fold, penalty and
share of the rows: a training set is a sum of groups, its fit a small solve, and
its error on any other set a quadratic form in that set's sums. The rows are
read twice (location and spread, then products) however many fits are wanted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Directions whose variance is below this share of the largest carry no signal
# that sums of products in double precision could tell from rounding.
LEAST_VARIANCE = 1e-12


@dataclass(frozen=True)
class Scale:
    """Means and population deviations (1 where 0) of feature columns and label."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]


def column_scale(df: DataFrame, columns: list[str], label: str) -> Scale:
    """The scale of all rows, in one aggregation. Null, NaN or infinite values are an error, as in assembling."""
    names = (*columns, label)
    values = [F.col(f"`{c}`").cast("double") for c in names]
    finite = [v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) for v in values]
    facts = [F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")) for v in values]
    row = df.agg(F.array(*facts).alias("facts"), *[F.count_if(~ok).alias(f"bad{i}") for i, ok in enumerate(finite)]).first()
    bad = [c for i, c in enumerate(names) if row[f"bad{i}"]]
    if bad:
        raise ValueError(f"Columns with missing or infinite values: {', '.join(bad)}")
    means = tuple(0.0 if f["mean"] is None else f["mean"] for f in row["facts"])
    return Scale(names, means, tuple(f["std"] or 1.0 for f in row["facts"]))


def product_rows(df: DataFrame, scale: Scale, groups: list[str]) -> DataFrame:
    """``groups, row, p0, p1, ...``: sums of products of (1, scaled features, scaled label), a line per row of the matrix.

    Each input row is unfolded to one line per matrix row, which the partial
    aggregation folds again before the shuffle; what moves is a matrix per task
    and group, whatever the number of rows.
    """
    scaled = [
        (F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s)
        for c, m, s in zip(scale.columns, scale.means, scale.deviations)
    ]
    keys = [F.col(f"`{g}`") for g in groups]
    unfolded = df.select(*keys, F.array(F.lit(1.0), *scaled).alias("_z"))
    unfolded = unfolded.select(*keys, "_z", F.posexplode("_z").alias("row", "_value"))
    sums = [F.sum(F.col("_value") * F.col("_z")[i]).alias(f"p{i}") for i in range(len(scaled) + 1)]
    return unfolded.groupBy(*keys, "row").agg(*sums)


def product_table(df: DataFrame, scale: Scale, groups: list[str]) -> DataFrame:
    """``groups, left_column, right_column, total``: the upper triangle of every group's matrix; ``1`` names the constant."""
    names = F.array(*[F.lit(c) for c in ("1", *scale.columns)])
    wide = product_rows(df, scale, groups)
    cells = F.array(*[F.col(c) for c in wide.columns if c not in (*groups, "row")])
    long = wide.select(*groups, "row", F.posexplode(cells).alias("column", "total")).where("row <= column")
    return long.select(
        *groups, names[F.col("row")].alias("left_column"), names[F.col("column")].alias("right_column"), "total"
    )


class Products:
    """The matrices of all groups, on the driver: groups times (columns + 2) squared numbers."""

    def __init__(self, scale: Scale, matrices: dict[tuple, np.ndarray]):
        self.scale = scale
        self.matrices = matrices

    @classmethod
    def of(cls, df: DataFrame, columns: list[str], label: str, groups: list[str]) -> Products:
        """Two jobs over ``df``. The distinct groups must be few: folds, deciles and the like."""
        scale = column_scale(df, columns, label)
        width = len(columns) + 2
        matrices: dict[tuple, np.ndarray] = {}
        for line in product_rows(df, scale, groups).collect():
            matrix = matrices.setdefault(tuple(line[: len(groups)]), np.zeros((width, width)))
            matrix[line["row"]] = line[-width:]
        return cls(scale, matrices)

    def total(self, wanted) -> np.ndarray:
        """Sum of the matrices of the groups that ``wanted(group)`` accepts."""
        width = len(self.scale.columns) + 1
        # Summed in the order of the groups, so that reruns agree to the last digit.
        return sum((self.matrices[g] for g in sorted(self.matrices) if wanted(g)), np.zeros((width, width)))

    def weights(self, train: np.ndarray, alpha: float = 0.0, intercept: bool = True) -> np.ndarray:
        """Weights of (constant, features) that predict the scaled label, fitted on a training matrix.

        Features are standardised on the training rows; ``alpha`` penalises the
        squared weights of those. Collinear directions take the least-norm
        solution. Without an intercept the prediction at the features' means is
        a label of 0.
        """
        n = train[0, 0]
        if not n:
            return np.full(len(train) - 1, np.nan)
        means, label_mean = train[0, 1:-1] / n, train[0, -1] / n
        cross = train[1:-1, -1] / n - means * label_mean
        covariance = train[1:-1, 1:-1] / n - np.outer(means, means)
        variance = np.diagonal(covariance)
        # A column that is constant on these rows has nothing but rounding left.
        varies = variance > LEAST_VARIANCE * np.maximum(np.diagonal(train)[1:-1] / n, 1.0)
        spread = np.sqrt(np.where(varies, variance, 1.0))
        correlation = np.where(np.outer(varies, varies), covariance / np.outer(spread, spread), 0.0)
        values, vectors = np.linalg.eigh(correlation)
        kept = values > LEAST_VARIANCE * max(values.max(initial=0.0), 1.0)
        target = vectors[:, kept].T @ np.where(varies, cross / spread, 0.0)
        slopes = vectors[:, kept] @ (target / (values[kept] + alpha / n)) / spread
        origin = label_mean if intercept else -self.scale.means[-1] / self.scale.deviations[-1]
        return np.concatenate([[origin - slopes @ means], slopes])

    def r2(self, weights: np.ndarray, rows: np.ndarray) -> float:
        """R2 of a fit on the rows of a matrix; NaN without rows, and 1 or 0 where the label is constant."""
        n = rows[0, 0]
        if not n or np.isnan(weights).any():
            return float("nan")
        error = np.concatenate([-weights, [1.0]])
        squared = max(float(error @ rows @ error), 0.0)
        spread = rows[-1, -1] - rows[0, -1] ** 2 / n
        if spread <= LEAST_VARIANCE * max(rows[-1, -1], n):
            return 1.0 if squared <= LEAST_VARIANCE * max(rows[-1, -1], n) else 0.0
        return float(1 - squared / spread)

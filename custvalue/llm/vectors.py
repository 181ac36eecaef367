"""Helpers of the vector searches: valid vectors, and a grid of bounded blocks.

A search compares a query set with all vectors. Both sides are cut into blocks
by a hash of the id, so a block holds a bounded number of rows whatever the
data; a cell of the grid is one query block against one candidate block. Each
side is sent once per block of the other side, and every pair of a query and a
candidate meets in exactly one cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID, VECTOR, DIM = "_id", "_vector", "_dim"


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``_id``, ``_vector``, ``_dim``: one row per id.

    Left out: null ids, null or empty vectors, and vectors with a null or
    non-finite component. An id is a key: of repeated rows one is kept, the
    greatest vector in component order where they differ. Other columns,
    whatever their names, are not read.
    """
    finite = F.forall(
        VECTOR, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    rows = df.select(df[id_col].cast("long").alias(ID), df[vector_col].alias(VECTOR))
    rows = rows.filter(F.col(ID).isNotNull() & F.col(VECTOR).isNotNull() & (F.size(VECTOR) > 0) & finite)
    rows = rows.groupBy(ID).agg(F.max(VECTOR).alias(VECTOR))
    return rows.withColumn(DIM, F.size(VECTOR))


@dataclass(frozen=True)
class Grid:
    """Numbers of query blocks and candidate blocks."""

    query_blocks: int
    candidate_blocks: int


def plan_grid(queries: int, candidates: int, tasks: int, query_block: int, candidate_block: int, least: int = 2048) -> Grid:
    """Blocks of at most about the given rows, and cells enough for ``tasks`` tasks.

    Every cell may return some rows for each of its queries, so candidate blocks
    are not cut below ``least`` rows for the sake of more tasks.
    """
    a = max(1, math.ceil(queries / query_block))
    b = max(1, math.ceil(candidates / candidate_block), min(math.ceil(tasks / a), math.ceil(candidates / least)))
    return Grid(a, b)


def block_of(key: Column, blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(blocks)).cast("int")


def in_cells(
    queries: DataFrame, candidates: DataFrame, grid: Grid, fn: Callable[[pa.Table, pa.Table], Iterator | pa.Table], schema: str
) -> DataFrame:
    """``fn(queries, candidates)`` on the rows of every cell; vectors of other lengths never meet."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_a", block_of(F.col(ID), grid.query_blocks, 1)).withColumn(
        "_b", every(grid.candidate_blocks)
    )
    right = candidates.withColumn("_b", block_of(F.col(ID), grid.candidate_blocks, 2)).withColumn(
        "_a", every(grid.query_blocks)
    )
    keys = [DIM, "_a", "_b"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(fn, schema)


def matrix(table: pa.Table, column: str = VECTOR, dtype=np.float64) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    values = table.column(column).combine_chunks()
    flat = np.asarray(values.flatten(), dtype=dtype)
    return flat.reshape(len(table), -1) if len(table) else flat.reshape(0, 0)


def ids(table: pa.Table) -> np.ndarray:
    return table.column(ID).to_numpy()


def row_chunks(rows: int, columns: int, cells: int = 2_000_000) -> Iterator[slice]:
    """Slices of rows, so that a matrix of rows x columns stays under ``cells`` entries."""
    step = max(1, cells // max(1, columns))
    return (slice(i, min(rows, i + step)) for i in range(0, rows, step))

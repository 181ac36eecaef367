"""Exact top-k search by distributed histogram selection.

Every pair of a query and a candidate is scored by an integer inner product.
A first pass builds one histogram of scores per query over the whole possible
range; the bin that holds the k-th highest score becomes the range of the next
pass, until bins are one value wide. Then a last pass keeps the scores above
the k-th value, and of those equal to it the smallest ids.

Scores are never stored: each pass scores again in the cells of a grid of
bounded blocks (see ``vectors``). What leaves a cell is small: of a histogram
only the upper bins are sent that hold the cell's own k highest scores, since
the k-th value of all cells cannot lie below the k-th value of one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custvalue.llm import vectors as V
from custvalue.session import materialise

_LOW, _ABOVE = "_low", "_above"
_EMPTY = np.iinfo(np.int64).min


def scaled(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(vectors * scale)


def _scores(left: pa.Table, right: pa.Table, scale: float, exact_float: bool):
    """Chunks of (query rows, score matrix as int64 with the query's own row at the least value)."""
    query_ids, candidate_ids = V.ids(left), V.ids(right)
    kind = np.float64 if exact_float else np.int64
    q, c = (scaled(V.matrix(t), scale).astype(kind) for t in (left, right))
    for rows in V.row_chunks(len(query_ids), len(candidate_ids)):
        scores = (q[rows] @ c.T).astype(np.int64)
        scores[query_ids[rows, None] == candidate_ids[None, :]] = _EMPTY
        yield rows, scores


def _histogram(span: int, width: int, scale: float, exact_float: bool):
    bins = -(-span // width)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            low, need, ids = (left.column(x).to_numpy() for x in (_LOW, "_need", V.ID))
            for rows, scores in _scores(left, right, scale, exact_float):
                n = scores.shape[0]
                over = np.where(scores == _EMPTY, -1, scores - low[rows, None])
                inside = (over >= 0) & (over < span)
                place = over // width
                flat = (place + np.arange(n)[:, None] * bins)[inside]
                counts = np.bincount(flat, minlength=n * bins).reshape(n, bins)
                above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts  # in the bins above this one
                r, b = np.nonzero((counts > 0) & (above < need[rows, None]))
                out.append((ids[rows][r], b, counts[r, b]))
        columns = [np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out) if out else [[]] * 3)]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip((V.ID, "_bin", "_count"), columns)})

    return cell


def _select(k: int, scale: float, exact_float: bool):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            low, ids, candidates = left.column(_LOW).to_numpy(), V.ids(left), V.ids(right)
            order = np.argsort(candidates, kind="stable")
            for rows, scores in _scores(left, right.take(pa.array(order)), scale, exact_float):
                least = low[rows, None]
                equal = (scores == least) & (scores != _EMPTY)
                keep = (scores > least) | (equal & (equal.cumsum(axis=1) <= k))
                r, c = np.nonzero(keep)
                out.append((ids[rows][r], candidates[order][c], scores[r, c]))
        columns = [np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out) if out else [[]] * 3)]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), columns)})

    return cell


def _reach(vectors: DataFrame, scale: float) -> tuple[int, int]:
    """Number of vectors, and the greatest squared length of a scaled vector."""
    square = F.aggregate(V.VECTOR, F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * scale).cast("double"), 2))
    row = vectors.agg(F.count("*").alias("n"), F.max(square).alias("most")).first()
    return row["n"], row["most"] or 0.0


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    bins: int = 1024,
    query_block: int = 4096,
    candidate_block: int = 16384,
) -> DataFrame:
    """The ``k`` candidates with the highest score for each query, exactly.

    The score is the integer inner product of ``floor(scale * x)``; a query's own
    id is no candidate; ties go to the smaller id. Returns ``query_id, rank
    (from 1), vec_id, score``; a query with fewer candidates has fewer rows, and
    an empty side gives no rows. Invalid vectors (null, empty, or with a null or
    non-finite component) take no part, repeated ids count once (see
    ``vectors.valid_vectors``), and vectors of another length than the query's
    are no candidates. Lengths whose scores leave 63 bits raise ``ValueError``.
    """
    spark = candidates.sparkSession
    queries = materialise(V.valid_vectors(queries, id_col, vector_col))
    candidates = materialise(V.valid_vectors(candidates, id_col, vector_col))
    n_queries, q_most = _reach(queries, scale)
    n_candidates, c_most = _reach(candidates, scale)
    reach = int(np.ceil(np.sqrt(q_most) * np.sqrt(c_most) * (1 + 1e-9))) + 1
    if reach >= 2**62:
        raise ValueError("the scores do not fit 63 bits; lower the scale")
    exact_float = reach < 2**52
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grid = V.plan_grid(n_queries, n_candidates, tasks, query_block, candidate_block)

    state = queries.select(V.ID, F.lit(-reach).cast("long").alias(_LOW), F.lit(0).cast("long").alias(_ABOVE))
    span = 2 * reach + 1
    while span > 1:
        width = -(-span // bins)
        asked = queries.join(state.withColumn("_need", F.lit(k) - F.col(_ABOVE)), V.ID)
        counts = V.in_cells(
            asked, candidates, grid, _histogram(span, width, scale, exact_float), f"{V.ID} long, _bin long, _count long"
        )
        counts = counts.groupBy(V.ID, "_bin").agg(F.sum("_count").alias("_count"))
        down = Window.partitionBy(V.ID).orderBy(F.desc("_bin"))
        counts = counts.withColumn("_upto", F.sum("_count").over(down))
        found = (
            counts.join(state, V.ID)
            .filter(F.col("_upto") + F.col(_ABOVE) >= k)
            .groupBy(V.ID)
            .agg(
                F.max("_bin").alias("_bin"),
                F.max_by(F.col("_upto") - F.col("_count"), "_bin").alias("_over"),
            )
        )
        state = materialise(
            state.join(found, V.ID, "left").select(  # with fewer than k candidates the range stays at its lower end
                V.ID,
                (F.col(_LOW) + F.coalesce("_bin", F.lit(0)) * width).alias(_LOW),
                (F.col(_ABOVE) + F.coalesce("_over", F.lit(0))).alias(_ABOVE),
            )
        )
        span = width
    kept = V.in_cells(
        queries.join(state, V.ID), candidates, grid, _select(k, scale, exact_float), "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

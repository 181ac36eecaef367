"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index: vectors are centred on their mean and rotated by some random orthogonal
matrices; of each rotated unit residual one bit per dimension is kept (its sign),
with two scalars: the residual's length, and the inner product of the unit
residual with its unit code. Search: the inner product of a query with the
packed code, divided by the second scalar, is an unbiased estimate; the same
scalar bounds its error, which falls with the root of the number of bits, so
more rotations of a short vector leave less to rerank. In every cell of the grid (see ``vectors``) the best
estimates are reranked first, which gives the k-th exact score; then every
vector whose upper bound reaches that score is reranked. Exact scores decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custvalue.llm import vectors as V
from custvalue.session import materialise

_CODE, _LENGTH, _MATCH = "_code", "_length", "_match"
UNPACKED_BYTES = 1 << 27


def rotation(dim: int, seed: int, rotations: int = 1) -> np.ndarray:
    """Random orthogonal matrices side by side (dim x rotations * dim), scaled to keep lengths."""
    random = np.random.default_rng([seed, dim])

    def one() -> np.ndarray:
        q, r = np.linalg.qr(random.standard_normal((dim, dim)))
        return q * np.sign(np.diag(r))

    return np.concatenate([one() for _ in range(rotations)], axis=1) / np.sqrt(rotations)


def _centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector of each length: partial sums in the tasks, one number per dimension to the driver."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table.column(V.DIM).to_numpy()
            for d in np.unique(dims):
                rows = V.matrix(table.filter(pa.array(dims == d)))
                total[d] = total.get(d, 0) + np.append(rows.sum(axis=0), len(rows))
        for d, s in total.items():
            yield pa.RecordBatch.from_pydict(
                {V.DIM: pa.array([d] * (d + 1), pa.int32()), "_at": pa.array(range(d + 1), pa.int32()), "_sum": pa.array(s)}
            )

    parts = vectors.select(V.DIM, V.VECTOR).mapInArrow(sums, f"{V.DIM} int, _at int, _sum double")
    rows = parts.groupBy(V.DIM, "_at").agg(F.sum("_sum").alias("s")).collect()
    found: dict[int, np.ndarray] = {}
    for r in rows:
        found.setdefault(r[V.DIM], np.zeros(r[V.DIM] + 1))[r["_at"]] = r["s"]
    return {d: s[:-1] / s[-1] for d, s in found.items()}


def encode(vectors: DataFrame, centres: dict[int, np.ndarray], seed: int, rotations: int = 1) -> DataFrame:
    """The index: every vector with its packed code and scalars."""

    def rows(batches):
        turns = {d: rotation(d, seed, rotations) for d in centres}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table.column(V.DIM).to_numpy()
            for d in np.unique(dims):
                part = table.filter(pa.array(dims == d))
                residual = V.matrix(part) - centres[int(d)]
                length = np.sqrt((residual**2).sum(axis=1))
                turned = (residual / np.where(length > 0, length, 1)[:, None]) @ turns[int(d)]
                bits = turned >= 0
                match = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
                packed = np.packbits(bits, axis=1)
                yield pa.RecordBatch.from_pydict(
                    {
                        V.ID: part.column(V.ID).combine_chunks(),
                        V.DIM: part.column(V.DIM).combine_chunks(),
                        V.VECTOR: part.column(V.VECTOR).combine_chunks(),
                        _CODE: pa.array([x.tobytes() for x in packed], pa.binary()),
                        _LENGTH: pa.array(length),
                        _MATCH: pa.array(match),
                    }
                )

    kind = dict(vectors.dtypes)[V.VECTOR]
    schema = f"{V.ID} long, {V.DIM} int, {V.VECTOR} {kind}, {_CODE} binary, {_LENGTH} double, {_MATCH} double"
    return vectors.select(V.ID, V.DIM, V.VECTOR).mapInArrow(rows, schema)


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in the order of the components, so equal rows score equally."""
    total = np.zeros(len(left))
    for d in range(left.shape[1]):
        total += left[:, d] * right[:, d]
    return total


def signs(codes: np.ndarray, bits: int) -> np.ndarray:
    """Packed codes (a line each) as -1 and 1."""
    return np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1


def estimates(codes, length, match, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, epsilon: float):
    """Estimated inner products (queries x codes) and the bound of each error."""
    return _estimates(signs(codes, turn.shape[1]), length, match, queries, centre, turn, epsilon)


def _estimates(unpacked, length, match, queries, centre, turn, epsilon):
    bits = turn.shape[1]
    safe = np.where(match > 0, match, 1)
    factor = (length / (safe * np.sqrt(bits))).astype(np.float32)
    turned = (queries @ turn).astype(np.float32)
    estimate = (turned @ unpacked.T) * factor + (queries @ centre).astype(np.float32)[:, None]
    spread = length * np.sqrt(np.maximum(0, 1 - safe**2)) / safe * epsilon / np.sqrt(max(1, bits - 1))
    return estimate, np.sqrt((queries**2).sum(axis=1))[:, None].astype(np.float32) * spread[None, :].astype(np.float32)


def _search(k: int, first: int, epsilon: float, centres: dict[int, np.ndarray], seed: int, rotations: int):
    def rerank(q, c, rows, columns):
        out = np.empty(len(rows))
        for part in V.row_chunks(len(rows), q.shape[1]):
            out[part] = inner_products(q[rows[part]], c[columns[part]])
        return out

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            ids, candidates = V.ids(left), V.ids(right)
            order = np.argsort(candidates, kind="stable")
            right, candidates = right.take(pa.array(order)), candidates[order]
            q, c = V.matrix(left), V.matrix(right)
            d = q.shape[1]
            turn = rotation(d, seed, rotations)
            codes = np.frombuffer(b"".join(right.column(_CODE).to_pylist()), np.uint8).reshape(len(right), -1)
            unpacked = signs(codes, turn.shape[1])
            length, match = right.column(_LENGTH).to_numpy(), right.column(_MATCH).to_numpy()
            for rows in V.row_chunks(len(ids), len(candidates)):
                estimate, bound = _estimates(unpacked, length, match, q[rows], centres[d], turn, epsilon)
                own = ids[rows, None] == candidates[None, :]
                estimate[own] = -np.inf
                n = estimate.shape[0]
                take = min(first, len(candidates))
                top = np.argpartition(-estimate, take - 1, axis=1)[:, :take]
                r = np.repeat(np.arange(n), take)
                exact = rerank(q[rows], c, r, top.ravel()).reshape(n, take)
                exact[np.take_along_axis(own, top, axis=1)] = -np.inf
                kth = np.sort(exact, axis=1)[:, -min(k, take)] if take >= k else np.full(n, -np.inf)
                upper = estimate + bound
                np.put_along_axis(upper, top, np.inf, axis=1)  # reranked already: none of them is lost to a bad estimate
                r, col = np.nonzero((upper >= (kth - 1e-5 * np.abs(kth))[:, None].astype(np.float32)) & ~own)
                score = rerank(q[rows], c, r, col)
                enough = score >= kth[r]  # the cell's k-th exact score: what lies below is not among the k nearest
                r, col, score = r[enough], col[enough], score[enough]
                by = np.lexsort((candidates[col], -score, r))
                r, col, score = r[by], col[by], score[by]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                r, col, score = r[place < k], col[place < k], score[place < k]
                out.append((ids[rows][r], candidates[col], score))
        columns = [np.concatenate(x) if out else np.empty(0) for x in (zip(*out) if out else [[]] * 3)]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("query_id", "vec_id", "score"), columns, kinds)})

    return cell


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    epsilon: float = 2.5,
    first: int | None = None,
    seed: int = 7,
    rotations: int = 8,
    query_block: int = 4096,
    candidate_block: int = 16384,
) -> DataFrame:
    """The ``k`` vectors of largest inner product found for each query.

    ``epsilon`` scales the error bound in standard deviations: a vector is
    missed when its estimate errs by more. ``first`` estimates are reranked to
    find the exact score that bounds must reach (default four times ``k``).
    A code has ``rotations`` bits a dimension. Blocks of candidates shrink with
    the length of the codes, so that a block's unpacked codes stay under
    ``UNPACKED_BYTES``.
    Returns ``query_id, rank (from 1), vec_id, score``, nearest first, ties to
    the smaller id; the score is the inner product of the original vectors in
    double precision. A query's own id is no candidate; with fewer candidates
    there are fewer rows, with an empty side none. Zero vectors and invalid ones
    (null, empty, null or non-finite components) take no part, repeated ids
    count once, and vectors of another length are no candidates.
    """
    spark = vectors.sparkSession
    nonzero = F.exists(V.VECTOR, lambda x: x != 0)
    queries = materialise(V.valid_vectors(queries, id_col, vector_col).filter(nonzero))
    valid = materialise(V.valid_vectors(vectors, id_col, vector_col).filter(nonzero))
    centres = _centres(valid)
    index = materialise(encode(valid, centres, seed, rotations))
    n_queries, n_vectors = queries.count(), index.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    room = UNPACKED_BYTES // (4 * rotations * max(centres, default=1))
    candidate_block = max(1, min(candidate_block, room))
    grid = V.plan_grid(n_queries, n_vectors, tasks, query_block, candidate_block)
    search = _search(k, first or 4 * k, epsilon, centres, seed, rotations)
    found = V.in_cells(queries, index, grid, search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

"""Whitening against plain fractions and numpy, and its cases."""

import math
from fractions import Fraction

import numpy as np
import pytest

from custvalue.llm import whitening
from custvalue.llm.whitening import Scale, covariances, principal, squares_of_pairs, whiten, whole_numbers

SCHEMA = "vec_id long, embedding array<double>"


def brute(vectors, scale=Scale()):
    """(n, x, sums, exact covariance matrix as fractions) by the definition."""
    x = [[math.floor(scale.scale * c) + scale.offset for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    cov = [[Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3) for j in range(d)] for i in range(d)]
    return n, x, sums, cov


def vectors_of(rng, n, d):
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d))).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_polarised_covariances_are_exact(seed):
    rng = np.random.default_rng(seed)
    n, x, _, cov = brute(vectors_of(rng, 37, 5))
    centre = [round(sum(r[i] for r in x) / n) for i in range(5)]
    y = np.array(x) - np.array(centre)
    squares = {(i, j): s for i, j, s in squares_of_pairs(y)}
    assert squares == {(i, j): sum(int(r[i] + (r[j] if j > i else 0)) ** 2 for r in y) for i in range(5) for j in range(i, 5)}
    got = covariances(n, [int(s) for s in y.sum(axis=0)], squares)
    assert got.tolist() == [[float(c) for c in row] for row in cov]


def test_sums_beyond_64_bits():
    y = np.array([[2**40, -(2**41)], [2**42, 3]])
    assert {(i, j): s for i, j, s in squares_of_pairs(y)} == {
        (0, 0): 2**80 + 2**84, (0, 1): 2**80 + (2**42 + 3) ** 2, (1, 1): 2**82 + 9
    }
    assert whole_numbers(np.array([[1e30, -0.01]]), Scale())[0].tolist() == [64 * int(1e30) + 10**6, 10**6 - 1]


def test_whole_result_on_random_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = vectors_of(rng, 300, 6)
    n, x, sums, cov = brute(vectors)
    rows = whiten(spark.createDataFrame(list(enumerate(vectors)), SCHEMA).repartition(5), components=4).collect()
    values, axes = np.linalg.eigh(np.array(cov, float))
    assert len(rows) == 300 * 4
    white = np.zeros((300, 4))
    for r in rows:
        assert r["n"] == n and int(r["deviation"]) == sum((n * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums))
        assert r["explained"] == pytest.approx(values[-r["component"]] / values.sum(), rel=1e-9)
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
    want = (np.array(x) - np.array(sums) / n) @ axes[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    assert np.allclose(np.abs((white * want).sum(axis=0)), (want * want).sum(axis=0))  # either sign
    errors = {r["identity_error"] for r in rows}
    real = np.abs(np.cov(white.T, bias=True) - np.eye(4)).max()
    assert len(errors) == 1 and max(errors) < 1e-9 and real < 1e-9


def test_constant_and_dependent_dimensions(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 60 and {r["identity_error"] < 1e-9 for r in got} == {True}
    shares = {r["component"]: r["explained"] for r in got}
    assert shares[1] == pytest.approx(1) and shares[2] == shares[3] == 0
    assert {r["whitened"] for r in got if r["component"] > 1} == {0.0}
    alone = whiten(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r["component"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [
        (1, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0)
    ]


def test_left_out_repeated_and_null_ids_and_lengths(spark):
    rows = [
        (1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]),
        (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 4.0]), (10, [2.0, 2.0, 5.0]),
    ]
    df = spark.createDataFrame([(*r, 0.0, "x") for r in rows], SCHEMA + ", n double, whitened string")
    got = whiten(df).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in got) == sorted(
        [("1", c, 3) for c in (1, 1, 2, 2)] + [("None", c, 3) for c in (1, 2)] + [(i, c, 2) for i in ("9", "10") for c in (1, 2, 3)]
    )


def test_empty_table(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_principal_is_in_falling_order():
    directions, shares = principal(np.diag([1.0, 9.0, 4.0]), 2)
    assert np.allclose(np.abs(directions), [[0, 0], [1 / 3, 0], [0, 1 / 2]]) and np.allclose(shares, [9 / 14, 4 / 14])


def test_registered_query_on_the_given_vectors(spark):
    from custvalue.llm import queries as Q

    folder = "/root/testdata/sf0.001"
    vectors = [r["embedding"] for r in Q.table(spark, folder, "embeddings").orderBy("vec_id").collect()]
    n, x, sums, _ = brute(vectors)
    cov = np.cov(np.array(x, float).T, bias=True)
    got = Q.op11_whitening(spark, folder).collect()
    assert len(got) == n * 32 and whitening.ROWS > 0
    values = np.linalg.eigvalsh(cov)[::-1]
    for r in got[::101]:
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-6)
    assert max(r["identity_error"] for r in got) < 1e-8

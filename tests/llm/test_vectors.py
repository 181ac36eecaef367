"""Exact top-k and approximate neighbours against brute force."""

import math

import numpy as np
import pytest

from custvalue.llm import ann, topk
from custvalue.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, score string, _a int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


def random_vectors(n, d, seed, scale=1.0):
    v = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32) * scale / math.sqrt(d)
    return [(i, [float(x) for x in row]) for i, row in enumerate(v)]


def ranked(rows):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows)


def slow(queries, candidates, k, score):
    out = []
    for q, a in queries:
        found = sorted((-score(a, b), c) for c, b in candidates if c != q and len(a) == len(b))[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found)]
    return sorted(out)


def integer_score(a, b):
    return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))


@pytest.mark.parametrize("bins,blocks", [(1024, (4096, 16384)), (7, (9, 20))])
def test_top_k_equals_brute_force_with_ties_and_copies(spark, bins, blocks):
    rows = random_vectors(150, 6, 1)
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # a very common vector
    rows += [(300, [0.0] * 6), (301, [0.0] * 6)]
    df = table(spark, rows)
    queries = [r for r in rows if r[0] % 50 == 0]
    got = topk.top_k(df.filter("vec_id % 50 = 0"), df, 5, bins=bins, query_block=blocks[0], candidate_block=blocks[1])
    assert ranked(got.collect()) == slow(queries, rows, 5, integer_score)


def test_top_k_of_few_null_and_broken_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (6, []),
        (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (1, [0.25, 0.5]), (50, [-1.0, 0.0]),
    ]
    df = table(spark, rows)
    good = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (7, [1.0, 2.0, 3.0]), (50, [-1.0, 0.0])]
    got = topk.top_k(df.filter("vec_id % 50 = 0"), df, 5)
    assert ranked(got.collect()) == slow([good[0], good[3]], good, 5, integer_score)
    assert topk.top_k(df.filter("false"), df, 5).collect() == []
    assert topk.top_k(df, df.filter("false"), 5).collect() == []
    with pytest.raises(ValueError):
        topk.top_k(table(spark, [(0, [1e30])]), table(spark, [(1, [1e30])]), 1)


def test_large_scores_stay_exact(spark):
    rows = [(i, [float(2**20 + i), 1.0]) for i in range(12)]
    df = table(spark, rows)
    got = topk.top_k(df.filter("vec_id = 0"), df, 3)
    assert ranked(got.collect()) == slow(rows[:1], rows, 3, integer_score)


def test_one_bit_estimates_are_close_and_bounded():
    rng = np.random.default_rng(2)
    d = 64
    v = rng.normal(size=(500, d)) / math.sqrt(d) + 0.1
    q = rng.normal(size=(20, d)) / math.sqrt(d)
    centre, turn = v.mean(axis=0), ann.rotation(d, 3)
    assert np.allclose(turn @ turn.T, np.eye(d))
    residual = v - centre
    length = np.linalg.norm(residual, axis=1)
    turned = residual / length[:, None] @ turn
    codes = np.packbits(turned >= 0, axis=1)
    estimate, bound = ann.estimates(codes, length, np.abs(turned).sum(1) / math.sqrt(d), q, centre, turn, 2.5)
    error = np.abs(estimate - q @ v.T)
    assert (error <= bound).mean() > 0.97 and abs((estimate - q @ v.T).mean()) < 0.01


def test_neighbours_recall_against_brute_force(spark):
    rows = random_vectors(1500, 32, 4)
    rows += [(2000 + i, rows[20][1]) for i in range(60)]
    df = table(spark, rows)
    got = ann.nearest(df.filter("vec_id % 20 = 0"), df, 20, query_block=64, candidate_block=400).collect()
    queries = [r for r in rows if r[0] % 20 == 0]
    dot = lambda a, b: float(sum(np.float64(np.float32(x)) * np.float64(np.float32(y)) for x, y in zip(a, b)))
    want = slow(queries, rows, 20, dot)
    found = {(q, c): s for q, _, c, s in ranked(got)}
    exact = {(q, c): s for q, _, c, s in want}
    assert len(got) == len(want)
    assert len(found.keys() & exact.keys()) >= 0.95 * len(exact)
    assert all(found[k] == exact[k] for k in found.keys() & exact.keys())
    places = [(q, -s, c) for q, r, c, s in ranked(got)]
    assert places == sorted(places)


def test_neighbours_of_few_and_broken_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, [2.0, 0.0]), (6, [2.0, 0.0])]
    df = table(spark, rows)
    got = ann.nearest(df.filter("vec_id % 20 = 0"), df, 20).collect()
    assert ranked(got) == [(0, 1, 6, 2.0), (0, 2, 1, 0.5)]
    assert ann.nearest(df, df.filter("false"), 3).collect() == []
    assert ann.nearest(table(spark, [(0, [3.0])]), table(spark, [(0, [3.0])]), 3).collect() == []


def test_blocks_follow_the_data():
    assert V.plan_grid(0, 0, 8, 100, 100) == V.Grid(1, 1)
    assert V.plan_grid(1000, 10**6, 8, 100, 10**4) == V.Grid(10, 100)
    assert V.plan_grid(10, 10_000, 200, 100, 10**5) == V.Grid(1, 5)


def test_no_neighbour_is_lost_to_a_bad_estimate(spark):
    rows = random_vectors(300, 4, 9)  # codes of four bits estimate badly
    df = table(spark, rows)
    got = ann.nearest(df.filter("vec_id % 20 = 0"), df, 20, epsilon=0.0, candidate_block=100).collect()
    counts = {}
    for r in got:
        counts[r["query_id"]] = counts.get(r["query_id"], 0) + 1
    assert counts == {i: 20 for i in range(0, 300, 20)}


def test_bounds_leave_little_to_rerank():
    """On the given vectors: the share whose upper bound reaches the k-th score, and the nearest among them."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    ids, v = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), dtype=float)
    q = v[ids % 20 == 0]
    exact = q @ v.T
    kth = np.sort(exact, axis=1)[:, -20:][:, :1]
    share, recall = {}, {}
    centre = v.mean(axis=0)
    length = np.linalg.norm(v - centre, axis=1)
    for rotations in (1, 8):
        turn = ann.rotation(v.shape[1], 7, rotations)
        assert np.allclose(turn @ turn.T, np.eye(v.shape[1]))  # lengths are kept
        turned = (v - centre) / length[:, None] @ turn
        match = np.abs(turned).sum(axis=1) / math.sqrt(turn.shape[1])
        estimate, bound = ann.estimates(np.packbits(turned >= 0, axis=1), length, match, q, centre, turn, 2.5)
        chosen, near = estimate + bound >= kth, exact >= kth
        share[rotations], recall[rotations] = chosen.mean(), (chosen & near).sum() / near.sum()
    assert min(recall.values()) >= 0.99
    assert share[8] < 0.1 + 20 / len(v) < share[1]


def test_blocks_shrink_with_long_codes(spark, monkeypatch):
    rows = random_vectors(200, 16, 12)
    df = table(spark, rows)
    want = ranked(ann.nearest(df.filter("vec_id % 20 = 0"), df, 5, epsilon=6.0).collect())
    monkeypatch.setattr(ann, "UNPACKED_BYTES", 4 * 8 * 16 * 50)  # fifty candidates a block
    assert ranked(ann.nearest(df.filter("vec_id % 20 = 0"), df, 5, epsilon=6.0).collect()) == want

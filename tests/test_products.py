"""Fits from sums of products against direct least squares, and staged ensembles against separate ones."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from custvalue.config import LinearParams, Settings, settings_from
from custvalue.operators import models
from custvalue.operators.prepare import with_contiguous_fold, with_fold
from custvalue.operators.products import Products, column_scale, product_table

COLUMNS = ["a", "b", "c", "twice"]
FOLDS = 4


@pytest.fixture(scope="module")
def data(spark):
    """Columns of very different size, one that repeats another, and a label far from zero."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        a, b, c = rng.gauss(1e5, 3e4), rng.gauss(0, 1e-3), rng.random()
        rows.append((str(i), a, b, c, 2 * a + 1, 7000 + 0.01 * a + 4000 * b + 90 * c + rng.gauss(0, 60)))
    schema = "CustomerID string, a double, b double, c double, twice double, y double"
    cached = spark.createDataFrame(rows, schema).persist()
    yield cached
    cached.unpersist()


@pytest.fixture(scope="module")
def arrays(data):
    draw = F.conv(F.substring(F.md5(F.concat("CustomerID", F.lit("|curve"))), 1, 8), 16, 10).cast("bigint") % 1000
    rows = np.array(
        [tuple(r) for r in with_fold(data, FOLDS).select(*COLUMNS, "y", "fold", draw).collect()], dtype=float
    )
    return rows[:, :4], rows[:, 4], rows[:, 5].astype(int), rows[:, 6]


def direct_r2(x, y, train, held_out, alpha=0.0, intercept=True):
    """Least squares on standardised columns, by numpy's own solver on the rows themselves."""
    mean, spread = x[train].mean(0), x[train].std(0)
    z = (x - mean) / spread
    penalty = np.sqrt(alpha) * np.eye(x.shape[1])
    shift = y[train].mean()
    beta = np.linalg.lstsq(
        np.vstack([z[train], penalty]), np.concatenate([y[train] - shift, np.zeros(x.shape[1])]), rcond=1e-10
    )[0]
    got = z[held_out] @ beta + (shift if intercept else 0.0)
    rest = y[held_out]
    return 1 - ((rest - got) ** 2).sum() / ((rest - rest.mean()) ** 2).sum()


@pytest.mark.parametrize("intercept", [True, False])
def test_folds_equal_least_squares(data, arrays, intercept):
    x, y, fold, _ = arrays
    settings = Settings(linear=LinearParams(fit_intercept=intercept))
    got = models.cross_validate("linear_regression", data, COLUMNS, "y", FOLDS, settings).orderBy("fold").collect()
    for row in got:
        held_out = fold == row["fold"]
        assert row["rows"] == held_out.sum()
        assert row["r2"] == pytest.approx(direct_r2(x, y, ~held_out, held_out, intercept=intercept), rel=1e-8)


def test_ridge_grid_equals_least_squares(data, arrays):
    x, y, fold, _ = arrays
    grid = {"alpha": [0.01, 1.0, 100.0]}
    found = models.grid_scores("ridge", data, COLUMNS, "y", grid, folds=FOLDS)
    for params, scores in zip(found.candidates, found.scores):
        for k, r2 in enumerate(scores):
            assert r2 == pytest.approx(direct_r2(x, y, fold != k, fold == k, params["alpha"]), rel=1e-8)
    assert found.best == int(np.argmax([np.mean(s) for s in found.scores]))


def test_learning_curve_equals_least_squares(data, arrays):
    x, y, fold, draw = arrays
    curve = models.learning_curve("linear_regression", data, COLUMNS, "y", folds=FOLDS, fractions=(0.3, 1.0)).collect()
    for row in curve:
        parts = [(fold != k) & (draw < 1000 * row["fraction"]) for k in range(FOLDS)]
        assert row["rows"] == np.mean([p.sum() for p in parts])
        assert row["train_mean"] == pytest.approx(np.mean([direct_r2(x, y, p, p) for p in parts]), rel=1e-8)
        tests = [direct_r2(x, y, p, fold == k) for k, p in enumerate(parts)]
        assert row["test_mean"] == pytest.approx(np.mean(tests), rel=1e-8)


def test_table_of_products(data, arrays):
    x, y, fold, _ = arrays
    values = np.column_stack([x, y])
    z = np.column_stack([np.ones(len(y)), (values - values.mean(0)) / values.std(0)])
    names = ["1", *COLUMNS, "y"]
    table = product_table(with_fold(data, FOLDS), column_scale(data, COLUMNS, "y"), ["fold"]).collect()
    assert len(table) == FOLDS * 21
    for r in table:
        part = z[fold == r["fold"]]
        want = part[:, names.index(r["left_column"])] @ part[:, names.index(r["right_column"])]
        assert r["total"] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_missing_values_are_an_error(data):
    holes = data.withColumn("b", F.when(F.col("CustomerID") != "3", F.col("b")))
    with pytest.raises(ValueError, match="b"):
        models.cross_validate("linear_regression", holes, COLUMNS, "y")


def test_empty_and_constant_tables(data):
    none = Products.of(with_fold(data.limit(0)), COLUMNS, "y", ["fold"])
    nothing = none.total(lambda group: True)
    assert np.isnan(none.r2(none.weights(nothing), nothing))
    flat = data.withColumns({"a": F.lit(3.0), "y": F.lit(9.0)})
    products = Products.of(with_fold(flat), COLUMNS, "y", ["fold"])
    rows = products.total(lambda group: True)
    assert products.r2(products.weights(rows), rows) == 1.0


@pytest.fixture(scope="module")
def vectors(data):
    labelled = data.select(*COLUMNS, F.col("y").alias("label"))
    ready = Pipeline(stages=models.preparation(COLUMNS)).fit(labelled).transform(labelled)
    cached = ready.select("features", "label").persist()
    yield cached
    cached.unpersist()


@pytest.mark.parametrize("row_sample", [1.0, 0.7])
def test_boosting_prefix_equals_a_shorter_fit(vectors, row_sample):
    def fit(rounds):
        return GBTRegressor(maxIter=rounds, maxDepth=2, subsamplingRate=row_sample, seed=42).fit(vectors)

    staged = models.staged_r2(fit(9), vectors, [9, 2, 5, 5])
    for rounds in (2, 5, 9):
        assert staged[rounds] == pytest.approx(models._r2_and_rows(fit(rounds).transform(vectors))[0], rel=1e-12)


def test_forest_prefix_is_the_mean_of_its_trees(vectors):
    forest = RandomForestRegressor(numTrees=6, maxDepth=3, seed=42).fit(vectors)
    rows = vectors.collect()
    y = np.array([r["label"] for r in rows])
    votes = np.array([[tree.predict(r["features"]) for tree in forest.trees] for r in rows])
    for stage, r2 in models.staged_r2(forest, vectors, [1, 4, 6]).items():
        got = votes[:, :stage].mean(1)
        assert r2 == pytest.approx(1 - ((y - got) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-10)
    with pytest.raises(ValueError):
        models.staged_r2(forest, vectors, [7])


def test_grid_of_ensembles_keeps_the_order_of_candidates(data):
    grid = {"rounds": [1, 6], "depth": [2], "rate": [0.1, 0.5]}
    found = models.grid_scores("gradient_boosting", data, COLUMNS, "y", grid, folds=2)
    assert [(c["rounds"], c["rate"]) for c in found.candidates] == [(1, 0.1), (1, 0.5), (6, 0.1), (6, 0.5)]
    # A first round has weight 1 whatever the rate.
    assert found.scores[0] == pytest.approx(found.scores[1])
    assert found.best == 3 and all(len(s) == 2 for s in found.scores)


def test_split_size_of_the_settings_sets_the_leaf_size():
    settings = settings_from({"models": {"random_forest": {"min_samples_split": 9, "min_samples_leaf": 2}}})
    assert models.estimator("random_forest", settings).getMinInstancesPerNode() == 5
    assert models.estimator("random_forest").getMinInstancesPerNode() == 2
    assert models._tuned("random_forest", {"min_split": 9, "min_leaf": 2}, 0.0, 0).getMinInstancesPerNode() == 5


@pytest.mark.parametrize("rows", [0, 1, 3, 5, 23])
def test_contiguous_folds_are_runs_of_the_ids(spark, rows):
    ids = [f"{i:03d}" for i in range(rows)]
    table = spark.createDataFrame([(c, "x") for c in reversed(ids)], "CustomerID string, other string")
    got = {r["CustomerID"]: r["fold"] for r in with_contiguous_fold(table, 5).collect()}
    want = {c: k for k, part in enumerate(np.array_split(ids, 5)) for c in part.tolist()} if rows else {}
    assert got == want


def test_contiguous_folds_of_models(data):
    got = models.cross_validate("linear_regression", data, COLUMNS, "y", FOLDS, contiguous=True).orderBy("fold").collect()
    table = np.array([tuple(r) for r in data.orderBy("CustomerID").select(*COLUMNS, "y").collect()])
    x, y = table[:, :4], table[:, 4]
    fold = np.repeat(np.arange(FOLDS), len(y) // FOLDS)
    assert [r["r2"] for r in got] == pytest.approx([direct_r2(x, y, fold != k, fold == k) for k in range(FOLDS)], rel=1e-8)

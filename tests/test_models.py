import contextlib
import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from custvalue import session
from custvalue.config import BoostingParams, ForestParams, Settings
from custvalue.operators import metrics, models, scoring, segments
from custvalue.operators.segments import PREDICTION
from custvalue.plans import queries
from custvalue.session import freeing_disk

QUICK = Settings(forest=ForestParams(trees=5, depth=4), boosting=BoostingParams(rounds=5, depth=3))
COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        a, b, c = rng.gauss(0, 1), rng.gauss(5, 3), rng.random()
        rows.append((str(i), a, b, c, 500 + 40 * a + 9 * b + rng.gauss(0, 1)))
    cached = spark.createDataFrame(rows, "CustomerID string, a double, b double, c double, y double").persist()
    yield cached
    cached.unpersist()


@pytest.fixture(scope="module")
def training(data):
    return models.train_all_models(data, COLUMNS, "y", settings=QUICK)


def test_all_models_train_and_the_best_is_linear(spark, training):
    assert set(training.models) == set(models.MODELS)
    assert training.best.name == "linear_regression"
    assert training.best.val_r2 > 0.99
    summary = models.training_summary(spark, training.models)
    assert summary.count() == 3
    assert models.best_of_summary(summary).first()["Best_Model"] == "linear_regression"


def test_unknown_model(data):
    with pytest.raises(ValueError):
        models.train_model("perceptron", data, COLUMNS, "y")


def test_known_alias(data):
    model = models.train_model("xgboost", data, COLUMNS, "y", settings=QUICK)
    assert model.name == "gradient_boosting" and model.val_r2 is None


def test_failing_model_is_left_out(data):
    bad = Settings(forest=ForestParams(trees=0))
    got = models.train_all_models(data, COLUMNS, "y", names=("linear_regression", "random_forest"), settings=bad)
    assert list(got.models) == ["linear_regression"]


def test_failing_models_are_named(data):
    bad = Settings(forest=ForestParams(trees=0))
    got = models.train_all_models(data, COLUMNS, "y", names=("linear_regression", "random_forest"), settings=bad)
    assert list(got.failed) == ["random_forest"]
    with pytest.raises(RuntimeError, match="random_forest"):
        got.complete()
    whole = models.train_all_models(data, COLUMNS, "y", names=("linear_regression",))
    assert whole.complete() is whole


def test_a_job_that_fails_ends_the_training(data):
    broken = data.withColumn("b", F.when(F.col("CustomerID") == "7", F.raise_error(F.lit("lost"))).otherwise(F.col("b")))
    with pytest.raises(Exception, match="lost"):
        models.train_all_models(broken, COLUMNS, "y", names=("linear_regression",))
    nulls = data.withColumn("b", F.when(F.col("CustomerID") != "7", F.col("b")))
    with pytest.raises(Exception, match="null"):
        models.train_all_models(nulls, COLUMNS, "y", names=("linear_regression", "random_forest"), settings=QUICK)


@pytest.mark.parametrize("query", [queries.train_summary, queries.model_evaluation, queries.feature_importance])
def test_queries_fail_with_a_model(spark, data, monkeypatch, query):
    rows = data.withColumnRenamed("y", "Monetary")
    monkeypatch.setattr(queries, "_matrix", lambda *_: (rows, COLUMNS, rows))
    fitted = models.estimator
    bad = Settings(forest=ForestParams(trees=0), boosting=QUICK.boosting)
    monkeypatch.setattr(models, "estimator", lambda name, *_: fitted(name, bad))
    with pytest.raises(RuntimeError, match="random_forest"):
        query(spark, "")


def test_validation_score_of_zero_counts():
    zero = models.TrainedModel("z", None, [], "y", train_r2=0.99, val_r2=0.0)
    small = models.TrainedModel("s", None, [], "y", train_r2=0.1, val_r2=0.1)
    assert models.best_model({"z": zero, "s": small}) is small


def test_linear_coefficients_match_least_squares(data, training):
    train, _ = models.split(data, 0.2, 42)
    rows = np.array([tuple(r) for r in train.select(*COLUMNS, "y").collect()])
    design = np.column_stack([np.ones(len(rows)), rows[:, :3]])
    beta = np.linalg.lstsq(design, rows[:, 3], rcond=None)[0]
    test = np.array([tuple(r) for r in training.test.select(*COLUMNS).orderBy("CustomerID").collect()])
    got = training.best.predictions(training.test).orderBy("CustomerID").select("prediction").collect()
    assert [r[0] for r in got] == pytest.approx(list(beta[0] + test @ beta[1:]), rel=1e-6)


@pytest.mark.parametrize("alpha", [0.1, 100.0])
def test_ridge_matches_closed_form(data, alpha):
    tuned = models.tune("ridge", data, COLUMNS, "y", grid={"alpha": [alpha]}, folds=2).model
    rows = np.array([tuple(r) for r in data.select(*COLUMNS, "y").orderBy("CustomerID").collect()])
    x = (rows[:, :3] - rows[:, :3].mean(0)) / rows[:, :3].std(0)
    y = rows[:, 3] - rows[:, 3].mean()
    beta = np.linalg.solve(x.T @ x + alpha * np.eye(3), x.T @ y)
    got = tuned.predictions(data).orderBy("CustomerID").select("prediction").collect()
    assert [r[0] for r in got] == pytest.approx(list(rows[:, 3].mean() + x @ beta), rel=1e-6)


def test_feature_importance(spark, training):
    for model in training.models.values():
        table = models.feature_importance(spark, model, top_n=2).collect()
        assert len(table) == 2
        assert table[0]["Importance"] >= table[1]["Importance"]
        whole = models.feature_importance(spark, model).agg(F.sum("Importance_Normalized")).first()[0]
        assert whole == pytest.approx(100)


def test_cross_validation(data):
    scores = models.cross_validate("linear_regression", data, COLUMNS, "y", folds=3)
    assert scores.count() == 3
    row = models.cv_summary(scores).first()
    assert row["min"] <= row["mean"] <= row["max"] and row["scoring"] == "r2"


def test_grid_search_picks_the_best_mean(data):
    got = models.tune("random_forest", data, COLUMNS, "y", grid={"trees": [3], "depth": [1, 5]}, folds=2)
    best = got.results.first()
    assert got.best_params == {"trees": 3, "depth": 5}
    assert best["mean_r2"] == pytest.approx(got.best_score)
    assert got.model.name == "random_forest_tuned"


def test_learning_curve(data):
    curve = models.learning_curve("linear_regression", data, COLUMNS, "y", folds=2, fractions=(0.5, 1.0))
    rows = {r["fraction"]: r for r in curve.collect()}
    assert rows[0.5]["rows"] < rows[1.0]["rows"] == 150


def test_save_and_load(spark, data, training, tmp_path):
    paths = models.save_all_models(spark, training.models, str(tmp_path))
    assert len(paths) == 3
    best = models.save_named(spark, training.models, path=str(tmp_path / "best"))
    loaded = models.load_model(spark, best)
    assert loaded.name == training.best.name and loaded.medians == training.best.medians
    left = scoring.predict(training.best, data).orderBy("CustomerID").collect()
    right = scoring.predict(loaded, data).orderBy("CustomerID").collect()
    assert left == right
    with pytest.raises(ValueError):
        models.save_named(spark, training.models, "absent")
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, str(tmp_path / "absent"))


def test_model_info(training):
    assert models.model_info(None) == {"status": "No model loaded"}
    info = models.model_info(training.models["random_forest"])
    assert info["n_features"] == 3 and info["n_estimators"] == 5 and info["has_scaler"]


# --- scoring ---------------------------------------------------------------


def test_predict_needs_a_model(data):
    with pytest.raises(ValueError):
        scoring.predict(None, data)


def test_predictions_are_not_negative(data, training):
    low = data.withColumn("a", F.lit(-1000.0))
    assert scoring.predict(training.best, low).agg(F.max(PREDICTION)).first()[0] == 0.0


def test_absent_columns_are_filled(data, training):
    model = training.best
    part = data.select("CustomerID", "a", "b")
    zero = scoring.align_features(part, model).first()
    median = scoring.align_features(part, model, fill="median").first()
    assert zero["c"] == 0.0 and median["c"] == pytest.approx(model.medians["c"])
    with pytest.raises(ValueError):
        scoring.align_features(part, model, fill="mean")


def test_interval(data, training):
    rows = scoring.predict_with_interval(training.best, data, confidence=0.9, rmse=2.0).collect()
    for r in rows:
        assert r["Upper_Bound"] - r[PREDICTION] == pytest.approx(1.6448536269514722 * 2)
        assert r["Lower_Bound"] >= 0


def test_scored_customers(data, training):
    rows = scoring.score_customers(training.best, data).collect()
    assert len(rows) == 300
    sizes = {}
    for r in rows:
        sizes[r["CLV_Segment"]] = sizes.get(r["CLV_Segment"], 0) + 1
    assert sizes == {"Low": 60, "Medium-Low": 60, "Medium": 60, "Medium-High": 60, "High": 60}
    assert max(r["CLV_Percentile"] for r in rows) == 100


def test_uploaded_form_and_insights(data, training):
    upload = data.select("CustomerID", F.col("a").cast("string").alias("a"), "b")
    assert scoring.score_uploaded(training.best, upload).count() == 300
    insights = scoring.customer_insights(training.best, data).first()
    assert insights["Model_Used"] == "linear_regression" and len(insights["Recommendations"]) == 3
    form = scoring.form_insights(training.best, upload.withColumn("a", F.col("a").cast("double")), data)
    assert form.count() == 300
    assert form.where("Share_Below IS NULL").isEmpty()


def test_segments_without_ids_and_with_other_counts(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 31)], f"{PREDICTION} double")
    got = segments.segment_customers(df, n_segments=3).collect()
    assert {r["CustomerID"] for r in got} == {f"Customer_{i}" for i in range(30)}
    assert {r["CLV_Segment"] for r in got} == {"Segment_1", "Segment_2", "Segment_3"}
    assert {r["Segment_Size"] for r in got} == {10}


def test_collapsed_edges_raise_unless_ranked(spark):
    rows = [(str(i), 7.0 if i % 2 else float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, f"CustomerID string, {PREDICTION} double")
    with pytest.raises(ValueError):
        segments.segment_customers(df)
    got = segments.segment_customers(df, ties="rank")
    assert {r["count"] for r in got.groupBy("CLV_Segment").count().collect()} == {8}


def test_unknown_segment_gets_the_default_advice(spark):
    df = spark.createDataFrame([("1", "Other")], "CustomerID string, CLV_Segment string")
    row = segments.with_recommendations(df).first()
    assert (row["Strategy"], row["Priority"], row["Recommended_Actions"]) == (
        "General Engagement",
        "Medium",
        "Standard engagement",
    )
    assert segments.with_short_actions(df).first()["Recommendations"] == ["General engagement recommended"]
    assert segments.with_short_actions(df, form=True).first()["Recommendations"] == []


# --- metrics ---------------------------------------------------------------


def pairs(spark, *rows):
    return spark.createDataFrame(
        [("m", str(i), float(y), p) for i, (y, p) in enumerate(rows)],
        "model string, CustomerID string, label double, prediction double",
    )


def test_metrics_by_hand(spark):
    row = metrics.regression_metrics(pairs(spark, (0, 1.0), (2, 2.0), (4, 3.0), (6, 10.0))).first()
    assert row["MAE"] == 1.5
    assert row["MSE"] == 4.5 and row["RMSE"] == pytest.approx(math.sqrt(4.5))
    assert row["R2"] == pytest.approx(1 - 18 / 20)
    assert row["Explained_Variance"] == pytest.approx(1 - 3.5 / 5)
    assert row["Max_Error"] == 4 and row["MedAE"] == 1
    assert row["MAPE"] == pytest.approx(100 * (0 + 0.25 + 4 / 6) / 3)
    assert row["Mean_Residual"] == -1 and row["Std_Residual"] == pytest.approx(math.sqrt(3.5))


def test_metrics_of_constant_and_broken_predictions(spark):
    exact = metrics.regression_metrics(pairs(spark, (5, 5.0), (5, 5.0))).first()
    assert exact["R2"] == 1.0 and exact["MAPE"] == 0
    off = metrics.regression_metrics(pairs(spark, (5, float("nan")), (5, float("inf")))).first()
    assert off["R2"] == 0.0 and off["MAE"] == 5.0
    assert metrics.regression_metrics(pairs(spark, (0, 1.0))).first()["MAPE"] is None


def test_residuals_of_few_rows(spark):
    row = metrics.residual_analysis(pairs(spark, (1, 0.0), (2, 0.0))).first()
    assert row["skewness"] is None and row["kurtosis"] is None and row["median"] == 1.5
    three = metrics.residual_analysis(pairs(spark, (1, 0.0), (2, 0.0), (6, 0.0))).first()
    assert three["skewness"] == pytest.approx(1.4578630522953287) and three["kurtosis"] is None


def test_normal_ppf_matches_the_standard_library(spark):
    from statistics import NormalDist

    ps = [1e-12, 1e-5, 0.01, 0.07, 0.3, 0.5, 0.8, 0.975, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(metrics.normal_ppf(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-12)


def test_compare_models(training):
    table = models.compare_models(training.models, training.test).collect()
    assert [r["R2"] for r in table] == sorted((r["R2"] for r in table), reverse=True)
    assert table[0]["model"] == "linear_regression"
    one = models.evaluate_model(training.best, training.test).first()
    assert one["MAE"] == pytest.approx(table[0]["MAE"])
    assert metrics.report(models.evaluation_rows(training.models, training.test)).count() == 3


def test_large_forests_are_fitted_in_few_partitions():
    def tasks(name, trees, depth, rows, cores=12):
        return models.tasks_for(name, trees, depth, 53, rows, cores)

    assert tasks("random_forest", 100, 10, 700_000) == 9  # each sends the statistics of all nodes
    assert tasks("random_forest", 100, 10, 4_300_000) == 9
    assert tasks("random_forest", 100, 10, 100_000_000) == 12
    assert tasks("random_forest", 20, 6, 700_000) == tasks("gradient_boosting", 100, 6, 700_000) == 12


def test_fits_do_not_shuffle_once_a_partition(spark, data, monkeypatch):
    seen = []
    fit = models.Pipeline.fit

    def spied(self, df, *rest):
        seen.append(df.rdd.getNumPartitions())
        return fit(self, df, *rest)

    monkeypatch.setattr(models.Pipeline, "fit", spied)
    cores = spark.sparkContext.defaultParallelism
    many = data.repartition(4 * cores)
    models.train_all_models(many, COLUMNS, "y", names=models.MODELS[1:], settings=QUICK)
    models.cross_validate("random_forest", many, COLUMNS, "y", folds=2, settings=QUICK)
    assert seen and max(seen) <= cores


def test_disk_is_freed_while_work_goes_on(spark, monkeypatch):
    freed = threading.Event()
    monkeypatch.setattr(session, "free_disk", lambda _: freed.set())
    monkeypatch.setattr(session, "_next_free", 0.0)
    with freeing_disk(spark, every=0.05):
        assert freed.wait(10)


def test_fits_of_trees_free_the_disk_of_their_shuffles(data, monkeypatch):
    entered = []

    @contextlib.contextmanager
    def spied(_):
        entered.append(True)
        yield

    monkeypatch.setattr(models, "freeing_disk", spied)
    models.train_model("linear_regression", data, COLUMNS, "y")
    assert not entered
    for name in models.MODELS[1:]:
        models.train_model(name, data, COLUMNS, "y", settings=QUICK)
    assert len(entered) == 2


def test_disk_is_freed_when_the_feature_table_is_there(monkeypatch):
    steps = []
    monkeypatch.setattr(queries, "features", lambda *_: "features")
    monkeypatch.setattr(queries, "materialise", lambda df: steps.append(df) or "table")
    monkeypatch.setattr(queries, "free_disk", lambda _: steps.append("freed"))
    monkeypatch.setattr(queries.prepare, "model_columns", lambda table: (steps.append(table) or "data", ["a"]))
    assert queries._matrix(None, "") == ("data", ["a"], "table")
    assert steps == ["features", "freed", "table"]

"""Model training on Spark ML: fit, compare, cross-validate, tune, save and load."""

from __future__ import annotations

import itertools
import json
import logging
import time
from dataclasses import dataclass, field
from datetime import datetime, timezone
from multiprocessing.pool import ThreadPool

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import (
    GBTRegressor,
    LinearRegression,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custvalue.config import Settings
from custvalue.operators.customers import KEY
from custvalue.operators.metrics import regression_metrics
from custvalue.operators.prepare import column_medians, split, with_contiguous_fold, with_fold
from custvalue.operators.products import Products
from custvalue.session import freeing_disk

log = logging.getLogger(__name__)

MODELS = ("linear_regression", "random_forest", "gradient_boosting")
# The boosted trees are also reachable under the name users of other libraries know.
ALIASES = {"xgboost": "gradient_boosting", "ridge": "linear_regression"}

# Default tuning grids.
RIDGE_GRID = {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]}
FOREST_GRID = {
    "trees": [50, 100, 200],
    "depth": [5, 10, 15, None],
    "min_split": [2, 5, 10],
    "min_leaf": [1, 2, 4],
}
BOOSTING_GRID = {
    "rounds": [50, 100, 200],
    "depth": [3, 6, 9],
    "rate": [0.01, 0.1, 0.2],
    "row_sample": [0.8, 1.0],
    "column_sample": [0.8, 1.0],
}
DEFAULT_GRIDS = {
    "linear_regression": RIDGE_GRID,
    "random_forest": FOREST_GRID,
    "gradient_boosting": BOOSTING_GRID,
}

UNLIMITED_DEPTH = 30  # the deepest tree Spark grows
# The setting that counts an ensemble's trees, and its value where a grid names none.
SIZES = {"random_forest": "trees", "gradient_boosting": "rounds"}
DEFAULT_TREES = 100


def canonical_name(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in MODELS:
        raise ValueError(f"Unknown model: {name}")
    return name


def leaf_size(min_leaf: int, min_split: int) -> int:
    """The leaf size that stands for a least leaf and a least split size.

    Spark has no minimum split size. Two leaves of half that size (rounded up)
    never split a smaller node; they also forbid uneven splits of larger ones.
    """
    return max(min_leaf, (min_split + 1) // 2)


def estimator(name: str, settings: Settings = Settings()) -> Estimator:
    """The configured regressor on ``features`` and ``label``."""
    name = canonical_name(name)
    if name == "linear_regression":
        return LinearRegression(
            regParam=0.0, elasticNetParam=0.0, fitIntercept=settings.linear.fit_intercept
        )
    if name == "random_forest":
        p = settings.forest
        return RandomForestRegressor(
            numTrees=p.trees,
            maxDepth=p.depth,
            minInstancesPerNode=leaf_size(p.min_leaf, p.min_split),
            featureSubsetStrategy="all",
            seed=p.seed,
        )
    b = settings.boosting
    return GBTRegressor(
        maxIter=b.rounds,
        maxDepth=b.depth,
        stepSize=b.rate,
        subsamplingRate=b.row_sample,
        featureSubsetStrategy=str(b.column_sample),
        seed=b.seed,
    )


def preparation(columns: list[str], scale: bool = True) -> list:
    """Pipeline stages from feature columns to the ``features`` vector."""
    output = "assembled" if scale else "features"
    stages = [VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="error")]
    if scale:
        stages.append(
            StandardScaler(inputCol="assembled", outputCol="features", withMean=True, withStd=True)
        )
    return stages


@dataclass
class TrainedModel:
    """A fitted pipeline and what is needed to use and describe it."""

    name: str
    pipeline: PipelineModel
    columns: list[str]
    target: str
    train_r2: float
    val_r2: float | None = None
    seconds: float = 0.0
    n_samples: int = 0
    scaled: bool = True
    medians: dict[str, float] = field(default_factory=dict)

    @property
    def regressor(self):
        return self.pipeline.stages[-1]

    @property
    def score(self) -> float:
        return self.train_r2 if self.val_r2 is None else self.val_r2

    def predictions(self, df: DataFrame) -> DataFrame:
        """``df`` with label and prediction; unclamped, for evaluation."""
        scored = self.pipeline.transform(df.withColumn("label", F.col(self.target).cast("double")))
        return scored.drop("assembled", "features")


# Bytes that a forest's tasks may send in all (uncompressed, of full trees), and the rows that call for a task more whatever it sends.
MOST_SENT = 48 << 30
ROWS_A_TASK = 1_000_000
# Of a tree node's statistics: bytes a bin, and bins a feature.
BIN_BYTES, BINS = 32, 32


def tasks_for(name: str, trees: int, depth: int, width: int, rows: int, cores: int) -> int:
    """In how many partitions an ensemble of trees is fitted on so many rows and features.

    Every task of a fit sends the statistics of all nodes, bins and features, so what
    is shuffled grows with the number of partitions, not with the rows. More
    than the cores have no use; large forests get fewer, as long as these
    are not too large. Boosted trees are small and fitted one after the other.
    """
    if name != "random_forest":
        return cores
    sent = trees * min(2 ** min(depth, 40) - 1, max(rows, 1)) * width * BINS * BIN_BYTES
    return max(1, min(cores, max(MOST_SENT // max(sent, 1), -(-rows // ROWS_A_TASK))))


def _fit(name: str, stages: list, df: DataFrame, width: int) -> PipelineModel:
    """Fit the stages, the last of which is the regressor, in no more partitions than it calls for.

    A fit of trees is a stage for every group of nodes, and what these shuffle
    is of no use after it, so disk is freed meanwhile.
    """
    regressor = stages[-1]
    if canonical_name(name) == "linear_regression":
        return Pipeline(stages=stages).fit(df)
    trees = regressor.getNumTrees() if hasattr(regressor, "getNumTrees") else regressor.getMaxIter()
    cores = df.sparkSession.sparkContext.defaultParallelism
    df = df.coalesce(tasks_for(canonical_name(name), trees, regressor.getMaxDepth(), width, df.count(), cores))
    with freeing_disk(df.sparkSession):
        return Pipeline(stages=stages).fit(df)


def evaluate_model(model: TrainedModel, test: DataFrame) -> DataFrame:
    return regression_metrics(evaluation_rows({model.name: model}, test))


def evaluation_rows(models: dict[str, TrainedModel], test: DataFrame) -> DataFrame:
    """``model, CustomerID, label, prediction`` stacked over the models."""
    stacked = None
    for name, model in models.items():
        rows = model.predictions(test).select(F.lit(name).alias("model"), KEY, "label", "prediction")
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked


def compare_models(models: dict[str, TrainedModel], test: DataFrame) -> DataFrame:
    return regression_metrics(evaluation_rows(models, test))


def _r2_and_rows(scored: DataFrame) -> tuple[float, int]:
    """R2 and row count of (label, prediction) in one aggregation."""
    error = F.col("label") - F.col("prediction")
    row = scored.agg(
        F.sum(error * error).alias("sse"), F.var_pop("label").alias("var"), F.count(F.lit(1)).alias("n")
    ).first()
    return _r2(row["sse"], row["var"], row["n"]), row["n"]


def _r2(squared_error: float, variance: float, rows: int) -> float:
    """NaN without rows; 1 or 0 where the label is constant."""
    if not rows:
        return float("nan")
    if not variance:
        return 1.0 if squared_error == 0 else 0.0
    return 1 - squared_error / (variance * rows)


def train_model(
    name: str,
    train: DataFrame,
    columns: list[str],
    target: str,
    validation: DataFrame | None = None,
    *,
    scale: bool = True,
    settings: Settings = Settings(),
) -> TrainedModel:
    """Fit one model; scores are R2 on the training and validation rows."""
    labelled = train.withColumn("label", F.col(target).cast("double"))
    started = time.monotonic()
    fitted = _fit(name, [*preparation(columns, scale), estimator(name, settings)], labelled, len(columns))
    model = TrainedModel(canonical_name(name), fitted, list(columns), target, 0.0, scaled=scale)
    model.seconds = time.monotonic() - started
    model.train_r2, model.n_samples = _r2_and_rows(model.predictions(train))
    if validation is not None:
        model.val_r2, _ = _r2_and_rows(model.predictions(validation))
    return model


@dataclass
class Training:
    """All models of one training run, the rows held out from it, and why models are missing."""

    models: dict[str, TrainedModel]
    test: DataFrame
    failed: dict[str, Exception] = field(default_factory=dict)

    def complete(self) -> Training:
        """This training if every model was fitted, else an error."""
        for name, error in self.failed.items():
            raise RuntimeError(f"Training of {', '.join(self.failed)} failed; {name}: {error}") from error
        return self

    @property
    def best(self) -> TrainedModel:
        return best_model(self.models)


def best_model(models: dict[str, TrainedModel]) -> TrainedModel:
    """Highest validation R2, or training R2 where there is no validation score."""
    if not models:
        raise ValueError("No models trained yet")
    return max(models.values(), key=lambda m: m.score)


def train_all_models(
    df: DataFrame,
    columns: list[str],
    target: str,
    *,
    names: tuple[str, ...] = MODELS,
    test_share: float | None = None,
    scale: bool = True,
    settings: Settings = Settings(),
) -> Training:
    """Fit every model on one hash split.

    A model whose settings or rows Spark refuses is logged and left out, with its
    error in ``failed``; ``complete()`` asks for all of them. Any other error, such
    as a job that fails, ends the training, whose scores would be those of fewer models.
    """
    share = settings.test_share if test_share is None else test_share
    data = df.select(KEY, *columns, target).persist()
    train, test = split(data, share, settings.seed)
    models, failed = {}, {}
    try:
        middles = {r["metric"]: r["q0"] for r in column_medians(train, columns).collect()}
        for name in names:
            try:
                model = train_model(name, train, columns, target, test, scale=scale, settings=settings)
            except IllegalArgumentException as error:
                log.exception("training %s failed", name)
                failed[canonical_name(name)] = error
                continue
            model.medians = middles
            models[model.name] = model
    finally:
        data.unpersist()
    return Training(models, test, failed)


def training_summary(spark: SparkSession, models: dict[str, TrainedModel]) -> DataFrame:
    rows = [
        (m.name, m.train_r2, m.val_r2, m.seconds, len(m.columns), m.n_samples) for m in models.values()
    ]
    schema = "Model string, Train_R2 double, Validation_R2 double, Training_Seconds double, N_Features int, N_Samples long"
    return spark.createDataFrame(rows, schema)


def best_of_summary(summary: DataFrame) -> DataFrame:
    score = F.coalesce("Validation_R2", "Train_R2")
    return summary.agg(F.max_by("Model", score).alias("Best_Model"), F.max(score).alias("Score"))


def feature_importance(spark: SparkSession, model: TrainedModel, top_n: int = 20) -> DataFrame:
    """Feature, importance and its share in percent of all features, largest first."""
    fitted = model.regressor
    if hasattr(fitted, "featureImportances"):
        values = [float(v) for v in fitted.featureImportances.toArray()]
    else:
        values = [abs(float(v)) for v in fitted.coefficients.toArray()]
    total = sum(values)
    rows = [(c, v, 100 * v / total if total else None) for c, v in zip(model.columns, values)]
    table = spark.createDataFrame(rows, "Feature string, Importance double, Importance_Normalized double")
    return table.orderBy(F.desc("Importance"), "Feature").limit(top_n)


def model_info(model: TrainedModel | None) -> dict:
    if model is None:
        return {"status": "No model loaded"}
    fitted = model.regressor
    info = {
        "model_name": model.name,
        "model_type": type(fitted).__name__,
        "n_features": len(model.columns),
        "feature_names": list(model.columns),
        "has_scaler": model.scaled,
        "training_metrics": {"train_score": model.train_r2, "val_score": model.val_r2},
    }
    if hasattr(fitted, "getNumTrees"):
        trees = fitted.getNumTrees
        info["n_estimators"] = trees() if callable(trees) else trees
        info["max_depth"] = fitted.getMaxDepth()
    return info


# --- folds, grids, learning curves -----------------------------------------


def _folds(df: DataFrame, columns: list[str], target: str, folds: int, contiguous: bool = False) -> DataFrame:
    """The rows with their fold: by hash of the id, or by place in its order."""
    labelled = df.select(KEY, *columns, F.col(target).cast("double").alias("label"))
    return (with_contiguous_fold if contiguous else with_fold)(labelled, folds)


def _fold_parts(data: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    return data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)


def cross_validate(
    name: str,
    df: DataFrame,
    columns: list[str],
    target: str,
    folds: int = 5,
    settings: Settings = Settings(),
    parallelism: int = 2,
    contiguous: bool = False,
) -> DataFrame:
    """``model, fold, r2, rows``; the scaler is fitted inside each fold.

    Linear fits of all folds come from one table of sums of products; other
    models are fitted fold by fold. ``contiguous`` folds are runs of the id's order.
    """
    data = _folds(df, columns, target, folds, contiguous).persist()

    def linear() -> list[tuple]:
        products = Products.of(data, columns, "label", ["fold"])
        scores = []
        for fold in range(folds):
            held_out = products.total(lambda group: group[0] == fold)
            weights = products.weights(
                products.total(lambda group: group[0] != fold), intercept=settings.linear.fit_intercept
            )
            scores.append((canonical_name(name), fold, products.r2(weights, held_out), round(held_out[0, 0])))
        return scores

    def one(fold: int) -> tuple:
        train, held_out = _fold_parts(data, fold)
        fitted = _fit(name, [*preparation(columns), estimator(name, settings)], train, len(columns))
        r2, rows = _r2_and_rows(fitted.transform(held_out))
        return canonical_name(name), fold, r2, rows

    try:
        if canonical_name(name) == "linear_regression":
            scores = linear()
        else:
            with ThreadPool(parallelism) as pool:
                scores = pool.map(one, range(folds))
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(scores, "model string, fold int, r2 double, rows long")


def cv_summary(scores: DataFrame, scoring: str = "r2") -> DataFrame:
    return scores.groupBy("model").agg(
        F.avg("r2").alias("mean"),
        F.stddev_pop("r2").alias("std"),
        F.min("r2").alias("min"),
        F.max("r2").alias("max"),
        F.count("r2").alias("cv_folds"),
        F.lit(scoring).alias("scoring"),
    )


def _tuned(name: str, params: dict, label_std: float, rows: int) -> Estimator:
    if name == "linear_regression":
        # Spark divides the squared error by 2n and by the label's deviation, and
        # scales features by the sample deviation where ridge is stated on
        # features of unit population deviation.
        alpha = params["alpha"] * (rows - 1) / rows
        return LinearRegression(
            regParam=alpha / rows * label_std, elasticNetParam=0.0, solver="normal", standardization=False
        )
    if name == "random_forest":
        return RandomForestRegressor(
            numTrees=params.get("trees", 100),
            maxDepth=params.get("depth", UNLIMITED_DEPTH) or UNLIMITED_DEPTH,
            minInstancesPerNode=leaf_size(params.get("min_leaf", 1), params.get("min_split", 2)),
            featureSubsetStrategy="all",
            seed=42,
        )
    return GBTRegressor(
        maxIter=params.get("rounds", 100),
        maxDepth=params.get("depth", 6),
        stepSize=params.get("rate", 0.1),
        subsamplingRate=params.get("row_sample", 1.0),
        featureSubsetStrategy=str(params.get("column_sample", 1.0)),
        seed=42,
    )


def staged_r2(ensemble, rows: DataFrame, stages: list[int]) -> dict[int, float]:
    """R2 of an ensemble's first ``n`` trees for every ``n`` of ``stages``, from one pass over (features, label).

    Every tree predicts once; running sums of the weighted predictions are the
    shorter ensembles. For boosting these are the very ensembles that fewer
    rounds fit. A forest draws the rows of all its trees together, so its first
    trees are a forest of that size, but not the one a separate fit would draw.
    """
    averaged = isinstance(ensemble, RandomForestRegressionModel)
    trees, weights = ensemble.trees, ensemble.treeWeights
    scored = rows.select("features", "label", F.lit(0.0).alias("_sum"))
    kept: list[str] = []
    done = 0
    for stage in sorted(set(stages)):
        if not 0 < stage <= len(trees):
            raise ValueError(f"{stage} trees wanted of an ensemble of {len(trees)}")
        terms = [F.col("_sum")]
        for i in range(done, stage):
            scored = trees[i].setPredictionCol(f"_tree{i}").transform(scored)
            terms.append(F.col(f"_tree{i}") * F.lit(float(weights[i])))
        total = F.aggregate(F.array(*terms), F.lit(0.0), lambda a, b: a + b)
        scored = scored.select("features", "label", *kept, total.alias("_sum"))
        kept.append(f"_stage{stage}")
        scored = scored.withColumn(kept[-1], F.col("_sum") / (stage if averaged else 1))
        done = stage
    errors = [F.sum((F.col("label") - F.col(c)) ** 2).alias(c) for c in kept]
    row = scored.agg(*errors, F.var_pop("label").alias("var"), F.count(F.lit(1)).alias("n")).first()
    return {stage: _r2(row[f"_stage{stage}"], row["var"], row["n"]) for stage in stages}


def _label_facts(data: DataFrame) -> tuple[float, int]:
    row = data.agg(F.stddev_pop("label").alias("s"), F.count("label").alias("n")).first()
    return row["s"], row["n"]


@dataclass
class GridScores:
    """R2 per candidate and fold."""

    candidates: list[dict]
    scores: list[list[float]]

    @property
    def means(self) -> list[float]:
        return [sum(s) / len(s) for s in self.scores]

    @property
    def best(self) -> int:
        return max(range(len(self.candidates)), key=self.means.__getitem__)

    def table(self, spark: SparkSession) -> DataFrame:
        """``params, mean_r2, std_r2``, best first."""
        rows = [(json.dumps(c), f, r2) for c, s in zip(self.candidates, self.scores) for f, r2 in enumerate(s)]
        long = spark.createDataFrame(rows, "params string, fold int, r2 double")
        results = long.groupBy("params").agg(F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("std_r2"))
        return results.orderBy(F.desc("mean_r2"), "params")


def _ridge_scores(data: DataFrame, columns: list[str], candidates: list[dict], folds: int) -> list[list[float]]:
    """All penalties and folds from one table of sums of products."""
    products = Products.of(data, columns, "label", ["fold"])
    scores: list[list[float]] = [[] for _ in candidates]
    for fold in range(folds):
        train = products.total(lambda group: group[0] != fold)
        held_out = products.total(lambda group: group[0] == fold)
        for i, params in enumerate(candidates):
            scores[i].append(products.r2(products.weights(train, params["alpha"]), held_out))
    return scores


def _ensemble_scores(
    name: str, data: DataFrame, columns: list[str], candidates: list[dict], folds: int, parallelism: int
) -> list[list[float]]:
    """Candidates that differ in their number of trees alone share a fit of the largest.

    Assembling and scaling are fitted once per fold and shared by the whole grid.
    """
    size = SIZES[name]
    alike: dict[str, list[tuple[int, int]]] = {}  # by the other settings: candidate, number of trees
    for i, params in enumerate(candidates):
        others = json.dumps({k: v for k, v in params.items() if k != size})
        alike.setdefault(others, []).append((i, params.get(size, DEFAULT_TREES)))
    scores: list[list[float]] = [[] for _ in candidates]
    for fold in range(folds):
        train, held_out = _fold_parts(data, fold)
        prepared = Pipeline(stages=preparation(columns)).fit(train)
        ready = prepared.transform(train).select("features", "label").persist()
        check = prepared.transform(held_out).select("features", "label").persist()

        def one(group: tuple[str, list[tuple[int, int]]]) -> list[tuple[int, float]]:
            others, members = group
            stages = [trees for _, trees in members]
            regressor = _tuned(name, json.loads(others) | {size: max(stages)}, 0.0, 0)
            fitted = _fit(name, [regressor], ready, len(columns)).stages[-1]
            by_stage = staged_r2(fitted, check, stages)
            return [(i, by_stage[trees]) for i, trees in members]

        try:
            with ThreadPool(parallelism) as pool:
                for found in pool.map(one, list(alike.items())):
                    for i, r2 in found:
                        scores[i].append(r2)
        finally:
            ready.unpersist()
            check.unpersist()
    return scores


def _grid_scores(
    name: str, data: DataFrame, columns: list[str], grid: dict[str, list] | None, folds: int, parallelism: int
) -> GridScores:
    grid = grid or DEFAULT_GRIDS[name]
    candidates = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    if name == "linear_regression":
        return GridScores(candidates, _ridge_scores(data, columns, candidates, folds))
    return GridScores(candidates, _ensemble_scores(name, data, columns, candidates, folds, parallelism))


def grid_scores(
    name: str,
    df: DataFrame,
    columns: list[str],
    target: str,
    grid: dict[str, list] | None = None,
    folds: int = 5,
    parallelism: int = 4,
    contiguous: bool = False,
) -> GridScores:
    """R2 of every candidate of a grid on every fold, without fitting the winner on all rows."""
    data = _folds(df, columns, target, folds, contiguous).persist()
    try:
        return _grid_scores(canonical_name(name), data, columns, grid, folds, parallelism)
    finally:
        data.unpersist()


@dataclass
class Tuning:
    results: DataFrame  # params, mean_r2, std_r2
    best_params: dict
    best_score: float
    model: TrainedModel


def tune(
    name: str,
    df: DataFrame,
    columns: list[str],
    target: str,
    grid: dict[str, list] | None = None,
    folds: int = 5,
    parallelism: int = 4,
    contiguous: bool = False,
) -> Tuning:
    """Grid search by mean R2 over the folds; the winner is fitted on all rows."""
    name = canonical_name(name)
    data = _folds(df, columns, target, folds, contiguous).persist()
    try:
        found = _grid_scores(name, data, columns, grid, folds, parallelism)
        best = found.best
        label_std, rows = _label_facts(data)
        winner = _fit(
            name, [*preparation(columns), _tuned(name, found.candidates[best], label_std, rows)], data, len(columns)
        )
        model = TrainedModel(f"{name}_tuned", winner, list(columns), target, 0.0)
        model.train_r2, model.n_samples = _r2_and_rows(winner.transform(data))
    finally:
        data.unpersist()
    return Tuning(found.table(df.sparkSession), found.candidates[best], found.means[best], model)


def learning_curve(
    name: str,
    df: DataFrame,
    columns: list[str],
    target: str,
    folds: int = 5,
    fractions: tuple[float, ...] = tuple(round(i / 10, 1) for i in range(1, 11)),
    settings: Settings = Settings(),
    parallelism: int = 4,
    contiguous: bool = False,
) -> DataFrame:
    """``fraction, rows, train_mean, train_std, test_mean, test_std`` of R2 over the folds.

    The subsets are nested and chosen by hash of the id, so they do not depend on
    partitioning. Linear fits of all fractions come from one table of sums of
    products by fold and by step between fractions.
    """
    digest = F.md5(F.concat(F.col(KEY).cast("string"), F.lit("|curve")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 1000
    cuts = sorted({round(fraction * 1000) for fraction in fractions})
    step = sum(((F.col("draw") >= cut).cast("int") for cut in cuts), F.lit(0))
    data = _folds(df, columns, target, folds, contiguous).withColumn("draw", draw).withColumn("step", step).persist()

    def linear() -> list[tuple]:
        products = Products.of(data, columns, "label", ["fold", "step"])
        scores = []
        for fraction, fold in itertools.product(fractions, range(folds)):
            last = cuts.index(round(fraction * 1000))
            part = products.total(lambda group: group[0] != fold and group[1] <= last)
            held_out = products.total(lambda group: group[0] == fold)
            weights = products.weights(part, intercept=settings.linear.fit_intercept)
            scores.append(
                (fraction, fold, round(part[0, 0]), products.r2(weights, part), products.r2(weights, held_out))
            )
        return scores

    def one(task: tuple[float, int]) -> tuple:
        fraction, fold = task
        train, held_out = _fold_parts(data, fold)
        part = train.where(F.col("draw") < round(fraction * 1000))
        fitted = _fit(name, [*preparation(columns), estimator(name, settings)], part, len(columns))
        train_r2, rows = _r2_and_rows(fitted.transform(part))
        return fraction, fold, rows, train_r2, _r2_and_rows(fitted.transform(held_out))[0]

    try:
        if canonical_name(name) == "linear_regression":
            scores = linear()
        else:
            with ThreadPool(parallelism) as pool:
                scores = pool.map(one, list(itertools.product(fractions, range(folds))))
    finally:
        data.unpersist()
    table = df.sparkSession.createDataFrame(
        scores, "fraction double, fold int, rows long, train_r2 double, test_r2 double"
    )
    return table.groupBy("fraction").agg(
        F.avg("rows").alias("rows"),
        F.avg("train_r2").alias("train_mean"),
        F.stddev_pop("train_r2").alias("train_std"),
        F.avg("test_r2").alias("test_mean"),
        F.stddev_pop("test_r2").alias("test_std"),
    )


# --- saving and loading ----------------------------------------------------


def save_model(spark: SparkSession, model: TrainedModel, path: str) -> str:
    """Write the pipeline and one metadata row under ``path``."""
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    facts = {k: getattr(model, k) for k in model.__dataclass_fields__ if k != "pipeline"}
    facts["saved_at"] = datetime.now(timezone.utc).isoformat()
    row = spark.range(1).select(F.lit(json.dumps(facts)).alias("value"))
    row.coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return path


def save_named(
    spark: SparkSession,
    models: dict[str, TrainedModel],
    name: str | None = None,
    path: str | None = None,
    settings: Settings = Settings(),
) -> str:
    """Save one model of a training run, the best one by default."""
    name = best_model(models).name if name is None else ALIASES.get(name, name)
    if name not in models:
        raise ValueError(f"Model {name} not found")
    return save_model(spark, models[name], path or f"{settings.models_path}/{name}")


def save_all_models(
    spark: SparkSession, models: dict[str, TrainedModel], folder: str | None = None, settings: Settings = Settings()
) -> list[str]:
    folder = folder or settings.models_path
    return [save_model(spark, m, f"{folder}/{name}") for name, m in models.items()]


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    try:
        text = spark.read.text(f"{path}/metadata").first()["value"]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Model not found: {path}") from error
        raise
    facts = json.loads(text)
    facts.pop("saved_at", None)
    return TrainedModel(pipeline=PipelineModel.load(f"{path}/pipeline"), **facts)

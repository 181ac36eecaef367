"""Predictions for whole customer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.functions import expressions as X
from custvalue.functions.ordering import quantile_values
from custvalue.operators import segments
from custvalue.operators.customers import KEY
from custvalue.operators.models import TrainedModel
from custvalue.operators.segments import PREDICTION
from custvalue.session import materialise


def align_features(df: DataFrame, model: TrainedModel, fill: str = "zero") -> DataFrame:
    """Select the trained columns in order; absent ones are 0 or the training median."""
    if fill not in ("zero", "median"):
        raise ValueError(f"Unknown fill: {fill}")

    def column(name: str):
        default = model.medians[name] if fill == "median" else 0.0
        return F.col(name) if name in df.columns else F.lit(default).alias(name)

    ids = [KEY] if KEY in df.columns else []
    return df.select(*ids, *[column(c) for c in model.columns])


def predict(model: TrainedModel | None, df: DataFrame, fill: str = "zero") -> DataFrame:
    """``CustomerID`` (where given) and the clamped prediction of every row.

    The pipeline scales and scores partition by partition, which is the batching.
    """
    if model is None:
        raise ValueError("No model loaded. Call load_model() first.")
    scored = model.pipeline.transform(align_features(df, model, fill))
    ids = [KEY] if KEY in df.columns else []
    return scored.select(*ids, X.clamp_at_zero(F.col("prediction")).alias(PREDICTION))


def predict_with_interval(
    model: TrainedModel,
    df: DataFrame,
    confidence: float = 0.95,
    rmse: float | None = None,
    fill: str = "zero",
) -> DataFrame:
    return segments.with_interval(predict(model, df, fill), confidence, rmse)


def score_customers(
    model: TrainedModel, features: DataFrame, n_segments: int = 5, ties: str = "error", fill: str = "zero"
) -> DataFrame:
    """Prediction, quantile segment and percentile of every customer."""
    return segments.segment_customers(predict(model, features, fill), n_segments, ties, statistics=False)


def score_uploaded(model: TrainedModel, features: DataFrame, ties: str = "error") -> DataFrame:
    """Score a feature file; columns it lacks take the training median."""
    numeric = {c: F.col(c).try_cast("double") for c in model.columns if c in features.columns}
    scored = score_customers(model, features.withColumns(numeric), ties=ties, fill="median")
    return features.join(scored.drop("CLV_Percentile"), KEY)


def customer_insights(
    model: TrainedModel, features: DataFrame, confidence: float = 0.95, rmse: float | None = None
) -> DataFrame:
    """For every row: value, bounds, fixed-threshold segment, recommendations and model name."""
    bounded = predict_with_interval(model, features, confidence, rmse)
    advised = segments.with_short_actions(segments.with_threshold_segment(bounded))
    rounded = {c: F.round(c, 2) for c in (PREDICTION, "Lower_Bound", "Upper_Bound")}
    return advised.withColumns(rounded).withColumns(
        {"Model_Used": F.lit(model.name), "Prediction_Timestamp": F.current_timestamp()}
    )


def form_insights(model: TrainedModel, features: DataFrame, targets: DataFrame) -> DataFrame:
    """For every row: value, segment and percentile against the training target.

    ``targets`` holds the target column of the training rows. Columns the rows
    lack take the training median.
    """
    predictions = materialise(predict(model, features, fill="median"))
    by = KEY if KEY in targets.columns else None
    edges = quantile_values(targets, {"target": F.col(model.target)}, [0.2, 0.4, 0.6, 0.8], unique_by=by)
    segmented = segments.with_training_segment(predictions, edges["target"])
    ranked = segments.share_below(targets, model.target, segmented)
    return segments.with_short_actions(ranked, form=True)

"""Customer value analytics on Spark: invoice lines in, customer-level insight out."""

from custvalue.config import Settings, load_settings
from custvalue.operators.clean import clean_data, preprocessing_stats, step_counts
from custvalue.operators.features import build_features
from custvalue.operators.metrics import regression_metrics, residual_analysis
from custvalue.operators.models import (
    compare_models,
    cross_validate,
    evaluate_model,
    feature_importance,
    learning_curve,
    load_model,
    model_info,
    save_all_models,
    save_model,
    save_named,
    train_all_models,
    train_model,
    training_summary,
    tune,
)
from custvalue.operators.prepare import model_columns, prepare_for_modeling, scale_features
from custvalue.operators.scoring import (
    customer_insights,
    form_insights,
    predict,
    predict_with_interval,
    score_customers,
    score_uploaded,
)
from custvalue.operators.segments import segment_customers, with_recommendations
from custvalue.operators.summary import aggregate_by_customer
from custvalue.sources.csv import load_and_validate, load_csv
from custvalue.sources.sinks import save_features, save_predictions, save_processed_data

__all__ = [
    "Settings",
    "aggregate_by_customer",
    "build_features",
    "clean_data",
    "compare_models",
    "cross_validate",
    "customer_insights",
    "evaluate_model",
    "feature_importance",
    "form_insights",
    "learning_curve",
    "load_and_validate",
    "load_csv",
    "load_model",
    "load_settings",
    "model_columns",
    "model_info",
    "predict",
    "predict_with_interval",
    "prepare_for_modeling",
    "preprocessing_stats",
    "regression_metrics",
    "residual_analysis",
    "save_all_models",
    "save_features",
    "save_model",
    "save_named",
    "save_predictions",
    "save_processed_data",
    "scale_features",
    "score_customers",
    "score_uploaded",
    "segment_customers",
    "step_counts",
    "train_all_models",
    "train_model",
    "training_summary",
    "tune",
    "with_recommendations",
]

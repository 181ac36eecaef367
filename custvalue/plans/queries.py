"""The registered queries. Each one reads the tables of a folder and returns a DataFrame.

Results are tidied at the very end: doubles rounded to four digits, integers as
64-bit, times as text, so that they can be compared with another engine.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custvalue.config import BoostingParams, ForestParams, Settings
from custvalue.functions import bins
from custvalue.functions import expressions as X
from custvalue.functions.ordering import quantile_values
from custvalue.operators import (
    behavior,
    clean,
    cohort,
    metrics,
    models,
    periods,
    prepare,
    products,
    profiles,
    reports,
    rfm,
    scoring,
    segments,
    timing,
    validate,
)
from custvalue.operators.customers import KEY, combine, distinct_counts, medians, reference_date
from custvalue.operators.features import build_features
from custvalue.operators.segments import PREDICTION
from custvalue.operators.summary import aggregate_by_customer
from custvalue.session import ensure_checkpoint_dir, free_disk, materialise
from custvalue.sources import dates, rejects
from custvalue.sources.starschema import raw_texts, raw_transactions

Query = Callable[[SparkSession, str], DataFrame]

# Keeps exact halves off the rounding boundary, where the order of a floating
# point sum would decide the last digit.
NUDGE = 1e-7
DIGITS = 4


def rounded(value: Column, digits: int = DIGITS) -> Column:
    return F.round(value + F.lit(NUDGE), digits)


def tidy(df: DataFrame) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = rounded(c)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind.startswith("timestamp") or kind == "date":
            c = c.cast("string")
        elif kind == "array<string>":
            c = F.array_join(c, " | ")
        out.append(c.alias(name))
    return df.select(*out)


# --- shared inputs ---------------------------------------------------------


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_transactions(spark, sf_dir)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_data(raw(spark, sf_dir))


def written_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned transactions for queries that aggregate them more than once."""
    return materialise(lines(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str, **flags) -> DataFrame:
    return build_features(written_lines(spark, sf_dir), **flags)


def stand_in_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule in place of a model, so that everything downstream has exact results."""
    cleaned = written_lines(spark, sf_dir)
    facts = combine(
        cleaned.groupBy(KEY).agg(F.avg("TotalAmount").alias("avg")),
        distinct_counts(cleaned, {"invoices": "InvoiceNo"}),
    )
    return facts.select(KEY, rounded(F.col("avg") * F.col("invoices") * 1.1, 2).alias(PREDICTION))


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_customers(stand_in_predictions(spark, sf_dir), statistics=False)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with their segment only, for reports that need no percentile."""
    return segments.label_customers(stand_in_predictions(spark, sf_dir))


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency, frequency, value and tenure beside the prediction and its segment."""
    cleaned = written_lines(spark, sf_dir)
    today = reference_date(cleaned)
    facts = cleaned.groupBy(KEY).agg(
        F.min("InvoiceDate").alias("first"),
        F.max("InvoiceDate").alias("last"),
        F.sum("TotalAmount").alias("Monetary"),
        F.avg("TotalAmount").alias("avg"),
    )
    customers = combine(facts, distinct_counts(cleaned, {"Frequency": "InvoiceNo"}))
    base = materialise(
        customers.select(
            KEY,
            X.whole_days(today, F.col("last")).alias("Recency"),
            "Frequency",
            "Monetary",
            X.whole_days(today, F.col("first")).alias("CustomerTenure"),
            rounded(F.col("avg") * F.col("Frequency") * 1.1, 2).alias(PREDICTION),
        )
    )
    predicted = segments.label_customers(base.select(KEY, PREDICTION))
    return reports.with_predictions(base.drop(PREDICTION), predicted)


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rule-based models to evaluate: ``model, CustomerID, label, prediction``."""
    cleaned = written_lines(spark, sf_dir)
    facts = combine(
        cleaned.groupBy(KEY).agg(F.sum("TotalAmount").alias("sum"), F.avg("TotalAmount").alias("avg")),
        distinct_counts(cleaned, {"invoices": "InvoiceNo"}),
    )
    # In thousands, so that squared errors keep their digits.
    scaled = rounded(F.col("avg") * F.col("invoices") * 1.1 / 1000, 2)
    label = rounded(F.col("sum") / 1000, 2).alias("label")
    pair = F.array(
        F.struct(F.lit("rule").alias("model"), scaled.alias("prediction")),
        F.struct(F.lit("rule_x3").alias("model"), rounded(scaled * 3, 2).alias("prediction")),
    )
    # The rows feed several aggregates of one result.
    return materialise(facts.select(KEY, label, F.inline(pair)).select("model", KEY, "label", "prediction"))


def as_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as purchases: real times of day, down to the microsecond."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").cast("string").alias("InvoiceNo"),
        F.col("ts").cast("timestamp_ntz").alias("InvoiceDate"),
        F.col("user_id").cast("string").alias(KEY),
        F.col("value").alias("TotalAmount"),
        F.col("event_type").alias("StockCode"),
    )


# --- cleaning and profiling ------------------------------------------------


def clean_transactions(spark, sf_dir):
    return lines(spark, sf_dir)


def clean_step_counts(spark, sf_dir):
    return clean.step_counts(raw(spark, sf_dir))


def preprocessing_stats(spark, sf_dir):
    before = raw(spark, sf_dir)
    return clean.preprocessing_stats(before, clean.clean_data(before))


def _cleaning(spark, sf_dir):
    path = f"{ensure_checkpoint_dir(spark)}/classified-{uuid.uuid4().hex}"
    return clean.clean_and_report(raw(spark, sf_dir), path)


def cleaning_run_steps(spark, sf_dir):
    return _cleaning(spark, sf_dir).steps


def cleaning_run_stats(spark, sf_dir):
    return _cleaning(spark, sf_dir).stats


def cleaning_run_lines(spark, sf_dir):
    return _cleaning(spark, sf_dir).lines


# Dates inside the given orders, so that days before and after are left out.
PROFILE_PERIOD = (datetime.date(1994, 1, 1), datetime.date(1996, 12, 31))
PROFILED = ["InvoiceNo", "StockCode", "Quantity", "UnitPrice", "CustomerID", "Country"]


def _period_profile(spark, sf_dir):
    lines_of_day = F.to_date(clean.parsed_date())
    profiles_of_days = profiles.daily_profiles(raw(spark, sf_dir), lines_of_day, PROFILED)
    return profiles.merged_profile(materialise(profiles_of_days), *PROFILE_PERIOD)


def profile_from_sketches(spark, sf_dir):
    """Distinct counts and quantiles of a period, estimated from stored profiles of its days."""
    return _period_profile(spark, sf_dir)


def profile_of_period(spark, sf_dir):
    """What the stored profiles of days give exactly for a period."""
    return _period_profile(spark, sf_dir).select("column", "rows", "missing", "min", "max", "mean", "std")


def validate_quality(spark, sf_dir):
    return validate.data_quality(raw(spark, sf_dir))


def null_profile(spark, sf_dir):
    return validate.null_profile(raw(spark, sf_dir))


def missing_columns(spark, sf_dir):
    profile = validate.null_profile(raw(spark, sf_dir), only_missing=True)
    return profile.withColumn("missing_percentage", F.round("missing_percentage", 2))


def distinct_profile(spark, sf_dir):
    return validate.distinct_profile(raw(spark, sf_dir))


def numeric_describe(spark, sf_dir):
    return validate.numeric_describe(raw(spark, sf_dir))


# --- customer level --------------------------------------------------------


def customer_summary(spark, sf_dir):
    return aggregate_by_customer(written_lines(spark, sf_dir))


def summary_model_matrix(spark, sf_dir):
    summary = materialise(aggregate_by_customer(written_lines(spark, sf_dir)))
    return prepare.prepare_for_modeling(summary)[0]


def rfm_base(spark, sf_dir):
    return rfm.rfm_base(written_lines(spark, sf_dir))


def _scored(spark, sf_dir):
    return rfm.rfm_scores(rfm.rfm_base(written_lines(spark, sf_dir)))


def rfm_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        KEY, "Recency", "RecencyScore", "FrequencyScore", "MonetaryScore", "RFMScore"
    )


def rfm_segments(spark, sf_dir):
    return _scored(spark, sf_dir)


def segment_counts(spark, sf_dir):
    return reports.value_counts(_scored(spark, sf_dir), "CustomerSegment")


def behavioral_features(spark, sf_dir):
    return behavior.behavioral_features(written_lines(spark, sf_dir))


def time_features(spark, sf_dir):
    return timing.time_features(written_lines(spark, sf_dir))


def weekday_pivot(spark, sf_dir):
    return timing.weekday_features(lines(spark, sf_dir))


def hour_period_pivot(spark, sf_dir):
    return timing.hour_features(lines(spark, sf_dir))


def purchase_interval_lag(spark, sf_dir):
    return timing.mean_gap_days(timing.purchase_gaps(lines(spark, sf_dir)))


def event_hour_habits(spark, sf_dir):
    return timing.time_features(as_transactions(spark, sf_dir))


def event_gaps(spark, sf_dir):
    return timing.purchase_gaps(as_transactions(spark, sf_dir)).withColumn(
        "InvoiceDate", F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )


def event_medians(spark, sf_dir):
    """Median value per user with every user on the range-sorted path for hot customers."""
    return medians(as_transactions(spark, sf_dir), "TotalAmount", "MedianValue", hot_lines=20)


def cohort_features(spark, sf_dir):
    return cohort.cohort_features(lines(spark, sf_dir))


def cohort_stats(spark, sf_dir):
    return cohort.cohort_stats(lines(spark, sf_dir))


# --- feature table and preparation -----------------------------------------


def feature_table_imputed(spark, sf_dir):
    return features(spark, sf_dir)


def _summary_numbers(spark, sf_dir):
    return materialise(aggregate_by_customer(written_lines(spark, sf_dir))).select(
        KEY, "TotalRevenue", "StdOrderValue", "TotalQuantity", "Recency", "Tenure"
    )


def standard_scaled(spark, sf_dir):
    return prepare.scale_features(_summary_numbers(spark, sf_dir))


def minmax_scaled(spark, sf_dir):
    return prepare.scale_features(_summary_numbers(spark, sf_dir), method="minmax")


def column_medians(spark, sf_dir):
    table = prepare.column_medians(_summary_numbers(spark, sf_dir))
    return table.select("metric", "n", F.col("q0").alias("median"))


def width_scores(spark, sf_dir):
    numbers = _summary_numbers(spark, sf_dir)
    span = numbers.agg(F.struct(F.min("TotalRevenue").alias("low"), F.max("TotalRevenue").alias("high"))).scalar()
    score = bins.width_score(F.col("TotalRevenue"), span.getField("low"), span.getField("high"))
    return numbers.select(KEY, score.alias("WidthScore"))


def label_encoding(spark, sf_dir):
    countries = lines(spark, sf_dir).select(KEY, "Country").distinct()
    return prepare.label_encode(countries, "Country", "CountryCode")


def train_test_split(spark, sf_dir):
    customers = lines(spark, sf_dir).select(KEY).distinct()
    share = prepare.hash_percent(F.col(KEY), 42)
    return customers.withColumn("is_test", (share < 20).cast("int"))


def fold_numbers(spark, sf_dir):
    return prepare.with_fold(lines(spark, sf_dir).select(KEY).distinct())


def contiguous_folds(spark, sf_dir):
    return prepare.with_contiguous_fold(lines(spark, sf_dir).select(KEY).distinct())


def feature_model_matrix(spark, sf_dir):
    """The columns that models are trained on, with their target."""
    return _matrix(spark, sf_dir)[0]


# --- segments of predictions -----------------------------------------------


def clv_segments(spark, sf_dir):
    return segments.segment_customers(stand_in_predictions(spark, sf_dir))


def tie_broken_segments(spark, sf_dir):
    """Four segments of invoice counts, which are tied so often that only ranks can cut them."""
    counts = distinct_counts(lines(spark, sf_dir), {"n": "InvoiceNo"})
    predicted = counts.select(KEY, F.col("n").cast("double").alias(PREDICTION))
    return segments.segment_customers(predicted, n_segments=4, ties="rank", statistics=False)


def percentile_rank(spark, sf_dir):
    """Percentile of the invoice count, a measure with very many ties."""
    counts = distinct_counts(lines(spark, sf_dir), {"n": "InvoiceNo"})
    placed = segments.ordered_predictions(counts.select(KEY, F.col("n").cast("double").alias(PREDICTION)))
    ranked = bins.with_percentile(placed, "Percentile")
    return ranked.select(KEY, F.col("value").alias("Invoices"), "Percentile")


def segment_stats(spark, sf_dir):
    return segments.segment_statistics(labelled(spark, sf_dir))


def recommendations(spark, sf_dir):
    return segments.with_recommendations(segmented(spark, sf_dir))


def threshold_segments(spark, sf_dir):
    predicted = stand_in_predictions(spark, sf_dir)
    scaled = predicted.withColumn(PREDICTION, rounded(F.col(PREDICTION) / 500, 2))
    return segments.with_short_actions(segments.with_threshold_segment(scaled))


def training_quantile_segments(spark, sf_dir):
    rows = model_rows(spark, sf_dir).where(F.col("model") == "rule_x3")
    predicted = rows.select(KEY, F.col("prediction").alias(PREDICTION))
    edges = quantile_values(rows, {"label": F.col("label")}, [0.2, 0.4, 0.6, 0.8], unique_by=KEY)
    segmented_rows = segments.with_training_segment(predicted, edges["label"])
    return segments.with_short_actions(
        segments.share_below(rows, "label", segmented_rows), form=True
    )


def prediction_interval(spark, sf_dir):
    return segments.with_interval(materialise(stand_in_predictions(spark, sf_dir)))


# --- reports ---------------------------------------------------------------


def segment_analysis(spark, sf_dir):
    return reports.segment_analysis(labelled(spark, sf_dir))


def value_by_segment(spark, sf_dir):
    return reports.value_by_segment(labelled(spark, sf_dir))


def predicted_segment_counts(spark, sf_dir):
    return reports.value_counts(labelled(spark, sf_dir), "CLV_Segment")


def filtered_predictions(spark, sf_dir):
    return reports.filtered_top(segmented(spark, sf_dir), ["High", "Medium"])


def kpi_summary(spark, sf_dir):
    return reports.kpi_summary(labelled(spark, sf_dir))


def pareto_curve(spark, sf_dir):
    return reports.pareto_curve(stand_in_predictions(spark, sf_dir))


def pareto_point(spark, sf_dir):
    return reports.pareto_point(pareto_curve(spark, sf_dir))


def top_customers(spark, sf_dir):
    return reports.top_customers(analysis(spark, sf_dir))


def at_risk_customers(spark, sf_dir):
    return reports.at_risk_customers(analysis(spark, sf_dir))


def segment_profile(spark, sf_dir):
    return reports.segment_profile(analysis(spark, sf_dir))


def profile_heatmap(spark, sf_dir):
    return reports.profile_heatmap(segment_profile(spark, sf_dir))


def top_countries(spark, sf_dir):
    return reports.top_countries(lines(spark, sf_dir))


def transaction_preview(spark, sf_dir):
    order = ["InvoiceDate", "InvoiceNo", "StockCode", "Quantity"]
    return reports.preview(lines(spark, sf_dir), order).select(*order, KEY, "TotalAmount")


def value_histogram(spark, sf_dir):
    return reports.histogram(lines(spark, sf_dir), "TotalAmount")


def prediction_histogram(spark, sf_dir):
    return reports.histogram(labelled(spark, sf_dir), PREDICTION, by="CLV_Segment")


def feature_correlation(spark, sf_dir):
    table = materialise(aggregate_by_customer(written_lines(spark, sf_dir)))
    return reports.correlation_matrix(table, prepare.numeric_columns(table)[:15])


# --- evaluation ------------------------------------------------------------


def regression_metrics(spark, sf_dir):
    return metrics.regression_metrics(model_rows(spark, sf_dir).where(F.col("model") == "rule"))


def model_comparison(spark, sf_dir):
    return metrics.regression_metrics(model_rows(spark, sf_dir))


def residual_analysis(spark, sf_dir):
    return metrics.residual_analysis(model_rows(spark, sf_dir))


def evaluation_report(spark, sf_dir):
    return metrics.report(model_rows(spark, sf_dir)).select("model", "R2", "fit", "residual_skewness", "residual_shape")


def residual_points(spark, sf_dir):
    return metrics.prediction_points(model_rows(spark, sf_dir))


def residual_histogram(spark, sf_dir):
    points = metrics.prediction_points(model_rows(spark, sf_dir).where(F.col("model") == "rule"))
    return reports.histogram(points, "residual")


def point_range(spark, sf_dir):
    return metrics.point_range(model_rows(spark, sf_dir))


def qq_points(spark, sf_dir):
    return metrics.qq_points(model_rows(spark, sf_dir), KEY)


def qq_line(spark, sf_dir):
    return metrics.qq_line(metrics.qq_points(model_rows(spark, sf_dir), KEY))


# --- models ----------------------------------------------------------------


def _matrix(spark, sf_dir):
    table = materialise(features(spark, sf_dir))
    free_disk(spark)  # of the lines, and of what they and the features were made of
    return (*prepare.model_columns(table), table)


def _trained(spark, sf_dir, *names):
    data, columns, table = _matrix(spark, sf_dir)
    training = models.train_all_models(data, columns, "Monetary", names=names or models.MODELS)
    return training.complete(), table


def train_summary(spark, sf_dir):
    training, _ = _trained(spark, sf_dir)
    return models.training_summary(spark, training.models).drop("Training_Seconds")


def model_evaluation(spark, sf_dir):
    training, _ = _trained(spark, sf_dir, "linear_regression", "random_forest")
    return models.compare_models(training.models, training.test)


def feature_importance(spark, sf_dir):
    training, _ = _trained(spark, sf_dir, "random_forest")
    return models.feature_importance(spark, training.best)


def cv_scores(spark, sf_dir):
    data, columns, _ = _matrix(spark, sf_dir)
    return models.cross_validate("linear_regression", data, columns, "Monetary")


def cv_scores_contiguous(spark, sf_dir):
    data, columns, _ = _matrix(spark, sf_dir)
    return models.cross_validate("linear_regression", data, columns, "Monetary", contiguous=True)


def cv_scores_ensembles(spark, sf_dir):
    """Folds of a small forest and of boosted trees."""
    data, columns, _ = _matrix(spark, sf_dir)
    small = Settings(forest=ForestParams(trees=20, depth=6), boosting=BoostingParams(rounds=10, depth=3))
    scores = [models.cross_validate(name, data, columns, "Monetary", 3, small) for name in models.MODELS[1:]]
    return scores[0].unionByName(scores[1])


def cv_overview(spark, sf_dir):
    return models.cv_summary(cv_scores(spark, sf_dir))


def grid_search(spark, sf_dir):
    data, columns, _ = _matrix(spark, sf_dir)
    return models.grid_scores("ridge", data, columns, "Monetary").table(spark)


def grid_search_forest(spark, sf_dir):
    data, columns, _ = _matrix(spark, sf_dir)
    grid = {"trees": [5, 10, 20], "depth": [3, 6], "min_split": [2, 10], "min_leaf": [1]}
    return models.grid_scores("random_forest", data, columns, "Monetary", grid, folds=3).table(spark)


def grid_search_boosting(spark, sf_dir):
    data, columns, _ = _matrix(spark, sf_dir)
    grid = {"rounds": [5, 10, 20], "depth": [3], "rate": [0.1, 0.2], "row_sample": [0.8, 1.0], "column_sample": [1.0]}
    return models.grid_scores("gradient_boosting", data, columns, "Monetary", grid, folds=3).table(spark)


def fold_products(spark, sf_dir):
    """Sums of products of the customer summary's columns by fold, from which linear models are fitted."""
    data, columns = prepare.prepare_for_modeling(materialise(aggregate_by_customer(written_lines(spark, sf_dir))))
    scale = products.column_scale(data, columns, "TotalRevenue")
    return products.product_table(prepare.with_fold(data), scale, ["fold"])


def learning_curve(spark, sf_dir):
    data, columns, _ = _matrix(spark, sf_dir)
    return models.learning_curve("linear_regression", data, columns, "Monetary")


def scored_customers(spark, sf_dir):
    training, table = _trained(spark, sf_dir, "linear_regression")
    return scoring.score_customers(training.best, table, ties="rank")


def scored_with_interval(spark, sf_dir):
    training, table = _trained(spark, sf_dir, "linear_regression")
    return scoring.predict_with_interval(training.best, table)


def customer_insights(spark, sf_dir):
    training, table = _trained(spark, sf_dir, "linear_regression")
    return scoring.customer_insights(training.best, table).drop("Prediction_Timestamp")


def form_insights(spark, sf_dir):
    """Score customers from a few form fields; the other columns take training medians."""
    training, table = _trained(spark, sf_dir, "linear_regression")
    fields = table.select(
        KEY, "Recency", "Frequency", "CustomerTenure", "TotalQuantity", "UniqueProducts",
        "AvgDaysBetweenPurchases", "TotalTransactions",
    )
    return scoring.form_insights(training.best, fields, table.select(KEY, "Monetary"))


def uploaded_scores(spark, sf_dir):
    training, table = _trained(spark, sf_dir, "linear_regression")
    upload = table.select(KEY, "Recency", "Frequency", "AvgTransactionValue", "TotalQuantity")
    return scoring.score_uploaded(training.best, upload, ties="rank")



def rolling_period_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spending, lines and active days of each customer over rolling periods."""
    return periods.rolling_periods(lines(spark, sf_dir))


def calendar_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and revenue by quarter, month and weekend flag."""
    return periods.calendar_report(lines(spark, sf_dir))


def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of the date texts of a retail export with their numbers' ranges, and the formats that follow from them."""
    texts = raw_texts(spark, sf_dir)
    formats = " | ".join(dates.date_formats(texts))
    return dates.date_shapes(texts).fillna(0).withColumn("formats", F.lit(formats))


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a retail export by the reason why they cannot be read, with those that can."""
    texts = raw_texts(spark, sf_dir)
    rows = rejects.classified(texts, dates.date_formats(texts))
    reason = F.coalesce("reject_reason", F.lit("accepted")).alias("reason")
    return rows.groupBy(reason).agg(F.count("*").alias("rows"), F.count_distinct("InvoiceNo").alias("invoices"))

# Queries by key, in the order of the operator inventory.
QUERIES: list[Query] = [
    date_formats, rejected_rows, rolling_period_features, calendar_report,
    clean_transactions, clean_step_counts, preprocessing_stats,
    cleaning_run_lines, cleaning_run_steps, cleaning_run_stats, profile_from_sketches, profile_of_period,
    validate_quality, null_profile, missing_columns, distinct_profile, numeric_describe,
    customer_summary, summary_model_matrix,
    rfm_base, rfm_scores, rfm_segments, segment_counts,
    behavioral_features,
    time_features, weekday_pivot, hour_period_pivot, purchase_interval_lag,
    event_hour_habits, event_gaps, event_medians,
    cohort_features, cohort_stats,
    feature_table_imputed, standard_scaled, minmax_scaled, column_medians, width_scores,
    label_encoding, train_test_split, fold_numbers, contiguous_folds, feature_model_matrix,
    clv_segments, tie_broken_segments, percentile_rank, segment_stats, recommendations,
    threshold_segments, training_quantile_segments, prediction_interval,
    segment_analysis, value_by_segment, predicted_segment_counts, filtered_predictions,
    kpi_summary, pareto_curve, pareto_point, top_customers, at_risk_customers,
    segment_profile, profile_heatmap, top_countries, transaction_preview, value_histogram,
    prediction_histogram, feature_correlation,
    regression_metrics, model_comparison, residual_analysis, evaluation_report,
    residual_points, residual_histogram, point_range, qq_points, qq_line,
    train_summary, model_evaluation, feature_importance, cv_scores, cv_scores_contiguous, cv_scores_ensembles,
    cv_overview,
    fold_products, grid_search, grid_search_forest, grid_search_boosting, learning_curve,
    scored_customers, scored_with_interval, customer_insights, form_insights, uploaded_scores,
]


def registered() -> dict[str, Query]:
    def tidied(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(query(spark, sf_dir))

        return run

    return {q.__name__: tidied(q) for q in QUERIES}

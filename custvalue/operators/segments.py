"""Value segments of predictions, and what to do for each segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custvalue.functions import bins
from custvalue.functions import expressions as X
from custvalue.functions.ordering import (
    order_statistics,
    positions,
    running_totals,
    with_row_index,
)
from custvalue.operators.customers import KEY

PREDICTION = "Predicted_CLV"

# Strategy, priority and actions per value segment.
STRATEGIES = {
    "High": (
        "Retention & Loyalty",
        "Critical",
        [
            "VIP program enrollment",
            "Exclusive offers and early access",
            "Personal account manager",
            "Premium customer service",
        ],
    ),
    "Medium-High": (
        "Upselling & Cross-selling",
        "High",
        [
            "Personalized product recommendations",
            "Loyalty program incentives",
            "Bundle offers",
            "Referral program",
        ],
    ),
    "Medium": (
        "Engagement & Growth",
        "Medium",
        [
            "Targeted email campaigns",
            "Seasonal promotions",
            "Product education",
            "Feedback collection",
        ],
    ),
    "Medium-Low": (
        "Activation & Re-engagement",
        "Medium",
        [
            "Win-back campaigns",
            "Special discounts",
            "New product introductions",
            "Survey for feedback",
        ],
    ),
    "Low": (
        "Cost-Effective Engagement",
        "Low",
        [
            "Automated email sequences",
            "Self-service resources",
            "Community building",
            "Consider profitability analysis",
        ],
    ),
}
# Used where a segment is not in the table above.
DEFAULT_STRATEGY = ("General Engagement", "Medium", ["Standard engagement"])

# Short recommendations for a single customer, per value segment.
SHORT_ACTIONS = {
    "High": [
        "Enroll in VIP loyalty program",
        "Assign dedicated account manager",
        "Offer exclusive products/services",
    ],
    "Medium-High": [
        "Target with cross-sell opportunities",
        "Offer loyalty rewards",
        "Invite to referral program",
    ],
    "Medium": [
        "Engage with personalized campaigns",
        "Offer seasonal promotions",
        "Gather feedback for improvement",
    ],
    "Medium-Low": [
        "Re-engagement campaign needed",
        "Offer incentives to increase purchase frequency",
        "Analyze reasons for low engagement",
    ],
    "Low": [
        "Cost-effective communication only",
        "Consider automated engagement",
        "Evaluate customer profitability",
    ],
}
DEFAULT_SHORT_ACTIONS = ["General engagement recommended"]

# Recommendations of the interactive single-customer form.
FORM_ACTIONS = {
    "High": [
        "🌟 Enroll in VIP loyalty program",
        "🎁 Offer exclusive products and early access",
        "👤 Assign dedicated account manager",
        "📞 Schedule regular check-ins",
    ],
    "Medium-High": [
        "📈 Target with upsell opportunities",
        "🎯 Personalized product recommendations",
        "💳 Offer premium loyalty tier",
        "📧 Regular engagement campaigns",
    ],
    "Medium": [
        "📬 Send targeted promotions",
        "🎉 Seasonal campaign inclusion",
        "📝 Gather feedback",
        "🔄 Cross-sell related products",
    ],
    "Medium-Low": [
        "🔔 Re-engagement campaigns",
        "💰 Offer incentives to increase purchase frequency",
        "❓ Survey for feedback",
        "📱 Mobile app promotions",
    ],
    "Low": [
        "📧 Automated email sequences",
        "💡 Self-service resources",
        "👥 Community building initiatives",
        "📊 Monitor for churn risk",
    ],
}


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def segment_dimension(spark: SparkSession) -> DataFrame:
    """Five rows: segment, its order, strategy, priority and action lists."""
    rows = []
    for order, name in enumerate(X.VALUE_SEGMENTS, start=1):
        strategy, priority, actions = STRATEGIES[name]
        rows.append(
            F.struct(
                F.lit(name).alias("CLV_Segment"),
                F.lit(order).alias("SegmentOrder"),
                F.lit(strategy).alias("Strategy"),
                F.lit(priority).alias("Priority"),
                _texts(actions).alias("Actions"),
                _texts(SHORT_ACTIONS[name]).alias("ShortActions"),
                _texts(FORM_ACTIONS[name]).alias("FormActions"),
            )
        )
    return spark.range(1).select(F.inline(F.array(*rows)))


def segment_labels(n_segments: int) -> list[str]:
    if n_segments == len(X.VALUE_SEGMENTS):
        return list(X.VALUE_SEGMENTS)
    return [f"Segment_{i}" for i in range(1, n_segments + 1)]


def with_generated_ids(predictions: DataFrame) -> DataFrame:
    """Name the rows ``Customer_0, Customer_1, ...`` when there is no id column."""
    numbered = with_row_index(predictions, "_row")
    return numbered.withColumn(KEY, F.concat(F.lit("Customer_"), F.col("_row").cast("string"))).drop("_row")


def ordered_predictions(predictions: DataFrame) -> DataFrame:
    """``CustomerID, value`` with the position of each prediction; read it many times."""
    return positions(
        predictions.select(KEY, F.col(PREDICTION).alias("value")).where(F.col("value").isNotNull()),
        ["value", KEY],
    )


def value_segments(placed: DataFrame, n_segments: int = 5, ties: str = "error") -> DataFrame:
    """Add ``CLV_Segment`` by quantile of the predicted value.

    Where equal predictions make quantile edges collapse the labels no longer fit:
    ``ties='error'`` raises, ``ties='rank'`` cuts by unique rank instead.
    """
    labels = _texts(segment_labels(n_segments))
    probabilities = bins.edge_probabilities(n_segments)
    named = placed.withColumn("metric", F.lit(PREDICTION))
    order = order_statistics(named, KEY, {PREDICTION: probabilities})[PREDICTION]
    if ties == "rank":
        bucket = bins.rank_score(F.col("value"), F.col(KEY), order, n_segments).cast("int")
    else:
        edges = [order.quantile(p) for p in probabilities]
        if len(bins.distinct_edges(edges)) <= n_segments:
            raise ValueError("Equal predictions collapse the segment edges; use ties='rank'")
        bucket = bins.edge_bucket(F.col("value"), edges)
    return placed.withColumn("CLV_Segment", F.element_at(labels, bucket))


def label_customers(predictions: DataFrame, n_segments: int = 5, ties: str = "error") -> DataFrame:
    """``CustomerID, Predicted_CLV, CLV_Segment``: the segment alone, without percentiles."""
    segmented = value_segments(ordered_predictions(predictions), n_segments, ties)
    return segmented.select(KEY, F.col("value").alias(PREDICTION), "CLV_Segment")


def segment_statistics(segmented: DataFrame, value: str = PREDICTION) -> DataFrame:
    return segmented.groupBy("CLV_Segment").agg(
        F.avg(value).alias("Segment_Mean_CLV"),
        F.min(value).alias("Segment_Min_CLV"),
        F.max(value).alias("Segment_Max_CLV"),
        F.count(value).alias("Segment_Size"),
    )


def segment_customers(
    predictions: DataFrame, n_segments: int = 5, ties: str = "error", statistics: bool = True
) -> DataFrame:
    """Segment, segment statistics and percentile of every prediction.

    One range sort of (prediction, id) serves the edges and the percentiles. The
    statistics have one row per segment, so they are broadcast.
    """
    if KEY not in predictions.columns:
        predictions = with_generated_ids(predictions)
    placed = ordered_predictions(predictions)
    labelled = value_segments(placed, n_segments, ties)
    segmented = bins.with_percentile(labelled, "CLV_Percentile").select(KEY, F.col("value").alias(PREDICTION), "CLV_Segment", "CLV_Percentile")
    if not statistics:
        return segmented
    stats = segment_statistics(labelled, "value")
    return segmented.join(F.broadcast(stats), "CLV_Segment", "left").select(
        KEY, PREDICTION, "CLV_Segment",
        "Segment_Mean_CLV", "Segment_Min_CLV", "Segment_Max_CLV", "Segment_Size",
        "CLV_Percentile",
    )


def with_recommendations(segmented: DataFrame) -> DataFrame:
    """Add strategy, priority and the joined action list of each row's segment."""
    dimension = segment_dimension(segmented.sparkSession).select(
        "CLV_Segment", "Strategy", "Priority", "Actions"
    )
    strategy, priority, actions = DEFAULT_STRATEGY
    joined = segmented.join(F.broadcast(dimension), "CLV_Segment", "left")
    return joined.select(
        *segmented.columns,
        F.coalesce("Strategy", F.lit(strategy)).alias("Strategy"),
        F.coalesce("Priority", F.lit(priority)).alias("Priority"),
        F.array_join(F.coalesce("Actions", _texts(actions)), ", ").alias("Recommended_Actions"),
    )


def with_short_actions(segmented: DataFrame, form: bool = False) -> DataFrame:
    """Add ``Recommendations``, the short action list of each row's segment."""
    source = "FormActions" if form else "ShortActions"
    dimension = segment_dimension(segmented.sparkSession).select("CLV_Segment", source)
    default = F.array().cast("array<string>") if form else _texts(DEFAULT_SHORT_ACTIONS)
    return segmented.join(F.broadcast(dimension), "CLV_Segment", "left").select(
        *segmented.columns, F.coalesce(source, default).alias("Recommendations")
    )


def with_threshold_segment(predictions: DataFrame) -> DataFrame:
    """Segment by fixed value thresholds."""
    return predictions.withColumn("CLV_Segment", X.threshold_segment(F.col(PREDICTION)))


def with_training_segment(predictions: DataFrame, edges: list[float]) -> DataFrame:
    """Segment by the 20, 40, 60 and 80 % quantiles of the training target."""
    low, middle, upper, high = (F.col(PREDICTION) >= F.lit(edge) for edge in edges)
    names = X.VALUE_SEGMENTS
    label = F.when(high, names[4]).when(upper, names[3]).when(middle, names[2]).when(low, names[1])
    return predictions.withColumn("CLV_Segment", label.otherwise(names[0]))


def share_below(targets: DataFrame, target: str, predictions: DataFrame) -> DataFrame:
    """Percentile of each prediction within the targets: share of smaller targets, in percent.

    Both value sets are counted per distinct value, stacked and range-sorted once;
    the running count of targets up to a prediction answers all rows together.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    known = targets.select(F.col(target).cast("double").alias("value"), one.alias("is_target"))
    asked = predictions.select(F.col(PREDICTION).alias("value"), none.alias("is_target"))
    stacked = (
        known.unionByName(asked)
        .where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.sum("is_target").alias("targets"))
    )
    counted = running_totals(stacked, ["value"], "targets").select(
        F.col("value").alias(PREDICTION),
        ((F.col("_running") - F.col("targets")) / F.col("_total") * 100).alias("Share_Below"),
    )
    return predictions.join(counted, PREDICTION, "left")


def with_interval(
    predictions: DataFrame, confidence: float = 0.95, rmse: float | None = None
) -> DataFrame:
    """Add bounds around each prediction, the lower one not below 0.

    The standard error is the training RMSE where it is given, otherwise a tenth
    of the population deviation of the predictions at hand.
    """
    if rmse is None:
        error = predictions.agg(F.stddev_pop(PREDICTION) * 0.1).scalar()
    else:
        error = F.lit(float(rmse))
    margin = F.lit(X.normal_quantile(confidence)) * error
    return predictions.withColumns(
        {
            "Lower_Bound": X.clamp_at_zero(F.col(PREDICTION) - margin),
            "Upper_Bound": F.col(PREDICTION) + margin,
            "Confidence_Level": F.lit(float(confidence)),
        }
    )

"""Business tables built on predictions and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.functions.ordering import quantile_values, running_totals
from custvalue.operators.customers import KEY
from custvalue.operators.segments import PREDICTION, segment_dimension

HIGH_VALUE = ("High", "Medium-High")
PROFILE_COLUMNS = ("Recency", "Frequency", "Monetary", "CustomerTenure")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def preview(df: DataFrame, order: list, n: int = 100) -> DataFrame:
    """The first ``n`` rows of a stated order."""
    return df.orderBy(*order).limit(n)


def top_countries(lines: DataFrame, n: int = 10) -> DataFrame:
    return value_counts(lines, "Country").limit(n)


def filter_segments(predictions: DataFrame, segments: list[str]) -> DataFrame:
    return predictions.where(F.col("CLV_Segment").isin(segments))


def filtered_top(predictions: DataFrame, segments: list[str], n: int = 100) -> DataFrame:
    """Rows of the chosen segments, highest prediction first."""
    return preview(filter_segments(predictions, segments), [F.desc(PREDICTION), KEY], n)


def kpi_summary(predictions: DataFrame) -> DataFrame:
    """One row: customers, total, mean, highest and median prediction, high-value share."""
    middle = quantile_values(predictions, {PREDICTION: F.col(PREDICTION)}, [0.5], unique_by=KEY)
    high = F.count_if(F.col("CLV_Segment") == "High")
    return predictions.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum(PREDICTION).alias("total_value"),
        F.avg(PREDICTION).alias("average_value"),
        F.max(PREDICTION).alias("highest_value"),
        high.alias("high_value_customers"),
        F.try_divide(high * F.lit(100.0), F.count(F.lit(1))).alias("high_value_percentage"),
    ).withColumn("median_value", F.lit(middle.get(PREDICTION, [None])[0]).cast("double"))


def average_target(features: DataFrame, target: str = "Monetary") -> DataFrame:
    return features.agg(F.count(F.lit(1)).alias("customers"), F.avg(target).alias("average_value"))


def segment_analysis(predictions: DataFrame) -> DataFrame:
    """Count, total, mean, min, max and shares per value segment; empty segments count 0."""
    facts = predictions.groupBy("CLV_Segment").agg(
        F.count(PREDICTION).alias("customers"),
        F.round(F.sum(PREDICTION), 2).alias("total_value"),
        F.round(F.avg(PREDICTION), 2).alias("avg_value"),
        F.round(F.min(PREDICTION), 2).alias("min_value"),
        F.round(F.max(PREDICTION), 2).alias("max_value"),
    )
    names = segment_dimension(predictions.sparkSession).select("CLV_Segment", "SegmentOrder")
    whole = F.broadcast(names).join(facts, "CLV_Segment", "left").withColumns(
        {
            "customers": F.coalesce("customers", F.lit(0)),
            "total_value": F.coalesce("total_value", F.lit(0.0)),
        }
    )
    totals = facts.agg(F.struct(F.sum("customers").alias("c"), F.sum("total_value").alias("v"))).scalar()

    def share(part: str, total: Column) -> Column:
        return F.round(F.try_divide(F.col(part), total) * 100, 1)

    return (
        whole.withColumns(
            {
                "pct_customers": share("customers", totals.getField("c")),
                "pct_value": share("total_value", totals.getField("v")),
            }
        )
        .orderBy("SegmentOrder")
        .drop("SegmentOrder")
    )


def value_by_segment(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("CLV_Segment").agg(F.sum(PREDICTION).alias("total_value"))


def pareto_curve(predictions: DataFrame) -> DataFrame:
    """Cumulative value, its share and the share of customers, best customers first."""
    ranked = running_totals(
        predictions.select(KEY, PREDICTION), [PREDICTION, KEY], PREDICTION, descending={PREDICTION}
    )
    return ranked.select(
        KEY,
        PREDICTION,
        F.col("_running").alias("Cumulative_Value"),
        (F.try_divide(F.col("_running"), F.col("_total")) * 100).alias("Cumulative_Percentage"),
        (F.col("_rank") / F.col("_n") * 100).alias("Customer_Percentage"),
    )


def pareto_point(curve: DataFrame, share: float = 80.0) -> DataFrame:
    """The smallest share of customers that holds ``share`` percent of the value."""
    reached = curve.where(F.col("Cumulative_Percentage") >= share)
    return reached.agg(F.min("Customer_Percentage").alias("pareto_point"))


def with_predictions(features: DataFrame, predictions: DataFrame) -> DataFrame:
    return features.join(predictions.select(KEY, PREDICTION, "CLV_Segment"), KEY)


def top_customers(analysis: DataFrame, n: int = 10) -> DataFrame:
    return preview(
        analysis.select(KEY, PREDICTION, "CLV_Segment", "Recency", "Frequency", "Monetary"),
        [F.desc(PREDICTION), KEY],
        n,
    )


def at_risk_customers(analysis: DataFrame, n: int = 10, quantile: float = 0.75) -> DataFrame:
    """High-value customers who have not bought for longer than most."""
    edges = quantile_values(analysis, {"Recency": F.col("Recency")}, [quantile], unique_by=KEY)
    limit = F.lit(edges.get("Recency", [None])[0]).cast("double")
    lapsed = analysis.where(F.col("CLV_Segment").isin(*HIGH_VALUE) & (F.col("Recency") > limit))
    return preview(
        lapsed.select(KEY, PREDICTION, "Recency", "Frequency", "Monetary"), [F.desc(PREDICTION), KEY], n
    )


def segment_profile(analysis: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean of the profile columns per segment, rounded to cents."""
    if columns is None:
        columns = list(PROFILE_COLUMNS)
        if not set(columns) <= set(analysis.columns):
            numeric = ("double", "float", "bigint", "int")
            columns = [c for c, kind in analysis.dtypes if kind in numeric][:4]
    return analysis.groupBy("CLV_Segment").agg(*[F.round(F.avg(c), 2).alias(c) for c in columns])


def profile_heatmap(profile: DataFrame) -> DataFrame:
    """The profile transposed to ``feature, CLV_Segment, value`` cells."""
    columns = [c for c in profile.columns if c != "CLV_Segment"]
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns]
    return profile.select("CLV_Segment", F.inline(F.array(*cells))).select("feature", "CLV_Segment", "value")


def histogram(df: DataFrame, value: str, bins: int = 50, by: str | None = None) -> DataFrame:
    """Rows per equal-width bin (and group), empty bins left out: ``bin, bin_low, bin_high, count``.

    The two ends of the range are fetched first, so ``df`` is read twice.
    """
    low, high = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    low, width = (low or 0.0), ((high or 0.0) - (low or 0.0)) / bins
    place = F.floor((F.col(value) - low) / width) + 1 if width > 0 else F.lit(1)
    group = [by] if by else []
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, F.least(F.lit(bins), place).cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return counted.select(
        *group,
        "bin",
        (F.lit(low) + (F.col("bin") - 1) * width).alias("bin_low"),
        (F.lit(low) + F.col("bin") * width).alias("bin_high"),
        "count",
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair: ``x, y, corr``; null where a column is constant.

    One aggregation computes each pair once; no matrix passes through the driver.
    """
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i:]]
    row = df.agg(*[F.corr(x, y).alias(f"{x}|{y}") for x, y in pairs])
    cells = []
    for x, y in pairs:
        for a, b in {(x, y), (y, x)}:
            cells.append(
                F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{x}|{y}`").alias("corr"))
            )
    return row.select(F.inline(F.array(*cells)))

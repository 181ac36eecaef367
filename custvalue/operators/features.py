"""The customer feature table: all blocks from one aggregation of the lines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.config import Settings
from custvalue.functions import expressions as X
from custvalue.functions.ordering import order_statistics
from custvalue.operators import behavior, cohort, rfm, timing
from custvalue.operators.customers import KEY, combine, distinct_counts, medians
from custvalue.operators.prepare import fill_missing, replace_infinite
from custvalue.session import free_disk, materialise

RFM_COLUMNS = [
    "Recency", "Frequency", "Monetary", "RecencyScore", "FrequencyScore", "MonetaryScore",
    "RFMScore", "RFMSegment", "CustomerSegment", "CustomerSegmentEncoded",
]


def build_features(
    lines: DataFrame,
    reference_date: datetime | None = None,
    include_rfm: bool = True,
    include_behavioral: bool = True,
    include_time: bool = True,
    include_cohort: bool = True,
    settings: Settings = Settings(),
) -> DataFrame:
    """One row per customer with the columns of the enabled blocks, no numeric nulls.

    The lines are read for one wide aggregation, one narrow distinct count and
    one median; the customer table is then materialised, and ranks, cohorts and
    imputation work on it alone. Give a written table when cleaning is costly.
    """
    # Only columns some enabled block asks for are aggregated.
    measures = {}

    def want(columns) -> None:
        for c in columns:
            measures.setdefault(str(c), c)

    uniques: dict[str, str] = {}
    want(timing.pace_measures())  # recency, cohort month and reference date
    if include_rfm or include_cohort:
        want(cohort.cohort_measures()[1:])
    if include_rfm:
        uniques["TotalTransactions"] = "InvoiceNo"
    if include_behavioral:
        want(behavior.measures())
        uniques |= behavior.DISTINCT
    if include_time:
        want(timing.weekday_measures() + timing.hour_measures())

    clocked = timing.with_clock(lines) if include_time else lines
    blocks = [clocked.groupBy(KEY).agg(*measures.values())]
    if uniques:
        blocks.append(distinct_counts(lines, uniques))
    if include_behavioral:
        blocks.append(
            medians(lines, "TotalAmount", "MedianTransactionValue", settings.hot_customer_lines)
        )
    customers = materialise(combine(*blocks))
    del blocks
    free_disk(lines.sparkSession)  # of the shuffled lines
    if reference_date is None:
        today = customers.agg(F.max("LastPurchase")).scalar()
    else:
        today = F.lit(reference_date).cast("timestamp_ntz")

    nullable: list[str] = []
    columns: list[str] = []
    if include_behavioral:
        customers = behavior.derive(customers)
        nullable += behavior.NULLABLE
    if include_time:
        customers = timing.derive_weekdays(timing.derive_pace(customers, today))
        nullable += timing.NULLABLE

    middles = None
    if include_rfm:
        customers = customers.withColumns(
            {
                "Recency": X.whole_days(today, F.col("LastPurchase")),
                "Frequency": F.col("TotalTransactions"),
                "Monetary": F.col("_spend"),
            }
        )
        # One range sort serves the scores and the medians of the nullable columns.
        placed = rfm.rfm_ranked(customers, {c: F.col(c) for c in nullable})
        wanted = {**rfm.WANTED, **{c: [0.5] for c in nullable}}
        orders = order_statistics(placed, KEY, wanted)
        middles = {c: orders[c].quantile(0.5) for c in nullable}
        customers = rfm.rfm_scores(customers, {m: orders[m] for m in rfm.WANTED}, settings.weights)
        columns += RFM_COLUMNS
    if include_behavioral:
        columns += behavior.COLUMNS
    if include_time:
        columns += timing.COLUMNS
    if include_cohort:
        customers = cohort.derive(customers)
        columns += cohort.COLUMNS
    customers = customers.select(KEY, *columns)
    return replace_infinite(fill_missing(customers, nullable, middles), nullable)

"""Recency, frequency and monetary value: base measures, scores and named segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.config import RfmWeights
from custvalue.functions import bins
from custvalue.functions import expressions as X
from custvalue.functions.ordering import OrderStatistics, long_values, order_statistics, positions
from custvalue.operators.customers import KEY, combine, distinct_counts, reference_date
from custvalue.session import materialise

SCORES = 5
# Ranks must not depend on the order in which a sum was added up.
MONETARY_DIGITS = 6


def rfm_base(lines: DataFrame, today: Column | None = None) -> DataFrame:
    """``CustomerID, Recency, Frequency, Monetary``."""
    today = reference_date(lines) if today is None else today
    facts = lines.groupBy(KEY).agg(
        F.max("InvoiceDate").alias("_last"), F.sum("TotalAmount").alias("Monetary")
    )
    return combine(facts, distinct_counts(lines, {"Frequency": "InvoiceNo"})).select(
        KEY, X.whole_days(today, F.col("_last")).alias("Recency"), "Frequency", "Monetary"
    )


def rfm_ranked(customers: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Order the three measures (and any ``extra`` ones) in one range sort.

    Returns ``metric, value, CustomerID`` with positions; every score edge, rank
    cut and median of the customer table is read off this one table.
    """
    values = {
        "Recency": F.col("Recency"),
        "Frequency": F.col("Frequency"),
        "Monetary": F.round("Monetary", MONETARY_DIGITS),
        **(extra or {}),
    }
    return positions(long_values(customers, values, [KEY]), ["value", KEY], group=["metric"])


SCORE_COLUMNS = ("RecencyScore", "FrequencyScore", "MonetaryScore")
WANTED = {m: bins.edge_probabilities(SCORES) for m in ("Recency", "Frequency", "Monetary")}


def rfm_scores(
    customers: DataFrame,
    orders: dict[str, OrderStatistics] | None = None,
    weights: RfmWeights = RfmWeights(),
) -> DataFrame:
    """Add scores, the weighted score, the score code, and the segment with its code.

    ``customers`` holds CustomerID, Recency, Frequency and Monetary (and may hold
    more columns). Without ``orders`` it is materialised first, as it is read
    again for the ordering.
    """
    if orders is None:
        customers = materialise(customers)
        orders = order_statistics(rfm_ranked(customers), KEY, WANTED)
    edges = [orders["Recency"].quantile(p) for p in bins.edge_probabilities(SCORES)]
    spend = F.round("Monetary", MONETARY_DIGITS)
    scored = customers.withColumns(
        {
            "RecencyScore": bins.quantile_score(F.col("Recency"), edges, ascending=False),
            "FrequencyScore": bins.rank_score(F.col("Frequency"), F.col(KEY), orders["Frequency"], SCORES),
            "MonetaryScore": bins.rank_score(spend, F.col(KEY), orders["Monetary"], SCORES),
        }
    )
    if len({o.n for o in orders.values()}) > 1:  # some customer lacks a measure
        # A missing score takes the median score. Scores have five values at most,
        # so the buffer of the median aggregate is tiny.
        middle = scored.agg(F.struct(*[F.median(s).alias(s) for s in SCORE_COLUMNS])).scalar()
        scored = scored.withColumns({s: F.coalesce(F.col(s), middle.getField(s)) for s in SCORE_COLUMNS})
    return _named(scored, weights)


def _named(scored: DataFrame, weights: RfmWeights) -> DataFrame:
    r, f, m = (F.col(s) for s in ("RecencyScore", "FrequencyScore", "MonetaryScore"))
    named = scored.withColumns(
        {
            "RFMScore": X.rfm_score(r, f, m, weights),
            "RFMSegment": X.rfm_code(r, f, m),
            "CustomerSegment": X.customer_segment(r, f, m),
        }
    )
    # Codes number the segments that occur, in label order: at most seven rows.
    occurring = sorted(r[0] for r in named.select("CustomerSegment").distinct().collect())
    code = F.array_position(F.array(*[F.lit(s) for s in occurring]), F.col("CustomerSegment")) - 1
    return named.withColumn("CustomerSegmentEncoded", code)

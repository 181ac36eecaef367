"""Quantile and equal-width binning, rank scores and percentile ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.functions.ordering import OrderStatistics

CONSTANT_SCORE = 3.0


def edge_probabilities(q: int) -> list[float]:
    return [i / q for i in range(q + 1)]


def distinct_edges(edges: list[float]) -> list[float]:
    return sorted(set(edges))


def edge_bucket(value: Column, edges: list[float]) -> Column:
    """1-based right-closed bucket among distinct ascending edges; the lowest edge is in bucket 1."""
    bucket = F.lit(1)
    for number, edge in enumerate(edges[1:-1], start=2):
        bucket = F.when(value > F.lit(edge), F.lit(number)).otherwise(bucket)
    return F.when(value.isNotNull(), bucket)


def quantile_score(value: Column, edges: list[float], ascending: bool = True) -> Column:
    """Score 1..k by quantile edges, k being the number of distinct intervals.

    Collapsed edges leave fewer buckets; a constant column scores 3 throughout.
    """
    edges = distinct_edges(edges)
    buckets = len(edges) - 1
    if buckets < 1:
        return F.lit(CONSTANT_SCORE)
    bucket = edge_bucket(value, edges)
    return (bucket if ascending else buckets + 1 - bucket).cast("double")


def width_score(value: Column, low: Column, high: Column, q: int = 5, ascending: bool = True) -> Column:
    """Score by ``q`` equal-width intervals of [low, high], for data that quantiles cannot split."""
    step = F.when(high > low, F.ceil((value - low) / (high - low) * q)).otherwise(F.lit(q // 2 + 1))
    bucket = F.least(F.lit(q), F.greatest(F.lit(1), step))
    bucket = F.when(value.isNotNull(), bucket)
    return (bucket if ascending else q + 1 - bucket).cast("double")


def rank_score(value: Column, id_: Column, order: OrderStatistics, q: int = 5) -> Column:
    """Score 1..q of a row's unique rank in the order (value, id).

    The row at place r of n has score ``max(1, ceil(q * r / (n - 1)))``, so score k
    ends at place ``floor(k * (n - 1) / q)``. The ``q - 1`` rows at these places
    decide the score of every row, and no ranked table has to be joined back.
    """
    if order.n <= 1:
        return F.when(value.isNotNull(), F.lit(CONSTANT_SCORE))
    score = F.lit(1)
    number = value.cast("double")
    for k in range(1, q):
        end_value, end_id = order.at(k / q)
        after = (number > F.lit(end_value)) | ((number == F.lit(end_value)) & (id_ > F.lit(end_id)))
        score = F.when(after, F.lit(k + 1)).otherwise(score)
    return F.when(value.isNotNull(), score.cast("double"))


def mean_rank_percentiles(placed: DataFrame) -> DataFrame:
    """Percentile rank of each shared value, ties at their mean rank: ``value, _tied``.

    ``placed`` is an ungrouped :func:`positions` table. Values held by one row are
    left out, as their percentile follows from their own position.
    """
    ties = placed.groupBy("value").agg(
        F.min("_pos").alias("_low"), F.max("_pos").alias("_high"), F.max("_n").alias("_rows")
    )
    mean_rank = (F.col("_low") + F.col("_high")) / F.lit(2) + 1
    return ties.where(F.col("_high") > F.col("_low")).select(
        "value", (mean_rank / F.col("_rows") * 100).alias("_tied")
    )


def with_percentile(placed: DataFrame, output: str) -> DataFrame:
    """Add the average-rank percentile of ``value``.

    The joined side has one row per shared value; a value shared by very many rows
    skews the other side only, which adaptive execution splits.
    """
    own = (F.col("_pos") + 1) / F.col("_n") * 100
    return (
        placed.join(mean_rank_percentiles(placed), "value", "left")
        .withColumn(output, F.coalesce("_tied", own))
        .drop("_tied")
    )

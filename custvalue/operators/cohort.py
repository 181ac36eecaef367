"""Cohort features: customers grouped by the month of their first purchase.

Everything comes from customer-level sums, so the transactions are not joined
with their cohort. A cohort table has one row per calendar month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from custvalue.functions import expressions as X
from custvalue.operators.customers import KEY
from custvalue.session import materialise

COLUMNS = ["CohortSize", "CohortAvgSpend", "CohortMonthEncoded"]


def cohort_measures() -> list:
    return [
        F.min("InvoiceDate").alias("FirstPurchase"),
        F.sum("TotalAmount").alias("_spend"),
        F.count("TotalAmount").alias("_amounts"),
    ]


def cohort_table(customers: DataFrame) -> DataFrame:
    """``CohortMonth, CohortSize, CohortAvgSpend, CohortMonthEncoded``.

    ``customers`` holds FirstPurchase, _spend and _amounts per customer.
    """
    months = customers.groupBy(X.month_key(F.col("FirstPurchase")).alias("CohortMonth")).agg(
        F.count(F.lit(1)).alias("CohortSize"),
        F.try_divide(F.sum("_spend"), F.sum("_amounts")).alias("CohortAvgSpend"),
    )
    by_month = W.orderBy("CohortMonth")  # one row per month
    return months.withColumn("CohortMonthEncoded", F.dense_rank().over(by_month).cast("bigint"))


def derive(customers: DataFrame) -> DataFrame:
    """Add the cohort columns; months bound the broadcast table."""
    keyed = customers.withColumn("CohortMonth", X.month_key(F.col("FirstPurchase")))
    return keyed.join(F.broadcast(cohort_table(customers)), "CohortMonth", "left").drop("CohortMonth")


def cohort_stats(lines: DataFrame) -> DataFrame:
    return cohort_table(lines.groupBy(KEY).agg(*cohort_measures()))


def cohort_features(lines: DataFrame) -> DataFrame:
    # The customer table is read for the months and again to attach them.
    return derive(materialise(lines.groupBy(KEY).agg(*cohort_measures()))).select(KEY, *COLUMNS)

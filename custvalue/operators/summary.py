"""Customer summary: one row of plain purchasing facts per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.functions import expressions as X
from custvalue.operators.customers import KEY, combine, distinct_counts, home_countries, reference_date


def aggregate_by_customer(lines: DataFrame) -> DataFrame:
    facts = lines.groupBy(KEY).agg(
        F.min("InvoiceDate").alias("FirstPurchaseDate"),
        F.max("InvoiceDate").alias("LastPurchaseDate"),
        F.sum("TotalAmount").alias("TotalRevenue"),
        F.avg("TotalAmount").alias("AvgOrderValue"),
        F.stddev_samp("TotalAmount").alias("StdOrderValue"),
        F.sum("Quantity").alias("TotalQuantity"),
        F.avg("Quantity").alias("AvgQuantity"),
    )
    uniques = distinct_counts(lines, {"TransactionCount": "InvoiceNo", "UniqueProducts": "StockCode"})
    today = reference_date(lines)
    return combine(facts, uniques, home_countries(lines)).select(
        KEY,
        "TransactionCount",
        "FirstPurchaseDate",
        "LastPurchaseDate",
        "TotalRevenue",
        "AvgOrderValue",
        F.coalesce("StdOrderValue", F.lit(0.0)).alias("StdOrderValue"),
        "TotalQuantity",
        "AvgQuantity",
        "UniqueProducts",
        "Country",
        X.whole_days(today, F.col("LastPurchaseDate")).alias("Recency"),
        X.whole_days(today, F.col("FirstPurchaseDate")).alias("Tenure"),
    )

"""Behavioural features: spread of line values, quantities and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.functions import expressions as X
from custvalue.operators.customers import KEY, combine, distinct_counts, medians

DISTINCT = {
    "UniqueProducts": "StockCode",
    "TotalTransactions": "InvoiceNo",
    "UniqueDescriptions": "Description",
}

COLUMNS = [
    "AvgTransactionValue", "StdTransactionValue", "MinTransactionValue", "MaxTransactionValue",
    "MedianTransactionValue", "TotalQuantity", "AvgQuantity", "StdQuantity", "MaxQuantity",
    "AvgUnitPrice", "StdUnitPrice", "MinUnitPrice", "MaxUnitPrice", "UniqueProducts",
    "TotalTransactions", "UniqueDescriptions", "TransactionValueRange", "PriceRange",
    "ProductDiversity", "AvgItemsPerTransaction", "TransactionValueCV",
]

# Null or infinite for some customers: one line only, or no invoice number at all.
NULLABLE = [
    "StdTransactionValue", "StdQuantity", "StdUnitPrice", "TransactionValueCV",
    "ProductDiversity", "AvgItemsPerTransaction",
]


def measures() -> list[Column]:
    return [
        F.avg("TotalAmount").alias("AvgTransactionValue"),
        F.stddev_samp("TotalAmount").alias("StdTransactionValue"),
        F.min("TotalAmount").alias("MinTransactionValue"),
        F.max("TotalAmount").alias("MaxTransactionValue"),
        F.sum("Quantity").alias("TotalQuantity"),
        F.avg("Quantity").alias("AvgQuantity"),
        F.stddev_samp("Quantity").alias("StdQuantity"),
        F.max("Quantity").alias("MaxQuantity"),
        F.avg("UnitPrice").alias("AvgUnitPrice"),
        F.stddev_samp("UnitPrice").alias("StdUnitPrice"),
        F.min("UnitPrice").alias("MinUnitPrice"),
        F.max("UnitPrice").alias("MaxUnitPrice"),
    ]


def derive(customers: DataFrame) -> DataFrame:
    invoices = F.col("TotalTransactions")
    return customers.withColumns(
        {
            "TransactionValueRange": F.col("MaxTransactionValue") - F.col("MinTransactionValue"),
            "PriceRange": F.col("MaxUnitPrice") - F.col("MinUnitPrice"),
            "ProductDiversity": X.ratio(F.col("UniqueProducts"), invoices),
            "AvgItemsPerTransaction": X.ratio(F.col("TotalQuantity"), invoices),
            "TransactionValueCV": X.spread_ratio(
                F.col("StdTransactionValue"), F.col("AvgTransactionValue")
            ),
        }
    )


def behavioral_features(lines: DataFrame, hot_lines: int = 1_000_000) -> DataFrame:
    facts = lines.groupBy(KEY).agg(*measures())
    middle = medians(lines, "TotalAmount", "MedianTransactionValue", hot_lines)
    return derive(combine(facts, distinct_counts(lines, DISTINCT), middle)).select(KEY, *COLUMNS)

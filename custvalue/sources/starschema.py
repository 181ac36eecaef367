"""Retail transactions derived from an order / line-item star schema.

The source tables are clean, so known faults are injected by rule: cancelled
invoices, free items, missing customers, copied rows and one-line customers.
The same rules are written in SQL in :mod:`custvalue.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Explicit schemas: only these columns are read, and no file footer is opened to find types.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_returnflag string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_name string",
}


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight raw columns; dates and customers as text, as a CSV would hold them."""

    def table(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    stamped = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (order % 24).cast("int"))
    # Whatever depends on the order alone is made once per order, not once per line.
    orders = (
        table("orders")
        .join(table("customer"), customer == F.col("c_custkey"))
        .join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            order,
            stamped.cast("string").alias("InvoiceDate"),
            F.when(order % 50 != 7, F.concat(customer.cast("string"), F.lit(".0"))).alias("CustomerID"),
            F.col("n_name").alias("Country"),
            (customer % 101 == 5).alias("one_line_customer"),
        )
    )
    lines = table("lineitem")
    # Copied rows: repeated before the joins, which then run once.
    lines = lines.unionByName(lines.where(F.col("l_orderkey") % 40 == 0))
    key, returned = F.col("l_orderkey"), F.col("l_returnflag") == "R"
    quantity = F.col("l_quantity").cast("bigint")
    its_line = (F.col("l_linenumber") == 1) & (key % 7 == 0)
    return (
        lines.join(orders, key == order)
        .where(~F.col("one_line_customer") | its_line)
        .join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat(F.when(returned, "CINV").otherwise("INV"), key.cast("string")).alias("InvoiceNo"),
            F.concat(F.lit("STK"), F.col("l_partkey").cast("string")).alias("StockCode"),
            F.col("p_name").alias("Description"),
            F.when(returned, -quantity).otherwise(quantity).alias("Quantity"),
            "InvoiceDate",
            F.when(key % 97 == 3, F.lit(0.0))
            .otherwise(F.col("l_extendedprice") / F.col("l_quantity"))
            .alias("UnitPrice"),
            "CustomerID",
            "Country",
        )
    )


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw transactions as texts of a retail export: month first, and some values that cannot be read."""
    df = raw_transactions(spark, sf_dir)
    order = F.regexp_extract("InvoiceNo", r"(\d+)", 1).cast("bigint")
    stamped = F.date_format(F.col("InvoiceDate").cast("timestamp_ntz"), "M/d/yyyy H:mm")
    return df.withColumns(
        {
            "Quantity": F.when(order % 61 == 8, F.lit("a dozen")).otherwise(F.col("Quantity").cast("string")),
            "UnitPrice": F.when(order % 67 == 9, F.lit("")).when(order % 71 == 4, F.lit("free")).otherwise(
                F.col("UnitPrice").cast("string")
            ),
            "InvoiceDate": F.when(order % 73 == 11, F.lit("soon")).when(order % 79 == 6, F.lit("2/30/1995 8:26")).otherwise(stamped),
            "CustomerID": F.when(order % 83 == 2, F.lit("guest")).otherwise(F.col("CustomerID")),
        }
    )

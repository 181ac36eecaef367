"""The per-customer aggregation that every customer-level operator starts from.

All measures that combine map-side share one ``groupBy``. Distinct counts are a
second, narrow aggregation: mixing them in would make every (customer, value)
pair carry the whole wide buffer through the shuffle. Medians are a third. The
three are keyed alike, so joining them needs no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.functions.ordering import grouped_quantiles

KEY = "CustomerID"


def reference_date(lines: DataFrame) -> Column:
    """The latest transaction date, as a scalar subquery."""
    return lines.agg(F.max("InvoiceDate")).scalar()


def distinct_counts(lines: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``CustomerID`` and the number of distinct non-null values: output name -> column.

    Each distinct pair is shuffled once under its own hash, so one customer with
    very many lines is spread out before its pairs are counted.
    """
    return lines.groupBy(KEY).agg(*[F.count_distinct(c).alias(name) for name, c in columns.items()])


def hot_customers(lines: DataFrame, floor: int) -> DataFrame:
    """Customers with more than ``floor`` lines and a millionth of all lines.

    The second condition bounds the result at a million ids, which makes it safe
    to broadcast whatever the size of the table.
    """
    counts = lines.groupBy(KEY).agg(F.count(F.lit(1)).alias("lines"))
    share = counts.agg(F.sum("lines")).scalar() / F.lit(1_000_000)
    return counts.where(F.col("lines") > F.greatest(F.lit(float(floor)), share)).select(KEY)


def medians(lines: DataFrame, value: str, output: str, hot_lines: int) -> DataFrame:
    """Exact median of ``value`` per customer.

    Ordinary customers use the ``median`` aggregate, whose buffer is bounded by
    the hot-customer limit. The lines of hot customers are counted per value and
    range-sorted, so no task ever holds one of those customers whole. Whether
    there are any is checked first: a table of no more than ``hot_lines`` rows has
    none (for Parquet the row count is metadata), otherwise one narrow scan of the
    customer column tells.
    """
    hot = hot_customers(lines, hot_lines)
    if lines.count() <= hot_lines or hot.isEmpty():
        return lines.groupBy(KEY).agg(F.median(value).alias(output))
    ordinary = (
        lines.join(F.broadcast(hot), KEY, "left_anti").groupBy(KEY).agg(F.median(value).alias(output))
    )
    counted = (
        lines.join(F.broadcast(hot), KEY, "left_semi")
        .where(F.col(value).isNotNull())
        .groupBy(KEY, F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    large = grouped_quantiles(counted, [KEY], [0.5]).select(KEY, F.col("q0").alias(output))
    return ordinary.unionByName(large)


def home_countries(lines: DataFrame) -> DataFrame:
    """Country of each customer's earliest line (the first name on a tie)."""
    earliest = lines.groupBy(KEY, "Country").agg(F.min("InvoiceDate").alias("_since"))
    first = F.min(F.when(F.col("Country").isNotNull(), F.struct("_since", "Country")))
    return earliest.groupBy(KEY).agg(first.getField("Country").alias("Country"))


def combine(*blocks: DataFrame) -> DataFrame:
    """Left-join aggregations that all hold one row per customer."""
    out = blocks[0]
    for block in blocks[1:]:
        out = out.join(block, KEY, "left")
    return out

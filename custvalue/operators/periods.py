"""Aggregates over rolling periods of days, and calendar flags of lines.

Lines are first added up by customer and day, map-side before the shuffle, so a
window over a customer holds a row a day at most, however many lines it owns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custvalue.operators.customers import KEY

# The periods of the settings, in days.
PERIODS = (30, 60, 90, 180, 365)


def with_calendar_flags(lines: DataFrame) -> DataFrame:
    """The lines with ``Quarter`` (1 to 4) and ``IsWeekend``; null dates have null flags."""
    date = F.col("InvoiceDate")
    return lines.withColumns({"Quarter": F.quarter(date), "IsWeekend": F.weekday(date) >= 5})


def daily_totals(lines: DataFrame) -> DataFrame:
    """``CustomerID, Date, Spent, Quantity, Lines`` of every customer and day with lines."""
    dated = lines.filter(F.col(KEY).isNotNull() & F.col("InvoiceDate").isNotNull())
    return dated.groupBy(KEY, F.to_date("InvoiceDate").alias("Date")).agg(
        F.sum("TotalAmount").alias("Spent"), F.sum("Quantity").alias("Quantity"), F.count("*").alias("Lines")
    )


def rolling_periods(lines: DataFrame, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """Totals of each customer over the last ``n`` days up to and with each day that has lines.

    ``CustomerID, Date``, and for every period ``Spent_n, Lines_n, ActiveDays_n``. Rows
    without customer or date are left out.
    """
    days = daily_totals(lines).withColumn("_day", F.unix_date("Date"))
    out = []
    for n in periods:
        frame = Window.partitionBy(KEY).orderBy("_day").rangeBetween(1 - n, 0)
        out += [
            F.sum("Spent").over(frame).alias(f"Spent_{n}"),
            F.sum("Lines").over(frame).alias(f"Lines_{n}"),
            F.count("*").over(frame).alias(f"ActiveDays_{n}"),
        ]
    return days.select(KEY, "Date", *out)


def calendar_report(lines: DataFrame) -> DataFrame:
    """Lines and revenue by quarter, month and weekend flag."""
    flagged = with_calendar_flags(lines)
    return flagged.groupBy("Quarter", "Month", "IsWeekend").agg(
        F.count("*").alias("Lines"), F.sum("TotalAmount").alias("Revenue")
    )

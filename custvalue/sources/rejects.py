"""Rows of transaction tables that cannot be read, with the reason, in the pass that reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.sources.dates import parsed

CORRUPT = "_corrupt_record"
REASONS = ("malformed line", "unreadable quantity", "unreadable price", "unreadable customer", "unreadable date")


def _present(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def reject_reason(df: DataFrame, formats: list[str] | None = None) -> Column:
    """The first of ``REASONS`` that holds for a row, null for a readable one.

    A missing quantity, price or customer is readable: cleaning decides about
    it. A missing date is not. Dates are read by ``formats`` (see
    :mod:`custvalue.sources.dates`), without any as ISO.
    """
    number = lambda c: _present(F.col(c)) & F.col(c).try_cast("double").isNull()
    date = F.col("InvoiceDate")
    when = date.try_cast("timestamp_ntz") if formats is None or dict(df.dtypes)["InvoiceDate"] != "string" else parsed(date, formats)
    corrupt = F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)
    checks = (corrupt, number("Quantity"), number("UnitPrice"), number("CustomerID"), when.isNull())
    reason = F.lit(None).cast("string")
    for name, failed in reversed(list(zip(REASONS, checks))):
        reason = F.when(failed, F.lit(name)).otherwise(reason)
    return reason


def classified(df: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """All rows with ``reject_reason``: written partitioned by it, one scan parts accepted rows from rejects."""
    return df.withColumn("reject_reason", reject_reason(df, formats))


def accepted_and_rejected(df: DataFrame, formats: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The readable rows as they are, and the others with their reason; together they are all rows."""
    rows = classified(df, formats)
    readable = rows.filter(F.col("reject_reason").isNull()).drop("reject_reason", CORRUPT)
    return readable, rows.filter(F.col("reject_reason").isNotNull())

"""Cleaning: each step is a function, ``clean_data`` chains them.

The order of the steps is that of the reported counts. Catalyst merges the
filters into one predicate and pushes it below the duplicate removal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.config import TRANSACTION_COLUMNS, Settings
from custvalue.sources.sinks import save_table

# The prefix of a cancelled invoice.
CANCELLATION_PREFIX = "C"


def canonical_columns(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rename configured source columns to the canonical names."""
    return df.withColumnsRenamed(
        {settings.source_name(c): c for c in TRANSACTION_COLUMNS if settings.source_name(c) in df.columns}
    )


def canonical_types(df: DataFrame) -> DataFrame:
    """Numbers as doubles (unreadable ones become null), customers in one spelling.

    ``'17850'`` and ``'17850.0'`` name one customer, so both become ``'17850.0'``
    before duplicates are compared. Text that is no number is left for
    :func:`convert_customer_id` to reject.
    """
    customer = F.col("CustomerID")
    return df.withColumns(
        {
            "Quantity": F.col("Quantity").try_cast("double"),
            "UnitPrice": F.col("UnitPrice").try_cast("double"),
            "CustomerID": F.coalesce(
                customer.try_cast("double").cast("string"), customer.cast("string")
            ),
        }
    )


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Drop copies over all columns. Copies are combined map-side before the shuffle."""
    return df.dropDuplicates()


def missing_customer() -> Column:
    return F.col("CustomerID").isNull() | (F.col("CustomerID") == "NaN")


def is_cancelled() -> Column:
    """Null invoices are not cancelled."""
    return F.coalesce(F.startswith(F.col("InvoiceNo").cast("string"), F.lit(CANCELLATION_PREFIX)), F.lit(False))


def is_positive(name: str) -> Column:
    return F.coalesce((F.col(name) > 0) & ~F.isnan(name), F.lit(False))


def parsed_date(date_format: str | None = None) -> Column:
    """Zone-less timestamp, null for text that is not a date."""
    raw = F.col("InvoiceDate")
    if date_format is None:
        return raw.try_cast("timestamp_ntz")
    return F.try_to_timestamp(raw.cast("string"), F.lit(date_format)).cast("timestamp_ntz")


def drop_missing_customers(df: DataFrame) -> DataFrame:
    return df.where(~missing_customer())


def drop_cancelled(df: DataFrame) -> DataFrame:
    return df.where(~is_cancelled())


def keep_positive_quantity(df: DataFrame) -> DataFrame:
    return df.where(is_positive("Quantity"))


def keep_positive_price(df: DataFrame) -> DataFrame:
    return df.where(is_positive("UnitPrice"))


def convert_dates(df: DataFrame, date_format: str | None = None) -> DataFrame:
    return df.withColumn("InvoiceDate", parsed_date(date_format)).where(F.col("InvoiceDate").isNotNull())


def convert_customer_id(df: DataFrame) -> DataFrame:
    """``'17850.0'`` becomes ``'17850'``; text that is no number raises."""
    return df.withColumn("CustomerID", F.col("CustomerID").cast("double").cast("bigint").cast("string"))


def add_derived_columns(df: DataFrame) -> DataFrame:
    ts = F.col("InvoiceDate")
    derived = {"TotalAmount": F.col("Quantity") * F.col("UnitPrice")}
    if dict(df.dtypes)["InvoiceDate"].startswith("timestamp"):
        derived |= {
            "Year": F.year(ts),
            "Month": F.month(ts),
            "DayOfWeek": F.weekday(ts),
            "Hour": F.hour(ts),
            "Date": F.to_date(ts),
        }
    return df.withColumns(derived)


def clean_data(
    df: DataFrame,
    settings: Settings = Settings(),
    *,
    duplicates: bool = True,
    missing_customers: bool = True,
    cancelled: bool = True,
    quantities: bool = True,
    prices: bool = True,
) -> DataFrame:
    """Raw transactions to cleaned transactions with derived columns."""
    steps = [
        (duplicates, remove_duplicates),
        (missing_customers, drop_missing_customers),
        (cancelled, drop_cancelled),
        (quantities, keep_positive_quantity),
        (prices, keep_positive_price),
    ]
    out = canonical_types(canonical_columns(df, settings))
    for wanted, step in steps:
        if wanted:
            out = step(out)
    return add_derived_columns(convert_customer_id(convert_dates(out, settings.date_format)))


# Steps after the removal of copies, with the condition that removes a row.
def _reasons(date_format: str | None) -> list[tuple[str, Column]]:
    return [
        ("missing_customers", missing_customer()),
        ("cancelled", is_cancelled()),
        ("invalid_quantities", ~is_positive("Quantity")),
        ("invalid_prices", ~is_positive("UnitPrice")),
        ("invalid_dates", parsed_date(date_format).isNull()),
    ]


def classified(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Distinct typed rows with ``_copies`` and ``_failed``, the number of the step that removes them (else null)."""
    typed = canonical_types(canonical_columns(df, settings))
    distinct = typed.groupBy(*typed.columns).agg(F.count(F.lit(1)).alias("_copies"))
    first_failed = F.lit(None).cast("int")
    for number, (_, failed) in reversed(list(enumerate(_reasons(settings.date_format), start=2))):
        first_failed = F.when(failed, number).otherwise(first_failed)
    return distinct.withColumn("_failed", first_failed)


def step_counts(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows removed by each cleaning step: ``step_no, step, rows_removed``, in one pass."""
    return _removed(classified(df, settings))


def _removed(rows: DataFrame) -> DataFrame:
    """The step counts of classified rows."""
    counted = rows.agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"),
        *[
            F.count_if(F.coalesce(F.col("_failed") == number, F.lit(False))).alias(name)
            for number, (name, _) in enumerate(_reasons(None), start=2)
        ],
    )
    cells = [
        F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.col(name).alias("rows_removed"))
        for i, name in enumerate(counted.columns, start=1)
    ]
    return counted.select(F.inline(F.array(*cells)))


@dataclass
class Cleaning:
    """One cleaning run; all three read the classified rows that it wrote."""

    lines: DataFrame
    steps: DataFrame
    stats: DataFrame


def clean_and_report(df: DataFrame, path: str, settings: Settings = Settings()) -> Cleaning:
    """Clean ``df`` and report on it from one reading of it.

    The classified rows are written as Parquet to ``path``. The cleaned lines are
    a filter on them, and the reports read the few columns that they need, so
    ``df`` is scanned and regrouped once. Counts observed while the rows pass
    would count the rows of repeated tasks again after the loss of an executor;
    these are exact. Customers before are counted on typed rows.
    """
    save_table(classified(df, settings), path, "parquet")
    rows = df.sparkSession.read.parquet(path)
    kept = rows.where(F.col("_failed").isNull()).drop("_copies", "_failed")
    lines = add_derived_columns(convert_customer_id(convert_dates(kept, settings.date_format)))
    customer = F.col("CustomerID")
    passed = F.col("_failed").isNull()
    counted = rows.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_before"),
        F.count_if(passed).alias("rows_after"),
        F.count_distinct(customer).alias("unique_customers_before"),
        F.count_distinct(F.when(passed, customer.cast("double").cast("bigint"))).alias("unique_customers_after"),
    )
    removed = F.col("rows_before") - F.col("rows_after")
    stats = counted.select(
        "rows_before",
        "rows_after",
        removed.alias("rows_removed"),
        F.try_divide(removed * F.lit(100.0), F.col("rows_before")).alias("removal_percentage"),
        F.lit(len(df.columns)).cast("bigint").alias("columns_before"),
        F.lit(len(lines.columns)).cast("bigint").alias("columns_after"),
        "unique_customers_before",
        "unique_customers_after",
    )
    return Cleaning(lines, _removed(rows), stats)


def preprocessing_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row comparing the table before and after cleaning."""

    def measures(df: DataFrame) -> tuple:
        # Without a customer column the distinct count is null.
        customers = F.count_distinct("CustomerID") if "CustomerID" in df.columns else F.max(F.lit(None))
        row = df.agg(F.struct(F.count(F.lit(1)).alias("rows"), customers.cast("bigint").alias("customers")))
        return row.scalar()

    one = before.sparkSession.range(1).select(measures(before).alias("b"), measures(after).alias("a"))
    removed = F.col("b.rows") - F.col("a.rows")
    return one.select(
        F.col("b.rows").alias("rows_before"),
        F.col("a.rows").alias("rows_after"),
        removed.alias("rows_removed"),
        F.try_divide(removed * F.lit(100.0), F.col("b.rows")).alias("removal_percentage"),
        F.lit(len(before.columns)).cast("bigint").alias("columns_before"),
        F.lit(len(after.columns)).cast("bigint").alias("columns_after"),
        F.col("b.customers").alias("unique_customers_before"),
        F.col("a.customers").alias("unique_customers_after"),
    )

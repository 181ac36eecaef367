"""The format of a column of date texts, inferred from the whole column in one aggregation.

Every text is reduced to its shape (each run of digits becomes ``9``) and its
numbers. A shape's rows and the least and greatest value of each number decide
which number is the year, the month and the day: a year has four digits, a month
is 12 at most. Shapes with the same separator decide together; where the values
allow both orders of day and month, the column is ambiguous and nothing is
guessed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE = r"^9([-/.])9(?:\1)9(?:([ T])9:9(:9)?)?$"
ORDERS = ("ymd", "dmy", "mdy")


class AmbiguousDates(ValueError):
    """Texts that fit several formats, or none."""


def date_shapes(df: DataFrame, column: str = "InvoiceDate") -> DataFrame:
    """``shape, rows, digits1, digits3, least1, most1, ... most3``: one row per shape of the column's texts.

    ``digits`` is the least number of digits of a number, ``least`` and ``most``
    its values; they are null for shapes with fewer numbers. Null and blank texts
    are left out. Rows are combined before the shuffle.
    """
    text = F.trim(F.col(f"`{column}`").cast("string"))
    number = lambda i: F.regexp_extract("text", r"^\D*" + r"\d+\D+" * i + r"(\d+)", 1)
    rows = df.select(text.alias("text")).filter(F.length("text") > 0)
    rows = rows.select(
        F.regexp_replace("text", r"\d+", "9").alias("shape"),
        *[number(i).try_cast("long").alias(f"n{i + 1}") for i in range(3)],
        *[F.nullif(F.length(number(i)), F.lit(0)).cast("long").alias(f"d{i + 1}") for i in (0, 2)],
    )
    digits = [F.min(f"d{i}").alias(f"digits{i}") for i in (1, 3)]
    values = [f(f"n{i}").alias(f"{name}{i}") for i in (1, 2, 3) for f, name in ((F.min, "least"), (F.max, "most"))]
    return rows.groupBy("shape").agg(F.count("*").alias("rows"), *digits, *values)


def _orders(row) -> set[str]:
    """Orders of year, month and day that all texts of a shape allow."""
    found = set()
    for order in ORDERS:
        year = row["digits1"] if order[0] == "y" else row["digits3"]
        month, day = order.index("m") + 1, order.index("d") + 1
        inside = all(1 <= row[f"least{i}"] and row[f"most{i}"] <= top for i, top in ((month, 12), (day, 31)))
        if year == 4 and inside:
            found.add(order)
    return found


def date_formats(df: DataFrame, column: str = "InvoiceDate") -> list[str]:
    """The datetime patterns of the column's texts, that of the most rows first.

    Texts of other shapes, or of shapes whose values are no dates, are left to be
    rejected. Raises ``AmbiguousDates`` where the values of all shapes of a
    separator allow several orders, and where texts are there but none is a date.
    A column without texts has no formats. At most a few dozen shapes of dates
    exist, so that many rows reach the driver.
    """
    shapes = date_shapes(df, column)
    rows = shapes.filter(F.col("shape").rlike(SHAPE)).orderBy(F.desc("rows"), "shape").collect()
    together: dict[tuple, set[str]] = {}
    dated = []
    for row in rows:
        orders, parts = _orders(row), re.match(SHAPE, row["shape"])
        if orders:
            key = parts[1], "ymd" in orders
            together[key] = together.get(key, orders) & orders
            dated.append((parts, key, row["shape"]))
    if not dated and not shapes.isEmpty():
        raise AmbiguousDates(f"no text of column {column} is a date")
    out = []
    for parts, key, shape in dated:
        if len(together[key]) != 1:
            raise AmbiguousDates(f"texts like {shape} in column {column} fit {' and '.join(sorted(together[key])) or 'no order'}")
        (order,) = together[key]
        pattern = parts[1].join({"y": "yyyy", "m": "M", "d": "d"}[x] for x in order)
        if parts[2]:
            pattern += ("'T'" if parts[2] == "T" else " ") + ("H:m:s" if parts[3] else "H:m")
        out.append(pattern)
    return out


def parsed(text: Column, formats: list[str]) -> Column:
    """The zone-less timestamp by the first pattern that fits; null where none does."""
    found = [F.try_to_timestamp(F.trim(text.cast("string")), F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*found) if found else F.lit(None).cast("timestamp_ntz")


def with_parsed_dates(df: DataFrame, column: str = "InvoiceDate") -> DataFrame:
    """The table with its date texts as timestamps; ISO texts, and columns that are no texts, are left as they are."""
    if dict(df.dtypes).get(column) != "string":
        return df
    formats = date_formats(df, column)
    if all(f.startswith("yyyy-") for f in formats):
        return df
    return df.withColumn(column, parsed(F.col(f"`{column}`"), formats))

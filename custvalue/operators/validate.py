"""Validation and profiling of a raw table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custvalue.config import Settings
from custvalue.functions.ordering import quantiles

# The quantiles of a numeric description.
DESCRIBE_QUANTILES = [0.25, 0.5, 0.75]


def column_check(df: DataFrame, settings: Settings = Settings()) -> dict:
    """Missing and extra columns, from the schema alone. Extra columns do not invalidate."""
    required, existing = settings.required_columns, df.columns
    missing = [c for c in required if c not in existing]
    return {
        "is_valid": not missing,
        "missing_columns": missing,
        "extra_columns": [c for c in existing if c not in required],
    }


def schema_summary(df: DataFrame) -> dict:
    """Column names, types and columns by kind, from the schema alone."""
    kinds = {"numeric_columns": [], "categorical_columns": [], "datetime_columns": []}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            kinds["numeric_columns"].append(f.name)
        elif isinstance(f.dataType, T.StringType):
            kinds["categorical_columns"].append(f.name)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            kinds["datetime_columns"].append(f.name)
    return {"columns": df.columns, "dtypes": dict(df.dtypes), **kinds}


def _is_missing(df: DataFrame, name: str):
    missing = F.col(name).isNull()
    if dict(df.dtypes)[name] in ("double", "float"):
        missing = missing | F.isnan(name)
    return missing


def data_quality(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row: validity, row and column counts, rows beyond their first copy."""
    check = column_check(df, settings)
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return counted.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
    ).select(
        F.lit(check["is_valid"]).alias("is_valid"),
        F.lit(len(check["missing_columns"])).cast("bigint").alias("missing_columns"),
        F.lit(len(check["extra_columns"])).cast("bigint").alias("extra_columns"),
        "total_rows",
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        "duplicate_rows",
    )


def null_profile(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """``column, missing_count, missing_percentage`` per column, in one scan."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(_is_missing(df, c)).alias(c) for c in df.columns],
    )
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(c).alias("missing_count"),
            F.try_divide(F.col(c) * F.lit(100.0), F.col("_rows")).alias("missing_percentage"),
        )
        for c in df.columns
    ]
    long = counts.select(F.inline(F.array(*cells)))
    return long.where(F.col("missing_count") > 0) if only_missing else long


def distinct_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """``column, distinct_count`` per column, nulls ignored.

    Spark shuffles each column's values under their own hash before counting
    them, so a frequent value is combined map-side and no task sees a whole
    column. ``approximate`` uses sketches: one scan, no shuffle of the values.
    """
    count = F.approx_count_distinct if approximate else F.count_distinct
    row = df.agg(*[count(F.when(~_is_missing(df, c), F.col(c))).alias(c) for c in df.columns])
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct_count")) for c in df.columns]
    return row.select(F.inline(F.array(*cells)))


def numeric_describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, count, mean, std, min, q25, q50, q75, max`` of the numeric columns, exact."""
    columns = columns or schema_summary(df)["numeric_columns"]
    values = {c: F.when(~_is_missing(df, c), F.col(c)).cast("double") for c in columns}
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.select(*[v.alias(c) for c, v in values.items()]).agg(
        *[f(c).alias(f"{c}|{m}") for c in columns for m, f in measures.items()]
    )
    cells = [
        F.struct(F.lit(c).alias("metric"), *[F.col(f"`{c}|{m}`").alias(m) for m in measures])
        for c in columns
    ]
    moments = row.select(F.inline(F.array(*cells)))
    middles = quantiles(df, values, DESCRIBE_QUANTILES)
    # Both sides have one row per numeric column.
    return moments.join(F.broadcast(middles), "metric", "left").select(
        F.col("metric").alias("column"),
        "count", "mean", "std", "min",
        F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"),
        "max",
    )

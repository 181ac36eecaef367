"""Stored profiles: mergeable facts per day and column, from which the profile of any period is put together.

Counts, sums and extremes are exact. Distinct values and quantiles are sketches
(HyperLogLog and KLL), whose size does not depend on the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.operators.prepare import NUMERIC

DISTINCT_BITS = 12  # relative standard error about 1.04 / sqrt(2 ** 12), 1.6 %
QUANTILE_SIZE = 200  # error of a rank about 1.33 %
QUANTILES = (0.25, 0.5, 0.75)


def _numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def _present(df: DataFrame, name: str) -> Column:
    """The value, null where it is NaN."""
    value = F.col(f"`{name}`")
    return F.when(~F.isnan(value), value) if dict(df.dtypes)[name] in ("double", "float") else value


def daily_profiles(df: DataFrame, day: Column, columns: list[str] | None = None) -> DataFrame:
    """``day, column, rows, missing, distinct, low, high, mean, squares, ranks``: a line per day and column.

    ``distinct`` and ``ranks`` are sketches, ``squares`` the summed squared
    distances from the day's mean; text columns have a distinct sketch alone.
    Rows without a day are profiled under a null day. One scan, and the sketches
    are combined before the shuffle, so a day may hold any share of the rows.
    """
    kinds = dict(df.dtypes)
    columns = columns or df.columns
    facts = []
    for i, c in enumerate(columns):
        value = _present(df, c)
        facts += [F.count(value).alias(f"n{i}"), F.hll_sketch_agg(value.cast("string"), DISTINCT_BITS).alias(f"d{i}")]
        if _numeric(kinds[c]):
            number = value.cast("double")
            facts += [
                F.min(number).alias(f"low{i}"),
                F.max(number).alias(f"high{i}"),
                F.avg(number).alias(f"mean{i}"),
                (F.var_pop(number) * F.count(number)).alias(f"squares{i}"),
                F.kll_sketch_agg_double(number, F.lit(QUANTILE_SIZE)).alias(f"ranks{i}"),
            ]
    wide = df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("rows"), *facts)
    lines = []
    for i, c in enumerate(columns):
        number = _numeric(kinds[c])
        lines.append(
            F.struct(
                F.lit(c).alias("column"),
                (F.col("rows") - F.col(f"n{i}")).alias("missing"),
                F.col(f"d{i}").alias("distinct"),
                *[
                    (F.col(f"{m}{i}") if number else F.lit(None).cast("double")).alias(m)
                    for m in ("low", "high", "mean", "squares")
                ],
                (F.col(f"ranks{i}") if number else F.lit(None).cast("binary")).alias("ranks"),
            )
        )
    return wide.select("day", "rows", F.inline(F.array(*lines))).select(
        "day", "column", "rows", "missing", "distinct", "low", "high", "mean", "squares", "ranks"
    )


def merged_profile(profiles: DataFrame, first=None, last=None) -> DataFrame:
    """The profile of all days from ``first`` to ``last`` (each included; open where none is named), without reading rows.

    ``column, rows, missing, distinct, min, max, mean, std, q25, q50, q75``: the
    first two, extremes, mean and deviation are exact, distinct counts and
    quantiles estimates. Days outside the period are pruned by the filter; rows
    without a day belong to the open period only. A period without days has no lines.
    """
    if first is not None:
        profiles = profiles.where(F.col("day") >= F.lit(first))
    if last is not None:
        profiles = profiles.where(F.col("day") <= F.lit(last))
    n = F.col("rows") - F.col("missing")
    # A shift near the values keeps the sum of squares from cancelling.
    shifts = profiles.groupBy("column").agg(F.avg("mean").alias("_shift"))
    off = F.col("mean") - F.col("_shift")
    ranks = F.kll_merge_agg_double("ranks").alias("_ranks")
    # One row per column on the right.
    merged = (
        profiles.join(F.broadcast(shifts), "column")
        .groupBy("column")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("missing").alias("missing"),
            F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"),
            F.min("low").alias("min"),
            F.max("high").alias("max"),
            F.sum(F.when(off.isNotNull(), n)).alias("_n"),
            F.first("_shift", ignorenulls=True).alias("_shift"),
            F.sum(n * off).alias("_sum"),
            F.sum(F.col("squares") + n * off * off).alias("_squares"),
            ranks,
        )
    )
    squares = F.greatest(F.col("_squares") - F.try_divide(F.col("_sum") ** 2, F.col("_n")), F.lit(0.0))
    probabilities = F.array(*[F.lit(q) for q in QUANTILES])
    known = F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_ranks", probabilities))
    return merged.withColumn("_q", known).select(
        "column", "rows", "missing", "distinct", "min", "max",
        (F.col("_shift") + F.try_divide(F.col("_sum"), F.col("_n"))).alias("mean"),
        F.when(F.col("_n") > 1, F.sqrt(squares / (F.col("_n") - 1))).alias("std"),
        *[F.col("_q")[i].alias(f"q{round(100 * q)}") for i, q in enumerate(QUANTILES)],
    )

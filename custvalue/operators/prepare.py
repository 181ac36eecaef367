"""Missing values, scaling, encoding, splitting and model matrices."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.functions.ordering import bracketed_quantiles, running_totals
from custvalue.operators.customers import KEY

# Columns that are no features of the customer summary / feature table.
SUMMARY_EXCLUDED = ("CustomerID", "FirstPurchaseDate", "LastPurchaseDate", "Country")
FEATURES_EXCLUDED = ("CustomerID", "RFMSegment", "CustomerSegment")
# Columns that restate the target, for callers who want a model without leakage.
LEAKY = ("MonetaryScore", "RFMScore")
# The reference scaler leaves 32-bit integers alone; these two hours are such.
UNSCALED_FOR_PARITY = ("EarliestPurchaseHour", "LatestPurchaseHour")

NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint")


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [c for c, kind in df.dtypes if (kind in NUMERIC or kind.startswith("decimal")) and c not in exclude]


# --- missing values --------------------------------------------------------


def column_medians(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``metric, n, q0`` with the exact median of each numeric column."""
    columns = columns or numeric_columns(df)
    found = bracketed_quantiles(df, {c: F.col(c) for c in columns}, [0.5])
    rows = [(c, n, middle) for c, (n, (middle,)) in found.items()]
    return df.sparkSession.createDataFrame(rows, "metric string, n long, q0 double")


def incomplete_columns(df: DataFrame) -> list[str]:
    """Numeric columns that hold a null, found with one aggregation."""
    kinds = dict(df.dtypes)

    def missing(c: str) -> Column:
        null = F.col(c).isNull()
        return null | F.isnan(c) if kinds[c] in ("double", "float") else null

    columns = numeric_columns(df, (KEY,))
    row = df.agg(*[F.bool_or(missing(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def fill_missing(
    df: DataFrame, columns: list[str] | None = None, middles: dict[str, float] | None = None
) -> DataFrame:
    """Numeric nulls become the column median; 0 in a column without any value.

    Each filled column is sorted to find its median, so only columns that hold a
    null are worth naming. Without ``columns`` they are looked up in one pass.
    ``middles`` supplies medians that exist already.
    """
    columns = incomplete_columns(df) if columns is None else columns
    if not columns:
        return df
    if middles is None:
        middles = {r["metric"]: r["q0"] for r in column_medians(df, columns).collect()}
    kinds = dict(df.dtypes)
    filled = {}
    for c in columns:
        value = F.col(c) if kinds[c] not in ("double", "float") else F.when(~F.isnan(c), F.col(c))
        middle = middles.get(c)
        filled[c] = F.coalesce(value, F.lit(0.0 if middle is None else middle))
    return df.withColumns(filled)


def replace_infinite(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    kinds = dict(df.dtypes)
    columns = [c for c in (columns or df.columns) if kinds[c] in ("double", "float")]
    infinite = F.lit(float("inf"))
    return df.withColumns({c: F.when(F.abs(c) == infinite, 0.0).otherwise(F.col(c)) for c in columns})


# --- scaling ---------------------------------------------------------------


def _scale(df: DataFrame, columns: list[str], statistics: dict, formula) -> DataFrame:
    cells = [f(c).alias(f"{c}|{name}") for c in columns for name, f in statistics.items()]
    row = df.agg(F.struct(*cells)).scalar()
    scaled = {}
    for c in columns:
        stats = {name: row.getField(f"{c}|{name}") for name in statistics}
        scaled[c] = formula(F.col(c).cast("double"), stats)
    return df.withColumns(scaled)


def scale_features(
    df: DataFrame,
    method: str = "standard",
    exclude: tuple[str, ...] = (KEY,),
    parity: bool = False,
) -> DataFrame:
    """Scale numeric columns; the statistics are one scalar subquery over ``df``.

    ``standard`` uses the population deviation, with 1 in place of 0. Any other
    method is min-max, which maps a constant column to 0. ``parity`` leaves the
    two whole-hour columns unscaled.
    """
    exclude = (*exclude, *UNSCALED_FOR_PARITY) if parity else exclude
    columns = numeric_columns(df, tuple(exclude))
    if method == "standard":
        return _scale(
            df,
            columns,
            {"mean": F.avg, "std": F.stddev_pop},
            lambda v, s: (v - s["mean"]) / F.when(s["std"] > 0, s["std"]).otherwise(1.0),
        )
    return _scale(
        df,
        columns,
        {"low": F.min, "high": F.max},
        lambda v, s: (v - s["low"])
        / F.when(s["high"] > s["low"], s["high"] - s["low"]).otherwise(1.0),
    )


# --- encoding --------------------------------------------------------------


def label_encode(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """Number the distinct values of a column 0..k-1 in ascending order.

    The numbering is a small table per distinct value; its size is the data's,
    so the join strategy is left to the optimiser.
    """
    text = F.col(column).cast("string")
    values = df.where(text.isNotNull()).select(text.alias(column)).distinct().withColumn("_one", F.lit(1))
    codes = running_totals(values, [column], "_one").select(
        F.col(column).alias("_label"), (F.col("_rank") - 1).alias("_code")
    )
    coded = df.join(codes, text == F.col("_label"), "left").drop("_label")
    return coded.drop(*([] if output else [column])).withColumnRenamed("_code", output or column)


# --- splits ----------------------------------------------------------------


def hash_percent(id_: Column, seed: int) -> Column:
    """A stable number in 0..99 per id, independent of partitioning."""
    digest = F.md5(F.concat(id_.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100


def split(df: DataFrame, test_share: float = 0.2, seed: int = 42, id_col: str = KEY):
    """Train and test rows by hash of the id."""
    marked = hash_percent(F.col(id_col), seed)
    limit = round(test_share * 100)
    return df.where(marked >= limit), df.where(marked < limit)


def with_fold(df: DataFrame, folds: int = 5, id_col: str = KEY, output: str = "fold") -> DataFrame:
    """Fold number by hash of the id, on another seed than the split."""
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit("|fold")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % folds
    return df.withColumn(output, number.cast("int"))


def with_contiguous_fold(df: DataFrame, folds: int = 5, id_col: str = KEY, output: str = "fold") -> DataFrame:
    """Fold number by place in the order of the (unique) id: runs of equal length, the first ones longer by a row if need be."""
    placed = running_totals(df.withColumn("_one", F.lit(1)), [id_col], "_one")
    place, rows = F.col("_rank") - 1, F.col("_n")
    length, longer = F.floor(rows / folds), rows % folds
    # A place inside the longer runs, or what lies behind them in runs of the plain length.
    ahead = longer * (length + 1)
    number = F.when(place < ahead, F.floor(place / (length + 1))).otherwise(
        longer + F.floor((place - ahead) / F.greatest(length, F.lit(1)))
    )
    return placed.select(*df.columns, number.cast("int").alias(output))


# --- model matrices --------------------------------------------------------


def assemble(df: DataFrame, columns: list[str], target: str, id_col: str = KEY) -> DataFrame:
    assembler = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error")
    return assembler.transform(
        df.select(id_col, *columns, F.col(target).cast("double").alias("label"))
    ).select(id_col, "features", "label")


def prepare_for_modeling(summary: DataFrame, target: str = "TotalRevenue") -> tuple[DataFrame, list[str]]:
    """Model columns of the customer summary: CustomerID, features (nulls filled), target."""
    columns = [c for c in summary.columns if c not in (*SUMMARY_EXCLUDED, target)]
    return fill_missing(summary.select(KEY, *columns, target)), columns


def model_columns(
    features: DataFrame, target: str = "Monetary", exclude_leaky: bool = False
) -> tuple[DataFrame, list[str]]:
    """Model columns of the feature table; remaining text columns are label-encoded."""
    drop = (*FEATURES_EXCLUDED, target, *(LEAKY if exclude_leaky else ()))
    columns = [c for c in features.columns if c not in drop]
    out = features.select(KEY, *columns, target)
    for c, kind in features.dtypes:
        if c in columns and kind == "string":
            out = label_encode(out, c)
    return out.select(KEY, *columns, target), columns

"""CSV and Parquet readers for transactions and for feature tables to score."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custvalue.config import Settings
from custvalue.operators.validate import column_check
from custvalue.sources.dates import with_parsed_dates

# Accepted spellings of the encodings Spark reads.
ENCODINGS = {
    "utf-8": "UTF-8",
    "utf8": "UTF-8",
    "latin1": "ISO-8859-1",
    "latin-1": "ISO-8859-1",
    "iso-8859-1": "ISO-8859-1",
    "cp1252": "cp1252",
    "windows-1252": "cp1252",
    "us-ascii": "US-ASCII",
}
FALLBACK_ENCODING = "ISO-8859-1"
# Windows-1252 is ISO-8859-1 but for these bytes, which Spark's reader leaves as control characters.
WINDOWS_BYTES = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
WINDOWS_TEXT = bytes(WINDOWS_BYTES).decode("cp1252")
REPLACEMENT_CHARACTER = "�"


def load_csv(
    spark: SparkSession, path: str, encoding: str | None = None, corrupt_column: str | None = None, **options
) -> DataFrame:
    """Read a CSV file or folder with a header line.

    Columns come back as strings unless a ``schema`` or ``inferSchema`` option is
    given; cleaning casts them. A named encoding is used as it is. Without one
    the text is read as UTF-8, and read again as ISO-8859-1 (which accepts every
    byte) if any value does not decode. That check is one extra pass, so name
    the encoding of large inputs. ``corrupt_column`` adds a column that holds the
    line where it has too few or too many values, null elsewhere.
    """
    named = encoding is not None
    charset = ENCODINGS.get((encoding or "utf-8").lower(), encoding)
    if corrupt_column is not None and "schema" not in options:
        columns = _read(spark, path, charset, options).schema
        options |= {"schema": columns.add(corrupt_column, "string"), "columnNameOfCorruptRecord": corrupt_column}
    df = _read(spark, path, charset, options)
    if not named and _has_undecodable_text(df):
        df = _read(spark, path, FALLBACK_ENCODING, options)
    return df


def _read(spark: SparkSession, path: str, charset: str, options: dict) -> DataFrame:
    options = dict(options)
    schema = options.pop("schema", None)
    windows = charset == "cp1252"
    charset = FALLBACK_ENCODING if windows else charset
    reader = spark.read.option("header", True).option("encoding", charset).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        df = reader.csv(path)
        return _windows_text(df) if windows else df
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"The file {path} does not exist") from error
        raise


def _windows_text(df: DataFrame) -> DataFrame:
    """Texts read as ISO-8859-1 with the signs that Windows-1252 has instead of control characters."""
    controls = bytes(WINDOWS_BYTES).decode("latin-1")
    return df.select(
        *[
            F.translate(F.col(f"`{c}`"), controls, WINDOWS_TEXT).alias(c) if kind == "string" else F.col(f"`{c}`")
            for c, kind in df.dtypes
        ]
    )


def _has_undecodable_text(df: DataFrame) -> bool:
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if not texts:
        return False
    broken = F.lit(False)
    for c in texts:
        broken = broken | F.coalesce(F.contains(F.col(f"`{c}`"), F.lit(REPLACEMENT_CHARACTER)), F.lit(False))
    return not df.where(broken).isEmpty()


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_and_validate(
    spark: SparkSession, path: str, settings: Settings = Settings(), **options
) -> tuple[DataFrame, dict]:
    """Read transactions and compare their columns with the required ones.

    A configured encoding other than UTF-8 is used as it is. Without a configured
    date format that of the date column is inferred in one more pass, and dates
    that are not in ISO form come back as timestamps; a column that fits several
    formats, or none, raises :class:`custvalue.sources.dates.AmbiguousDates`. The
    second value is metadata only; the data measures (nulls, duplicates) are the
    DataFrames of :mod:`custvalue.operators.validate`.
    """
    encoding = options.pop("encoding", None)
    if encoding is None and ENCODINGS.get(settings.encoding.lower()) != "UTF-8":
        encoding = settings.encoding
    df = load_csv(spark, path, encoding, **options)
    dates = settings.source_name("InvoiceDate")
    if settings.date_format is None and dates in df.columns:
        df = with_parsed_dates(df, dates)
    return df, column_check(df, settings)

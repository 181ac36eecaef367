"""Writers. Every writer returns the path it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from custvalue.config import Settings


def save_table(
    df: DataFrame, path: str, fmt: str = "csv", partition_by: list[str] | None = None, only_present: bool = False
) -> str:
    """Replace ``path`` by ``df`` as a folder of CSV (with header) or Parquet files.

    The rows are written to a private folder beside ``path``, which takes its
    place by renaming when all of them are there. A write that fails leaves what
    was there before, and ``df`` may read from ``path`` itself. Between the two
    renames ``path`` is absent for a moment; where the second one fails, the
    first is undone. (On object stores a rename is a copy.)

    ``only_present`` replaces the partitions that ``df`` holds and keeps the
    others; Spark stages and renames those itself.
    """
    if only_present:
        if not partition_by:
            raise ValueError("only_present needs partition columns")
        _write(df, path, fmt, partition_by, dynamic=True)
        return path
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    files = target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())
    token = uuid.uuid4().hex
    # Names that begin with a dot are not read as data where the parent folder is a table.
    fresh, former = (jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{kind}-{token}") for kind in ("new", "old"))
    try:
        _write(df, fresh.toString(), fmt, partition_by)
        replaced = files.exists(target)
        if replaced and not files.rename(target, former):
            raise OSError(f"Could not move {path} aside")
        if not files.rename(fresh, target):
            if replaced:
                files.rename(former, target)
            raise OSError(f"Could not publish {path}")
        if replaced:
            files.delete(former, True)
    finally:
        files.delete(fresh, True)
    return path


def _write(df: DataFrame, path: str, fmt: str, partition_by: list[str] | None, dynamic: bool = False) -> None:
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"Unknown format: {fmt}")
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def save_processed_data(
    df: DataFrame, path: str | None = None, fmt: str = "csv", settings: Settings = Settings()
) -> str:
    return save_table(df, path or settings.processed_path, fmt)


def save_features(
    df: DataFrame, path: str | None = None, fmt: str = "csv", settings: Settings = Settings()
) -> str:
    return save_table(df, path or settings.features_path, fmt)


def save_predictions(
    df: DataFrame, path: str, fmt: str = "csv", by_segment: bool = False, only_present: bool = False
) -> str:
    """Write predictions; ``by_segment`` lays them out in one folder per value segment.

    With ``only_present`` the segments that ``df`` lacks keep their former rows.
    """
    return save_table(df, path, fmt, ["CLV_Segment"] if by_segment else None, only_present)


def save_report(report: DataFrame, path: str, fmt: str = "csv") -> str:
    """Write an evaluation report table (see :func:`custvalue.operators.metrics.report`)."""
    return save_table(report, path, fmt)

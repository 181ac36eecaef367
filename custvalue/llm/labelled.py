"""Bounded samples of labelled rows for fitting the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

_SPAN = float(2**63)


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def sample_per_class(rows: DataFrame, class_col: str, key_col: str, per_class: int) -> list[Row]:
    """At most ``per_class`` rows of each class, those of the least key hash; classes without rows are absent.

    Classes are counted first, so that tasks send only about as many rows as are
    asked for; null classes and keys are left out.
    """
    rows = rows.filter(F.col(class_col).isNotNull() & F.col(key_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(class_col).count().collect()}
    if not counts:
        return []
    place = (F.xxhash64(F.col(key_col).cast("string")).cast("double") / _SPAN + 1) / 2
    share = F.lit(None).cast("double")
    for name, n in counts.items():
        share = F.when(F.col(class_col) == name, min(1.0, (1.2 * per_class + 20) / n)).otherwise(share)
    near = rows.withColumn("_place", place).filter(F.col("_place") <= share)
    found = near.limit(2 * (per_class + 20) * len(counts)).collect()
    kept: dict[object, list[Row]] = {}
    for row in sorted(found, key=lambda r: (r["_place"], str(r[key_col]))):
        same = kept.setdefault(row[class_col], [])
        if len(same) < per_class:
            same.append(row)
    return [r for name in sorted(kept, key=str) for r in kept[name]]

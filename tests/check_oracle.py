"""Compare registered queries with their SQL counterparts: ``python tests/check_oracle.py [sf_dir] [key ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

import __spark_entry__ as entry_points
from tests.conftest import local_session


def table_of(df) -> list[tuple]:
    columns = sorted(df.columns)
    rows = []
    for record in df[columns].itertuples(index=False):
        rows.append(tuple(None if pd.isna(v) else v for v in record))
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def compare(spark, connection, sf_dir: str, key: str) -> str | None:
    """None when equal, otherwise what differs."""
    got = entry_points.queries()[key](spark, sf_dir).toPandas()
    want = connection.sql(entry_points.oracle_sql()[key]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns}
    mixed = {c: k for c, k in kinds.items() if k[0] != k[1]}
    if mixed:
        return f"types {mixed}"
    left, right = table_of(got), table_of(want)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if different:
        return f"{len(different)} of {len(left)} rows differ, first {different[0]}"
    return None


def connect(sf_dir: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or list(entry_points.oracle_sql())
    spark, connection, failures = local_session(), connect(sf_dir), 0
    for key in keys:
        started = time.monotonic()
        try:
            problem = compare(spark, connection, sf_dir, key)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {key} {time.monotonic() - started:.1f}s {problem or ''}", flush=True)
    print(f"{len(keys) - failures} of {len(keys)} equal")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Safe replacement of tables, cleaning with its reports from one reading, and profiles merged from stored days."""

import datetime
import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from custvalue.operators import clean, profiles
from custvalue.sources.sinks import save_predictions, save_table

# --- publication -----------------------------------------------------------


def kept(spark, path, fmt="parquet"):
    return sorted(r[0] for r in spark.read.format(fmt).load(path).select("v").collect())


@pytest.mark.parametrize("former", [True, False])
def test_failed_write_leaves_the_former_rows(spark, tmp_path, former):
    path = f"{tmp_path}/table"
    if former:
        save_table(spark.range(3).select(F.col("id").alias("v")), path, "parquet")
    # Most tasks write their rows before the last one fails.
    broken = spark.range(0, 1000, 1, 4).select(
        F.when(F.col("id") < 999, F.col("id")).otherwise(F.raise_error(F.lit("torn"))).cast("long").alias("v")
    )
    with pytest.raises(Exception, match="torn"):
        save_table(broken, path, "parquet")
    assert os.listdir(tmp_path) == (["table"] if former else [])
    if former:
        assert kept(spark, path) == [0, 1, 2]


def test_a_table_may_be_rewritten_from_itself(spark, tmp_path):
    path = f"{tmp_path}/table"
    save_table(spark.range(4).select(F.col("id").alias("v")), path, "parquet")
    save_table(spark.read.parquet(path).select((F.col("v") * 10).alias("v")), path, "parquet")
    assert kept(spark, path) == [0, 10, 20, 30]
    assert os.listdir(tmp_path) == ["table"]


def test_unknown_format_touches_nothing(spark, tmp_path):
    path = f"{tmp_path}/table"
    save_table(spark.range(2).select(F.col("id").alias("v")), path, "parquet")
    with pytest.raises(ValueError):
        save_table(spark.range(1), path, "orc?")
    assert kept(spark, path) == [0, 1]


def test_segments_that_are_absent_stay_if_asked(spark, tmp_path):
    path = f"{tmp_path}/scored"
    schema = "v long, CLV_Segment string"
    save_predictions(spark.createDataFrame([(1, "Low"), (2, "High")], schema), path, "parquet", by_segment=True)
    fresh = spark.createDataFrame([(3, "High")], schema)
    save_predictions(fresh, path, "parquet", by_segment=True, only_present=True)
    assert kept(spark, path) == [1, 3]
    save_predictions(fresh, path, "parquet", by_segment=True)
    assert kept(spark, path) == [3]
    with pytest.raises(ValueError):
        save_predictions(fresh, path, "parquet", only_present=True)


# --- cleaning --------------------------------------------------------------

SCHEMA = "InvoiceNo string, StockCode string, Description string, Quantity string, InvoiceDate string, UnitPrice string, CustomerID string, Country string"
GOOD = ("1", "s", "mug", "2", "2020-01-01 10:00:00", "1.5", "7", "France")


def changed(**cells):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return tuple(cells.get(n, v) for n, v in zip(names, GOOD))


ROWS = [
    GOOD, GOOD, changed(CustomerID="7.0"), changed(InvoiceNo="2"), changed(CustomerID=None), changed(InvoiceNo="C1"),
    changed(Quantity="0"), changed(Quantity="x"), changed(UnitPrice=None), changed(InvoiceDate="soon"),
    changed(InvoiceNo=None), changed(CustomerID="8", UnitPrice="0"),
]


@pytest.mark.parametrize("rows", [ROWS, ROWS[4:6], []])
def test_one_reading_gives_what_the_separate_ones_give(spark, tmp_path, rows):
    raw = spark.createDataFrame(rows, SCHEMA)
    run = clean.clean_and_report(raw, f"{tmp_path}/classified")
    lines = clean.clean_data(raw)
    assert run.lines.columns == lines.columns
    # Compared as text, for rows may hold nulls.
    assert sorted(map(str, run.lines.collect())) == sorted(map(str, lines.collect()))
    assert run.steps.collect() == clean.step_counts(raw).collect()
    typed = clean.canonical_types(raw)  # customers before are counted on typed rows
    assert run.stats.collect() == clean.preprocessing_stats(typed, lines).collect()


def test_reports_read_no_more_than_they_need(spark, tmp_path):
    run = clean.clean_and_report(spark.createDataFrame(ROWS, SCHEMA), f"{tmp_path}/classified")
    for report in (run.steps, run.stats):
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Country" not in plan


# --- stored profiles -------------------------------------------------------


@pytest.fixture(scope="module")
def days(spark):
    """Sixty days, one of which holds a third of the rows, with values far from zero."""
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        day = 30 if i % 3 == 0 else rng.randrange(60)
        value = None if i % 50 == 0 else float("nan") if i % 50 == 1 else 1e7 + rng.expovariate(0.1)
        rows.append((datetime.date(2021, 1, 1) + datetime.timedelta(day), f"k{rng.randrange(2500)}", value))
    rows += [(None, "no day", 1.0)]
    table = spark.createDataFrame(rows, "d date, k string, v double")
    stored = profiles.daily_profiles(table, F.col("d"), ["k", "v"]).persist()
    yield rows, stored
    stored.unpersist()


@pytest.mark.parametrize("first, last", [(0, 59), (10, 20), (30, 30), (None, None)])
def test_merged_profile_against_the_rows(days, first, last):
    rows, stored = days
    start = datetime.date(2021, 1, 1)
    low, high = (None if n is None else start + datetime.timedelta(n) for n in (first, last))
    part = [r for r in rows if low is None or (r[0] is not None and low <= r[0] <= high)]
    got = {r["column"]: r for r in profiles.merged_profile(stored, low, high).collect()}
    values = sorted(r[2] for r in part if r[2] is not None and not math.isnan(r[2]))
    v, k = got["v"], got["k"]
    assert v["rows"] == k["rows"] == len(part)
    assert v["missing"] == len(part) - len(values) and k["missing"] == 0
    assert (v["min"], v["max"]) == (values[0], values[-1])
    assert v["mean"] == pytest.approx(statistics.fmean(values), rel=1e-12)
    assert v["std"] == pytest.approx(statistics.stdev(values), rel=1e-6)
    assert k["min"] is None and k["q50"] is None
    # Four deviations of the sketch with 2^12 registers; three rank errors of the quantiles.
    distinct = len({r[1] for r in part})
    assert abs(k["distinct"] - distinct) <= 4 * 1.04 / 64 * distinct + 1
    for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        rank = sum(x <= v[name] for x in values) / len(values)
        assert abs(rank - q) <= 0.04


def test_profiles_of_nothing(spark, days):
    _, stored = days
    assert profiles.merged_profile(stored, datetime.date(1999, 1, 1), datetime.date(1999, 1, 2)).count() == 0
    empty = spark.createDataFrame([], "d date, k string, v double")
    assert profiles.daily_profiles(empty, F.col("d"), ["k", "v"]).count() == 0
    nulls = spark.createDataFrame([(datetime.date(2020, 1, 1), None, None)] * 2, "d date, k string, v double")
    got = {r["column"]: r for r in profiles.merged_profile(profiles.daily_profiles(nulls, F.col("d"))).collect()}
    assert got["v"]["missing"] == 2 and got["v"]["mean"] is None and got["v"]["std"] is None and got["v"]["q50"] is None
    assert got["k"]["distinct"] == 0

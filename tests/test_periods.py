"""Rolling periods against plain sums, with a customer that owns a third of the lines."""

import datetime as dt
import random

from custvalue.operators.periods import daily_totals, rolling_periods, with_calendar_flags

SCHEMA = "CustomerID string, InvoiceDate timestamp_ntz, TotalAmount double, Quantity double"


def rows_of(n, seed=4):
    rng = random.Random(seed)
    start = dt.datetime(2020, 1, 1)
    who = lambda: "hot" if rng.random() < 0.34 else f"c{rng.randrange(40)}"
    return [(who(), start + dt.timedelta(hours=rng.randrange(24 * 500)), float(rng.randrange(1, 50)), 1.0) for _ in range(n)]


def test_equals_plain_sums_with_a_hot_customer(spark):
    rows = rows_of(1500)
    got = rolling_periods(spark.createDataFrame(rows, SCHEMA), (1, 30, 365)).collect()
    assert {(r["CustomerID"], r["Date"]) for r in got} == {(c, t.date()) for c, t, *_ in rows} and len(got) == len(
        {(c, t.date()) for c, t, *_ in rows}
    )
    for r in got:
        for n in (1, 30, 365):
            own = [(t.date(), a) for c, t, a, _ in rows if c == r["CustomerID"] and 0 <= (r["Date"] - t.date()).days < n]
            assert (r[f"Spent_{n}"], r[f"Lines_{n}"], r[f"ActiveDays_{n}"]) == (sum(a for _, a in own), len(own), len({d for d, _ in own}))


def test_a_hot_customer_is_a_row_a_day(spark):
    days = daily_totals(spark.createDataFrame([("hot", dt.datetime(2020, 1, 1, i % 24), 1.0, 1.0) for i in range(5000)], SCHEMA))
    assert [(r["Lines"], r["Spent"]) for r in days.collect()] == [(5000, 5000.0)]


def test_missing_customers_and_dates_and_empty_tables(spark):
    rows = [(None, dt.datetime(2020, 1, 1), 1.0, 1.0), ("a", None, 1.0, 1.0), ("a", dt.datetime(2020, 2, 29), 2.0, 1.0)]
    assert [r["Spent_30"] for r in rolling_periods(spark.createDataFrame(rows, SCHEMA)).collect()] == [2.0]
    assert rolling_periods(spark.createDataFrame([], SCHEMA)).collect() == []
    flags = with_calendar_flags(spark.createDataFrame(rows[1:], SCHEMA)).collect()
    assert [(r["Quarter"], r["IsWeekend"]) for r in flags] == [(None, None), (1, True)]

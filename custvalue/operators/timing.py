"""Time features: tenure, pace, weekday and hour habits. Counts are of invoice lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.functions import expressions as X
from custvalue.functions.ordering import previous_values
from custvalue.operators.customers import KEY, reference_date

WEEKDAYS = [f"DOW_{d}" for d in range(7)]  # Monday first
WEEKEND = ["DOW_5", "DOW_6"]
PERIODS = list(X.PERIOD_HOURS)

PACE_COLUMNS = [
    "PurchaseCount", "CustomerTenure", "DaysSinceLastPurchase", "AvgDaysBetweenPurchases",
    "PurchaseVelocity",
]
WEEKDAY_COLUMNS = [*WEEKDAYS, "WeekendRatio", "MostFrequentDay"]
HOUR_COLUMNS = [
    "AvgPurchaseHour", "StdPurchaseHour", "EarliestPurchaseHour", "LatestPurchaseHour",
    *[f"Period_{p}" for p in PERIODS],
]
COLUMNS = [*PACE_COLUMNS, *WEEKDAY_COLUMNS, *HOUR_COLUMNS]

NULLABLE = ["StdPurchaseHour"]  # one line only


def pace_measures() -> list[Column]:
    return [
        F.count("InvoiceDate").alias("PurchaseCount"),
        F.min("InvoiceDate").alias("FirstPurchase"),
        F.max("InvoiceDate").alias("LastPurchase"),
    ]


def with_clock(lines: DataFrame) -> DataFrame:
    """Weekday, hour and invoice flag of each line, computed once for all counters."""
    return lines.withColumns(
        {
            "_day": F.weekday("InvoiceDate"),
            "_hour": F.hour("InvoiceDate"),
            "_counted": F.col("InvoiceNo").isNotNull(),
        }
    )


def weekday_measures() -> list[Column]:
    return [F.count_if((F.col("_day") == d) & F.col("_counted")).alias(name) for d, name in enumerate(WEEKDAYS)]


def hour_measures() -> list[Column]:
    hour = F.col("_hour")
    return [
        F.avg(hour).alias("AvgPurchaseHour"),
        F.stddev_samp(hour).alias("StdPurchaseHour"),
        F.min(hour).alias("EarliestPurchaseHour"),
        F.max(hour).alias("LatestPurchaseHour"),
        *[F.count_if(X.in_period(hour, p) & F.col("_counted")).alias(f"Period_{p}") for p in PERIODS],
    ]


def derive_pace(customers: DataFrame, today: Column) -> DataFrame:
    first, last, lines = F.col("FirstPurchase"), F.col("LastPurchase"), F.col("PurchaseCount")
    span = X.elapsed_micros(last, first)
    # The mean of consecutive gaps telescopes to the span over the number of gaps.
    gap = F.when(lines > 1, X.floor_days((span / (lines - 1)).cast("bigint"))).otherwise(F.lit(0))
    return customers.withColumns(
        {
            "CustomerTenure": X.whole_days(today, first),
            "DaysSinceLastPurchase": X.whole_days(today, last),
            "AvgDaysBetweenPurchases": gap.cast("bigint"),
        }
    ).withColumn("PurchaseVelocity", X.velocity(F.col("PurchaseCount"), F.col("CustomerTenure")))


def derive_weekdays(customers: DataFrame) -> DataFrame:
    days = F.array(*WEEKDAYS)

    def total(names: list[str]) -> Column:
        return sum((F.col(n) for n in names[1:]), F.col(names[0]))

    workdays = [d for d in WEEKDAYS if d not in WEEKEND]
    return customers.withColumns(
        {
            "WeekendRatio": total(WEEKEND) / (total(workdays) + 1),
            "MostFrequentDay": (F.array_position(days, F.array_max(days)) - 1).cast("double"),
        }
    )


def weekday_features(lines: DataFrame) -> DataFrame:
    return derive_weekdays(with_clock(lines).groupBy(KEY).agg(*weekday_measures())).select(KEY, *WEEKDAY_COLUMNS)


def hour_features(lines: DataFrame) -> DataFrame:
    return with_clock(lines).groupBy(KEY).agg(*hour_measures()).select(KEY, *HOUR_COLUMNS)


def time_features(lines: DataFrame, today: Column | None = None) -> DataFrame:
    today = reference_date(lines) if today is None else today
    facts = with_clock(lines).groupBy(KEY).agg(*pace_measures(), *weekday_measures(), *hour_measures())
    return derive_weekdays(derive_pace(facts, today)).select(KEY, *COLUMNS)


def purchase_gaps(lines: DataFrame) -> DataFrame:
    """Days since the previous purchase: ``CustomerID, InvoiceDate, lines, gap_days``.

    Lines of one moment are zero days apart, so they are counted first and only
    the moments are ordered.
    """
    moments = lines.groupBy(KEY, "InvoiceDate").agg(F.count(F.lit(1)).alias("lines"))
    chained = previous_values(moments, KEY, "InvoiceDate")
    gap = X.elapsed_micros(F.col("InvoiceDate"), F.col("_previous")) / F.lit(X.DAY_MICROS)
    return chained.select(KEY, "InvoiceDate", "lines", gap.alias("gap_days"))


def mean_gap_days(gaps: DataFrame) -> DataFrame:
    """Floored mean gap between consecutive lines, from :func:`purchase_gaps`."""
    lines = F.sum("lines")
    mean = F.sum("gap_days") / (lines - 1)
    return gaps.groupBy(KEY).agg(
        F.when(lines > 1, F.coalesce(F.floor(mean), F.lit(0))).otherwise(F.lit(0)).alias("MeanGapDays")
    )

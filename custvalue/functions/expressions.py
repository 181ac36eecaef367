"""Scalar column expressions. All of them stay inside JVM code generation."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from custvalue.config import RfmWeights

DAY_MICROS = 86_400_000_000


# --- time ------------------------------------------------------------------


def micros_of_day(ts: Column) -> Column:
    whole = F.hour(ts) * F.lit(3600) + F.minute(ts) * F.lit(60)
    seconds = F.extract(F.lit("SECOND"), ts)  # decimal, carries the fraction
    return whole.cast("bigint") * F.lit(1_000_000) + (seconds * F.lit(1_000_000)).cast("bigint")


def elapsed_micros(later: Column, earlier: Column) -> Column:
    """Microseconds between two zone-less timestamps, whatever the session time zone."""
    days = F.date_diff(later.cast("date"), earlier.cast("date")).cast("bigint")
    return days * F.lit(DAY_MICROS) + micros_of_day(later) - micros_of_day(earlier)


def floor_days(micros: Column) -> Column:
    """Whole days in a span, rounding towards minus infinity (-12 h is -1)."""
    return ((micros - F.pmod(micros, F.lit(DAY_MICROS))) / F.lit(DAY_MICROS)).cast("bigint")


def whole_days(later: Column, earlier: Column) -> Column:
    return floor_days(elapsed_micros(later, earlier))


# First and last hour of each part of the day, both included.
PERIOD_HOURS = {"Night": (0, 6), "Morning": (7, 12), "Afternoon": (13, 18), "Evening": (19, 24)}


def in_period(hour: Column, period: str) -> Column:
    return hour.between(*PERIOD_HOURS[period])


def time_period(hour: Column) -> Column:
    """Part of the day of an hour; hours 0 and 6 both belong to the night."""
    return F.coalesce(*[F.when(in_period(hour, p), F.lit(p)) for p in PERIOD_HOURS])


def month_key(ts: Column) -> Column:
    """``yyyy-MM`` of a zone-less timestamp; a cast, unlike formatting, ignores the session time zone."""
    return F.substring(ts.cast("string"), 1, 7)


# --- arithmetic ------------------------------------------------------------


def ratio(numerator: Column, denominator: Column) -> Column:
    """IEEE division under ANSI mode: x/0 is infinite and 0/0 is null."""
    return (
        F.when(denominator != 0, numerator / denominator)
        .when(numerator > 0, F.lit(float("inf")))
        .when(numerator < 0, F.lit(float("-inf")))
    )


def spread_ratio(deviation: Column, mean: Column) -> Column:
    """Coefficient of variation, 0 for a zero mean."""
    return F.when(mean != 0, deviation / mean).otherwise(F.lit(0.0))


def velocity(count: Column, tenure_days: Column) -> Column:
    """Purchases per 30 days of tenure; the plain count for a customer new today."""
    return F.when(tenure_days > 0, count / (tenure_days / F.lit(30))).otherwise(count.cast("double"))


def finite_or_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def scrub_prediction(value: Column) -> Column:
    """NaN, null and infinite predictions count as 0."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def clamp_at_zero(value: Column) -> Column:
    """A customer's value cannot be negative. Null stays null, so it is not hidden."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def normal_quantile(confidence: float) -> float:
    """Two-sided standard normal quantile, a plan constant."""
    return NormalDist().inv_cdf((1 + confidence) / 2)


# --- labels ----------------------------------------------------------------

# Value segments, lowest first.
VALUE_SEGMENTS = ("Low", "Medium-Low", "Medium", "Medium-High", "High")

# Lower bounds (exclusive) of the fixed-threshold value segments.
VALUE_THRESHOLDS = ((1000, "High"), (500, "Medium-High"), (200, "Medium"), (50, "Medium-Low"))

# Customer segments, in label order (their index is the encoded value).
CUSTOMER_SEGMENTS = (
    "At Risk",
    "Cant Lose",
    "Champions",
    "Lost",
    "Loyal Customers",
    "New Customers",
    "Potential Loyalists",
)


def rfm_score(r: Column, f: Column, m: Column, weights: RfmWeights) -> Column:
    return r * F.lit(weights.recency) + f * F.lit(weights.frequency) + m * F.lit(weights.monetary)


def rfm_code(r: Column, f: Column, m: Column) -> Column:
    return F.concat(*[s.cast("int").cast("string") for s in (r, f, m)])


def customer_segment(r: Column, f: Column, m: Column) -> Column:
    """Named segment of a score triple; the first matching branch decides. A null score meets no condition."""
    recent, lapsed = r >= 4, r <= 2
    rare = f <= 2
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((r >= 3) & (f >= 3) & (m >= 3), "Loyal Customers")
        .when(recent & rare, "New Customers")
        .when(lapsed & (f >= 3), "At Risk")
        .when(lapsed & rare & (m >= 3), "Cant Lose")
        .when(lapsed & rare, "Lost")
        .otherwise("Potential Loyalists")
    )


def threshold_segment(value: Column) -> Column:
    label = F.lit(VALUE_SEGMENTS[0])
    for bound, name in reversed(VALUE_THRESHOLDS):
        label = F.when(value > bound, name).otherwise(label)
    return label


def fit_label(r2: Column) -> Column:
    return (
        F.when(r2 > 0.9, "Excellent").when(r2 > 0.7, "Good").when(r2 > 0.5, "Moderate").otherwise("Poor")
    )


def skew_label(skewness: Column) -> Column:
    return F.when(F.abs(skewness) < 0.5, "approximately normal").otherwise("skewed")

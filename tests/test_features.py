import datetime as dt
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from custvalue.config import Settings
from custvalue.functions import bins
from custvalue.functions import expressions as X
from custvalue.functions import ordering
from custvalue.operators import cohort, customers, features, prepare, rfm, summary, timing
from custvalue.plans import queries as Q

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    cached = Q.lines(spark, SF_DIR).persist()
    yield cached
    cached.unpersist()  # or later plans of the same query would read it


@pytest.fixture(scope="module")
def table(lines):
    cached = features.build_features(lines).persist()
    yield cached
    cached.unpersist()


def moments(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("t")
    )


# --- expressions -----------------------------------------------------------


def test_whole_days_floor(spark):
    ref = F.lit(dt.datetime(2020, 1, 10, 12)).cast("timestamp_ntz")
    rows = moments(spark, "2020-01-11 00:00:00", "2020-01-09 12:00:00.000001", "2020-01-09 12:00:00", "2019-01-10 12:00:00")
    assert [r[0] for r in rows.select(X.whole_days(ref, F.col("t"))).collect()] == [-1, 0, 1, 365]


def test_whole_days_ignore_session_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = moments(spark, "2021-03-27 12:00:00")  # the night of the change to summer time follows
        ref = F.lit("2021-03-28 12:00:00").cast("timestamp_ntz")
        assert rows.select(X.whole_days(ref, F.col("t"))).first()[0] == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_time_periods(spark):
    hours = spark.range(24).select(X.time_period(F.col("id")).alias("p"))
    names = [r["p"] for r in hours.collect()]
    assert names == ["Night"] * 7 + ["Morning"] * 6 + ["Afternoon"] * 6 + ["Evening"] * 5


def test_ratio_follows_ieee(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(X.ratio(F.col("a"), F.col("b"))).collect()] == [float("inf"), None, float("-inf"), 1.5]


def test_customer_segment_rules(spark):
    expected = {
        (5, 5, 5): "Champions", (4, 3, 3): "Loyal Customers", (5, 1, 5): "New Customers",
        (1, 3, 1): "At Risk", (2, 2, 3): "Cant Lose", (1, 1, 1): "Lost", (3, 2, 2): "Potential Loyalists",
        (3, 5, 2): "Potential Loyalists", (4, 3, 2): "Potential Loyalists",
    }
    df = spark.createDataFrame([(float(r), float(f), float(m)) for r, f, m in expected], "r double, f double, m double")
    got = df.select("r", "f", "m", X.customer_segment(F.col("r"), F.col("f"), F.col("m")).alias("s")).collect()
    assert {(int(x.r), int(x.f), int(x.m)): x.s for x in got} == expected


def test_threshold_segments(spark):
    df = spark.createDataFrame([(v,) for v in (1000.01, 1000.0, 500.0, 200.0, 50.0)], "v double")
    got = [r[0] for r in df.select(X.threshold_segment(F.col("v"))).collect()]
    assert got == ["High", "Medium-High", "Medium", "Medium-Low", "Low"]


def test_scrub_and_clamp(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (-2.0,)], "v double")
    assert [r[0] for r in df.select(X.scrub_prediction(F.col("v"))).collect()] == [0.0, 0.0, 0.0, -2.0]
    assert [r[0] for r in df.select(X.clamp_at_zero(F.col("v"))).collect()][2:] == [None, 0.0]


# --- ordering and binning --------------------------------------------------


def ids_and(spark, values):
    return spark.createDataFrame([(f"{i:04d}", float(v)) for i, v in enumerate(values)], "id string, value double")


def pandas_scores(values, ascending):
    """Quantile scores as pandas computes them, for comparison."""
    series = pd.Series(values, dtype=float)
    edges = np.unique(pd.qcut(series, 5, retbins=True, duplicates="drop")[1])
    k = len(edges) - 1
    if k < 1:
        return [3.0] * len(series)
    labels = list(range(1, k + 1)) if ascending else list(range(k, 0, -1))
    return list(pd.qcut(series, 5, labels=labels, duplicates="drop").astype(float))


@pytest.mark.parametrize("seed", range(6))
def test_quantile_score_matches_pandas(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([rng.randint(0, 6), rng.randint(0, 400)]) for _ in range(rng.randint(2, 90))]
    df = ids_and(spark, values)
    edges = ordering.quantile_values(df, {"v": F.col("value")}, bins.edge_probabilities(5), unique_by="id")["v"]
    for ascending in (True, False):
        got = df.select("id", bins.quantile_score(F.col("value"), edges, ascending).alias("s")).orderBy("id")
        assert [r["s"] for r in got.collect()] == pandas_scores(values, ascending)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 11, 16, 37])
def test_rank_score_matches_pandas(spark, n):
    values = [i % 4 for i in range(n)]
    df = ids_and(spark, values)
    placed = ordering.positions(df.withColumn("metric", F.lit("v")), ["value", "id"], group=["metric"])
    order = ordering.order_statistics(placed, "id", {"v": bins.edge_probabilities(5)})["v"]
    got = df.select("id", bins.rank_score(F.col("value"), F.col("id"), order).alias("s")).orderBy("id")
    want = pandas_scores(pd.Series(values).rank(method="first"), True)
    assert [r["s"] for r in got.collect()] == want


def test_width_score(spark):
    df = ids_and(spark, [0, 2, 4, 9, 10])
    got = df.select(bins.width_score(F.col("value"), F.lit(0.0), F.lit(10.0)).alias("s")).collect()
    assert [r["s"] for r in got] == [1.0, 1.0, 2.0, 5.0, 5.0]
    flat = df.select(bins.width_score(F.lit(5.0), F.lit(5.0), F.lit(5.0), ascending=False).alias("s")).first()
    assert flat["s"] == 3.0


def test_positions_and_running_totals_match_brute_force(spark):
    rng = random.Random(3)
    values = [1.0] * 60 + [rng.randint(0, 30) for _ in range(120)]  # a third share one value
    df = ids_and(spark, values)
    ordered = sorted((v, f"{i:04d}") for i, v in enumerate(values))
    placed = ordering.positions(df, ["value", "id"]).collect()
    assert {r["id"]: r["_pos"] for r in placed} == {i: p for p, (_, i) in enumerate(ordered)}
    total, want = 0.0, {}
    for v, i in sorted(ordered, key=lambda x: (-x[0], x[1])):
        total += v
        want[i] = total
    running = ordering.running_totals(df, ["value", "id"], "value", descending={"value"}).collect()
    assert {r["id"]: r["_running"] for r in running} == want
    assert {r["_rank"] for r in running} == set(range(1, len(values) + 1))


def test_quantiles_with_and_without_key_agree(spark):
    values = [3, 3, 3, 3, 8, 1, 9, 12, 12, 40]
    df = ids_and(spark, values)
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    keyed = ordering.quantile_values(df, {"v": F.col("value")}, probabilities, unique_by="id")["v"]
    counted = ordering.quantile_values(df, {"v": F.col("value")}, probabilities)["v"]
    assert keyed == pytest.approx(list(np.quantile(values, probabilities)))
    assert counted == pytest.approx(keyed)


def test_percentiles_match_pandas(spark):
    values = [5, 5, 5, 1, 2, 9, 9, 3]
    placed = ordering.positions(ids_and(spark, values), ["value", "id"])
    got = {r["id"]: r["p"] for r in bins.with_percentile(placed, "p").collect()}
    want = pd.Series(values).rank(pct=True) * 100
    assert [got[f"{i:04d}"] for i in range(len(values))] == pytest.approx(list(want))


def test_row_index(spark):
    df = spark.range(50).repartition(5)
    assert sorted(r["i"] for r in ordering.with_row_index(df, "i").collect()) == list(range(50))


# --- customer level --------------------------------------------------------


def test_summary_has_one_row_per_customer(lines):
    got = summary.aggregate_by_customer(lines)
    assert got.count() == lines.select("CustomerID").distinct().count()
    assert {"Recency", "TotalRevenue"} <= set(got.columns)
    assert got.where("StdOrderValue IS NULL").isEmpty()


def test_hot_customers_take_the_sorted_path_and_agree(lines):
    plain = customers.medians(lines, "TotalAmount", "m", 10**9)
    split = customers.medians(lines, "TotalAmount", "m", 25)
    assert not customers.hot_customers(lines, 25).isEmpty()
    assert customers.hot_customers(lines, 10**9).isEmpty()
    left = {r["CustomerID"]: r["m"] for r in plain.collect()}
    right = {r["CustomerID"]: r["m"] for r in split.collect()}
    assert left == pytest.approx(right)


def test_median_of_a_customer_with_a_third_of_all_lines(spark):
    rows = [("hot", float(i % 97)) for i in range(300)] + [(f"c{i % 60}", float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "CustomerID string, TotalAmount double")
    got = {r["CustomerID"]: r["m"] for r in customers.medians(df, "TotalAmount", "m", 100).collect()}
    assert got["hot"] == statistics.median(i % 97 for i in range(300))
    assert got["c7"] == statistics.median(range(7, 600, 60))


def test_purchase_gaps_agree_with_closed_form(lines):
    gaps = {r[0]: r[1] for r in timing.mean_gap_days(timing.purchase_gaps(lines)).collect()}
    closed = {r[0]: r[1] for r in timing.time_features(lines).select("CustomerID", "AvgDaysBetweenPurchases").collect()}
    assert gaps == closed


def test_cohort_average_is_over_lines(lines):
    got = {r["CohortMonth"]: r["CohortAvgSpend"] for r in cohort.cohort_stats(lines).collect()}
    pdf = lines.select("CustomerID", "InvoiceDate", "TotalAmount").toPandas()
    month = pdf.groupby("CustomerID")["InvoiceDate"].transform("min").dt.strftime("%Y-%m")
    assert got == pytest.approx(pdf.groupby(month)["TotalAmount"].mean().to_dict())


def test_feature_table(table):
    assert len(table.columns) == 57
    numeric = prepare.numeric_columns(table)
    assert prepare.incomplete_columns(table) == []
    assert len(numeric) == 54
    for score in rfm.SCORE_COLUMNS:
        low, high = table.agg(F.min(score), F.max(score)).first()
        assert low >= 1 and high <= 5
    assert table.where(~F.col("CustomerSegment").isin(list(X.CUSTOMER_SEGMENTS))).isEmpty()


@pytest.mark.parametrize(
    "flags, present, absent",
    [
        ({"include_rfm": True}, ["Recency", "Frequency", "Monetary", "RFMScore"], ["PriceRange"]),
        ({"include_behavioral": True}, ["AvgTransactionValue", "UniqueProducts", "TotalTransactions"], ["Recency"]),
        ({"include_time": True}, ["CustomerTenure", "DaysSinceLastPurchase", "DOW_6"], ["CohortSize"]),
        ({"include_cohort": True}, ["CohortSize", "CohortMonthEncoded"], ["Monetary"]),
    ],
)
def test_blocks_by_flag(lines, flags, present, absent):
    off = dict.fromkeys(("include_rfm", "include_behavioral", "include_time", "include_cohort"), False)
    got = features.build_features(lines, **{**off, **flags})
    assert set(present) <= set(got.columns)
    assert not set(absent) & set(got.columns)
    assert got.count() == lines.select("CustomerID").distinct().count()


def test_given_reference_date(lines):
    later = features.build_features(
        lines, reference_date=dt.datetime(2030, 1, 1), include_behavioral=False, include_time=False, include_cohort=False
    )
    assert later.agg(F.min("Recency")).first()[0] > 1000


def test_hot_limit_does_not_change_features(lines, table):
    columns = ["CustomerID", "MedianTransactionValue", "RFMSegment", "TransactionValueCV"]
    other = features.build_features(lines, settings=Settings(hot_customer_lines=25)).select(*columns)
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, table.select(*columns).collect()))


# --- preparation -----------------------------------------------------------


def test_fill_missing_and_infinite(spark):
    df = spark.createDataFrame(
        [("a", 1.0, None), ("b", None, None), ("c", 3.0, None), ("d", float("inf"), None)],
        "CustomerID string, v double, w double",
    )
    got = prepare.replace_infinite(prepare.fill_missing(df)).orderBy("CustomerID").collect()
    assert [r["v"] for r in got] == [1.0, 3.0, 3.0, 0.0]
    assert [r["w"] for r in got] == [0.0] * 4


def test_scaling_conventions(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 7.0, 3), ("b", 3.0, 7.0, 5)], "CustomerID string, v double, flat double, LatestPurchaseHour int"
    )
    standard = prepare.scale_features(df).orderBy("CustomerID").collect()
    assert [(r["v"], r["flat"], r["LatestPurchaseHour"]) for r in standard] == [(-1.0, 0.0, -1.0), (1.0, 0.0, 1.0)]
    kept = prepare.scale_features(df, parity=True).orderBy("CustomerID").collect()
    assert [r["LatestPurchaseHour"] for r in kept] == [3, 5]
    small = prepare.scale_features(df, method="minmax").orderBy("CustomerID").collect()
    assert [(r["v"], r["flat"]) for r in small] == [(0.0, 0.0), (1.0, 0.0)]


def test_model_columns(table):
    data, columns = prepare.model_columns(table)
    assert len(columns) == 53
    assert not {"CustomerID", "Monetary"} & set(columns)
    assert data.count() == table.count()
    _, safe = prepare.model_columns(table, exclude_leaky=True)
    assert not {"MonetaryScore", "RFMScore"} & set(safe)


def test_text_columns_are_label_encoded(spark):
    df = spark.createDataFrame([("1", 2.0, "b"), ("2", 3.0, "a"), ("3", 4.0, "b")], "CustomerID string, Monetary double, Kind string")
    data, columns = prepare.model_columns(df)
    assert columns == ["Kind"]
    assert {r["CustomerID"]: r["Kind"] for r in data.collect()} == {"1": 1, "2": 0, "3": 1}


def test_prepare_for_modeling(lines):
    data, columns = prepare.prepare_for_modeling(summary.aggregate_by_customer(lines))
    assert "CustomerID" not in columns and "TotalRevenue" not in columns
    assert data.columns == ["CustomerID", *columns, "TotalRevenue"]


def test_split_is_stable_and_complete(table):
    train, test = prepare.split(table)
    again, _ = prepare.split(table.repartition(3))
    assert train.count() + test.count() == table.count()
    assert sorted(r[0] for r in train.select("CustomerID").collect()) == sorted(
        r[0] for r in again.select("CustomerID").collect()
    )


def test_a_null_score_is_no_champion(spark):
    df = spark.createDataFrame([(None, 5, 5), (5, None, 5), (5, 5, None), (5, 5, 5)], "r int, f int, m int")
    named = df.select(X.customer_segment(df.r, df.f, df.m)).collect()
    assert [r[0] for r in named] == ["Potential Loyalists"] * 3 + ["Champions"]


def test_bracketed_quantiles_are_exact_and_sort_few_values(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(str(i), rng.gauss(0, 1), float(rng.randrange(3)), None if i % 3 else rng.random(), None) for i in range(20_001)]
    rows += [("x", float("nan"), float("inf"), -0.0, None)]
    df = spark.createDataFrame(rows, "CustomerID string, a double, b double, c double, d double").persist()
    values = {c: F.col(c) for c in "abcd"}
    shares = [0.0, 0.2, 0.5, 0.999, 1.0]
    want = {r["metric"]: (r["n"], [r[f"q{i}"] for i in range(5)]) for r in ordering.quantiles(df, values, shares).collect()}
    ordered = []
    totals = ordering.running_totals

    def spied(counted, *rest, **more):
        ordered.append(counted.count())
        return totals(counted, *rest, **more)

    monkeypatch.setattr(ordering, "running_totals", spied)
    assert ordering.bracketed_quantiles(df, values, shares) == want
    assert len(ordered) == 1 and ordered[0] < 2_000  # of 26,669 distinct values
    assert ordering.bracketed_quantiles(df.limit(0), values, shares) == {}
    numbers, sizes = df.select("c"), {"c": want["c"][0]}
    low, high = want["c"][1][1], want["c"][1][3]
    brackets = {("c", 1): [0.9, 0.95], ("c", 2): [low, high]}  # the first one misses its place
    found = ordering._inside(numbers, {"c": "c"}, sizes, brackets, shares)
    assert found == {("c", 2): want["c"][1][2]}
    df.unpersist()


def test_medians_of_many_columns(spark):
    columns = [F.lit(None).cast("double") if i == 7 else (F.col("id") * (i + 1)).cast("double") for i in range(60)]
    df = spark.range(501).select(F.col("id").cast("string").alias("CustomerID"), *[c.alias(f"c{i}") for i, c in enumerate(columns)])
    found = {r["metric"]: (r["n"], r["q0"]) for r in prepare.column_medians(df).collect()}
    assert found == {f"c{i}": (501, 250.0 * (i + 1)) for i in range(60) if i != 7}

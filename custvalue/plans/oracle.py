"""The SQL counterpart of each registered query, for an independent engine (DuckDB dialect).

Statements are put together from common table expressions. ``_out`` applies the
same final rounding and casts as :func:`custvalue.plans.queries.tidy`.
"""

from __future__ import annotations

from statistics import NormalDist

from custvalue.operators import segments as S
from custvalue.operators.metrics import AS241_CENTRE, AS241_MIDDLE, AS241_TAIL
from custvalue.operators.periods import PERIODS
from custvalue.operators.prepare import FEATURES_EXCLUDED

NUDGE = "1e-7"
DAY = "86400000000"

# --- building blocks -------------------------------------------------------

RAW = """
base AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || 'INV' || l_orderkey AS InvoiceNo,
         'STK' || l_partkey AS StockCode,
         p_name AS Description,
         CAST(l_quantity AS BIGINT) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS Quantity,
         strftime(o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS InvoiceDate,
         CASE WHEN l_orderkey % 97 = 3 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice / l_quantity END AS UnitPrice,
         CASE WHEN o_orderkey % 50 <> 7 THEN o_custkey || '.0' END AS CustomerID,
         n_name AS Country,
         l_orderkey
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
  WHERE o_custkey % 101 <> 5 OR (l_linenumber = 1 AND o_orderkey % 7 = 0)
),
raw AS (
  SELECT * EXCLUDE (l_orderkey) FROM base
  UNION ALL
  SELECT * EXCLUDE (l_orderkey) FROM base WHERE l_orderkey % 40 = 0
)"""

TEXTS = RAW + r""",
texts AS (
  SELECT InvoiceNo, CASE WHEN o % 61 = 8 THEN 'a dozen' ELSE Quantity::VARCHAR END AS Quantity,
         CASE WHEN o % 67 = 9 THEN '' WHEN o % 71 = 4 THEN 'free' ELSE UnitPrice::VARCHAR END AS UnitPrice,
         CASE WHEN o % 83 = 2 THEN 'guest' ELSE CustomerID END AS CustomerID,
         CASE WHEN o % 73 = 11 THEN 'soon' WHEN o % 79 = 6 THEN '2/30/1995 8:26' ELSE
           month(t) || '/' || day(t) || '/' || year(t) || ' ' || hour(t) || ':' || lpad(minute(t)::VARCHAR, 2, '0') END AS InvoiceDate
  FROM (SELECT *, regexp_extract(InvoiceNo, '(\d+)', 1)::BIGINT AS o, InvoiceDate::TIMESTAMP AS t FROM raw))"""

CLEAN = RAW + """,
clean AS (
  SELECT InvoiceNo, StockCode, Description, CAST(Quantity AS DOUBLE) AS Quantity,
         CAST(InvoiceDate AS TIMESTAMP) AS InvoiceDate, UnitPrice,
         CAST(CAST(CAST(CustomerID AS DOUBLE) AS BIGINT) AS VARCHAR) AS CustomerID, Country,
         Quantity * UnitPrice AS TotalAmount
  FROM (SELECT DISTINCT * FROM raw)
  WHERE CustomerID IS NOT NULL AND NOT starts_with(InvoiceNo, 'C') AND Quantity > 0 AND UnitPrice > 0
),
ref AS (SELECT max(InvoiceDate) AS today FROM clean)"""

EVENTS = """
clean AS (
  SELECT CAST(event_id AS VARCHAR) AS InvoiceNo, ts AS InvoiceDate, CAST(user_id AS VARCHAR) AS CustomerID,
         "value" AS TotalAmount
  FROM events
),
ref AS (SELECT max(InvoiceDate) AS today FROM clean)"""


def _days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / {DAY}.0) AS BIGINT)"


SUMMARY = CLEAN + f""",
home AS (
  SELECT CustomerID, Country FROM (
    SELECT CustomerID, Country,
           row_number() OVER (PARTITION BY CustomerID ORDER BY InvoiceDate, Country) AS rn FROM clean)
  WHERE rn = 1
),
summary AS (
  SELECT CustomerID, count(DISTINCT InvoiceNo) AS TransactionCount,
         min(InvoiceDate) AS FirstPurchaseDate, max(InvoiceDate) AS LastPurchaseDate,
         sum(TotalAmount) AS TotalRevenue, avg(TotalAmount) AS AvgOrderValue,
         coalesce(stddev_samp(TotalAmount), 0) AS StdOrderValue,
         sum(Quantity) AS TotalQuantity, avg(Quantity) AS AvgQuantity,
         count(DISTINCT StockCode) AS UniqueProducts, any_value(home.Country) AS Country,
         {_days('any_value(today)', 'max(InvoiceDate)')} AS Recency,
         {_days('any_value(today)', 'min(InvoiceDate)')} AS Tenure
  FROM clean JOIN home USING (CustomerID), ref
  GROUP BY CustomerID
)"""

RFM = CLEAN + f""",
rfm_base AS (
  SELECT CustomerID, {_days('any_value(today)', 'max(InvoiceDate)')} AS Recency,
         count(DISTINCT InvoiceNo) AS Frequency, sum(TotalAmount) AS Monetary
  FROM clean, ref GROUP BY CustomerID
)"""

SCORES = RFM + """,
edges AS (
  SELECT list_sort(list_distinct(quantile_cont(Recency, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e, count(*) AS n
  FROM rfm_base
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY Frequency, CustomerID) AS rf,
         row_number() OVER (ORDER BY round(Monetary, 6), CustomerID) AS rm
  FROM rfm_base
),
scored AS (
  SELECT CustomerID, Recency, Frequency, Monetary,
         CASE WHEN len(e) < 2 THEN 3.0
              ELSE len(e) - greatest(1, len(list_filter(e, lambda x: x < Recency))) END AS RecencyScore,
         CASE WHEN n = 1 THEN 3.0 ELSE greatest(1, ceil(5.0 * (rf - 1) / (n - 1))) END AS FrequencyScore,
         CASE WHEN n = 1 THEN 3.0 ELSE greatest(1, ceil(5.0 * (rm - 1) / (n - 1))) END AS MonetaryScore
  FROM placed, edges
),
named AS (
  SELECT *, 0.25 * RecencyScore + 0.35 * FrequencyScore + 0.40 * MonetaryScore AS RFMScore,
         CAST(RecencyScore AS INTEGER) || '' || CAST(FrequencyScore AS INTEGER) || '' || CAST(MonetaryScore AS INTEGER) AS RFMSegment,
         CASE WHEN RecencyScore >= 4 AND FrequencyScore >= 4 AND MonetaryScore >= 4 THEN 'Champions'
              WHEN RecencyScore >= 3 AND FrequencyScore >= 3 AND MonetaryScore >= 3 THEN 'Loyal Customers'
              WHEN RecencyScore >= 4 AND FrequencyScore <= 2 THEN 'New Customers'
              WHEN RecencyScore <= 2 AND FrequencyScore >= 3 THEN 'At Risk'
              WHEN RecencyScore <= 2 AND FrequencyScore <= 2 AND MonetaryScore >= 3 THEN 'Cant Lose'
              WHEN RecencyScore <= 2 AND FrequencyScore <= 2 THEN 'Lost'
              ELSE 'Potential Loyalists' END AS CustomerSegment
  FROM scored
),
rfm_named AS (
  SELECT *, dense_rank() OVER (ORDER BY CustomerSegment) - 1 AS CustomerSegmentEncoded FROM named
)"""

BEHAVIOR_SELECT = """
  SELECT *, MaxTransactionValue - MinTransactionValue AS TransactionValueRange,
         MaxUnitPrice - MinUnitPrice AS PriceRange,
         UniqueProducts / TotalTransactions AS ProductDiversity,
         TotalQuantity / TotalTransactions AS AvgItemsPerTransaction,
         CASE WHEN AvgTransactionValue <> 0 THEN StdTransactionValue / AvgTransactionValue ELSE 0 END AS TransactionValueCV
  FROM (
    SELECT CustomerID, avg(TotalAmount) AS AvgTransactionValue, stddev_samp(TotalAmount) AS StdTransactionValue,
           min(TotalAmount) AS MinTransactionValue, max(TotalAmount) AS MaxTransactionValue,
           median(TotalAmount) AS MedianTransactionValue,
           sum(Quantity) AS TotalQuantity, avg(Quantity) AS AvgQuantity, stddev_samp(Quantity) AS StdQuantity,
           max(Quantity) AS MaxQuantity,
           avg(UnitPrice) AS AvgUnitPrice, stddev_samp(UnitPrice) AS StdUnitPrice, min(UnitPrice) AS MinUnitPrice,
           max(UnitPrice) AS MaxUnitPrice,
           count(DISTINCT StockCode) AS UniqueProducts, count(DISTINCT InvoiceNo) AS TotalTransactions,
           count(DISTINCT Description) AS UniqueDescriptions
    FROM clean GROUP BY CustomerID)"""
BEHAVIOR = f",\nbehavior AS ({BEHAVIOR_SELECT})"
BEHAVIOR_SPEC = """CustomerID, AvgTransactionValue:d, StdTransactionValue:d, MinTransactionValue:d,
MaxTransactionValue:d, MedianTransactionValue:d, TotalQuantity:d, AvgQuantity:d, StdQuantity:d, MaxQuantity:d,
AvgUnitPrice:d, StdUnitPrice:d, MinUnitPrice:d, MaxUnitPrice:d, UniqueProducts:i, TotalTransactions:i,
UniqueDescriptions:i, TransactionValueRange:d, PriceRange:d, ProductDiversity:d, AvgItemsPerTransaction:d,
TransactionValueCV:d"""

_DOW = ", ".join(
    f"count(CASE WHEN isodow = {d + 1} THEN InvoiceNo END) AS DOW_{d}" for d in range(7)
)
_PERIODS = ", ".join(
    f"count(CASE WHEN hh BETWEEN {a} AND {b} THEN InvoiceNo END) AS Period_{name}"
    for name, a, b in (("Night", 0, 6), ("Morning", 7, 12), ("Afternoon", 13, 18), ("Evening", 19, 24))
)
TIMING = f""",
parts AS (SELECT *, isodow(InvoiceDate) AS isodow, hour(InvoiceDate) AS hh FROM clean),
timing0 AS (
  SELECT CustomerID, count(InvoiceDate) AS PurchaseCount,
         {_days('any_value(today)', 'min(InvoiceDate)')} AS CustomerTenure,
         {_days('any_value(today)', 'max(InvoiceDate)')} AS DaysSinceLastPurchase,
         CASE WHEN count(*) > 1 THEN CAST(floor((epoch_us(max(InvoiceDate)) - epoch_us(min(InvoiceDate)))
              / (count(*) - 1) / {DAY}.0) AS BIGINT) ELSE 0 END AS AvgDaysBetweenPurchases,
         {_DOW},
         avg(hh) AS AvgPurchaseHour, stddev_samp(hh) AS StdPurchaseHour, min(hh) AS EarliestPurchaseHour,
         max(hh) AS LatestPurchaseHour, {_PERIODS}
  FROM parts, ref GROUP BY CustomerID
),
timing AS (
  SELECT *, CASE WHEN CustomerTenure > 0 THEN PurchaseCount / (CustomerTenure / 30.0) ELSE PurchaseCount END AS PurchaseVelocity,
         (DOW_5 + DOW_6) / (DOW_0 + DOW_1 + DOW_2 + DOW_3 + DOW_4 + 1) AS WeekendRatio,
         CASE greatest(DOW_0, DOW_1, DOW_2, DOW_3, DOW_4, DOW_5, DOW_6)
              WHEN DOW_0 THEN 0 WHEN DOW_1 THEN 1 WHEN DOW_2 THEN 2 WHEN DOW_3 THEN 3
              WHEN DOW_4 THEN 4 WHEN DOW_5 THEN 5 ELSE 6 END AS MostFrequentDay
  FROM timing0
)"""
WEEKDAY_SPEC = ", ".join(f"DOW_{d}:i" for d in range(7)) + ", WeekendRatio:d, MostFrequentDay:d"
HOUR_SPEC = """AvgPurchaseHour:d, StdPurchaseHour:d, EarliestPurchaseHour:i, LatestPurchaseHour:i,
Period_Night:i, Period_Morning:i, Period_Afternoon:i, Period_Evening:i"""
TIMING_SPEC = f"""CustomerID, PurchaseCount:i, CustomerTenure:i, DaysSinceLastPurchase:i, AvgDaysBetweenPurchases:i,
PurchaseVelocity:d, {WEEKDAY_SPEC}, {HOUR_SPEC}"""

COHORT = """,
firsts AS (SELECT CustomerID, strftime(min(InvoiceDate), '%Y-%m') AS CohortMonth FROM clean GROUP BY CustomerID),
cohorts AS (
  SELECT CohortMonth, count(DISTINCT CustomerID) AS CohortSize, avg(TotalAmount) AS CohortAvgSpend,
         dense_rank() OVER (ORDER BY CohortMonth) AS CohortMonthEncoded
  FROM clean JOIN firsts USING (CustomerID) GROUP BY CohortMonth
),
cohort AS (SELECT CustomerID, CohortSize, CohortAvgSpend, CohortMonthEncoded FROM firsts JOIN cohorts USING (CohortMonth))"""

PRED = CLEAN + f""",
pred AS (
  SELECT CustomerID, round(avg(TotalAmount) * count(DISTINCT InvoiceNo) * 1.1 + {NUDGE}, 2) AS Predicted_CLV
  FROM clean GROUP BY CustomerID
)"""


def _percentile(value: str) -> str:
    return (
        f"(rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0)"
        " / count(*) OVER () * 100"
    )


SEGMENTED = PRED + f""",
pred_edges AS (SELECT list_sort(list_distinct(quantile_cont(Predicted_CLV, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM pred),
segmented AS (
  SELECT CustomerID, Predicted_CLV,
         (['Low', 'Medium-Low', 'Medium', 'Medium-High', 'High'])[greatest(1, len(list_filter(e, lambda x: x < Predicted_CLV)))] AS CLV_Segment,
         {_percentile('Predicted_CLV')} AS CLV_Percentile
  FROM pred, pred_edges
)"""

ANALYSIS = SEGMENTED + f""",
analysis AS (
  SELECT CustomerID, {_days('any_value(today)', 'max(InvoiceDate)')} AS Recency,
         count(DISTINCT InvoiceNo) AS Frequency, sum(TotalAmount) AS Monetary,
         {_days('any_value(today)', 'min(InvoiceDate)')} AS CustomerTenure,
         any_value(Predicted_CLV) AS Predicted_CLV, any_value(CLV_Segment) AS CLV_Segment
  FROM clean JOIN segmented USING (CustomerID), ref GROUP BY CustomerID
)"""
PROFILE = ANALYSIS + """,
profile AS (
  SELECT CLV_Segment, round(avg(Recency), 2) AS Recency, round(avg(Frequency), 2) AS Frequency,
         round(avg(Monetary), 2) AS Monetary, round(avg(CustomerTenure), 2) AS CustomerTenure
  FROM analysis GROUP BY CLV_Segment
)"""

MODEL_ROWS = CLEAN + f""",
model_base AS (
  SELECT CustomerID, round(sum(TotalAmount) / 1000 + {NUDGE}, 2) AS label,
         round(avg(TotalAmount) * count(DISTINCT InvoiceNo) * 1.1 / 1000 + {NUDGE}, 2) AS prediction
  FROM clean GROUP BY CustomerID
),
model_rows AS (
  SELECT 'rule' AS model, CustomerID, label, prediction, label - prediction AS e FROM model_base
  UNION ALL
  SELECT 'rule_x3', CustomerID, label, round(prediction * 3 + {NUDGE}, 2), label - round(prediction * 3 + {NUDGE}, 2)
  FROM model_base
),
metrics AS (
  SELECT model, avg(abs(e)) AS MAE, avg(e * e) AS MSE, sqrt(avg(e * e)) AS RMSE,
         1 - sum(e * e) / (var_pop(label) * count(*)) AS R2, 1 - var_pop(e) / var_pop(label) AS Explained_Variance,
         max(abs(e)) AS Max_Error, 100 * avg(CASE WHEN label <> 0 THEN abs(e / label) END) AS MAPE,
         avg(e) AS Mean_Residual, stddev_pop(e) AS Std_Residual, median(abs(e)) AS MedAE
  FROM model_rows GROUP BY model
),
residuals AS (
  SELECT model, avg(e) AS mean, stddev_pop(e) AS std, skewness(e) AS skewness, kurtosis(e) AS kurtosis,
         min(e) AS min, max(e) AS max, median(e) AS median, quantile_cont(e, 0.05) AS percentile_5,
         quantile_cont(e, 0.95) AS percentile_95
  FROM model_rows GROUP BY model
)"""
METRICS_SPEC = """model, MAE:d, MSE:d, RMSE:d, R2:d, Explained_Variance:d, Max_Error:d, MAPE:d, Mean_Residual:d,
Std_Residual:d, MedAE:d"""


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    text = f"CAST({coefficients[-1]!r} AS DOUBLE)"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + CAST({c!r} AS DOUBLE))"
    return text


def _fraction(pair: tuple, x: str) -> str:
    return f"{_horner(pair[0], x)} / {_horner(pair[1], x)}"


QQ = MODEL_ROWS + f""",
ordered AS (
  SELECT model, CustomerID, e AS residual, row_number() OVER (PARTITION BY model ORDER BY e, CustomerID) AS i,
         count(*) OVER (PARTITION BY model) AS n
  FROM model_rows
),
plotting AS (
  SELECT *, CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n)
                 ELSE (CAST(i AS DOUBLE) - 0.3175) / (CAST(n AS DOUBLE) + 0.365) END AS p
  FROM ordered
),
tails AS (
  SELECT *, p - CAST(0.5 AS DOUBLE) AS q, CAST(0.180625 AS DOUBLE) - pow(p - CAST(0.5 AS DOUBLE), 2) AS c,
         sqrt(-ln(least(p, 1 - p))) AS r
  FROM plotting
),
shifted AS (SELECT *, r - CAST(1.6 AS DOUBLE) AS rm, r - CAST(5 AS DOUBLE) AS rt FROM tails),
qq AS (
  SELECT model, CustomerID, residual,
         CASE WHEN abs(q) <= 0.425 THEN q * {_fraction(AS241_CENTRE, 'c')}
              WHEN r <= 5 THEN sign(q) * {_fraction(AS241_MIDDLE, 'rm')}
              ELSE sign(q) * {_fraction(AS241_TAIL, 'rt')} END AS theoretical
  FROM shifted
)"""


def _out(spec: str, source: str, tail: str = "") -> str:
    """SELECT the named columns; ``:d`` rounds a double, ``:i`` casts to 64 bit, ``:t`` and ``:y`` print times."""
    cells = []
    for item in spec.replace("\n", " ").split(","):
        name, _, kind = item.strip().partition(":")
        cells.append(
            {
                "": f'"{name}"',
                "d": f'round(CAST("{name}" AS DOUBLE) + {NUDGE}, 4) AS "{name}"',
                "i": f'CAST("{name}" AS BIGINT) AS "{name}"',
                "t": f"strftime(\"{name}\", '%Y-%m-%d %H:%M:%S') AS \"{name}\"",
                "y": f"strftime(\"{name}\", '%Y-%m-%d') AS \"{name}\"",
            }[kind]
        )
    return f"SELECT {', '.join(cells)} FROM {source} {tail}"


def _query(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


def _list(values: list[str], joiner: str) -> str:
    return "'" + joiner.join(values).replace("'", "''") + "'"


def _lookup(column: str, table: dict[str, str], default: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items())
    return f"CASE {column} {cases} ELSE {default} END"


RAW_COLUMNS = ("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country")


def _union(parts: list[str]) -> str:
    return "(" + "\nUNION ALL\n".join(parts) + ")"


def _null_profile() -> str:
    return _union(
        [
            f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS missing_count,
            100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*) AS missing_percentage FROM raw"""
            for c in RAW_COLUMNS
        ]
    )


def _describe() -> str:
    return _union(
        [
            f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
            quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max
            FROM raw"""
            for c in ("Quantity", "UnitPrice")
        ]
    )


SUMMARY_NUMBERS = ("TotalRevenue", "StdOrderValue", "TotalQuantity", "Recency", "Tenure")


def _scaled(formula) -> str:
    cells = ", ".join(f"round(CAST({formula(c)} AS DOUBLE) + {NUDGE}, 4) AS {c}" for c in SUMMARY_NUMBERS)
    return f"SELECT CustomerID, {cells} FROM summary"


MODEL_NUMBERS = (
    "TransactionCount", "AvgOrderValue", "StdOrderValue", "TotalQuantity", "AvgQuantity", "UniqueProducts", "Recency",
    "Tenure", "TotalRevenue",
)


def _fold_products() -> str:
    scaled = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in MODEL_NUMBERS)
    names = ", ".join(f"'{c}'" for c in ("1", *MODEL_NUMBERS))
    places = f"range(1, {len(MODEL_NUMBERS) + 2})"
    return f"""SELECT fold, names[i] AS left_column, names[j] AS right_column, round(sum(z[i] * z[j]) + {NUDGE}, 4) AS total
FROM (SELECT CAST('0x' || substr(md5(CustomerID || '|fold'), 1, 8) AS BIGINT) % 5 AS fold, [1.0::DOUBLE, {scaled}] AS z,
        [{names}] AS names FROM summary), {places} AS a(i), {places} AS b(j)
WHERE i <= j GROUP BY fold, i, j, names"""


def _period_profile() -> str:
    def facts(c: str) -> str:
        if c not in ("Quantity", "UnitPrice"):
            return ", ".join(f"CAST(NULL AS DOUBLE) AS {m}" for m in ("min", "max", "mean", "std"))
        functions = {"min": "min", "max": "max", "avg": "mean", "stddev_samp": "std"}
        return ", ".join(f"round(CAST({f}({c}) AS DOUBLE) + {NUDGE}, 4) AS {m}" for f, m in functions.items())

    period = "CAST(CAST(InvoiceDate AS TIMESTAMP) AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'"
    columns = ("InvoiceNo", "StockCode", "Quantity", "UnitPrice", "CustomerID", "Country")
    return _union(
        [
            f"""SELECT '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS missing, {facts(c)}
            FROM raw WHERE {period}"""
            for c in columns
        ]
    )


def _medians() -> str:
    return _union(
        [f"SELECT '{c}' AS metric, count({c}) AS n, median({c}) AS median FROM summary" for c in SUMMARY_NUMBERS]
    )


FEATURE_IMPUTED = ("StdTransactionValue", "StdQuantity", "StdUnitPrice", "TransactionValueCV", "StdPurchaseHour")


def _feature_table() -> str:
    filled = ", ".join(f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in FEATURE_IMPUTED)
    return (
        SCORES
        + BEHAVIOR
        + TIMING
        + COHORT
        + f""",
features AS (
  SELECT * REPLACE ({filled})
  FROM rfm_named JOIN behavior USING (CustomerID) JOIN timing USING (CustomerID) JOIN cohort USING (CustomerID)
)"""
    )


RFM_SPEC = """CustomerID, Recency:i, Frequency:i, Monetary:d, RecencyScore:d, FrequencyScore:d, MonetaryScore:d,
RFMScore:d, RFMSegment, CustomerSegment, CustomerSegmentEncoded:i"""


def _tail_of(spec: str) -> str:
    return spec.split(",", 1)[1]


FEATURE_SPEC = ",".join(
    [RFM_SPEC, _tail_of(BEHAVIOR_SPEC), _tail_of(TIMING_SPEC), "CohortSize:i, CohortAvgSpend:d, CohortMonthEncoded:i"]
)


def _histogram(source: str, value: str, by: str = "") -> str:
    group = f"{by}, " if by else ""
    return f"""
SELECT {group}CAST(bin AS BIGINT) AS bin, round(lo + (bin - 1) * width + {NUDGE}, 4) AS bin_low,
       round(lo + bin * width + {NUDGE}, 4) AS bin_high, count(*) AS count
FROM (SELECT {group}lo, width, least(50, floor(({value} - lo) / width) + 1) AS bin
      FROM {source}, (SELECT min({value}) AS lo, (max({value}) - min({value})) / 50 AS width FROM {source}))
GROUP BY {group}bin, lo, width"""


CORRELATED = (
    "TransactionCount", "TotalRevenue", "AvgOrderValue", "StdOrderValue", "TotalQuantity", "AvgQuantity",
    "UniqueProducts", "Recency", "Tenure",
)


def _correlations() -> str:
    return " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}) + {NUDGE}, 4) AS corr FROM summary"
        for x in CORRELATED
        for y in CORRELATED
    )


def _gaps(select: str) -> str:
    return f""",
moments AS (SELECT CustomerID, InvoiceDate, count(*) AS lines FROM clean GROUP BY CustomerID, InvoiceDate),
gaps AS (
  SELECT *, (epoch_us(InvoiceDate) - epoch_us(lag(InvoiceDate) OVER (PARTITION BY CustomerID ORDER BY InvoiceDate)))
            / {DAY}.0 AS gap_days
  FROM moments
)
{select}"""


# --- statements ------------------------------------------------------------


def statements() -> dict[str, str]:
    z = repr(NormalDist().inv_cdf(0.975))
    sql = {}
    number = lambda i: f"list_extract(regexp_extract_all(InvoiceDate, '\\d+'), {i})"
    ranges = ", ".join(f"coalesce({f}(TRY_CAST({number(i)} AS BIGINT)), 0) AS {n}{i}" for i in (1, 2, 3) for f, n in (("min", "least"), ("max", "most")))
    sql["date_formats"] = _query(
        TEXTS,
        f"""SELECT regexp_replace(InvoiceDate, '\\d+', '9', 'g') AS shape, count(*) AS "rows", coalesce(min(len({number(1)})), 0) AS digits1,
        coalesce(min(len({number(3)})), 0) AS digits3, {ranges}, 'M/d/yyyy H:m' AS formats FROM texts GROUP BY 1""",
    )
    windows = [
        f"""round(sum(Spent) OVER w{n} + {NUDGE}, 4) AS Spent_{n}, CAST(sum(Lines) OVER w{n} AS BIGINT) AS Lines_{n},
        count(*) OVER w{n} AS ActiveDays_{n}"""
        for n in PERIODS
    ]
    frames = [
        f"""w{n} AS (PARTITION BY CustomerID ORDER BY "Date" RANGE BETWEEN INTERVAL {n - 1} DAYS PRECEDING AND CURRENT ROW)"""
        for n in PERIODS
    ]
    sql["rolling_period_features"] = _query(
        CLEAN
        + """,
days AS (SELECT CustomerID, CAST(InvoiceDate AS DATE) AS "Date", sum(TotalAmount) AS Spent, count(*) AS Lines FROM clean GROUP BY ALL)""",
        f"""SELECT CustomerID, strftime("Date", '%Y-%m-%d') AS "Date", {", ".join(windows)} FROM days WINDOW {", ".join(frames)}""",
    )
    sql["calendar_report"] = _query(
        CLEAN,
        f"""SELECT quarter(InvoiceDate) AS "Quarter", month(InvoiceDate) AS "Month", isodow(InvoiceDate) >= 6 AS IsWeekend,
        count(*) AS Lines, round(sum(TotalAmount) + {NUDGE}, 4) AS Revenue FROM clean GROUP BY ALL""",
    )
    unreadable = lambda c: f"{c} IS NOT NULL AND trim({c}) <> '' AND TRY_CAST({c} AS DOUBLE) IS NULL"
    sql["rejected_rows"] = _query(
        TEXTS,
        f"""SELECT CASE WHEN {unreadable("Quantity")} THEN 'unreadable quantity' WHEN {unreadable("UnitPrice")} THEN 'unreadable price'
        WHEN {unreadable("CustomerID")} THEN 'unreadable customer'
        WHEN try_strptime(InvoiceDate, '%m/%d/%Y %H:%M') IS NULL THEN 'unreadable date' ELSE 'accepted' END AS reason,
        count(*) AS "rows", count(DISTINCT InvoiceNo) AS invoices FROM texts GROUP BY 1""",
    )
    sql["clean_transactions"] = _query(
        CLEAN,
        f"""SELECT InvoiceNo, StockCode, Description, round(Quantity + {NUDGE}, 4) AS Quantity,
        strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate, round(UnitPrice + {NUDGE}, 4) AS UnitPrice,
        CustomerID, Country, round(TotalAmount + {NUDGE}, 4) AS TotalAmount, year(InvoiceDate) AS "Year",
        month(InvoiceDate) AS "Month", isodow(InvoiceDate) - 1 AS DayOfWeek, hour(InvoiceDate) AS "Hour",
        strftime(InvoiceDate, '%Y-%m-%d') AS "Date" FROM clean""",
    )
    sql["clean_step_counts"] = _query(
        RAW
        + """,
marked AS (
  SELECT *, CASE WHEN CustomerID IS NULL THEN 2 WHEN starts_with(InvoiceNo, 'C') THEN 3 WHEN NOT Quantity > 0 THEN 4
                 WHEN NOT UnitPrice > 0 THEN 5 WHEN TRY_CAST(InvoiceDate AS TIMESTAMP) IS NULL THEN 6 END AS failed
  FROM (SELECT DISTINCT * FROM raw)
)""",
        """SELECT CAST(1 AS BIGINT) AS step_no, 'duplicates' AS step,
       (SELECT count(*) FROM raw) - (SELECT count(*) FROM marked) AS rows_removed
UNION ALL SELECT 2, 'missing_customers', count(*) FROM marked WHERE failed = 2
UNION ALL SELECT 3, 'cancelled', count(*) FROM marked WHERE failed = 3
UNION ALL SELECT 4, 'invalid_quantities', count(*) FROM marked WHERE failed = 4
UNION ALL SELECT 5, 'invalid_prices', count(*) FROM marked WHERE failed = 5
UNION ALL SELECT 6, 'invalid_dates', count(*) FROM marked WHERE failed = 6""",
    )
    sql["preprocessing_stats"] = _query(
        CLEAN
        + """,
b AS (SELECT count(*) AS rows_before, count(DISTINCT CustomerID) AS unique_customers_before FROM raw),
a AS (SELECT count(*) AS rows_after, count(DISTINCT CustomerID) AS unique_customers_after FROM clean)""",
        f"""SELECT rows_before, rows_after, rows_before - rows_after AS rows_removed,
       round(100.0 * (rows_before - rows_after) / rows_before + {NUDGE}, 4) AS removal_percentage,
       CAST(8 AS BIGINT) AS columns_before, CAST(14 AS BIGINT) AS columns_after,
       unique_customers_before, unique_customers_after FROM b, a""",
    )
    for kind, same in (("lines", "clean_transactions"), ("steps", "clean_step_counts"), ("stats", "preprocessing_stats")):
        sql[f"cleaning_run_{kind}"] = sql[same]  # the same tables, put together from one reading
    sql["profile_of_period"] = _query(RAW, _period_profile())
    sql["validate_quality"] = _query(
        RAW,
        """SELECT true AS is_valid, CAST(0 AS BIGINT) AS missing_columns, CAST(0 AS BIGINT) AS extra_columns,
       count(*) AS total_rows, CAST(8 AS BIGINT) AS total_columns,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS duplicate_rows FROM raw""",
    )
    sql["null_profile"] = _query(RAW, _out("column, missing_count:i, missing_percentage:d", _null_profile()))
    sql["missing_columns"] = _query(
        RAW,
        f"""SELECT "column", missing_count, round(round(missing_percentage, 2) + {NUDGE}, 4) AS missing_percentage
        FROM {_null_profile()} WHERE missing_count > 0""",
    )
    sql["distinct_profile"] = _query(
        RAW,
        _union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM raw" for c in RAW_COLUMNS])[1:-1],
    )
    sql["numeric_describe"] = _query(
        RAW, _out("column, count:i, mean:d, std:d, min:d, q25:d, q50:d, q75:d, max:d", _describe())
    )
    sql["customer_summary"] = _query(
        SUMMARY,
        _out(
            """CustomerID, TransactionCount:i, FirstPurchaseDate:t, LastPurchaseDate:t, TotalRevenue:d, AvgOrderValue:d,
        StdOrderValue:d, TotalQuantity:d, AvgQuantity:d, UniqueProducts:i, Country, Recency:i, Tenure:i""",
            "summary",
        ),
    )
    sql["summary_model_matrix"] = _query(
        SUMMARY,
        _out(
            """CustomerID, TransactionCount:i, AvgOrderValue:d, StdOrderValue:d, TotalQuantity:d, AvgQuantity:d,
        UniqueProducts:i, Recency:i, Tenure:i, TotalRevenue:d""",
            "summary",
        ),
    )
    sql["rfm_base"] = _query(RFM, _out("CustomerID, Recency:i, Frequency:i, Monetary:d", "rfm_base"))
    sql["rfm_scores"] = _query(
        SCORES,
        _out("CustomerID, Recency:i, RecencyScore:d, FrequencyScore:d, MonetaryScore:d, RFMScore:d", "rfm_named"),
    )
    sql["rfm_segments"] = _query(SCORES, _out(RFM_SPEC, "rfm_named"))
    sql["segment_counts"] = _query(
        SCORES, "SELECT CustomerSegment, count(*) AS count FROM rfm_named GROUP BY CustomerSegment"
    )
    sql["behavioral_features"] = _query(CLEAN + BEHAVIOR, _out(BEHAVIOR_SPEC, "behavior"))
    sql["time_features"] = _query(CLEAN + TIMING, _out(TIMING_SPEC, "timing"))
    sql["weekday_pivot"] = _query(CLEAN + TIMING, _out("CustomerID, " + WEEKDAY_SPEC, "timing"))
    sql["hour_period_pivot"] = _query(CLEAN + TIMING, _out("CustomerID, " + HOUR_SPEC, "timing"))
    sql["purchase_interval_lag"] = _query(
        CLEAN,
        "\n".join([_gaps("""SELECT CustomerID, CAST(CASE WHEN sum(lines) > 1
        THEN coalesce(floor(sum(gap_days) / (sum(lines) - 1)), 0) ELSE 0 END AS BIGINT) AS MeanGapDays
FROM gaps GROUP BY CustomerID""")]),
    )
    sql["event_hour_habits"] = _query(EVENTS + TIMING, _out(TIMING_SPEC, "timing"))
    sql["event_gaps"] = _query(
        EVENTS,
        _gaps(
            f"""SELECT CustomerID, strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S.%f') AS InvoiceDate, lines,
       round(gap_days + {NUDGE}, 4) AS gap_days FROM gaps"""
        ),
    )
    sql["event_medians"] = _query(
        EVENTS,
        f"SELECT CustomerID, round(median(TotalAmount) + {NUDGE}, 4) AS MedianValue FROM clean GROUP BY CustomerID",
    )
    sql["cohort_features"] = _query(
        CLEAN + COHORT, _out("CustomerID, CohortSize:i, CohortAvgSpend:d, CohortMonthEncoded:i", "cohort")
    )
    sql["cohort_stats"] = _query(
        CLEAN + COHORT, _out("CohortMonth, CohortSize:i, CohortAvgSpend:d, CohortMonthEncoded:i", "cohorts")
    )
    sql["feature_table_imputed"] = _query(_feature_table(), _out(FEATURE_SPEC, "features"))
    sql["standard_scaled"] = _query(
        SUMMARY, _scaled(lambda c: f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()")
    )
    sql["minmax_scaled"] = _query(
        SUMMARY, _scaled(lambda c: f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())")
    )
    sql["column_medians"] = _query(SUMMARY, _out("metric, n:i, median:d", _medians()))
    sql["width_scores"] = _query(
        SUMMARY,
        """SELECT CustomerID, CAST(least(5, greatest(1, ceil((TotalRevenue - min(TotalRevenue) OVER ())
       / (max(TotalRevenue) OVER () - min(TotalRevenue) OVER ()) * 5))) AS DOUBLE) AS WidthScore FROM summary""",
    )
    sql["label_encoding"] = _query(
        CLEAN,
        """SELECT CustomerID, Country, dense_rank() OVER (ORDER BY Country) - 1 AS CountryCode
FROM (SELECT DISTINCT CustomerID, Country FROM clean)""",
    )
    sql["train_test_split"] = _query(
        CLEAN,
        """SELECT DISTINCT CustomerID, CAST(CAST('0x' || substr(md5(CustomerID || '|42'), 1, 8) AS BIGINT) % 100 < 20
       AS BIGINT) AS is_test FROM clean""",
    )
    sql["fold_numbers"] = _query(
        CLEAN,
        """SELECT DISTINCT CustomerID, CAST('0x' || substr(md5(CustomerID || '|fold'), 1, 8) AS BIGINT) % 5 AS fold
FROM clean""",
    )
    sql["contiguous_folds"] = _query(
        CLEAN,
        """SELECT CustomerID, CASE WHEN p < n % 5 * (n // 5 + 1) THEN p // (n // 5 + 1)
       ELSE n % 5 + (p - n % 5 * (n // 5 + 1)) // greatest(n // 5, 1) END AS fold
FROM (SELECT CustomerID, row_number() OVER (ORDER BY CustomerID) - 1 AS p, count(*) OVER () AS n
      FROM (SELECT DISTINCT CustomerID FROM clean))""",
    )
    model_spec = ", ".join(c.strip() for c in FEATURE_SPEC.split(",") if c.strip().split(":")[0] not in FEATURES_EXCLUDED[1:])
    sql["feature_model_matrix"] = _query(_feature_table(), _out(model_spec, "features"))
    sql["fold_products"] = _query(SUMMARY, _fold_products())
    sql["clv_segments"] = _query(
        SEGMENTED,
        f"""SELECT CustomerID, round(Predicted_CLV + {NUDGE}, 4) AS Predicted_CLV, CLV_Segment,
       round(avg(Predicted_CLV) OVER s + {NUDGE}, 4) AS Segment_Mean_CLV, round(min(Predicted_CLV) OVER s + {NUDGE}, 4) AS Segment_Min_CLV,
       round(max(Predicted_CLV) OVER s + {NUDGE}, 4) AS Segment_Max_CLV, count(*) OVER s AS Segment_Size,
       round(CLV_Percentile + {NUDGE}, 4) AS CLV_Percentile
FROM segmented WINDOW s AS (PARTITION BY CLV_Segment)""",
    )
    invoices = ",\ninvoices AS (SELECT CustomerID, CAST(count(DISTINCT InvoiceNo) AS DOUBLE) AS v FROM clean GROUP BY CustomerID)"
    sql["tie_broken_segments"] = _query(
        CLEAN + invoices,
        f"""SELECT CustomerID, v AS Predicted_CLV,
       'Segment_' || CAST(greatest(1, ceil(4.0 * (row_number() OVER (ORDER BY v, CustomerID) - 1) / (count(*) OVER () - 1))) AS INTEGER) AS CLV_Segment,
       round({_percentile('v')} + {NUDGE}, 4) AS CLV_Percentile FROM invoices""",
    )
    sql["percentile_rank"] = _query(
        CLEAN + invoices,
        f"SELECT CustomerID, v AS Invoices, round({_percentile('v')} + {NUDGE}, 4) AS Percentile FROM invoices",
    )
    sql["segment_stats"] = _query(
        SEGMENTED,
        f"""SELECT CLV_Segment, round(avg(Predicted_CLV) + {NUDGE}, 4) AS Segment_Mean_CLV,
       round(min(Predicted_CLV) + {NUDGE}, 4) AS Segment_Min_CLV, round(max(Predicted_CLV) + {NUDGE}, 4) AS Segment_Max_CLV,
       count(*) AS Segment_Size FROM segmented GROUP BY CLV_Segment""",
    )
    strategy = {k: _list([v[0]], "") for k, v in S.STRATEGIES.items()}
    priority = {k: _list([v[1]], "") for k, v in S.STRATEGIES.items()}
    actions = {k: _list(v[2], ", ") for k, v in S.STRATEGIES.items()}
    sql["recommendations"] = _query(
        SEGMENTED,
        f"""SELECT CustomerID, round(Predicted_CLV + {NUDGE}, 4) AS Predicted_CLV, CLV_Segment,
       round(CLV_Percentile + {NUDGE}, 4) AS CLV_Percentile,
       {_lookup('CLV_Segment', strategy, "'General Engagement'")} AS Strategy,
       {_lookup('CLV_Segment', priority, "'Medium'")} AS Priority,
       {_lookup('CLV_Segment', actions, "'Standard engagement'")} AS Recommended_Actions FROM segmented""",
    )
    short = {k: _list(v, " | ") for k, v in S.SHORT_ACTIONS.items()}
    form = {k: _list(v, " | ") for k, v in S.FORM_ACTIONS.items()}
    sql["threshold_segments"] = _query(
        PRED
        + f""",
small AS (SELECT CustomerID, round(Predicted_CLV / 500 + {NUDGE}, 2) AS v FROM pred),
cut AS (SELECT CustomerID, v, CASE WHEN v > 1000 THEN 'High' WHEN v > 500 THEN 'Medium-High' WHEN v > 200 THEN 'Medium'
        WHEN v > 50 THEN 'Medium-Low' ELSE 'Low' END AS CLV_Segment FROM small)""",
        f"""SELECT CustomerID, round(v + {NUDGE}, 4) AS Predicted_CLV, CLV_Segment,
       {_lookup('CLV_Segment', short, "''")} AS Recommendations FROM cut""",
    )
    sql["training_quantile_segments"] = _query(
        MODEL_ROWS
        + """,
targets AS (SELECT label FROM model_rows WHERE model = 'rule_x3'),
cuts AS (SELECT quantile_cont(label, [0.2, 0.4, 0.6, 0.8]) AS q FROM targets),
cut AS (
  SELECT CustomerID, prediction,
         CASE WHEN prediction >= q[4] THEN 'High' WHEN prediction >= q[3] THEN 'Medium-High'
              WHEN prediction >= q[2] THEN 'Medium' WHEN prediction >= q[1] THEN 'Medium-Low' ELSE 'Low' END AS CLV_Segment,
         (SELECT 100.0 * count(*) FILTER (WHERE t.label < m.prediction) / count(*) FROM targets t) AS share_below
  FROM model_rows m, cuts WHERE model = 'rule_x3'
)""",
        f"""SELECT CustomerID, round(prediction + {NUDGE}, 4) AS Predicted_CLV, CLV_Segment,
       round(share_below + {NUDGE}, 4) AS Share_Below, {_lookup('CLV_Segment', form, "''")} AS Recommendations FROM cut""",
    )
    sql["prediction_interval"] = _query(
        PRED,
        f"""SELECT CustomerID, round(Predicted_CLV + {NUDGE}, 4) AS Predicted_CLV,
       round(greatest(Predicted_CLV - m, 0) + {NUDGE}, 4) AS Lower_Bound, round(Predicted_CLV + m + {NUDGE}, 4) AS Upper_Bound,
       round(CAST(0.95 AS DOUBLE) + {NUDGE}, 4) AS Confidence_Level
FROM pred, (SELECT CAST({z} AS DOUBLE) * stddev_pop(Predicted_CLV) * 0.1 AS m FROM pred)""",
    )
    sql["segment_analysis"] = _query(
        SEGMENTED
        + """,
names AS (SELECT unnest(['Low', 'Medium-Low', 'Medium', 'Medium-High', 'High']) AS CLV_Segment),
facts AS (
  SELECT CLV_Segment, count(*) AS customers, round(sum(Predicted_CLV), 2) AS total_value, round(avg(Predicted_CLV), 2) AS avg_value,
         round(min(Predicted_CLV), 2) AS min_value, round(max(Predicted_CLV), 2) AS max_value
  FROM segmented GROUP BY CLV_Segment
),
whole AS (
  SELECT CLV_Segment, coalesce(customers, 0) AS customers, coalesce(total_value, 0) AS total_value, avg_value, min_value, max_value
  FROM names LEFT JOIN facts USING (CLV_Segment)
),
shares AS (
  SELECT *, round(100.0 * customers / sum(customers) OVER (), 1) AS pct_customers,
         round(100.0 * total_value / sum(total_value) OVER (), 1) AS pct_value FROM whole
)""",
        _out(
            "CLV_Segment, customers:i, total_value:d, avg_value:d, min_value:d, max_value:d, pct_customers:d, pct_value:d",
            "shares",
        ),
    )
    sql["value_by_segment"] = _query(
        SEGMENTED,
        f"SELECT CLV_Segment, round(sum(Predicted_CLV) + {NUDGE}, 4) AS total_value FROM segmented GROUP BY CLV_Segment",
    )
    sql["predicted_segment_counts"] = _query(
        SEGMENTED, "SELECT CLV_Segment, count(*) AS count FROM segmented GROUP BY CLV_Segment"
    )
    sql["filtered_predictions"] = _query(
        SEGMENTED,
        _out(
            "CustomerID, Predicted_CLV:d, CLV_Segment, CLV_Percentile:d",
            """(SELECT * FROM segmented WHERE CLV_Segment IN ('High', 'Medium')
            ORDER BY Predicted_CLV DESC, CustomerID LIMIT 100)""",
        ),
    )
    sql["kpi_summary"] = _query(
        SEGMENTED,
        _out(
            """total_customers:i, total_value:d, average_value:d, highest_value:d, high_value_customers:i,
        high_value_percentage:d, median_value:d""",
            """(SELECT count(*) AS total_customers, sum(Predicted_CLV) AS total_value, avg(Predicted_CLV) AS average_value,
        max(Predicted_CLV) AS highest_value, count(*) FILTER (WHERE CLV_Segment = 'High') AS high_value_customers,
        100.0 * count(*) FILTER (WHERE CLV_Segment = 'High') / count(*) AS high_value_percentage,
        median(Predicted_CLV) AS median_value FROM segmented)""",
        ),
    )
    pareto = PRED + """,
running AS (
  SELECT CustomerID, Predicted_CLV,
         sum(Predicted_CLV) OVER (ORDER BY Predicted_CLV DESC, CustomerID ROWS UNBOUNDED PRECEDING) AS Cumulative_Value,
         row_number() OVER (ORDER BY Predicted_CLV DESC, CustomerID) AS i FROM pred
),
curve AS (
  SELECT CustomerID, Predicted_CLV, Cumulative_Value,
         Cumulative_Value / (SELECT sum(Predicted_CLV) FROM pred) * 100 AS Cumulative_Percentage,
         100.0 * i / count(*) OVER () AS Customer_Percentage FROM running
)"""
    sql["pareto_curve"] = _query(
        pareto,
        _out("CustomerID, Predicted_CLV:d, Cumulative_Value:d, Cumulative_Percentage:d, Customer_Percentage:d", "curve"),
    )
    sql["pareto_point"] = _query(
        pareto,
        f"SELECT round(min(Customer_Percentage) + {NUDGE}, 4) AS pareto_point FROM curve WHERE Cumulative_Percentage >= 80",
    )
    sql["top_customers"] = _query(
        ANALYSIS,
        _out(
            "CustomerID, Predicted_CLV:d, CLV_Segment, Recency:i, Frequency:i, Monetary:d",
            "(SELECT * FROM analysis ORDER BY Predicted_CLV DESC, CustomerID LIMIT 10)",
        ),
    )
    sql["at_risk_customers"] = _query(
        ANALYSIS,
        _out(
            "CustomerID, Predicted_CLV:d, Recency:i, Frequency:i, Monetary:d",
            """(SELECT * FROM analysis WHERE CLV_Segment IN ('High', 'Medium-High')
            AND Recency > (SELECT quantile_cont(Recency, 0.75) FROM analysis)
            ORDER BY Predicted_CLV DESC, CustomerID LIMIT 10)""",
        ),
    )
    sql["segment_profile"] = _query(
        PROFILE, _out("CLV_Segment, Recency:d, Frequency:d, Monetary:d, CustomerTenure:d", "profile")
    )
    sql["profile_heatmap"] = _query(
        PROFILE,
        _out(
            "feature, CLV_Segment, value:d",
            _union(
                [
                    f"SELECT '{c}' AS feature, CLV_Segment, {c} AS value FROM profile"
                    for c in ("Recency", "Frequency", "Monetary", "CustomerTenure")
                ]
            ),
        ),
    )
    sql["top_countries"] = _query(
        CLEAN, "SELECT Country, count(*) AS count FROM clean GROUP BY Country ORDER BY count DESC, Country LIMIT 10"
    )
    sql["transaction_preview"] = _query(
        CLEAN,
        _out(
            "InvoiceDate:t, InvoiceNo, StockCode, Quantity:d, CustomerID, TotalAmount:d",
            "(SELECT * FROM clean ORDER BY InvoiceDate, InvoiceNo, StockCode, Quantity LIMIT 100)",
        ),
    )
    sql["value_histogram"] = _query(CLEAN, _histogram("clean", "TotalAmount"))
    sql["prediction_histogram"] = _query(SEGMENTED, _histogram("segmented", "Predicted_CLV", "CLV_Segment"))
    sql["feature_correlation"] = _query(SUMMARY, _correlations())
    sql["regression_metrics"] = _query(MODEL_ROWS, _out(METRICS_SPEC, "metrics", "WHERE model = 'rule'"))
    sql["model_comparison"] = _query(MODEL_ROWS, _out(METRICS_SPEC, "metrics"))
    sql["residual_analysis"] = _query(
        MODEL_ROWS,
        _out(
            """model, mean:d, std:d, skewness:d, kurtosis:d, min:d, max:d, median:d, percentile_5:d, percentile_95:d""",
            "residuals",
        ),
    )
    sql["evaluation_report"] = _query(
        MODEL_ROWS,
        f"""SELECT model, round(R2 + {NUDGE}, 4) AS R2, CASE WHEN R2 > 0.9 THEN 'Excellent' WHEN R2 > 0.7 THEN 'Good'
       WHEN R2 > 0.5 THEN 'Moderate' ELSE 'Poor' END AS fit, round(skewness + {NUDGE}, 4) AS residual_skewness,
       CASE WHEN abs(skewness) < 0.5 THEN 'approximately normal' ELSE 'skewed' END AS residual_shape
FROM metrics JOIN residuals USING (model)""",
    )
    sql["residual_points"] = _query(
        MODEL_ROWS,
        _out(
            "model, CustomerID, label:d, prediction:d, residual:d",
            "(SELECT model, CustomerID, label, prediction, e AS residual FROM model_rows)",
        ),
    )
    sql["residual_histogram"] = _query(
        MODEL_ROWS + ",\nrule AS (SELECT e AS residual FROM model_rows WHERE model = 'rule')",
        _histogram("rule", "residual"),
    )
    sql["point_range"] = _query(
        MODEL_ROWS,
        f"""SELECT model, round(least(min(label), min(prediction)) + {NUDGE}, 4) AS low,
       round(greatest(max(label), max(prediction)) + {NUDGE}, 4) AS high FROM model_rows GROUP BY model""",
    )
    sql["qq_points"] = _query(QQ, _out("model, CustomerID, theoretical:d, residual:d", "qq"))
    sql["qq_line"] = _query(
        QQ,
        f"""SELECT model, round(regr_slope(residual, theoretical) + {NUDGE}, 4) AS slope,
       round(regr_intercept(residual, theoretical) + {NUDGE}, 4) AS intercept,
       round(corr(residual, theoretical) + {NUDGE}, 4) AS r FROM qq GROUP BY model""",
    )
    return sql

"""Exact global order at scale: positions, running totals and quantiles.

A window without partition keys moves the whole table into one task, and the
exact ``percentile`` aggregate keeps a map of all distinct values in one task.
Both are replaced by one range shuffle: rows are range-partitioned by the sort
keys, sorted inside each slice, and written once to the checkpoint folder so
that every later use sees the same slices. A table with one row per slice (and
group) then supplies the offset of each slice. The sort keys must be unique, so
that a value shared by many rows is spread over several slices.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from custvalue.session import materialise, slices

# monotonically_increasing_id() holds the partition in the upper bits and the
# row's place in its partition in the lower 33.
_PLACE_BITS = 33


def _sorted_slices(df: DataFrame, keys: list[str], descending: set[str]) -> DataFrame:
    order = [F.col(k).desc() if k in descending else F.col(k).asc() for k in keys]
    ranged = df.repartitionByRange(slices(df.sparkSession), *order).sortWithinPartitions(*order)
    return _placed(ranged)


def _placed(df: DataFrame) -> DataFrame:
    """Fix the partition and the place of every row as columns."""
    return materialise(
        df.withColumn("_marker", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_marker", _PLACE_BITS))
        .withColumn("_place", F.col("_marker").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
        .drop("_marker")
    )


def _slice_offsets(sizes: DataFrame, group: list[str]) -> DataFrame:
    """Exclusive prefix of ``_size`` over the slices of a group, plus the group total.

    ``sizes`` has one row per slice and group, so a window here sees at most as
    many rows per group as there are slices.
    """
    whole = W.partitionBy(*group)
    before = whole.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn(
        "_total", F.sum("_size").over(whole)
    )


def with_row_index(df: DataFrame, output: str) -> DataFrame:
    """Number the rows 0..n-1 in partition order, without a sort or a shuffle of the rows."""
    placed = _placed(df)
    sizes = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    offsets = _slice_offsets(sizes, []).select("_slice", "_offset")
    return (
        placed.join(F.broadcast(offsets), "_slice")
        .withColumn(output, F.col("_offset") + F.col("_place"))
        .drop("_slice", "_place", "_offset")
    )


def positions(
    df: DataFrame,
    keys: list[str],
    *,
    group: list[str] | None = None,
    descending: set[str] = frozenset(),
) -> DataFrame:
    """Add ``_pos`` (0-based place in the order) and ``_n`` (row count), per group.

    ``keys`` must be unique within a group. The groups are meant to be few and
    named by the caller (metric names), which bounds the broadcast table at
    slices plus groups.
    """
    group = group or []
    placed = _sorted_slices(df, [*group, *keys], set(descending))
    sizes = placed.groupBy("_slice", *group).agg(
        F.count(F.lit(1)).alias("_size"), F.min("_place").alias("_first")
    )
    offsets = _slice_offsets(sizes, group).select("_slice", *group, "_first", "_offset", "_total")
    return (
        placed.join(F.broadcast(offsets), ["_slice", *group])
        .withColumn("_pos", F.col("_offset") + F.col("_place") - F.col("_first"))
        .withColumnRenamed("_total", "_n")
        .drop("_slice", "_place", "_first", "_offset")
    )


def running_totals(
    df: DataFrame,
    keys: list[str],
    weight: str,
    *,
    group: list[str] | None = None,
    descending: set[str] = frozenset(),
) -> DataFrame:
    """Add ``_running`` (inclusive running sum of ``weight``), ``_total`` and, when
    ungrouped, ``_rank`` (1-based place) and ``_n``.

    ``keys`` must be unique within a group; there may be any number of groups.
    """
    group = group or []
    placed = _sorted_slices(df, [*group, *keys], set(descending))
    measures = [F.sum(weight).alias("_size"), F.count(F.lit(1)).alias("_rows")]
    offsets = _slice_offsets(placed.groupBy("_slice", *group).agg(*measures), group)
    if not group:
        whole = W.orderBy("_slice")  # one row per slice
        offsets = F.broadcast(
            offsets.withColumn(
                "_rows_before",
                F.coalesce(F.sum("_rows").over(whole.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            ).withColumn("_n", F.sum("_rows").over(W.partitionBy()))
        )
    local = W.partitionBy("_slice", *group).orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = (
        placed.withColumn("_local", F.sum(weight).over(local))
        .join(offsets, ["_slice", *group])
        .withColumn("_running", F.col("_offset") + F.col("_local"))
    )
    if not group:
        joined = joined.withColumn("_rank", F.col("_rows_before") + F.col("_place") + 1)
    return joined.drop("_slice", "_place", "_local", "_offset", "_size", "_rows", "_rows_before")


def previous_values(df: DataFrame, group: str, key: str) -> DataFrame:
    """Add ``_previous``: the preceding ``key`` of the same group (keys unique per group).

    A lag that never puts a whole group into one task: inside a slice it is a
    window, and the first row of a group in a slice takes the group's last key
    from the slice before.
    """
    placed = _sorted_slices(df, [group, key], set())
    ends = placed.groupBy("_slice", group).agg(F.max(key).alias("_last"))
    before = F.lag("_last").over(W.partitionBy(group).orderBy("_slice"))
    carried = ends.select("_slice", group, before.alias("_carried"))
    local = F.lag(key).over(W.partitionBy("_slice", group).orderBy("_place"))
    return (
        placed.withColumn("_local", local)
        .join(carried, ["_slice", group])
        .withColumn("_previous", F.coalesce("_local", "_carried"))
        .drop("_slice", "_place", "_local", "_carried")
    )


# --- quantiles -------------------------------------------------------------


def _rational(p: float) -> Fraction:
    return Fraction(p).limit_denominator(1_000_000)


def _lower_place(p: float) -> str:
    """floor(p * (n - 1)) as integer SQL, free of rounding."""
    q = _rational(p)
    return f"((_n - 1) * {q.numerator} div {q.denominator})"


def long_values(df: DataFrame, values: dict[str, Column], keep: list[str] = ()) -> DataFrame:
    """One row per (metric, non-null value), with the ``keep`` columns alongside."""
    cells = [F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()]
    long = df.select(*keep, F.inline(F.array(*cells)))
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def quantiles(
    df: DataFrame, values: dict[str, Column], probabilities: list[float], *, unique_by: str | None = None
) -> DataFrame:
    """Exact, linearly interpolated quantiles: ``metric, n, q0, q1, ...``.

    With ``unique_by`` (a row key) the values are sorted as they are. Without it
    equal values are counted first, so repeated values cost one row each.
    """
    if unique_by is not None:
        placed = positions(
            long_values(df, values, [unique_by]), ["value", unique_by], group=["metric"]
        ).select("metric", "value", "_n", F.col("_pos").alias("_low"), F.col("_pos").alias("_high"))
        return pick_quantiles(placed, ["metric"], probabilities)
    counted = long_values(df, values).groupBy("metric", "value").agg(F.count(F.lit(1)).alias("_count"))
    return grouped_quantiles(counted, ["metric"], probabilities)


def grouped_quantiles(counted: DataFrame, group: list[str], probabilities: list[float]) -> DataFrame:
    """Exact quantiles per group from ``group, value, _count`` (values unique per group)."""
    spans = running_totals(counted, ["value"], "_count", group=group).select(
        *group,
        "value",
        F.col("_total").alias("_n"),
        (F.col("_running") - F.col("_count")).alias("_low"),
        (F.col("_running") - 1).alias("_high"),
    )
    return pick_quantiles(spans, group, probabilities)


def pick_quantiles(spans: DataFrame, group: list[str], probabilities: list[float]) -> DataFrame:
    """Keep the values that cover a wanted position and interpolate between them.

    ``spans`` holds ``group, value, _n`` and the positions ``_low.._high`` of the value.
    """
    wanted, picks = [], [F.max("_n").alias("n")]
    for i, p in enumerate(probabilities):
        low = _lower_place(p)
        covers_low = f"({low} BETWEEN _low AND _high)"
        covers_high = f"(least({low} + 1, _n - 1) BETWEEN _low AND _high)"
        wanted += [covers_low, covers_high]
        picks.append(F.expr(f"max(CASE WHEN {covers_low} THEN value END) AS _lo{i}"))
        picks.append(F.expr(f"max(CASE WHEN {covers_high} THEN value END) AS _hi{i}"))
    picked = spans.where(" OR ".join(wanted)).groupBy(*group).agg(*picks)
    between = []
    for i, p in enumerate(probabilities):
        q = _rational(p)
        share = f"(((n - 1) * {q.numerator} % {q.denominator}) / {q.denominator})"
        # An infinite neighbour that carries no weight must not turn the result into NaN.
        between.append(
            F.expr(
                f"CASE WHEN {share} = 0 OR _lo{i} = _hi{i} THEN _lo{i} "
                f"ELSE _lo{i} + (_hi{i} - _lo{i}) * {share} END AS q{i}"
            )
        )
    return picked.select(*group, "n", *between)


# --- quantiles without a sort ----------------------------------------------

# How far a bracket reaches to both sides of a wanted place, as a share of the rows; the sketch is twice as exact.
_REACH = 0.002


def bracketed_quantiles(
    df: DataFrame, values: dict[str, Column], probabilities: list[float]
) -> dict[str, tuple[int, list[float]]]:
    """Exact quantiles as :func:`quantiles` gives them, without sorting the rows: ``metric -> (n, quantiles)``.

    Sketches from one aggregation bracket the wanted places. Then the rows below
    each bracket are counted, and only the distinct values inside are put in
    order, which are few. Where a bracket misses its place, all values are put
    in order. Metrics without any value are left out. ``df`` is read three times.
    """
    names = {m: f"m{i}" for i, m in enumerate(values)}
    numbers = df.select(*[F.nanvl(v.cast("double"), F.lit(None).cast("double")).alias(names[m]) for m, v in values.items()])
    ends = [min(max(p + side * _REACH, 0.0), 1.0) for p in probabilities for side in (-1, 1)]
    sketches = [F.percentile_approx(c, ends, round(2 / _REACH)).alias(c) for c in names.values()]
    facts = numbers.agg(*sketches, *[F.count(c).alias(f"{c}_n") for c in names.values()]).first()
    sizes = {m: facts[f"{c}_n"] for m, c in names.items() if facts[f"{c}_n"]}
    brackets = {(m, i): facts[names[m]][2 * i : 2 * i + 2] for m in sizes for i in range(len(probabilities))}
    found = _inside(numbers, names, sizes, brackets, probabilities)
    missed = {key: [-float("inf"), float("inf")] for key in brackets if key not in found}
    if missed:
        found |= _inside(numbers, names, sizes, missed, probabilities)
    return {m: (n, [found[m, i] for i in range(len(probabilities))]) for m, n in sizes.items()}


def _inside(
    numbers: DataFrame, names: dict[str, str], sizes: dict[str, int], brackets: dict, probabilities: list[float]
) -> dict[tuple[str, int], float]:
    """By metric and place in ``probabilities``: the quantiles that lie inside their brackets."""
    if not brackets:
        return {}
    tags = {key: f"{names[key[0]]}_{key[1]}" for key in brackets}
    counts = []
    for key, (low, high) in brackets.items():
        value = F.col(names[key[0]])
        counts.append(F.count_if(value < F.lit(low)).alias(f"{tags[key]}_below"))
        counts.append(F.count_if(value <= F.lit(high)).alias(f"{tags[key]}_upto"))
    counted = numbers.agg(*counts).first()
    found, cells, facts = {}, [], []
    for key, (low, high) in brackets.items():
        n, below, upto = sizes[key[0]], counted[f"{tags[key]}_below"], counted[f"{tags[key]}_upto"]
        q = _rational(probabilities[key[1]])
        place = (n - 1) * q.numerator // q.denominator
        if not below <= place <= min(place + 1, n - 1) < upto:
            continue  # missed
        if low == high:  # one value, however often
            found[key] = low
            continue
        value, tag = F.col(names[key[0]]), F.lit(tags[key])
        cells.append(F.struct(tag.alias("metric"), F.when(value.between(F.lit(low), F.lit(high)), value).alias("value")))
        facts.append((tags[key], below, n))
    if not facts:
        return found
    inner = numbers.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
    counted = inner.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("_count"))
    starts = numbers.sparkSession.createDataFrame(facts, "metric string, _below long, _n long")
    spans = (
        running_totals(counted, ["value"], "_count", group=["metric"])
        .join(F.broadcast(starts), "metric")
        .select(
            "metric",
            "value",
            "_n",
            (F.col("_below") + F.col("_running") - F.col("_count")).alias("_low"),
            (F.col("_below") + F.col("_running") - 1).alias("_high"),
        )
    )
    rows = {r["metric"]: r for r in pick_quantiles(spans, ["metric"], probabilities).collect()}
    return found | {key: rows[tag][f"q{key[1]}"] for key, tag in tags.items() if tag in rows}


# --- order statistics on the driver ----------------------------------------


@dataclass(frozen=True)
class OrderStatistics:
    """The few rows of one ordered metric that its quantiles and rank cuts need."""

    n: int
    rows: dict[int, tuple]  # position -> (value, id)

    def quantile(self, p: float) -> float | None:
        if self.n == 0:
            return None
        q = _rational(p)
        place, rest = divmod((self.n - 1) * q.numerator, q.denominator)
        low = self.rows[place][0]
        high = self.rows[min(place + 1, self.n - 1)][0]
        # An infinite neighbour that carries no weight must not turn the result into NaN.
        return low if rest == 0 or low == high else low + (high - low) * (rest / q.denominator)

    def at(self, p: float) -> tuple:
        """The row at place floor(p * (n - 1))."""
        q = _rational(p)
        return self.rows[(self.n - 1) * q.numerator // q.denominator]


def order_statistics(
    placed: DataFrame, id_col: str, wanted: dict[str, list[float]]
) -> dict[str, OrderStatistics]:
    """Fetch the rows around the wanted quantiles of each metric, in one job.

    ``placed`` comes from :func:`positions` over (metric, value, id). At most two
    rows per metric and probability reach the driver, whatever the table's size;
    they return to the plan as literals.
    """
    near = [
        f"(metric = '{metric}' AND _pos BETWEEN {_lower_place(p)} AND {_lower_place(p)} + 1)"
        for metric, probabilities in wanted.items()
        for p in probabilities
    ]
    found = placed.where(" OR ".join(near)).select("metric", "value", id_col, "_pos", "_n").collect()
    out = {}
    for metric in wanted:
        own = [r for r in found if r["metric"] == metric]
        rows = {r["_pos"]: (r["value"], r[id_col]) for r in own}
        out[metric] = OrderStatistics(own[0]["_n"] if own else 0, rows)
    return out


def quantile_values(
    df: DataFrame, values: dict[str, Column], probabilities: list[float], *, unique_by: str | None = None
) -> dict[str, list[float]]:
    """:func:`quantiles` as plain numbers per metric, one small row per metric."""
    table = quantiles(df, values, probabilities, unique_by=unique_by).collect()
    return {r["metric"]: [r[f"q{i}"] for i in range(len(probabilities))] for r in table}

"""Mixing sources to target weights, with DataFrame functions alone.

Words are added up per source. Sources take turns at the weights and share a
multiple of all words; a source's target stops at a multiple of its own words,
and what it cannot take is shared again by weight. A source's rate is its target
over its words: each of its documents is taken floor(rate) times, plus once more
with the probability that is left, drawn from a hash of the document.

Whole documents of very different sizes make such draws uneven, so a number of
hash seeds is tried and each source uses the one whose words come nearest its
target. A draw depends on the document, the seed and nothing else, so reruns
agree however the rows are dealt.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.functions.ordering import positions, running_totals
from custvalue.session import materialise

WORDS = r"[^\x20\x09-\x0D]+"
HASH_BITS = 28  # seven hexadecimal digits
BROADCAST_SOURCES, BROADCAST_CHARS = 100_000, 8_000_000  # a larger table of sources is joined by a shuffle


@dataclass(frozen=True)
class Mix:
    """Weights in turn over the ordered sources, the share of all words to take, the most of a source, seeds tried."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    seeds: int = 64

    def __post_init__(self):
        if not self.weights or min(self.weights) < 1 or self.share < 0 or self.most < 1 or self.seeds < 1:
            raise ValueError("weights, most and seeds must be at least 1 and the share must not be negative")


def words_of(text: Column) -> Column:
    """Words of a text as a long; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _key(df: DataFrame, id_col: str, source_col: str, text_col: str) -> Column:
    """A hash of a document's id, source and text as 32 hexadecimal digits; nulls differ from empty texts."""
    mark = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.md5(c.cast("string"))))
    return F.md5(F.concat(*[mark(df[c]) for c in (id_col, source_col, text_col)]))


def _measured(df: DataFrame, id_col: str, source_col: str, text_col: str, *more: Column) -> DataFrame:
    """``_id, _source, _size, _h, _step``; the last two are what draws are made of."""
    key = _key(df, id_col, source_col, text_col)
    part = lambda at: F.conv(F.substring(key, at, HASH_BITS // 4), 16, 10).cast("long")
    return df.select(
        df[id_col].alias("_id"),
        df[source_col].cast("string").alias("_source"),
        words_of(df[text_col]).alias("_size"),
        part(1).alias("_h"),
        part(1 + HASH_BITS // 4).alias("_step"),
        *more,
    )


def _chance(seed: Column) -> Column:
    """A number of 0 to under 1 for each document and seed."""
    return F.pmod(F.col("_h") + F.col("_step") * seed, F.lit(1 << HASH_BITS)) / F.lit(float(1 << HASH_BITS))


def _copies(seed: Column) -> Column:
    whole = F.floor("_rate")
    return whole + F.when(_chance(seed) < F.col("_rate") - whole, 1).otherwise(0)


def _targets(measured: DataFrame, mix: Mix) -> DataFrame:
    """``_source, _source_size, _target, _rate`` of every source.

    Sources are in order of code points, the null source last. A source is at
    its limit if the shares of all sources, each stopped at its own limit, would
    not use up the words at the level where it stops; all levels come from
    running totals over the sources in order of their levels.
    """
    sums = measured.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    placed = positions(sums.withColumn("_missing", F.col("_source").isNull()), ["_missing", "_source"])
    common, turn = math.lcm(*mix.weights), F.col("_pos") % len(mix.weights)
    by_turn = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), turn.cast("int") + 1)
    weighed = placed.withColumn("_weight", by_turn(mix.weights)).withColumn("_cap", F.col("_source_size") * mix.most)
    # The level at which a source stops is cap / weight; times the weights' common multiple it is a whole number.
    weighed = weighed.withColumn("_level", F.col("_cap") * by_turn([common // w for w in mix.weights])).drop("_n")
    by_weight = running_totals(weighed, ["_level", "_pos"], "_weight")
    by_weight = by_weight.select(
        "_source", "_pos", "_source_size", "_weight", "_cap", "_level",
        F.col("_running").alias("_weights"), F.col("_total").alias("_all_weights"),
    )
    both = running_totals(by_weight, ["_level", "_pos"], "_cap").withColumn("_words", F.lit(mix.share) * F.col("_total") / mix.most)
    exact = lambda name: F.col(name).cast("decimal(38,0)")
    at_level = exact("_running") * common + exact("_level") * (F.col("_all_weights") - F.col("_weights"))
    at_level = at_level <= F.col("_words") * common
    both = materialise(both.withColumn("_full", at_level))
    used = both.agg(
        F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))), F.lit(0)).alias("_used"),
        F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_weight"))), F.lit(0)).alias("_sharing"),
    ).first()
    words, sharing = (0, 1) if used is None else (used["_used"], max(1, used["_sharing"]))
    shared = (F.col("_words") - F.lit(float(words))) * F.col("_weight") / F.lit(float(sharing))
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(shared)
    rate = F.when(F.col("_source_size") > 0, F.least(F.lit(float(mix.most)), target / F.col("_source_size")))
    return both.select("_source", "_source_size", target.alias("_target"), F.coalesce(rate, F.lit(0.0)).alias("_rate"))


def _with_sources(measured: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """The rows with the columns of their source; a table of sources above the bound is not broadcast."""
    named = sources.withColumnRenamed("_source", "_name")
    return measured.join(F.broadcast(named) if small else named, F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")


def _plan(measured: DataFrame, mix: Mix) -> tuple[DataFrame, bool]:
    """The sources with their rates and seeds, and whether the table is small enough to broadcast."""
    targets = materialise(_targets(measured, mix))
    size = targets.agg(F.count("*"), F.coalesce(F.sum(F.length("_source")), F.lit(0))).first()
    small = size[0] <= BROADCAST_SOURCES and size[1] <= BROADCAST_CHARS
    tries = _with_sources(measured, targets, small).withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(mix.seeds - 1))))
    taken = tries.groupBy("_source", "_try").agg(
        F.abs(F.sum(F.col("_size") * _copies(F.col("_try"))) - F.max("_target")).alias("_off")
    )
    nearest = F.min(F.struct("_off", "_try"))["_try"].alias("_seed")
    chosen = taken.groupBy(F.col("_source").alias("_name")).agg(nearest)
    joined = targets.join(chosen, F.col("_source").eqNullSafe(F.col("_name")), "left").drop("_name")
    return materialise(joined), small


def mix_plan(
    df: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """``id, source, size, source_size, target, copies`` of every row of ``df``.

    Null texts have no words; null sources are one source, the last; null ids
    are kept. Rows alike in id, source and text draw alike. A source without
    words has target 0 and no copies. An empty table gives no rows, and other
    columns, whatever their names, are not read.
    """
    measured = materialise(_measured(df, id_col, source_col, text_col))
    sources, small = _plan(measured, mix)
    return _with_sources(measured, sources, small).select(
        F.col("_id").alias("id"),
        F.col("_source").alias("source"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        _copies(F.col("_seed")).cast("long").alias("copies"),
    )


def mix_documents(
    df: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """The rows of ``df``, all columns as they are, each as often as the mix takes it (see ``mix_plan``)."""
    rows = _measured(df, id_col, source_col, text_col, F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"))
    sources, small = _plan(materialise(rows.drop("_row")), mix)
    copies = _with_sources(rows, sources, small).withColumn("_copies", _copies(F.col("_seed")).cast("int"))
    taken = copies.filter("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    return taken.select("_row.*")

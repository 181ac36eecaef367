"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the least node of the neighbourhood."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are tied to the least of them; edges run from greater to lesser nodes."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    mixed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), mixed).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that has an edge; the root is the least node of its component.

    ``edges`` has two columns of nodes, in any direction, repeats and loops
    included; edges with a null node are ignored. Rounds are logarithmic in the
    longest path; each is checkpointed. A star of any size is summed before it
    is shuffled, and joined by a key that adaptive execution can split.
    """
    u, v = edges.columns
    pairs = edges.filter(F.col(u).isNotNull() & F.col(v).isNotNull())
    pairs = pairs.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    current = materialise(pairs.filter("u > v").distinct())
    state = _state(current)
    while state[0]:
        current = materialise(_small_star(_large_star(current)))
        state, last = _state(current), state
        if state == last:
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

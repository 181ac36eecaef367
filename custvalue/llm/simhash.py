"""Near-duplicate detection by SimHash fingerprints and deletion-variant signatures.

A fingerprint takes each of its 64 bits by majority over the hashes of a text's
word shingles. To find all pairs within ``k`` bits, fingerprints are cut into
``k // 2 + 1`` segments, so that at least one segment of such a pair differs by
at most one bit. Each segment is indexed under its value and under every variant
with one bit deleted; pairs that share a signature are verified bit by bit.

Work runs on distinct fingerprints, so copies are one row. Where very many
fingerprints share a segment's value, their signatures are refined by the same
rule on the remaining bits, so no bucket is compared pair by pair at length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from custvalue.llm.components import connected_components
from custvalue.llm.kept import releasing
from custvalue.session import materialise

BITS, SEED = 64, 42
_CHUNK = 1_000_000  # shingles hashed at once


def fingerprint(text: bytes | None, shingle_words: int) -> int:
    """64-bit SimHash of a UTF-8 text, as a signed integer; a text without words has zero."""
    words = (text or b"").lower().split()  # of bytes: lowers A-Z, splits at space and 0x09-0x0D
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
        total = len(words) - shingle_words + 1
    counts = np.zeros(BITS, np.int64)
    for _ in range(0, total, _CHUNK):
        digests = b"".join([xxh64_digest(s, SEED) for s in islice(shingles, _CHUNK)])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle_words: int, key_col: str | None = None) -> DataFrame:
    """``id, fp`` of every row, and ``key`` if a column of row keys is named; texts travel as UTF-8 bytes."""
    keys = {"id": id_col} | ({"key": key_col} if key_col else {})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle_words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(found, pa.int64())], [*keys, "fp"])

    own = [df[c].cast("long").alias(k) for k, c in keys.items()]
    texts = df.select(*own, df[text_col].cast("binary").alias("text"))
    return texts.mapInArrow(releasing(rows), ", ".join(f"{k} long" for k in [*keys, "fp"]))


def _cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of nearly equal parts of ``width`` bits."""
    edges = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _part(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1))


def _rest(value: Column, shift: int, width: int) -> Column:
    """The bits outside a segment, closed up."""
    low = value.bitwiseAND(F.lit((1 << shift) - 1))
    high = F.shiftleft(F.shiftrightunsigned(value, shift + width), shift) if shift + width < BITS else F.lit(0)
    return high.bitwiseOR(low)


def _signatures(value: Column, width: int, distance: int, deleted_bit: int) -> Column:
    """Array of the signatures of a value of ``width`` bits for pairs within ``distance`` bits.

    A signature is a tag, which names the segment and the deleted bit, and the
    segment's other bits. Variants are made only where the bit to delete equals
    ``deleted_bit``: of a pair that differs in it, each side makes one.
    """
    parts = _cuts(width, max(1, distance // 2 + 1))
    return F.concat(*[_variants(_part(value, at, w), n, w, distance > 0, deleted_bit) for n, (at, w) in enumerate(parts)])


def _variants(part: Column, segment: int, width: int, deletions: bool, deleted_bit: int) -> Column:
    first = segment * (BITS + 1)
    own = F.array(F.struct(F.lit(first + BITS).cast("long").alias("tag"), part.alias("bits")))
    if not deletions:
        return own
    set_bits = lambda i: F.call_function("shiftright", part, i).bitwiseAND(F.lit(1))
    mask = lambda i: F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i))
    spots = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: set_bits(i) == deleted_bit)
    return F.concat(
        own,
        F.transform(
            spots, lambda i: F.struct((F.lit(first) + i).cast("long").alias("tag"), part.bitwiseAND(mask(i)).alias("bits"))
        ),
    )


def _indexed(fps: DataFrame, distance: int, side: int) -> DataFrame:
    parts = _signatures(F.col("fp"), BITS, max(2, distance), side)
    return fps.select("fp", F.explode(parts).alias("s")).select("fp", "s.tag", "s.bits")


def _refined(rows: DataFrame, distance: int, side: int) -> DataFrame:
    """Rows of crowded signatures with a second signature over the bits outside the first segment.

    ``bit2`` pairs variants made of a clear bit with those made of a set bit.
    """
    choice = F
    for n, (at, width) in enumerate(_cuts(BITS, max(2, distance) // 2 + 1)):
        rest, first = _rest(F.col("fp"), at, width), n * (BITS + 1)
        for here, left in (
            (F.col("tag") == first + BITS, distance),
            (F.col("tag").between(first, first + BITS - 1), max(0, distance - 1)),
        ):
            made = []
            for bit in (0, 1) if left else (0,):
                facing = bit if side == 0 else 1 - bit
                made.append(
                    F.transform(
                        _signatures(rest, BITS - width, left, bit),
                        lambda s: F.struct(
                            s["tag"].alias("tag"),
                            s["bits"].alias("bits"),
                            F.when(s["tag"] % (BITS + 1) == BITS, -1).otherwise(facing).alias("bit"),  # noqa: B023
                        ),
                    )
                )
            choice = choice.when(here, F.array_distinct(F.concat(*made)))
    second = F.explode(choice).alias("s")
    return rows.select("fp", "tag", "bits", second).select(
        "fp", "tag", "bits", F.col("s.tag").alias("tag2"), F.col("s.bits").alias("bits2"), F.col("s.bit").alias("bit2")
    )


def links(fps: DataFrame, distance: int, crowded: int = 4096) -> DataFrame:
    """``a, b``: pairs of the distinct fingerprints ``fp`` that differ in 1 to ``distance`` bits (a pair may repeat).

    A segment value that more than ``crowded`` fingerprints share is crowded:
    all pairs that involve it are found by refined signatures instead.
    """
    left, right = _indexed(fps, distance, 0), _indexed(fps, distance, 1)
    near = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= distance
    once = (F.col("l.tag") % (BITS + 1) < BITS) | (F.col("l.fp") < F.col("r.fp"))

    def joined(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        same = near & once
        for k in keys:
            same = same & (F.col(f"l.{k}") == F.col(f"r.{k}"))
        return x.alias("l").join(y.alias("r"), same).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))

    segments = _cuts(BITS, max(2, distance) // 2 + 1)
    values = F.array(*[F.struct(F.lit(n).alias("n"), _part(F.col("fp"), s, w).alias("bits")) for n, (s, w) in enumerate(segments)])
    crowds = fps.select(F.explode(values).alias("s")).groupBy("s.n", "s.bits").count().filter(F.col("count") > crowded)
    crowds = materialise(crowds.select("n", "bits"))
    if crowds.isEmpty():
        return joined(left, right, ["tag", "bits"])
    hot = crowds.filter("false").select(F.lit(0).cast("long").alias("tag"), "bits")
    for n, (_, w) in enumerate(segments):
        own = crowds.filter(F.col("n") == n).select("bits")
        hot = hot.union(own.select(F.lit(n * (BITS + 1) + BITS).cast("long"), "bits"))
        at = F.explode(F.sequence(F.lit(0), F.lit(w - 1)))
        spots = own.select("bits", at.alias("i"))
        mask = F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i")))
        hot = hot.union(spots.select((F.lit(n * (BITS + 1)) + F.col("i")).cast("long"), F.col("bits").bitwiseAND(mask)))
    hot = materialise(hot.distinct())
    plain = [x.join(hot, ["tag", "bits"], "left_anti") for x in (left, right)]
    dense = [_refined(x.join(hot, ["tag", "bits"], "left_semi"), distance, side) for side, x in enumerate((left, right))]
    keys = ["tag", "bits"]
    return joined(*plain, keys).union(joined(*dense, [*keys, "tag2", "bits2", "bit2"]))


def _rooted(groups: DataFrame, distance: int, crowded: int) -> DataFrame:
    """``groups``, one row a fingerprint ``fp``, with the ``root`` of each one's component."""
    roots = connected_components(links(groups.select("fp"), distance, crowded))
    joined = groups.join(roots, groups["fp"] == roots["node"], "left")
    return materialise(joined.select(*groups.columns, F.coalesce("root", "fp").alias("root")))


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    distance: int = 2,
    crowded: int = 4096,
) -> DataFrame:
    """``doc_id, fingerprint (16 hex digits), component_id`` of every row.

    Documents link when their fingerprints differ in at most ``distance`` bits;
    ``component_id`` is the smallest id that links reach. Null and empty texts,
    and texts without words, have fingerprint zero and link like any other. A
    row without an id takes the component of its fingerprint, null if no row
    with an id is in it. Repeated ids are rows of their own; an empty table
    gives no rows. Other columns, whatever their names, are not read.
    """
    docs = materialise(fingerprints(df, id_col, text_col, shingle_words))
    groups = materialise(docs.groupBy("fp").agg(F.min("id").alias("least")))
    roots = _rooted(groups, distance, crowded)
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = roots.join(least, "root").select("fp", "component_id")
    text = F.lpad(F.lower(F.hex("fp")), BITS // 4, "0")
    return docs.join(by_print, "fp").select(F.col("id").alias("doc_id"), text.alias("fingerprint"), "component_id")


def one_of_each_group(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    distance: int = 2,
    crowded: int = 4096,
) -> DataFrame:
    """``df`` with the row of the smallest id of each near-duplicate group, in its own columns.

    Rows count as themselves, also if they share an id: of several with a
    group's smallest id the first stays. Of a group's rows without an id the
    first stays beside it. Rows are numbered and written once, so that all steps
    see the same ones.
    """
    name = "_row"
    while name in df.columns:
        name += "_"
    rows = materialise(df.withColumn(name, F.monotonically_increasing_id()))
    docs = fingerprints(rows, id_col, text_col, shingle_words, name)
    named, nameless = F.col("id").isNotNull(), F.col("id").isNull()
    least = F.min(F.when(named, F.struct("id", "key"))).alias("least")
    groups = materialise(docs.groupBy("fp").agg(least, F.min(F.when(nameless, F.col("key"))).alias("nameless")))
    kept = _rooted(groups, distance, crowded).groupBy("root").agg(F.min("least").alias("least"), F.min("nameless").alias("nameless"))
    keys = kept.select(F.explode(F.array("least.key", "nameless")).alias("_key")).filter("_key is not null")
    return rows.join(keys, rows[name] == keys["_key"], "left_semi").drop(name)

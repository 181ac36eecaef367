"""Phrase collocations from FM-indexes over word ids, one index per shard of documents.

A shard is a bounded run of a task's documents. Its index holds two
Burrows-Wheeler transforms of the shard's word ids, of the text and of its
reverse, sorted to the depth of the longest phrase. An interval of the one is
the interval of the same phrase in the other, so a phrase is extended to the
right or to the left by counting the words beside its interval: all phrases of a
length are extended at once, by one sort of (interval, word).

Counts are summed across shards. Most phrases are rare, so before phrases are
sent as texts, shards exchange hashes: each sends the hashes of its words and of
its phrases with their counts, dealt out by hash, and gets back those that are
frequent enough over all shards, as a bit for each in the order sent. Every part
of a frequent phrase is as frequent, so a shard extends such phrases only. Equal
hashes of different phrases add up to more than each count, so no frequent
phrase is lost, and what is kept by mistake falls out when the texts are counted.

What is kept of a shard between these steps are its word ids and words; the
transforms are built from them whenever it is opened.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custvalue.session import materialise, slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = ".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans((UPPER + BREAKS + "\t").encode(), (LOWER + "." * len(BREAKS) + " ").encode())
UNKNOWN = "und"
HASH_BYTES = 6  # of a hash that are sent; its bucket tells some of the rest
BATCH_CHARS = 2_000_000  # text cut into words at once
_BETWEEN = re.compile(f"[ \t{re.escape(BREAKS)}]")


@dataclass(frozen=True)
class Settings:
    """Lengths and least count of phrases, the shares that rule them out, and the bounds of shards and tasks."""

    longest: int = 3
    least: int = 10
    inside_percent: int = 50
    first: int = 2000
    shard_words: int = 1 << 21
    hashes_per_task: int = 1 << 20

    def __post_init__(self):
        if self.longest < 2 or self.least < 1 or self.first < 1:
            raise ValueError("phrases have 2 words or more, and counts and ranks start at 1")


# --- the index of a shard ---------------------------------------------------


@dataclass
class Phrases:
    """Phrases of one length: their words as rows, their counts, and their intervals in both transforms."""

    words: np.ndarray
    counts: np.ndarray
    forward: np.ndarray
    backward: np.ndarray

    def some(self, which: np.ndarray) -> Phrases:
        return Phrases(self.words[which], self.counts[which], self.forward[which], self.backward[which])


def _order(text: np.ndarray, depth: int, alphabet: int, step: int) -> np.ndarray:
    """Places of the text sorted by the ``depth`` symbols from each place on, forwards (step 1) or backwards (-1)."""
    symbol = lambda k: np.roll(text, -step * k).astype(np.int64)
    if depth == 1:
        return np.argsort(text, kind="stable")
    if alphabet < 2**31 and depth == 2:
        return np.argsort(symbol(0) * alphabet + symbol(1), kind="stable")
    return np.lexsort([symbol(k) for k in range(depth - 1, -1, -1)])


class Index:
    """A bidirectional FM-index of word ids; id 0 ends every piece and is in no phrase.

    ``starts`` has the first row of each symbol; ``left`` the symbol before each
    row of the sorted text, ``right`` the symbol after each row of the sorted
    reverse. Phrases of up to ``depth`` words have whole intervals.
    """

    def __init__(self, starts: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.starts, self.left, self.right = starts, left, right
        self._steps: dict[bool, np.ndarray] = {}

    @classmethod
    def of(cls, text: np.ndarray, alphabet: int, depth: int) -> Index:
        starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        left = np.roll(text, 1)[_order(text, depth, alphabet, 1)]
        right = np.roll(text, -1)[_order(text, depth, alphabet, -1)]
        return cls(starts, left, right)

    def words(self) -> Phrases:
        """Every single word."""
        ids = np.arange(1, len(self.starts) - 1)
        counts = np.diff(self.starts)[1:]
        there = counts > 0
        at = self.starts[1:-1][there]
        return Phrases(ids[there][:, None].astype(np.int32), counts[there], at, at)

    def _step(self, to_right: bool) -> np.ndarray:
        """Row that each row of a transform leads to: the symbol's first row and its rank among equal symbols."""
        if to_right not in self._steps:
            column = self.right if to_right else self.left
            out = np.empty(len(column), np.int64)
            out[np.argsort(column, kind="stable")] = np.arange(len(column))
            self._steps[to_right] = out
        return self._steps[to_right]

    def extend(self, phrases: Phrases, to_right: bool, both: bool = True) -> Phrases:
        """All phrases that are one word longer on one side, from the words beside each interval.

        In the transform that was read, a longer phrase's interval is where its
        first row leads (found with ``both`` only); in the other, it lies behind
        those of lesser words.
        """
        column, at = (self.right, phrases.backward) if to_right else (self.left, phrases.forward)
        ends = np.cumsum(phrases.counts)
        of = np.repeat(np.arange(len(ends)), phrases.counts)
        rows = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - phrases.counts - at, phrases.counts)
        pairs = of * (len(self.starts) - 1) + column[rows]
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.empty(0, np.int64)
        parent, symbol = np.divmod(pairs[first], len(self.starts) - 1)
        counts = np.diff(np.append(first, len(pairs)))
        real = symbol > 0
        beside = symbol[real][:, None].astype(np.int32)
        known = phrases.words[parent[real]]
        words = np.hstack([known, beside] if to_right else [beside, known])
        led = self._step(to_right)[rows[order[first]]][real] if both else np.zeros(len(words), np.int64)
        other = (phrases.forward if to_right else phrases.backward)[parent]
        behind = (other + first - (ends - phrases.counts)[parent])[real]
        return Phrases(words, counts[real], *((behind, led) if to_right else (led, behind)))


def _mixed(code: np.ndarray) -> np.ndarray:
    code = (code ^ (code >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    code = (code ^ (code >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return code ^ (code >> np.uint64(31))


def phrase_hashes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A hash of each row of words from the hashes of the words, alike in all shards."""
    code = np.full(len(words), words.shape[1], np.uint64)
    for column in words.T:
        code = _mixed(code * np.uint64(0x9E3779B97F4A7C15) + hashes[column])
    return code


def by_length(index: Index, hashes: np.ndarray, longest: int, frequent: Masks | None = None) -> Iterator[tuple[int, Phrases, np.ndarray]]:
    """(length, phrases, hashes) for phrases of 1 to ``longest`` words, in the order of their hashes.

    Two words are extended from every word. Longer phrases are those whose parts
    are frequent, so ``frequent`` has to say which of the phrases of 2 to
    ``longest`` - 1 words are. Words are extended to the right, two words to the
    left, and so on in turn.
    """
    phrases, known = index.words(), None
    for length in range(1, longest + 1):
        if length > 1:
            phrases = index.extend(phrases, length % 2 == 0, length + 1 < longest)
        if known is not None:
            part = phrases.words[:, 1:] if length % 2 == 0 else phrases.words[:, :-1]
            phrases = phrases.some(_among(phrase_hashes(part, hashes), known))
        codes = phrase_hashes(phrases.words, hashes)
        order = np.argsort(codes, kind="stable")
        phrases, codes = phrases.some(order), codes[order]
        yield length, phrases, codes
        if 1 < length < longest:
            which = frequent.of(length, codes)
            phrases, known = phrases.some(which), codes[which]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    return known[np.minimum(at, len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def bucket_cuts(codes: np.ndarray, buckets: int) -> list[int]:
    """Ends of the buckets of sorted hashes; buckets are equal ranges of hashes."""
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
    return [*np.searchsorted(codes, edges).tolist(), len(codes)]


class Masks:
    """Which of a shard's phrases are frequent, by length and bucket, as bits in the order of their hashes."""

    def __init__(self, rows: list[dict], buckets: dict[int, int]):
        self.bits = {(r["level"], r["bucket"]): r["bits"] for r in rows}
        self.buckets = buckets

    def of(self, length: int, codes: np.ndarray) -> np.ndarray:
        out, start = [np.empty(0, bool)], 0
        for bucket, end in enumerate(bucket_cuts(codes, self.buckets[length])):
            if end > start:
                bits = np.frombuffer(self.bits[length, bucket], np.uint8)
                out.append(np.unpackbits(bits, count=end - start).astype(bool))
            start = end
        return np.concatenate(out)


# --- shards -----------------------------------------------------------------


def _tokens(texts: list[str], closed: bool) -> list[bytes]:
    """Words of texts, lower-cased, with ``.`` between pieces, and at the end if ``closed``."""
    return " .".join([*texts, ""] if closed else texts).encode().translate(_FOLD).replace(b".", b" . ").split(b" ")


class Shard:
    """Word ids of the documents of a shard, while they are gathered."""

    def __init__(self):
        self.ids: dict[str, dict[bytes, int]] = {}
        self.names: list[bytes] = [b""]
        self.langs: list[str] = [""]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, texts: list[str], closed: bool = True) -> None:
        """Add texts of a language; without ``closed`` the last one goes on in the next call."""
        ids = self.ids.setdefault(lang, {b".": 0, b"": -1})
        found = _tokens(texts, closed)
        new = sorted(set(found).difference(ids))
        ids.update(zip(new, range(len(self.names), len(self.names) + len(new))))
        self.names += new
        self.langs += [lang] * len(new)
        numbers = np.fromiter(map(ids.__getitem__, found), np.int32, len(found))
        numbers = numbers[numbers >= 0]
        ends = numbers == 0
        ends[1:] &= numbers[:-1] != 0  # pieces without words leave no marks
        self.parts.append(numbers[ends | (numbers > 0)])
        self.size += len(self.parts[-1])

    def packed(self) -> bytes:
        text = np.concatenate([np.zeros(1, np.int32), *self.parts])
        spoken = {g: i for i, g in enumerate(dict.fromkeys(self.langs))}
        lang_of = np.array([spoken[g] for g in self.langs], np.int32)
        parts = [text.tobytes(), lang_of.tobytes(), b"\n".join(self.names), json.dumps(list(spoken)).encode()]
        packed = [pa.compress(p, codec="zstd", asbytes=True) if p else b"" for p in parts]
        return np.array([x for p in zip(parts, packed) for x in map(len, p)], "<i8").tobytes() + b"".join(packed)

    def totals(self) -> dict[str, int]:
        """Occurrences of words by language."""
        counts = np.bincount(np.concatenate(self.parts), minlength=len(self.names))
        out: dict[str, int] = {}
        for lang, ids in self.ids.items():
            out[lang] = int(counts[[i for i in ids.values() if i > 0]].sum())
        return out


def unpacked(data: bytes, depth: int) -> tuple[Index, np.ndarray, pa.Array, pa.Array]:
    """The index, and the hashes, languages and texts of its words."""
    sizes = np.frombuffer(data, "<i8", 8).reshape(4, 2)
    ends = (8 * 8 + np.concatenate([[0], np.cumsum(sizes[:, 1])])).tolist()
    text, lang_of, names, spoken = [
        pa.decompress(data[a:b], int(size), codec="zstd", asbytes=True) if size else b""
        for a, b, size in zip(ends, ends[1:], sizes[:, 0])
    ]
    words, langs = names.split(b"\n"), json.loads(spoken)
    seeds = [xxhash.xxh32_intdigest(g) for g in langs]
    of = np.frombuffer(lang_of, np.int32)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seeds[g]) for w, g in zip(words, of.tolist())), np.uint64, len(words))
    index = Index.of(np.frombuffer(text, np.int32), len(words), depth)
    return index, hashes, pa.array(langs, pa.string()).take(pa.array(of)), pa.array(words, pa.binary()).cast(pa.string())


def _shards(df: DataFrame, settings: Settings, text_col: str, lang_col: str) -> DataFrame:
    """``shard, index, langs, totals``: the packed ids of every shard and its words by language, written once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, shard = TaskContext.get().partitionId(), 0, Shard()

        def done():
            nonlocal n, shard
            totals = shard.totals()
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + n]),
                    pa.array([shard.packed()], pa.binary()),
                    pa.array([list(totals)], pa.list_(pa.string())),
                    pa.array([list(totals.values())], pa.list_(pa.int64())),
                ],
                ["shard", "index", "langs", "totals"],
            )
            n, shard = n + 1, Shard()
            return row

        for lang, texts, closed in _runs(batches):
            shard.add(lang, texts, closed)
            if closed and shard.size >= settings.shard_words:
                yield done()
        if shard.size:
            yield done()

    lang = F.coalesce(df[lang_col].cast("string"), F.lit(UNKNOWN)).alias("lang")
    texts = df.select(lang, F.coalesce(df[text_col], F.lit("")).alias("text"))
    return materialise(texts.mapInArrow(rows, "shard long, index binary, langs array<string>, totals array<long>"))


def _runs(batches: Iterable[pa.RecordBatch], most: int = BATCH_CHARS) -> Iterator[tuple[str, list[str], bool]]:
    """(language, texts, closed) of bounded length; a longer text comes in parts cut between words, the last of them closed."""
    for batch in batches:
        held: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            text = text.as_py()
            at = 0
            while len(text) - at > most and (cut := _BETWEEN.search(text, at + most)):
                yield lang, [text[at : cut.end()]], False
                at = cut.end()
            if at:
                yield lang, [text[at:]], True
                continue
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] >= most:
                yield lang, held.pop(lang), True
                del sizes[lang]
        for lang, texts in held.items():
            yield lang, texts, True


# --- exchange of hashes -----------------------------------------------------


def _bytes(array: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(array, kind).tobytes()


def _exchange(shards: DataFrame, levels: list[int], known: DataFrame | None, buckets: dict[int, int], settings: Settings) -> DataFrame:
    """``shard, level, bucket, bits``: which of each shard's phrases of ``levels`` words are frequent over all shards.

    Counts above the least are sent as it, and hashes are dealt out evenly by
    their upper bits, so the work does not depend on how often a phrase occurs.
    ``buckets`` gets the number of buckets of the levels.
    """
    least, longest = settings.least, max(levels)
    kind = np.dtype("u1") if least < 256 else np.dtype("<u4")
    indexed, before = _with_known(shards, known), dict(buckets)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, index, hashes, _, _, frequent in _opened(batches, before, settings):
            for length, phrases, codes in by_length(index, hashes, longest, frequent):
                if length not in levels:
                    continue
                low = codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
                counts, start = np.minimum(phrases.counts, least).astype(kind), 0
                for bucket, end in enumerate(bucket_cuts(codes, parts)):
                    if end > start:
                        sent = [shard, length, bucket, low[start:end].tobytes(), counts[start:end].tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sent], ["shard", "level", "bucket", "codes", "counts"])
                    start = end

    def summed(table: pa.Table) -> pa.Table:
        counts = [np.frombuffer(x.as_py(), kind) for x in table.column("counts")]
        codes = np.zeros((sum(map(len, counts)), 8), np.uint8)
        codes[:, :HASH_BYTES] = np.frombuffer(b"".join(x.as_py() for x in table.column("codes")), np.uint8).reshape(-1, HASH_BYTES)
        unique, of = np.unique(codes.view("<u8").ravel(), return_inverse=True)
        good = (np.bincount(of, np.concatenate(counts), len(unique)) >= least)[of]
        ends = np.cumsum([len(c) for c in counts])
        bits = [np.packbits(good[e - len(c) : e]).tobytes() for c, e in zip(counts, ends)]
        return table.select(["shard", "level", "bucket"]).append_column("bits", pa.array(bits, pa.binary()))

    own = F.aggregate("totals", F.lit(0).cast("long"), lambda total, x: total + x)
    words = shards.agg(F.coalesce(F.sum(own), F.lit(0))).first()[0]  # no fewer than distinct phrases of a length
    parts = max(1, -(-words // settings.hashes_per_task))
    buckets.update({length: parts for length in levels})
    rows = indexed.mapInArrow(dealt, "shard long, level long, bucket long, codes binary, counts binary")
    replies = rows.groupBy("bucket").applyInArrow(summed, "shard long, level long, bucket long, bits binary")
    return materialise(replies)


def _opened(batches: Iterator[pa.RecordBatch], buckets: dict[int, int], settings: Settings):
    """(shard, index, hashes, languages and texts of its words, masks) of rows ``shard, index, known``."""
    for batch in batches:
        for i in range(batch.num_rows):
            frequent = Masks(batch.column("known")[i].as_py() or [], buckets)
            data = batch.column("index")[i].as_buffer().to_pybytes()
            yield batch.column("shard")[i].as_py(), *unpacked(data, settings.longest - 1), frequent


def _with_known(shards: DataFrame, replies: DataFrame | None) -> DataFrame:
    """The shards with the replies to them; those are a bit for each of a shard's phrases."""
    rows = shards.select("shard", "index")
    if replies is None:
        return rows.withColumn("known", F.lit(None).cast("array<struct<level:long,bucket:long,bits:binary>>"))
    known = replies.groupBy("shard").agg(F.collect_list(F.struct("level", "bucket", "bits")).alias("known"))
    return rows.join(known, "shard", "left")


def phrase_counts(df: DataFrame, settings: Settings = Settings(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, words, phrase, f`` of every phrase of up to ``longest`` words that occurs ``least`` times or more.

    Counts are over whole texts of all rows, within pieces, by language (null:
    ``und``). Null and empty texts have no words, repeated rows count each time,
    an empty table gives no rows, and other columns are not read.
    """
    return _counts(_shards(df, settings, text_col, lang_col), settings).filter(F.col("f") >= settings.least)


def _counts(shards: DataFrame, settings: Settings) -> DataFrame:
    buckets: dict[int, int] = {}
    known = _exchange(shards, [1, 2], None, buckets, settings)
    for length in range(3, settings.longest + 1):
        known = known.unionByName(_exchange(shards, [length], known, buckets, settings))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, index, hashes, langs, texts, frequent in _opened(batches, buckets, settings):
            for length, phrases, codes in by_length(index, hashes, settings.longest, frequent):
                phrases = phrases.some(frequent.of(length, codes))
                for first in range(0, len(phrases.counts), 50_000):
                    words = phrases.words[first : first + 50_000]
                    spelt = [texts.take(pa.array(column)) for column in words.T]
                    yield pa.RecordBatch.from_arrays(
                        [
                            langs.take(pa.array(words[:, 0])),
                            pa.array(np.full(len(words), length, np.int32)),
                            pc.binary_join_element_wise(*spelt, " "),
                            pa.array(phrases.counts[first : first + 50_000].astype(np.int64)),
                        ],
                        ["lang", "words", "phrase", "f"],
                    )

    counted = _with_known(shards, known).mapInArrow(rows, "lang string, words int, phrase string, f long")
    return counted.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def _word_totals(shards: DataFrame) -> DataFrame:
    """``lang, n``: occurrences of words."""
    each = shards.select(F.explode(F.arrays_zip("langs", "totals")).alias("x"))
    return each.groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.totals").alias("n"))


# --- collocations -----------------------------------------------------------


def _part(start: int, end: int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), start + 1, end - start), " ")


def _scored(counts: DataFrame, length: int) -> DataFrame:
    """Candidates of a length with the counts of the parts at their lowest cut and the score there."""
    rows = counts.filter(F.col("words") == length).select("lang", "phrase", F.col("f").alias("a"))
    parts = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias("_f"))
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = []
    for k in range(1, length):
        for name, part in ((f"l{k}", _part(0, k)), (f"r{k}", _part(k, length))):
            own = parts.withColumnRenamed("_f", name)
            rows = rows.withColumn("_own", part)
            rows = rows.join(own, (F.col("lang") == F.col("_lang")) & (F.col("_own") == F.col("_part"))).drop("_lang", "_part", "_own")
        score = F.expr(
            f"(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) "
            f"div (cast(l{k} as decimal(18,0)) * cast(r{k} as decimal(18,0)))"
        )
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    lowest = F.array_min(F.array(*cuts))
    return rows.select("lang", "phrase", "a", lowest["l"].alias("l"), lowest["r"].alias("r"), lowest["score"].alias("score"))


def _inside(counts: DataFrame, longest: int) -> DataFrame:
    """``lang, phrase, _longer``: parts of candidates, with the largest count of a longer candidate that holds them."""
    spans = [(n, i, j) for n in range(3, longest + 1) for i in range(n) for j in range(i + 2, n + 1) if j - i < n]
    longer = counts.filter(F.col("words") > 2)
    pieces = F.array_compact(F.array(*[F.when(F.col("words") == n, _part(i, j)) for n, i, j in spans]))
    held = longer.select("lang", F.explode(pieces).alias("phrase"), "f")
    return held.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))


def _first(rows: DataFrame, order: list[Column], first: int, groups: int) -> DataFrame:
    """The first rows of each language, through two rounds of smaller groups, so that no language meets in one task whole."""
    for salts in (groups, min(16, groups)):
        salt = F.pmod(F.xxhash64("phrase", F.lit(salts)), F.lit(salts))
        place = F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))
        rows = rows.withColumn("_salt", salt).withColumn("_place", place).filter(F.col("_place") <= first)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return rows.drop("_salt", "_place").withColumn("rank", place).filter(F.col("rank") <= first)


def collocations(
    df: DataFrame, settings: Settings = Settings(), text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first phrases of each language by score.

    Candidates are phrases of 2 to ``longest`` words that occur ``least`` times
    or more. A phrase scores floor(1000000 a a / (l r)) at its lowest cut into a
    first part and a rest, the first such cut; one inside a longer candidate of
    at least ``inside_percent`` of its count is dropped. Ranked by score, count
    and phrase. Arithmetic is exact for counts below 10^15. Null languages are ``und``; null and empty
    texts have no words, repeated rows count each time, an empty table gives no
    rows, and other columns, whatever their names, are not read.
    """
    shards = _shards(df, settings, text_col, lang_col)
    counts = materialise(_counts(shards, settings).filter(F.col("f") >= settings.least))
    scored = _scored(counts, 2)
    for length in range(3, settings.longest + 1):
        scored = scored.unionByName(_scored(counts, length))
    if settings.longest > 2:
        inside = _inside(counts, settings.longest)
        scored = scored.join(inside, ["lang", "phrase"], "left")
        scored = scored.filter(
            F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * settings.inside_percent)
        ).drop("_longer")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = _first(scored, order, settings.first, slices(df.sparkSession))
    return best.join(_word_totals(shards), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

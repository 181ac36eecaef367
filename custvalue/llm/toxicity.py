"""Toxicity by subword-bag embeddings, averaged into a linear softmax and trained jointly.

A word is the bag of itself and its character n-grams, each with a vector in a
hashed table, so a misspelling shares most of a known word's vectors. The word's
own vector has a share of its own beside the average of its n-grams: a word seen
in toxic documents only counts in full although its syllables are common. A long
run without spaces is cut into consecutive words, so that all of it counts. A
window is a short run of a document's words; it is their average (short windows
are filled up with empty words), a linear layer and a softmax of two classes give
its score, and a document scores as its most toxic window does. So a few words
decide in a long document as they do in a short one.

Training has two steps, both in numpy on a bounded sample of labelled
documents: first on averages of whole documents, which finds the vectors that
tell the classes apart; then on windows, where a toxic document is represented
by its highest window and a clean one by its highest two and another. The words
of the sample are numbered as they are read and held as numbers; what the fit
takes besides is cut into parts of bounded size.
"""

from __future__ import annotations

import math
import re
import string
import unicodedata
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custvalue.llm.kept import last_used, releasing
from custvalue.llm.labelled import sample_per_class

KNOWN_WORDS = 150_000
TEXTS_PER_ID = 8  # distinct texts of a repeated id that the fit reads
EDGES = string.punctuation + "«»“”„‘’…–—·¡¿"
LONG_RUN, CHUNK, OVERLAP = 40, 8, 4  # characters; n-grams of up to ``OVERLAP + 1`` are whole in a chunk
_SIGNS = re.escape(EDGES + "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c)[0] == "P"))
_PART = re.compile(f"[^{_SIGNS}]+|[{_SIGNS}]+")


@dataclass(frozen=True)
class Settings:
    """Shape of the model, and the bounds of the sample it is fitted on: documents of each class (in each step), and characters of all."""

    per_class: int = 4000
    document_sample: int = 1000
    most_chars: int = 60_000_000
    buckets: int = 1 << 20
    dim: int = 4
    shortest: int = 3
    longest: int = 5
    own: float = 1.5
    window: int = 2
    document_epochs: int = 2
    window_rounds: int = 12
    windows_seen: int = 60_000
    most_rounds: int = 40
    toxic_weight: float = 3.0
    rate: float = 0.15
    damping: float = 0.01
    layer_rate: float = 1.0
    seed: int = 11


def words(text: str | None) -> list[str]:
    """The text between white space, with runs of over ``LONG_RUN`` characters cut into words (see ``_cut_run``)."""
    found = (text or "").lower().split()
    if max(map(len, found), default=0) <= LONG_RUN:
        return found
    return [w for run in found for w in ((run,) if len(run) <= LONG_RUN else _cut_run(run))]


def _cut_run(run: str) -> Iterator[str]:
    """A run cut at its signs; parts that are still long are cut into chunks, which overlap so that no n-gram is lost."""
    for part in _PART.findall(run):
        bare = part.strip(EDGES)
        if len(bare) > LONG_RUN:
            for at in range(0, len(bare) - OVERLAP, CHUNK - OVERLAP):
                yield bare[at : at + CHUNK]
        elif bare:
            yield bare


def subwords(found: Sequence[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for words without the signs around them, and the place of each row's word.

    A word's rows are those of the word itself and of its character n-grams,
    marked at both ends, with the word's own row last; a word of signs alone has
    none. All words are hashed at once, character by character.
    """
    bare = [w.strip(EDGES) for w in found]
    points = np.frombuffer("".join(f"<{w}>" for w in bare).encode("utf-32-le", "replace"), "<u4").astype(np.uint32)
    sizes = np.array([len(w) + 2 for w in bare], np.int64)
    word = np.repeat(np.arange(len(bare)), sizes)
    inside = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def mixed(code: np.ndarray) -> np.ndarray:
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        code = (code ^ (code >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (code ^ (code >> np.uint32(16))) % np.uint32(settings.buckets)

    rows, places = [], []
    code = np.zeros(len(points), np.uint32)
    for n in range(1, settings.longest + 1):
        code = code[: len(points) - n + 1] * np.uint32(0x9E3779B1) + points[n - 1 :] + np.uint32(n)
        if n >= settings.shortest:
            whole = word[: len(code)] == word[n - 1 :]
            rows.append(mixed(code)[whole])
            places.append(word[: len(code)][whole])
    powers = np.cumprod(np.full(sizes.max(initial=2), 0x01000193, np.uint32), dtype=np.uint32)
    full = np.bincount(word, (points * powers[inside]).astype(np.float64), len(bare)).astype(np.uint64)
    named = sizes > 2
    rows.append(mixed((full & np.uint64(0xFFFFFFFF)).astype(np.uint32))[named])
    places.append(np.flatnonzero(named))
    places = np.concatenate(places)
    order = np.argsort(places, kind="stable")
    return np.concatenate(rows).astype(np.int32)[order], places[order]


def shares(counts: np.ndarray, own: float) -> np.ndarray:
    """Share of each row in its word, for words of so many rows: ``own`` for the last, the others share 1."""
    out = np.repeat(1 / np.maximum(counts - 1, 1), counts)
    out[np.cumsum(counts)[counts > 0] - 1] = own
    return out


def windows_of(n: int, window: int) -> np.ndarray:
    """Starts of nearly equal windows of at most ``window`` words, and the end."""
    parts = max(1, -(-n // window))
    return np.arange(parts + 1) * n // parts


def _numbered(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of all texts as numbers, the number of words of each text, and the words by number, in order of appearance."""
    coded, sizes = [], [np.empty(0, np.int64)]
    for some in batched(texts, 200):
        found = pa.array([words(t) for t in some], pa.list_(pa.string()))
        sizes.append(found.value_lengths().to_numpy().astype(np.int64))
        coded.append(found.flatten().dictionary_encode())
    kind = pa.dictionary(pa.int32(), pa.string())
    one = pa.chunked_array(coded, kind).unify_dictionaries()
    numbers = [np.empty(0, np.int32), *(c.indices.to_numpy() for c in one.chunks)]
    named = one.chunk(0).dictionary if one.num_chunks else pa.array([], pa.string())
    return np.concatenate(numbers), np.concatenate(sizes), named


class Bags:
    """Documents as word numbers, one after the other; words as rows of the table; windows as runs of words."""

    def __init__(self, texts: Iterable[str | None], settings: Settings):
        self.words, self.sizes, named = _numbered(texts)
        self.settings = settings
        self.first = np.cumsum(self.sizes) - self.sizes
        parts, counts = [], [np.zeros(1, np.int64)]
        for at in range(0, len(named), 5_000):
            some = named.slice(at, 5_000).to_pylist()
            rows, places = subwords(some, settings)
            parts.append(rows)
            counts.append(np.bincount(places, minlength=len(some)))
        self.starts = np.cumsum(np.concatenate(counts))
        self.rows, filled = np.empty(self.starts[-1], np.int32), 0
        for rows in _popped(parts):
            self.rows[filled : filled + len(rows)] = rows
            filled += len(rows)
        self.windows = np.maximum(1, -(-self.sizes // settings.window))  # of each document, see ``windows_of``
        self.edges, filled = np.empty(self.windows.sum(), np.int32), 0
        for n, at in zip(self.sizes.tolist(), self.first):
            cuts = windows_of(n, settings.window)[:-1]
            self.edges[filled : filled + len(cuts)] = cuts + at
            filled += len(cuts)

    @property
    def ends(self) -> np.ndarray:
        return np.append(self.edges[1:], np.int32(len(self.words))) if len(self.edges) else self.edges

    def document(self, i: int) -> np.ndarray:
        return self.words[self.first[i] : self.first[i] + self.sizes[i]]

    def features(self, bag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Table rows of the words of a bag, each with its share of its word, and the rows of each word."""
        counts = self.starts[bag + 1] - self.starts[bag]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[bag] - ends + counts, counts)
        return self.rows[at], shares(counts, self.settings.own), counts

    def values(self, weights: np.ndarray) -> np.ndarray:
        """What each word adds to a window, by one weight for each row of the table."""
        out = [np.empty(0)]
        for at in range(0, len(self.starts) - 1, 10_000):
            some = np.arange(at, min(at + 10_000, len(self.starts) - 1))
            rows, share, counts = self.features(some)
            out.append(np.bincount(np.repeat(np.arange(len(some)), counts), share * weights[rows], len(some)))
        return np.concatenate(out)

    def window_sums(self, weights: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(self.words) + 1)
        np.take(self.values(weights), self.words, out=sums[1:], mode="clip")  # no copy, as the numbers are in range
        np.cumsum(sums, out=sums)
        found = sums[self.ends]
        found -= sums[self.edges]
        return found


def _popped(parts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The parts in order, each let go before the next."""
    parts.reverse()
    while parts:
        yield parts.pop()


def _folded(table: np.ndarray, layer: np.ndarray) -> np.ndarray:
    """One weight per row of the table, in double precision, without a copy of the whole table in it."""
    difference, out = layer[:, 1] - layer[:, 0], np.empty(len(table))
    for at in range(0, len(table), 1 << 16):
        out[at : at + (1 << 16)] = table[at : at + (1 << 16)] @ difference
    return out


@dataclass
class Model:
    """The fitted vectors; ``weights`` folds table and linear layer into one number per row."""

    settings: Settings
    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    weights: np.ndarray = field(init=False)

    def __post_init__(self):
        self.weights = _folded(self.table, self.layer).astype(np.float32)

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def _train(model: Model, bags: Bags, chosen: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, epochs: int, even: bool, rng, seen) -> None:
    """Gradient steps on batches of bags; table and layer move together. ``even`` weights the classes equally.

    Steps on rows of the table shrink with the slopes a row has seen, as in
    adaptive gradient descent, but ``damping`` keeps rare rows from moving as
    far as frequent ones: a subword counts by how often it helps.
    """
    settings = model.settings
    size = 128 if not even else 32  # whole documents are large bags
    share = np.bincount(labels, minlength=2)
    weight = (len(labels) / 2 / np.maximum(share, 1))[labels] if even else np.where(labels == 1, settings.toxic_weight, 1.0)
    place = np.empty(settings.buckets, np.int32)  # of a row among the used ones of a batch
    for _ in range(epochs):
        order = rng.permutation(len(chosen))
        for first in range(0, len(order), size):
            batch = order[first : first + size]
            rows, part, counts = bags.features(np.concatenate([chosen[i] for i in batch]))
            of = np.repeat(np.repeat(np.arange(len(batch)), [len(chosen[i]) for i in batch]), counts)
            part /= sizes[batch][of]
            hidden = np.stack([np.bincount(of, part * v[rows], len(batch)) for v in model.table.T], axis=1)
            logits = hidden @ model.layer + model.bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (p - np.eye(2)[labels[batch]]) * weight[batch][:, None] / len(batch)
            back = error @ model.layer.T
            used = np.unique(rows)
            place[used] = np.arange(len(used), dtype=np.int32)
            where = place[rows]
            slope = np.stack([np.bincount(where, part * b[of], len(used)) for b in back.T], axis=1)
            slope *= len(batch)
            seen[used] += slope * slope
            model.table[used] -= settings.rate * slope / (np.sqrt(seen[used]) + settings.damping)
            model.layer -= settings.layer_rate * hidden.T @ error
            model.bias -= settings.layer_rate * error.sum(axis=0)


def _chosen(sums: np.ndarray, bags: Bags, y: np.ndarray, rng) -> np.ndarray:
    """Windows to train on: the highest of each document, and of a clean one the second and another."""
    begins = np.cumsum(bags.windows) - bags.windows
    others = begins + rng.integers(bags.windows)
    taken = [others[y == 0]]
    for first, n, label in zip(begins.tolist(), bags.windows.tolist(), y.tolist()):
        own = sums[first : first + n]
        highest = own.argmax()
        taken.append([first + highest])
        if n > 1 and label == 0:
            own[highest] = -np.inf
            taken.append([first + own.argmax()])
    return np.unique(np.concatenate(taken))


def fit(texts: Iterable[str | None], labels: list[int], settings: Settings = Settings()) -> Model:
    """Fit on the given documents; label 1 is toxic. Without both classes every score is the one seen (or 0)."""
    rng = np.random.default_rng(settings.seed)
    table = np.zeros((settings.buckets, settings.dim), np.float32)
    layer = rng.normal(0, 1 / np.sqrt(settings.dim), (settings.dim, 2))
    model = Model(settings, table, layer, np.zeros(2))
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        model.bias = np.array([0.0, 20.0]) if 1 in labels else np.array([20.0, 0.0])
        return model
    bags = Bags(texts, settings)
    seen = np.zeros_like(table)
    some = np.concatenate([rng.permutation(np.flatnonzero(y == c))[: settings.document_sample] for c in (0, 1)])
    lengths = np.maximum(bags.sizes[some], settings.window).astype(float)
    _train(model, bags, [bags.document(i) for i in some], lengths, y[some], settings.document_epochs, True, rng, seen)
    begins = np.cumsum(bags.windows) - bags.windows
    rounds = used = 0
    while rounds < settings.window_rounds or (used < settings.windows_seen and rounds < settings.most_rounds):
        chosen = _chosen(bags.window_sums(_folded(model.table, model.layer)), bags, y, rng)
        rounds, used = rounds + 1, used + len(chosen)
        bag = [bags.words[a:b] for a, b in zip(bags.edges[chosen], bags.ends[chosen])]
        of = np.searchsorted(begins, chosen, "right") - 1  # the documents of the windows
        _train(model, bags, bag, np.full(len(chosen), float(settings.window)), y[of], 1, False, rng, seen)
    fitted = Model(settings, model.table, model.layer, model.bias)
    highest = np.maximum.reduceat(bags.window_sums(fitted.weights), begins)
    fitted.bias[1] -= _cut(highest / settings.window + fitted.offset, y)
    return fitted


def _cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """Where to cut the sample's logits.

    The lowest cut with the smallest sum of both error rates, moved half of the
    way down to the 99.9th percentile of the clean documents if that is lower:
    fitted toxic documents score higher than new ones, whose words the fit has
    not seen.
    """
    order = np.argsort(logits, kind="stable")
    z, toxic = logits[order], labels[order] == 1
    missed = np.concatenate([[0], np.cumsum(toxic)]) / max(1, toxic.sum())
    raised = np.concatenate([[0], np.cumsum(~toxic)]) / max(1, (~toxic).sum())
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    lowest = edges[np.argmin(missed + 1 - raised)]
    return float((lowest + min(lowest, np.quantile(z[~toxic], 0.999))) / 2)


class Scorer:
    """Scores of texts; the values of words met before are kept in a bounded table."""

    def __init__(self, weights: np.ndarray, offset: float, settings: Settings):
        self.weights, self.offset, self.settings = weights, offset, settings
        self.known: dict[str, float] = {}

    def _learn(self, new: list[str]) -> None:
        rows, places = subwords(new, self.settings)
        share = shares(np.bincount(places, minlength=len(new)), self.settings.own)
        self.known.update(zip(new, np.bincount(places, share * self.weights[rows], len(new)).tolist()))

    def logits(self, texts: Sequence[str | None]) -> list[float]:
        found = [words(t) for t in texts]
        new = set().union(*found).difference(self.known)
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            new = set().union(*found)
        new = sorted(new)
        for first in range(0, len(new), 20_000):
            self._learn(new[first : first + 20_000])
        value, out = self.known.__getitem__, []
        for text in found:
            values = np.fromiter(map(value, text), np.float64, len(text))
            top = np.add.reduceat(values, windows_of(len(text), self.settings.window)[:-1]).max() if text else 0.0
            out.append(float(top) / self.settings.window + self.offset)
        return out

    def scores(self, texts: Sequence[str | None]) -> list[float]:
        """The highest softmax score of a window of each text; one without words scores as an empty window."""
        return [1 / (1 + math.exp(-max(-40.0, min(40.0, z)))) for z in self.logits(texts)]


def fit_on(df: DataFrame, labels: DataFrame, settings: Settings, id_col: str, text_col: str) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class, chosen by a hash of the id.

    ``labels`` has ``doc_id`` and ``label`` (0 or 1); null labels are ignored, a
    document labelled twice counts as toxic if either says so. The chosen ids
    are few, whatever the tables hold, so the documents are not shuffled. Of an
    id's distinct texts at most ``TEXTS_PER_ID`` are read, and ``4 * per_class``
    of all ids, those of the least hashes; every id's first comes before any
    second. Of those, texts are read in that order as long as they have no more
    than ``most_chars`` characters in all, so the driver's memory is bounded.
    """
    spark = df.sparkSession
    one = labels.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = sample_per_class(one, "label", "doc_id", settings.per_class)
    ids = spark.createDataFrame([(r["doc_id"], int(r["label"])) for r in picked], "_id long, label int")
    texts = df.select(df[id_col].cast("long").alias("_id"), df[text_col].alias("text"))
    found = texts.join(F.broadcast(ids), "_id").withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    place = F.row_number().over(Window.partitionBy("_id").orderBy("_hash"))
    size = F.coalesce(F.length("text"), F.lit(0)).alias("_size")
    several = found.select("_id", "_hash", size).distinct().withColumn("_place", place).filter(F.col("_place") <= TEXTS_PER_ID)
    chosen = several.orderBy("_place", "_hash", "_id").limit(4 * settings.per_class).select("_id", "_hash", "_size").collect()
    fits = np.cumsum([r["_size"] for r in chosen]) <= settings.most_chars
    keys = spark.createDataFrame([(r["_id"], r["_hash"]) for r, good in zip(chosen, fits) if good], "_id long, _hash long")
    rows = found.join(F.broadcast(keys), ["_id", "_hash"]).select(F.coalesce("text", F.lit("")).alias("text"), "label")
    sample = rows.distinct().toArrow().sort_by([("text", "ascending"), ("label", "ascending")])
    y, texts = sample.column("label").to_pylist(), _texts(sample.column("text"))
    del sample  # the texts go when they are read
    model = fit(texts, y, settings)
    pa.default_memory_pool().release_unused()
    return model


def _texts(column: pa.ChunkedArray) -> Iterator[str]:
    for t in column:
        yield t.as_py()


def score_documents(
    df: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, score`` (0 to 1) of every row, by a model fitted on ``labels`` (see ``fit_on``).

    Whole texts are scored, from nothing but the text. Null and empty texts
    score as an empty window. Rows with a null or repeated id are kept, an empty
    table gives no rows, and other columns, whatever their names, are not read.
    """
    score = _scoring(df.sparkSession, fit_on(df, labels, settings, id_col, text_col))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(score(batch.column("text")), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "score"])

    texts = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return texts.mapInArrow(releasing(rows), "doc_id long, score double")


def drop_toxic(
    df: DataFrame,
    labels: DataFrame,
    threshold: float = 0.5,
    settings: Settings = Settings(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text scores below ``threshold``."""
    score = _scoring(df.sparkSession, fit_on(df, labels, settings, id_col, text_col))
    place = df.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s in score(batch.column(place))], pa.bool_()))

    return df.mapInArrow(releasing(rows), df.schema)


def _scoring(spark, model: Model):
    """A function of a column of texts for tasks; a Python process keeps the scorer, and so its table of words, between batches and tasks."""
    shared = spark.sparkContext.broadcast((model.weights, model.offset, model.settings))
    name = zlib.crc32(model.weights.tobytes() + repr((model.offset, model.settings)).encode())

    def score(texts: pa.Array) -> list[float]:
        scorer, out = last_used(("toxicity", name), lambda: Scorer(*shared.value)), []
        for first in range(0, len(texts), 200):
            out += scorer.scores([t.as_py() for t in texts.slice(first, 200)])
        return out

    return score

"""Language identification by string kernels with Nyström landmarks and kernel ridge regression.

Two texts are compared by the n-grams that they share: the kernel counts the
distinct character n-grams of lengths 1 to 3 present in both (blended spectrum),
divided by the root of the product of their own counts. A bounded sample of
labelled texts gives landmarks; kernel values to the landmarks, whitened by the
landmarks' own kernel matrix, are the Nyström features of a text, and one ridge
regression per language separates that language from the rest.

A text's kernel row is its presence vector times the landmarks' presence matrix,
so landmarks, whitening and regressions fold into one matrix, and a batch of
texts is scored by one matrix product.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.llm.kept import releasing
from custvalue.llm.labelled import sample_per_class

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Sizes of the model: texts and landmarks per language bound the sample; n-grams are hashed to ``bits`` bits."""

    per_language: int = 400
    landmarks: int = 64
    longest: int = 3
    bits: int = 18
    ridge: float = 1e-3
    sharpness: float = 4.0
    batch: int = 64


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str | None, settings: Settings) -> np.ndarray:
    """Numbers of the distinct n-grams of a text's lower-cased letters; other characters are one space."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    letters = _letters()[points]
    if not letters.any():
        return np.empty(0, np.int64)
    points = np.concatenate([[32], np.where(letters, points, 32), [32]]).astype(np.uint32)
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
    present = np.zeros(1 << settings.bits, bool)
    code = np.zeros(len(points), np.uint32)
    for n in range(1, settings.longest + 1):
        if len(points) < n:
            break
        code = code[: len(points) - n + 1] * np.uint32(0x9E3779B1) + points[n - 1 :] + np.uint32(n)
        mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        present[mixed >> np.uint32(32 - settings.bits)] = True
    return np.flatnonzero(present)


@dataclass
class Model:
    """Languages, the columns of the hashed n-grams that landmarks hold, and the folded matrix."""

    settings: Settings
    languages: list[str]
    columns: np.ndarray
    matrix: np.ndarray

    def outputs(self, found: Sequence[np.ndarray]) -> np.ndarray:
        """One regression output per text and language, of texts given by their n-grams."""
        present = np.zeros((len(found), len(self.matrix)), np.float32)
        for i, g in enumerate(found):
            at = self.columns[g]
            present[i, at[at >= 0]] = 1
        lengths = np.sqrt([max(1, len(g)) for g in found])
        return present @ self.matrix / lengths[:, None]

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        """Language and score (0 to 1) of each text; ``und`` and 0 without letters or without a learned language."""
        names, scores = [], []
        for first in range(0, len(texts), self.settings.batch):
            found = [grams(t, self.settings) for t in texts[first : first + self.settings.batch]]
            if not self.languages:
                names += [UNKNOWN] * len(found)
                scores += [0.0] * len(found)
                continue
            out = self.outputs(found)
            reach = np.maximum(np.abs(out).max(axis=1, keepdims=True), 1e-9)
            p = np.exp(self.settings.sharpness * out / reach)
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for i, g in enumerate(found):
                names.append(self.languages[best[i]] if len(g) else UNKNOWN)
                scores.append(float(p[i, best[i]]) if len(g) else 0.0)
        return names, scores


def fit(texts: list[str], languages: list[str], settings: Settings = Settings()) -> Model:
    """Fit on labelled texts; the first texts of each language are its landmarks."""
    kept = [(g, y) for t, y in zip(texts, languages) if len(g := grams(t, settings))]
    names = sorted({y for _, y in kept})
    columns = np.full(1 << settings.bits, -1, np.int64)
    if not names:
        return Model(settings, [], columns, np.zeros((0, 0), np.float32))
    chosen = [g for name in names for g in [g for g, y in kept if y == name][: settings.landmarks]]
    used = np.unique(np.concatenate(chosen))
    columns[used] = np.arange(len(used))
    marks = np.zeros((len(used), len(chosen)), np.float32)
    for j, g in enumerate(chosen):
        marks[columns[g], j] = 1 / np.sqrt(len(g))

    def kernel(some: Sequence[np.ndarray]) -> np.ndarray:
        rows = []
        for first in range(0, len(some), 128):
            part = np.zeros((len(some[first : first + 128]), len(used)), np.float32)
            for i, g in enumerate(some[first : first + 128]):
                at = columns[g]
                part[i, at[at >= 0]] = 1 / np.sqrt(len(g))
            rows.append((part @ marks).astype(np.float64))
        return np.concatenate(rows)

    value, vector = np.linalg.eigh(kernel(chosen))
    strong = value > 1e-6 * value.max()
    whiten = vector[:, strong] / np.sqrt(value[strong])
    features = kernel([g for g, _ in kept]) @ whiten
    labels = np.array([y for _, y in kept])
    targets = np.where(labels[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = np.array([(labels == n).sum() for n in names])
    weight = np.sqrt(1 / share[np.searchsorted(names, labels)])[:, None]  # every language counts the same
    x, y = features * weight, targets * weight
    gram = x.T @ x + settings.ridge * np.eye(x.shape[1])
    solved = np.linalg.solve(gram, x.T @ y)
    matrix = (marks.astype(np.float64) @ (whiten @ solved)).astype(np.float32)
    return Model(settings, names, columns, matrix)


def fit_on(df: DataFrame, settings: Settings, key_col: str, text_col: str, lang_col: str) -> Model:
    """Fit on at most ``per_language`` rows of each language, chosen by a hash of the key; null languages are left out."""
    rows = df.select(df[key_col].alias("key"), df[text_col].alias("text"), df[lang_col].cast("string").alias("lang"))
    picked = sample_per_class(rows, "lang", "key", settings.per_language)
    seen, texts, languages = set(), [], []
    for r in picked:
        if (r["text"], r["lang"]) not in seen:
            seen.add((r["text"], r["lang"]))
            texts.append(r["text"] or "")
            languages.append(r["lang"])
    return fit(texts, languages, settings)


def predict_languages(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from nothing but its whole text.

    Null and empty texts, and texts without letters, are ``und`` with score 0.
    Rows with a null or repeated id are kept, an empty table gives no rows, and
    other columns, whatever their names, are not read.
    """
    predict = _predicting(df.sparkSession, model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    texts = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return texts.mapInArrow(releasing(rows), "doc_id long, lang_pred string, score double")


def keep_languages(
    df: DataFrame, model: Model, languages: Sequence[str] | None = None, least: float = 0.0, text_col: str = "text"
) -> DataFrame:
    """The rows of ``df``, all columns as they are, in a wanted language (default: any learned one) and sure enough."""
    wanted = set(model.languages if languages is None else languages)
    predict = _predicting(df.sparkSession, model)
    place = df.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(batch.column(place))
            yield batch.filter(pa.array([n in wanted and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return df.mapInArrow(releasing(rows), df.schema)


def _predicting(spark, model: Model):
    """A function of a column of texts for tasks."""
    shared = spark.sparkContext.broadcast(model)

    def predict(column: pa.Array) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for first in range(0, len(column), model_batch):
            texts = [t.as_py() for t in column.slice(first, model_batch)]
            n, s = shared.value.predict(texts)
            names += n
            scores += s
        return names, scores

    model_batch = model.settings.batch
    return predict

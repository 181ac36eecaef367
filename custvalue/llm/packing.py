"""Packing of examples into sequences under several limits at once, by the dot-product heuristic.

An example is a vector: its tokens, one segment, and its loss-bearing tokens.
A sequence has a capacity in each. The sequence being filled takes the example
that fits and whose vector has the largest inner product with the capacity that
is left, both as fractions of the limits. When none fits but tokens and
segments are left, the example of the largest product is cut to fill the room;
its rest goes back to the pool. Examples longer than a sequence are cut first.

Every task packs the rows of its own partition through a pool of bounded size,
so nothing is shuffled and no sequence depends on another task. A task's last,
partly filled sequence is cut into sequences of powers of two, which need no
padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.llm.kept import releasing
from custvalue.llm.tokens import encoded

SCHEMA = (
    "doc_id long, start long, length long, loss_tokens long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, ids binary"
)


@dataclass(frozen=True)
class Limits:
    """Capacity of a sequence, and the tokens that a task's pool holds while it packs."""

    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048
    pool_tokens: int = 400_000
    power_tails: bool = True


@dataclass
class Piece:
    """A run of a document's ids; those from ``prompt`` on (in the document) bear loss."""

    doc: object
    ids: np.ndarray
    start: int
    length: int
    prompt: int

    def loss(self, length: int | None = None) -> int:
        end = self.start + (self.length if length is None else length)
        return max(0, end - max(self.start, self.prompt))

    def longest(self, tokens: int, loss: int) -> int:
        """The longest head within so many tokens and loss-bearing tokens."""
        return min(self.length, tokens, max(0, self.prompt - self.start) + loss)

    def cut(self, at: int) -> tuple[Piece, Piece]:
        tail = Piece(self.doc, self.ids, self.start + at, self.length - at, self.prompt)
        return Piece(self.doc, self.ids, self.start, at, self.prompt), tail


class Pool:
    """Pieces that wait, with their vectors as rows of a matrix."""

    def __init__(self):
        self.pieces: list[Piece | None] = []
        self.sizes = np.empty((0, 3))
        self.used = 0
        self.tokens = 0

    def add(self, piece: Piece) -> None:
        if self.used == len(self.sizes):
            keep = [i for i, p in enumerate(self.pieces) if p is not None]
            rows = self.sizes[keep]
            self.pieces = [self.pieces[i] for i in keep]
            self.sizes = np.zeros((max(64, 2 * len(keep)), 3))
            self.sizes[: len(keep)], self.used = rows, len(keep)
        self.pieces.append(piece)
        self.sizes[self.used] = piece.length, 1, piece.loss()
        self.used += 1
        self.tokens += piece.length

    def take(self, at: int) -> Piece:
        piece, self.pieces[at] = self.pieces[at], None
        self.sizes[at] = 0
        self.tokens -= piece.length
        return piece

    def best(self, left: np.ndarray, limits: np.ndarray, fitting: bool) -> int | None:
        """Row of the largest inner product with the capacity left; the first of equal ones."""
        sizes = self.sizes[: self.used]
        there = sizes[:, 0] > 0
        if fitting:
            for column, room in enumerate(left):
                there &= sizes[:, column] <= room
        rows = np.flatnonzero(there)
        if not len(rows):
            return None
        return int(rows[np.argmax(sizes[rows] @ (left / limits**2))])


def _fill(pool: Pool, limits: Limits) -> list[Piece]:
    """One sequence from the pool."""
    most = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    left, taken = most.copy(), []
    while left[0] >= 1 and left[1] >= 1:
        at = pool.best(left, most, fitting=True)
        if at is None:
            at = pool.best(left, most, fitting=False)
            if at is None:
                break
            head = pool.pieces[at].longest(int(left[0]), int(left[2]))
            if head == 0:
                break
            piece, rest = pool.take(at).cut(head)
            pool.add(rest)
        else:
            piece = pool.take(at)
        taken.append(piece)
        left -= (piece.length, 1, piece.loss())
    return taken


def _powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces of a partly filled sequence in sequences whose lengths are powers of two, the longest first."""
    pieces = pieces[::-1]
    left = sum(p.length for p in pieces)
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        out = []
        while size:
            piece = pieces.pop()
            if piece.length > size:
                piece, rest = piece.cut(size)
                pieces.append(rest)
            out.append(piece)
            size -= piece.length
        yield out


def sequences(examples: Iterable[tuple[object, np.ndarray, int]], limits: Limits) -> Iterator[list[Piece]]:
    """Sequences of the pieces of (document, ids, prompt tokens), through a pool of bounded size."""
    pool = Pool()
    for doc, ids, prompt in examples:
        piece = Piece(doc, ids, 0, len(ids), prompt)
        while piece.length > limits.tokens or piece.loss() > limits.loss_tokens:  # a sequence of its own
            head, piece = piece.cut(piece.longest(limits.tokens, limits.loss_tokens))
            if head.length == limits.tokens:
                yield [head]
            else:
                pool.add(head)
        if piece.length:
            pool.add(piece)
        while pool.tokens > limits.pool_tokens:
            for _ in range(max(1, pool.tokens // (2 * limits.tokens))):
                yield _fill(pool, limits)
    while pool.tokens:
        filled = _fill(pool, limits)
        if limits.power_tails and not pool.tokens and sum(p.length for p in filled) < limits.tokens:
            yield from _powers(filled)
        else:
            yield filled


def pack(
    df: DataFrame,
    tokenizer_path: str,
    limits: Limits = Limits(),
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, loss_tokens, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    A document is its text's ids and ``end_id``; a null or empty text has the
    end id alone. ``prompt_col`` names the number of leading tokens that bear no
    loss (null: none; without it every token bears loss). Pieces of a document
    cover its ids once; those of a sequence are gapless from offset 0. Rows with
    a null or repeated id are documents of their own, an empty table gives no
    rows, and other columns, whatever their names, are not read. ``ids`` are
    little-endian unsigned 32-bit integers, null without ``with_ids``.
    Sequence ids are unique: the partition's number and a count.
    """
    if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
        raise ValueError("every limit must be at least 1")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prompts: list[int] = []

        def noted():
            for batch in batches:
                prompts.extend(batch.column("prompt").to_pylist())
                yield batch

        examples = ((doc, ids, prompts.pop(0)) for doc, ids in encoded(noted(), tokenizer_path, end_id))
        first, out = TaskContext.get().partitionId() << 32, []
        for n, pieces in enumerate(sequences(examples, limits)):
            at = 0
            for p in pieces:
                ids = p.ids[p.start : p.start + p.length].tobytes()
                out.append(
                    (p.doc, p.start, p.length, p.loss(), zlib.crc32(ids), len(p.ids), first + n, at, ids if with_ids else None)
                )
                at += p.length
            if len(out) >= 500:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    prompt = F.lit(0) if prompt_col is None else F.greatest(F.coalesce(df[prompt_col], F.lit(0)), F.lit(0))
    texts = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"), prompt.cast("long").alias("prompt"))
    return texts.mapInArrow(releasing(rows), SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 8 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

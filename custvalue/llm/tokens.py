"""Token ids of whole texts with a tokenizer file, inside tasks.

A tokenizer that splits texts at white space before its merges gives a piece of
text the same ids wherever it stands, if the piece begins with a space before a
visible character. Texts are cut at those spaces; the tokenizer encodes each
distinct piece once, and pieces met before come from a bounded table.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from custvalue.llm.kept import last_used

KNOWN_PIECES = 300_000  # pieces kept in the table; about 200 bytes each
LONGEST_KNOWN = 64  # longer pieces are encoded each time
BATCH_CHARS = 3_000_000  # text encoded at once
LEARNT_WORDS = 1 << 13  # new words whose tokens are held at once
JOINED_PIECES = 1 << 17  # pieces whose ids are put together at once

_CUT = re.compile(r" (?=\S)")
_RUN = re.compile(r"\s\s")
_SIGNS = frozenset(".,;:!?")
_WORD = re.compile(r" ?[^\W\d_]+")
_TOKEN_ID = attrgetter("id")


def _is_word(piece: str) -> bool:
    """Whether a piece is letters alone, perhaps after a space."""
    return (piece[1:] if piece[0] == " " else piece).isalpha()


def pieces(text: str) -> list[str]:
    """The text cut before every space that a visible character follows."""
    if _RUN.search(text):
        first, *rest = _CUT.split(text)
    else:
        first, *rest = text.split(" ")
        if rest and not rest[-1]:  # a space at the end
            rest.pop()
            if rest:
                rest[-1] += " "
            else:
                first += " "
    return [first, *map(" ".__add__, rest)]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PieceTokenizer:
    """Ids by a byte-level tokenizer of the tokenizers library that adds no space before a text.

    A piece of letters alone goes straight to the tokenizer's model, any other
    through the whole tokenizer. A word and what follows it are looked up
    apart, and so are the lines of a piece: the tokenizer splits there too.

    The table numbers the pieces it knows and holds their ids one after the
    other; ``starts`` has where each begins, and the end. Number 0 is no text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.codes = np.array([ord(self.letters[b]) for b in range(256)], "<u2")
        self.known: dict[str, int] = {"": 0}
        self.flat, self.starts = array("I"), array("q", [0, 0])
        self.uses = np.zeros(0, np.int64)  # occurrences of the pieces, by number

    def _shrink(self) -> None:
        """Keep the more used half of a full table."""
        uses = np.zeros(len(self.known), np.int64)
        uses[: len(self.uses)] = self.uses
        uses[0] = np.iinfo(np.int64).max  # no text
        kept = np.sort(np.argsort(-uses, kind="stable")[: KNOWN_PIECES // 2])
        sizes, flat = self._sizes(kept), self._joined(kept)
        names = list(self.known)  # in the order of their numbers
        self.known = {names[i]: n for n, i in enumerate(kept.tolist())}
        self.flat, self.starts = array("I", flat.tobytes()), array("q", [0, *np.cumsum(sizes).tolist()])
        self.uses = uses[kept] // 2
        self.uses[0] = 0

    def _piece(self, piece: str) -> array:
        """Ids of a piece; new ones are added to the table unless they are long."""
        at = self.known.get(piece)
        if at is not None:
            return self.flat[self.starts[at] : self.starts[at + 1]]
        body = piece[1:] if piece[0] == " " else piece
        if body[:-1].isalpha() and body[-1:] in _SIGNS:  # false for a space alone
            found = self._piece(piece[:-1]) + self._piece(piece[-1])
        else:
            found = self._split(piece)
        if len(piece) <= LONGEST_KNOWN:
            self._add(piece, found)
        return found

    def _split(self, piece: str) -> array:
        word = _WORD.match(piece)
        if word and word[0].lstrip(" ").isalpha():
            if word.end() < len(piece):
                return self._piece(word[0]) + self._piece(piece[word.end() :])
            tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
            return array("I", [t.id for t in tokens])
        if "\n" in piece and len(piece) > 1 and not _RUN.search(piece):
            found, line = array("I"), self._piece("\n")
            for i, part in enumerate(piece.split("\n")):
                found += line + self._piece(part) if i else self._piece(part)
            return found
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _add(self, piece: str, ids: array) -> int:
        """The number of a new piece."""
        number = self.known[piece] = len(self.starts) - 1
        self.flat += ids
        self.starts.append(len(self.flat))
        return number

    def _number(self, piece: str) -> int:
        """The number of a piece, which is added if it is new."""
        at = self.known.get(piece)
        if at is None:
            ids = self._piece(piece)
            at = self.known[piece] if piece in self.known else self._add(piece, ids)
        return at

    def _learn(self, new: Iterable[str]) -> None:
        """Add new pieces: words first, all together, then the others, whose ids are put together from those of their parts."""
        words, others, parts, counts, whole = [], [], [], [], set()
        for piece in new:
            body = piece[1:] if piece[0] == " " else piece
            if body.isalpha():
                words.append(piece)
                continue
            if body[:-1].isalpha():  # a word and what follows it
                others.append(piece)
                parts += piece[:-1], piece[-1]
                counts.append(2)
                continue
            own = []
            for line in piece.split("\n") if "\n" in piece and not _RUN.search(piece) else [piece]:
                word = _WORD.match(line)
                if word and _is_word(word[0]):
                    own.append(word[0])
                    line = line[word.end() :]
                if line:
                    own.append(line)
                own.append("\n")
            own.pop()
            if own == [piece] or own == ["\n"]:
                whole.add(piece)
            else:
                others.append(piece)
                parts += own
                counts.append(len(own))
        known = self.known
        unknown = set(parts).difference(known)
        between = {p for p in unknown if not _is_word(p)}
        words += unknown.difference(between, words)
        for first in range(0, len(words), LEARNT_WORDS):
            some = words[first : first + LEARNT_WORDS]
            tokens = list(map(self.model.tokenize, self._spelt(some)))
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            self._add_all(some, sizes, array("I", map(_TOKEN_ID, chain.from_iterable(tokens))))
        for piece in between | whole:
            self._number(piece)
        if others:
            numbers = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
            firsts = np.cumsum(counts) - counts
            self._add_all(others, np.add.reduceat(self._sizes(numbers), firsts), self._joined(numbers))

    def _spelt(self, words: list[str]) -> list[str]:
        """Words without line feeds, each of their bytes as the letter that stands for it."""
        letters = self.codes[np.frombuffer("\n".join(words).encode(), np.uint8)]
        return letters.tobytes().decode("utf-16-le").split(self.letters[10])

    def _add_all(self, new: list[str], sizes: np.ndarray, ids: array | np.ndarray) -> None:
        """Add new pieces, with the number of ids of each and these ids one after the other."""
        first = len(self.starts) - 1
        self.known.update(zip(new, range(first, first + len(new))))
        self.starts.frombytes((len(self.flat) + np.cumsum(sizes)).astype(np.int64).tobytes())
        self.flat.frombytes(ids.tobytes())

    def ids(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null text has none.

        Texts are cut at spaces and their words numbered by Arrow, so that each
        distinct word is looked up once; ids are put together from the table.
        Texts in which a space stands before white space are cut one by one.
        """
        if len(self.known) > KNOWN_PIECES:
            self._shrink()
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(column):
            return []
        cut = pc.split_pattern(pc.fill_null(column, ""), " ")
        coded = cut.flatten().dictionary_encode()
        words, place = coded.dictionary, coded.indices.to_numpy()
        sizes = cut.value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        first = ends - sizes
        later = np.ones(len(place), bool)
        later[first] = False
        used = np.bincount(place[later], minlength=len(words)) > 0
        signs = pc.utf8_slice_codeunits(words, 0, 1).dictionary_encode()
        odd = np.array([not x or x.isspace() for x in signs.dictionary.to_pylist()], bool)[signs.indices.to_numpy()]
        pieces_of = {i: pieces(column[i].as_py()) for i in np.unique(np.searchsorted(ends, np.flatnonzero(later & odd[place]), "right"))}
        plain = np.flatnonzero(used & ~odd)
        spaced = pc.binary_join_element_wise(" ", words.take(pa.array(plain)), "").to_numpy(zero_copy_only=False).tolist()
        starting = words.take(pa.array(place[first])).to_pylist()
        own = np.fromiter(map(self.known.get, spaced, repeat(-1)), np.int64, len(spaced))
        missing = np.flatnonzero(own < 0)
        unknown = [spaced[i] for i in missing.tolist()]
        new = unknown + list(set(starting).union(*pieces_of.values()).difference(self.known, unknown))
        self._learn([p for p in new if len(p) <= LONGEST_KNOWN])
        long = {p: self._piece(p) for p in new if len(p) > LONGEST_KNOWN}  # may add parts of them
        kept = len(self.starts), len(self.flat)
        for piece, ids in long.items():
            self._add(piece, ids)
        own[missing] = np.fromiter(map(self.known.__getitem__, unknown), np.int64, len(unknown))
        numbers = np.zeros(len(words), np.int64)
        numbers[plain] = own
        number = numbers[place]
        number[first] = [self.known[w] for w in starting]
        found = self._joined(number)
        uses = np.bincount(number[number < kept[0] - 1], minlength=kept[0] - 1)
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        bounds = np.concatenate([[0], np.cumsum(self._sizes(number))])
        out = [found[bounds[a] : bounds[b]] for a, b in zip(first, ends)]
        for i, own in pieces_of.items():
            out[i] = self._joined(np.array([self.known[p] for p in own], np.int64))
        for piece in long:
            del self.known[piece]
        del self.starts[kept[0] :], self.flat[kept[1] :]
        return out

    def _sizes(self, numbers: np.ndarray) -> np.ndarray:
        starts = np.array(self.starts)
        return starts[numbers + 1] - starts[numbers]

    def _joined(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of pieces by number, one after the other; the places of the ids are made for some pieces at a time."""
        starts, flat, parts = np.array(self.starts), np.array(self.flat, np.uint32), [np.empty(0, np.uint32)]
        for first in range(0, len(numbers), JOINED_PIECES):
            some = numbers[first : first + JOINED_PIECES]
            begins = starts[some]
            sizes = starts[some + 1] - begins
            at = np.repeat(begins + sizes - np.cumsum(sizes), sizes)
            at += np.arange(len(at))
            parts.append(flat[at])
        return np.concatenate(parts)


def tokenizer(path: str) -> PieceTokenizer:
    """The tokenizer of a file; a Python process keeps it, and so its table of pieces, between tasks."""
    return last_used(("tokenizer", path), lambda: PieceTokenizer(path))


def by_size(texts: pa.Array, most: int = BATCH_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """(start, texts) in runs of about ``most`` bytes; a longer text is a run of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    start = size = 0
    for i, own in enumerate(sizes.tolist()):
        size += own
        if size >= most:
            yield start, texts.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts.slice(start)


def encoded(batches: Iterable[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[object, np.ndarray]]:
    """(id, ids with the end id) of the rows of Arrow batches with columns ``id`` and ``text``; a null text is empty."""
    end = np.array([end_id], np.uint32)
    model = tokenizer(path)
    for batch in batches:
        names = batch.column("id").to_pylist()
        for start, run in by_size(batch.column("text")):
            for name, ids in zip(names[start:], model.ids(run)):
                yield name, np.concatenate([ids, end])

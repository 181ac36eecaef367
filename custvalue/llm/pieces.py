"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut by Arrow into segments that no piece spans (a run of spaces and the
word after it). Every distinct segment is encoded once: its substrings, of the lengths
that pieces with the same first characters have, are exploded and joined with the
piece table, which gives the edges of its lattice; edges are grouped by segment
and folded with the higher-order ``aggregate``. The encoded segments are then put
together by document.

The fold follows the kind of the model. For a unigram table it is Viterbi: the
best path to every position. For a BPE table the best path by scores is not what
the model means (on sample texts it differs for more than half of the words),
so edges are folded in the order of their merges: an edge is taken if it joins
exactly two present symbols. Positions between symbols are the bits of a number;
segments too long for one are folded in Python, over the same edges in order.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from custvalue.llm.kept import forget, last_used, releasing
from custvalue.llm.tokenfile import filesystem, new_folder
from custvalue.llm.tokens import by_size
from custvalue.session import drop_folder, free_disk

SPACE = "▁"
# Layout of an edge in 63 bits, from the lowest: id, length, start, rank.
_ID, _LENGTH, _START, _RANK = (17, 0), (5, 17), (24, 22), (17, 46)
_NONE = (1 << 17) - 1  # id and rank of a character that is no piece
_PREFIX, _SHORT = 3, 0b110  # characters that choose the lengths to try; the lengths below, as bits
WORDS_PER_TASK = 20_000
CUT_BYTES, JOIN_BYTES = 8_000_000, 1_500_000  # text cut at once; text whose ids are put together at once
SENT_BYTES, SENT_ROWS = 16_000_000, 100_000  # distinct segments a task holds before it sends them; rows it sends at once
HELD_BYTES = 64_000_000  # positions in tables of hashes that a task holds while it reads a large table of words
_MASKED = 62  # segments of at most so many characters are folded as bits of a long


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with id and score, and the ids of unknown characters and of the first byte piece (None: no bytes)."""

    pieces: tuple[tuple[str, int, float], ...]
    unknown: int
    first_byte: int | None
    kind: str = "bpe"

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)


def vocabulary(path: str, kind: str = "bpe") -> Vocabulary:
    """The vocabulary of a model file that adds a space before a text and changes no characters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    size = model.get_piece_size()
    pieces = tuple((model.id_to_piece(i), i, model.get_score(i)) for i in range(size) if not special(i))
    first = model.piece_to_id("<0x00>")
    return Vocabulary(pieces, model.unk_id(), first if model.is_byte(first) else None, kind)


def _piece_table(spark: SparkSession, vocab: Vocabulary) -> DataFrame:
    """``piece, id, rank, score``: as many rows as the vocabulary has pieces."""
    if vocab.longest >= 1 << _LENGTH[0] or max((i for _, i, _ in vocab.pieces), default=0) >= _NONE:
        raise ValueError("pieces may have 31 characters and ids under 131071")
    ranked = sorted(vocab.pieces, key=lambda p: (-p[2], p[1]))
    return spark.createDataFrame(
        [(p, i, rank, s) for rank, (p, i, s) in enumerate(ranked)], "piece string, id int, rank int, score double"
    )


def cut_lines(vocab: Vocabulary) -> bool:
    """Whether a line feed begins a segment; else it is as other characters."""
    return not any("\n" in p for p, _, _ in vocab.pieces)


def raw_segments(texts: pa.Array, lines: bool) -> pa.ListArray:
    """Each text's segments, without the space sign that all but those after a line feed begin with.

    Empty for a null or empty text. Texts with single spaces are split at them
    by Arrow; a regular expression cuts the others.
    """
    spaced = pc.fill_null(texts, "")
    if lines:
        spaced = pc.replace_substring(spaced, "\n", " \n")
    found = pc.split_pattern(spaced, " ")
    odd = pc.or_(pc.equal(spaced, ""), pc.starts_with(spaced, " "))
    for sign in ("  ", SPACE) if lines else ("  ", SPACE, "\n"):
        odd = pc.or_(odd, pc.match_substring(spaced, sign))
    at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if not len(at):
        return found
    cut = re.compile(f"(?<=[^{SPACE}])(?={SPACE})" + "|(?=\n)" * lines)
    others = [_bare(cut.split(SPACE + t.replace(" ", SPACE))) if t else [] for t in texts.take(pa.array(at)).to_pylist()]
    places = np.arange(len(texts))
    places[at] = len(texts) + np.arange(len(at))
    return pa.concat_arrays([found, pa.array(others, found.type)]).take(pa.array(places))


def _bare(segments: list[str]) -> list[str]:
    return [x.removeprefix(SPACE) for x in segments]


def _distinct_segments(docs: DataFrame, lines: bool) -> DataFrame:
    """``raw``: the distinct segments of the column ``text``; each task sends those of as many texts as it can hold once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the table of a former call
        held: list[pa.Array] = []
        for batch in batches:
            for _, run in by_size(batch.column("text"), CUT_BYTES):
                held.append(raw_segments(run, lines).flatten().unique())
                if sum(x.nbytes for x in held) > SENT_BYTES:
                    held = [pa.chunked_array(held).unique()]
                    if held[0].nbytes > SENT_BYTES // 2:
                        yield from _sent(held.pop())
        if held:
            yield from _sent(pa.chunked_array(held).unique())
        pa.default_memory_pool().release_unused()  # the process stays for later stages

    return docs.select("text").mapInArrow(rows, "raw string").repartition("raw").distinct()


def _sent(raw: pa.Array) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(raw), SENT_ROWS):
        yield pa.RecordBatch.from_arrays([raw.slice(start, SENT_ROWS)], ["raw"])


def _segmented(docs: DataFrame, lines: bool) -> DataFrame:
    """``docs`` with ``segments`` instead of ``text``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, run in by_size(batch.column("text"), JOIN_BYTES):
                own = batch.slice(start, len(run))
                columns = [own.column("doc_id"), own.column("plain"), raw_segments(run, lines)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "plain", "segments"])

    return docs.select("doc_id", "plain", "text").mapInArrow(rows, "doc_id long, plain boolean, segments array<string>")


def with_space(raw: Column) -> Column:
    """A segment as the pieces write it."""
    return F.when(F.startswith(raw, F.lit("\n")), raw).otherwise(F.concat(F.lit(SPACE), raw))


def _field(edge: Column, field: tuple[int, int]) -> Column:
    return F.shiftright(edge, field[1]).bitwiseAND(F.lit((1 << field[0]) - 1))


def _pack(rank: Column, start: Column, length: Column, piece: Column) -> Column:
    parts = ((rank, _RANK), (start, _START), (length, _LENGTH), (piece, _ID))
    total = None
    for value, (_, at) in parts:
        shifted = F.shiftleft(value.cast("long"), at)
        total = shifted if total is None else total.bitwiseOR(shifted)
    return total


def _length_table(spark: SparkSession, vocab: Vocabulary) -> DataFrame:
    """``_prefix, lengths, most``: the lengths, as bits and at most, of the pieces with the same first ``_PREFIX`` characters."""
    lengths = {}
    for piece, _, _ in vocab.pieces:
        if len(piece) >= _PREFIX:
            lengths[piece[:_PREFIX]] = lengths.get(piece[:_PREFIX], _SHORT) | 1 << len(piece)
    return spark.createDataFrame(
        [(p, bits, bits.bit_length() - 1) for p, bits in lengths.items()], "_prefix string, lengths int, most int"
    )


def lattices(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``word, edges`` of distinct words: edges of every piece in a word, and of characters that are none.

    An edge is packed in ``e``; ``span`` and ``ends`` are its positions as bits,
    which mean something in words of at most ``_MASKED`` characters. Of every
    start, the substrings are exploded whose length a piece with the same first
    characters has. They meet the pieces by their hashes alone, which are looked
    up faster than texts; that each text begins with the other is asked besides.
    Words are numbered as they come, so their edges are in order for the grouping.
    """
    spark, size, start = words.sparkSession, F.length("word"), F.col("start")
    lengths, pieces = _length_table(spark, vocab), _piece_table(spark, vocab)  # a fixed vocabulary
    bounds = F.broadcast(lengths.withColumn("_key", F.xxhash64("_prefix")))
    table = F.broadcast(pieces.select(F.xxhash64("piece").alias("_key"), F.col("piece").alias("_piece"), "id", "rank"))
    numbered = words.select(F.monotonically_increasing_id().alias("_n"), "word")
    starts = numbered.select("_n", "word", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
    starts = starts.withColumn("first", F.substring("word", start + 1, F.lit(_PREFIX)))
    starts = starts.join(bounds, _equal("first", "_prefix"), "left")
    reach = F.least(F.coalesce("most", F.lit(_PREFIX - 1)), size - start)
    bits = F.coalesce("lengths", F.lit(_SHORT)).alias("lengths")
    spans = starts.select("_n", "word", "start", bits, F.explode(F.sequence(F.lit(1), reach)).alias("length"))
    spans = spans.filter(F.getbit("lengths", F.col("length")) == 1)
    spans = spans.select("_n", "word", "start", "length", F.substring("word", start + 1, F.col("length")).alias("piece"))
    found = spans.join(table, _equal("piece", "_piece"), "left").filter("id is not null or length = 1")
    none = F.lit(_NONE)
    packed = _pack(F.coalesce("rank", none), start, F.col("length"), F.coalesce("id", none))
    span = F.call_function("shiftleft", _bit(F.col("length") + 1) - 1, start)
    ends = F.call_function("shiftleft", _bit(F.col("length")) + 1, start)
    edge = F.struct(packed.alias("e"), span.alias("span"), ends.alias("ends"))
    return found.select("_n", "word", edge.alias("edge")).groupBy("_n", "word").agg(F.collect_list("edge").alias("edges")).drop("_n")


def _equal(text: str, other: str) -> Column:
    """Equality of texts, the other's hash being ``_key``, as a join by that number alone."""
    both = F.startswith(F.col(text), F.col(other)) & F.startswith(F.col(other), F.col(text))
    return (F.xxhash64(text) == F.col("_key")) & both


def _bit(x: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), x.cast("int"))


def _merge_fold(edges: Column, size: Column) -> Column:
    """Positions that are left between symbols after all merges, as bits."""

    def step(mask: Column, edge: Column) -> Column:
        span, ends = edge["span"], edge["ends"]
        joins = (F.bit_count(mask.bitwiseAND(span)) == 3) & (mask.bitwiseAND(ends) == ends)
        return F.when(joins, mask.bitwiseAND(F.bitwise_not(span)).bitwiseOR(ends)).otherwise(mask)

    merges = F.sort_array(F.filter(edges, lambda e: F.bit_count(e["span"]) > 2))  # by rank, then start
    return F.aggregate(merges, _bit(size + 1) - 1, step)


def _viterbi_fold(edges: Column, size: Column, scores: list[float], unknown: float) -> Column:
    """As ``_merge_fold``, for the path of the highest sum of scores; of equal ones, that of the longer last piece.

    The state holds, for every position reached, the best sum and the positions
    of its path; edges come in the order of their ends, then their starts.
    """
    table = F.split(F.lit(",".join(repr(s) for s in sorted(scores, reverse=True))), ",").cast("array<double>")
    order = lambda e: F.shiftleft((_field(e, _START) + _field(e, _LENGTH)).cast("long"), 24).bitwiseOR(_field(e, _START))
    moved = F.transform(edges, lambda e: F.struct(order(e["e"]).alias("at"), e["e"].alias("edge")))
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("mask")))

    def step(state: Column, moved_edge: Column) -> Column:
        edge = moved_edge["edge"]
        a = _field(edge, _START).cast("int")
        b = a + _field(edge, _LENGTH).cast("int")
        rank = _field(edge, _RANK).cast("int")
        gain = F.when(rank == _NONE, F.lit(unknown)).otherwise(F.get(table, rank))
        before = F.get(state, a)
        new = F.struct((before["score"] + gain).alias("score"), before["mask"].bitwiseOR(_bit(b)).alias("mask"))
        better = F.when(F.get(state, b)["score"] >= new["score"], F.get(state, b)).otherwise(new)
        return F.concat(F.slice(state, 1, b), F.array(better))

    return F.element_at(F.aggregate(F.sort_array(moved), start, step), -1)["mask"]


def _symbols(edges: Column, mask: Column) -> Column:
    """Edges, without their rank, of the symbols between the positions of ``mask``, by start.

    The mask is bound as a variable, so that the optimiser does not move its fold into the filter, once per edge.
    """
    low = (1 << _RANK[1]) - 1
    between = lambda m: F.filter(edges, lambda e: m.bitwiseAND(e["span"]) == e["ends"])
    kept = F.get(F.transform(F.array(mask), between), 0)
    return F.sort_array(F.transform(kept, lambda e: e["e"].bitwiseAND(F.lit(low))))


def _symbol_ids(word: Column, symbols: Column, vocab: Vocabulary) -> Column:
    """Ids of the symbols; characters that are no piece become their bytes."""

    def expanded(edge: Column) -> Column:
        code = F.hex(F.encode(F.substring(word, _field(edge, _START).cast("int") + 1, F.lit(1)), "UTF-8"))
        one = lambda i: F.conv(F.substring(code, 2 * i + 1, F.lit(2)), 16, 10).cast("int") + (vocab.first_byte or 0)
        parts = F.transform(F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1), one)
        unknown = F.array(F.lit(vocab.unknown)) if vocab.first_byte is None else parts
        return F.when(_field(edge, _ID) == _NONE, unknown).otherwise(F.array(_field(edge, _ID).cast("int")))

    plain = F.transform(symbols, lambda e: _field(e, _ID).cast("int"))
    some_none = F.exists(symbols, lambda e: _field(e, _ID) == _NONE)
    return F.when(some_none, F.flatten(F.transform(symbols, expanded))).otherwise(plain)


def _part(edge: int, field: tuple[int, int]) -> int:
    return (edge >> field[1]) & ((1 << field[0]) - 1)


def _long_merges(size: int, edges: list[int]) -> np.ndarray:
    """The end of the symbol that starts at each position, by the merge fold without the limit of a number's bits."""
    follow = np.arange(1, size + 2)
    present = np.ones(size + 1, bool)
    for e in sorted(edges):
        a = _part(e, _START)
        b = a + _part(e, _LENGTH)
        if b - a > 1 and present[a] and present[b] and follow[a] < b and follow[follow[a]] == b:
            present[follow[a]] = False
            follow[a] = b
    return follow


def _long_viterbi(size: int, edges: list[int], scores: list[float], unknown: float) -> np.ndarray:
    """As ``_long_merges``, by the Viterbi fold: back-pointers to the best start of the last piece of every prefix."""
    best, back = [0.0] + [-np.inf] * size, [0] * (size + 1)
    for a, b, rank in sorted((_part(e, _START), _part(e, _START) + _part(e, _LENGTH), _part(e, _RANK)) for e in edges):
        score = best[a] + (unknown if rank == _NONE else scores[rank])
        if score > best[b]:  # starts rise, so of equal paths the longer last piece stays
            best[b], back[b] = score, a
    follow, at = np.zeros(size + 1, int), size
    while at > 0:
        follow[back[at]] = at
        at = back[at]
    return follow


def _long_ids(word: str, edges: list[int], follow: np.ndarray, vocab: Vocabulary) -> list[int]:
    """Ids of the symbols from each position of ``follow`` to the next."""
    ids = {(_part(e, _START), _part(e, _LENGTH)): _part(e, _ID) for e in edges}
    at, out = 0, []
    while at < len(word):
        piece = ids[at, int(follow[at]) - at]
        if piece != _NONE:
            out.append(piece)
        elif vocab.first_byte is None:
            out.append(vocab.unknown)
        else:
            out += [vocab.first_byte + b for b in word[at].encode("utf-8", "replace")]
        at = int(follow[at])
    return out


def encode_words(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``word, ids`` of distinct words."""
    short, long = _encoded(words, vocab)
    return short.union(long)


def _encoded(words: DataFrame, vocab: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """``word, ids`` of the words that are folded as bits, still dealt out by word, and of longer ones.

    The words are dealt out by themselves first, ``WORDS_PER_TASK`` to a task,
    so that their edges, which are many more bytes, stay where they are when
    they are grouped, and need little memory.
    """
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.count() // WORDS_PER_TASK)
    dealt, size = words.repartition(parts, "word"), F.length("word")
    edges, long = (lattices(dealt.filter(some), vocab) for some in (size <= _MASKED, size > _MASKED))
    scores = sorted((s for _, _, s in vocab.pieces), reverse=True)  # by rank
    unknown = min(scores, default=0.0) - 10.0
    bpe = vocab.kind == "bpe"
    mask = _merge_fold(F.col("edges"), size) if bpe else _viterbi_fold(F.col("edges"), size, scores, unknown)
    folded = edges.select("word", "edges", mask.alias("mask"))
    symbols = folded.select("word", _symbols(F.col("edges"), F.col("mask")).alias("symbols"))
    ids = symbols.select("word", _symbol_ids(F.col("word"), F.col("symbols"), vocab).alias("ids"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, own in zip(batch.column("word"), batch.column("edges")):
                word, own = value.as_py(), own.as_py()
                follow = _long_merges(len(word), own) if bpe else _long_viterbi(len(word), own, scores, unknown)
                found = pa.array([_long_ids(word, own, follow, vocab)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict({"word": [word], "ids": found})

    return ids, long.select("word", F.col("edges.e").alias("edges")).mapInArrow(rows, "word string, ids array<int>")


def decode(df: DataFrame, vocab: Vocabulary, key_cols: list[str], ids_col: str = "ids") -> DataFrame:
    """``key_cols, decoded``: the text of each row's ids. Ids that are null, no piece and no byte add nothing.

    The texts of the pieces, a fixed vocabulary, are one literal array in the
    plan; a row looks its ids up in it, without a shuffle. Bytes that are no
    text become replacement characters. The space that encoding adds before a
    text is still there.
    """
    texts = {i: p.replace(SPACE, " ").encode().hex() for p, i, _ in vocab.pieces}
    if vocab.first_byte is not None:
        texts |= {vocab.first_byte + b: f"{b:02x}" for b in range(256)}
    table = F.split(F.lit(",".join(texts.get(i, "") for i in range(max(texts, default=0) + 1))), ",")
    code = F.array_join(F.transform(ids_col, lambda i: F.get(table, i)), "")  # leaves nulls out
    return df.select(*key_cols, F.make_valid_utf8(F.unhex(F.coalesce(code, F.lit(""))).cast("string")).alias("decoded"))


def _saved(df: DataFrame) -> str:
    """The folder beside the checkpoints that ``df`` is written to."""
    folder = new_folder(df.sparkSession, "segments")
    df.write.parquet(folder)
    return folder


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written beside the checkpoints and read back, and its folder: a fraction of a checkpoint's size for short words and ids."""
    folder = _saved(df)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def _packed_table(words: DataFrame, id_type: str) -> str:
    """A folder of the hashes of all words in order, their numbers of ids, the ids, and the hashes of words that do not decode back.

    Sorted, packed and written in the tasks, for ``_read_table`` and
    ``_read_entries``; nothing of it comes to the driver. A number of ids takes one byte, and 255 with the number
    in the last column, in the same order, where it does not fit.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, batch in enumerate(batches):
            ids, hashes = batch.column("ids"), batch.column("h").to_numpy()
            sizes = np.diff(ids.offsets.to_numpy())
            same = batch.column("same").to_numpy(zero_copy_only=False).astype(bool)
            arrays = (
                hashes,
                np.minimum(sizes, 255).astype("u1"),
                ids.flatten().to_numpy().astype(id_type),
                hashes[~same],
                sizes[sizes >= 255].astype("<u4"),
            )
            yield pa.RecordBatch.from_pydict({"part": [part], "n": [n]} | {f"c{i}": [x.tobytes()] for i, x in enumerate(arrays)})

    hashed = words.select(F.xxhash64("raw").alias("h"), "ids", "same").repartitionByRange("h").sortWithinPartitions("h")
    return _saved(hashed.mapInArrow(rows, "part long, n long, " + ", ".join(f"c{i} binary" for i in range(5))))


def _read_table(folder: str, id_type: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a folder of ``_packed_table``: hashes, where the ids of each begin, and the end, the ids, and the hashes that fail.

    One column at a time is read beside its array.
    """
    system, base = filesystem(folder)
    column = lambda name: pq.read_table(base, columns=[name], filesystem=system, use_threads=False).column(0)
    order = np.lexsort((column("n").to_numpy(), column("part").to_numpy())).tolist()

    def joined(name: str, kind: str) -> np.ndarray:
        values = column(name)
        return np.concatenate([np.empty(0, kind), *(np.frombuffer(values[i].as_buffer(), kind) for i in order)])

    known, flat, wrong = joined("c0", "<i8"), joined("c2", id_type), joined("c3", "<i8")
    counts = joined("c1", "u1")
    sizes = counts.astype(np.int32)
    sizes[counts == 255] = joined("c4", "<u4")
    starts = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)])
    pa.default_memory_pool().release_unused()
    return known, starts, flat, wrong


def _read_entries(folder: str, id_type: str, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``_read_table``, of the wanted hashes alone, which are distinct and in order.

    The table is read through in pieces, of which only what is wanted is kept, so it may have any size.
    """
    system, base = filesystem(folder)
    empty = (np.empty(0, "<i8"), np.empty(0, np.int64), np.empty(0, id_type), np.empty(0, "<i8"))
    found = [empty]
    for info in system.get_file_info(pafs.FileSelector(base)):
        if not info.path.endswith(".parquet"):
            continue
        with system.open_input_file(info.path) as stream:
            for batch in pq.ParquetFile(stream).iter_batches(batch_size=64, use_threads=False):
                found += [_entries(*line, id_type, wanted) for line in zip(*(batch.column(f"c{i}") for i in range(5)))]
    known, sizes, flat, wrong = (np.concatenate(x) for x in zip(*found))
    del found
    if len(known) != len(wanted):
        raise RuntimeError("the texts were not the same when they were read again")
    order = np.argsort(known)
    starts = np.cumsum(sizes) - sizes
    places, bounds = _ranges(starts[order], sizes[order])
    pa.default_memory_pool().release_unused()
    return known[order], bounds, flat[places], wrong


def _entries(
    hashes: pa.Scalar, counts: pa.Scalar, ids: pa.Scalar, wrong: pa.Scalar, large: pa.Scalar, id_type: str, wanted: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a line of ``_packed_table``: the wanted hashes, their numbers of ids, the ids, and the hashes among them that fail."""
    known, counts, flat, wrong, large = (
        np.frombuffer(x.as_buffer(), kind) for x, kind in zip((hashes, counts, ids, wrong, large), ("<i8", "u1", id_type, "<i8", "<u4"))
    )
    sizes = counts.astype(np.int64)
    sizes[counts == 255] = large
    own = wanted[slice(*np.searchsorted(wanted, known[[0, -1]]) + [0, 1])] if len(known) else known
    at = np.searchsorted(known, own)
    at = at[known[np.minimum(at, len(known) - 1)] == own] if len(known) else at
    places, _ = _ranges((np.cumsum(sizes) - sizes)[at], sizes[at])
    return known[at], sizes[at], flat[places], wrong[np.isin(wrong, known[at])]


@dataclass(frozen=True)
class _Coded:
    """Some texts as the hashes of their distinct segments, in any order, and the place of every segment among these.

    ``cuts`` parts the places by text.
    """

    doc_id: pa.Array
    plain: np.ndarray
    hashes: np.ndarray
    places: np.ndarray
    cuts: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.hashes.nbytes + self.places.nbytes + self.cuts.nbytes


def _coded(batches: Iterator[pa.RecordBatch], lines: bool) -> Iterator[_Coded]:
    for batch in batches:
        for start, run in by_size(batch.column("text"), JOIN_BYTES):
            lists = raw_segments(run, lines)
            coded = lists.flatten().dictionary_encode()
            hashes = [xxh64_intdigest(w, 42) for w in coded.dictionary.cast(pa.binary()).to_pylist()]
            rest = batch.slice(start, len(run))
            yield _Coded(
                rest.column("doc_id").take(pa.array(np.arange(len(run)))),  # a copy, which does not hold the batch
                rest.column("plain").to_numpy(zero_copy_only=False),
                np.array(hashes, np.uint64).view(np.int64),
                coded.indices.to_numpy(),
                lists.offsets.to_numpy() - lists.offsets[0].as_py(),
            )


def _gathered(texts: Iterator[_Coded], most: int) -> Iterator[list[_Coded]]:
    """Runs of texts of about so many bytes."""
    held, size = [], 0
    for some in texts:
        held.append(some)
        size += some.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _looked_up(
    some: _Coded, known: np.ndarray, starts: np.ndarray, flat: np.ndarray, wrong_words: np.ndarray
) -> pa.RecordBatch:
    """Ids of the texts; each distinct segment is looked up once, in the order of the hashes."""
    order = np.argsort(some.hashes)
    at = np.empty(len(order), np.int64)
    at[order] = np.searchsorted(known, some.hashes[order])
    own, own_starts = _ranges(starts[at].astype(np.int64), starts[at + 1] - starts[at])
    own = flat[own]
    ids, bounds = _ranges(own_starts[some.places], own_starts[some.places + 1] - own_starts[some.places])
    failed = np.isin(known[at], wrong_words)[some.places] if len(wrong_words) else np.zeros(len(some.places), bool)
    wrong = np.concatenate([[0], np.cumsum(failed)])[some.cuts]
    return pa.RecordBatch.from_arrays(
        [
            some.doc_id,
            pa.ListArray.from_arrays(pa.array(bounds[some.cuts], pa.int32()), pa.array(own[ids].astype(np.int32))),
            pa.array((np.diff(wrong) == 0) & some.plain),
        ],
        ["doc_id", "ids", "round_trip"],
    )


def _by_table(docs: DataFrame, folder: str, id_type: str, lines: bool, digested: bool, whole: bool) -> DataFrame:
    """Ids of the documents, or their digest in the same task, by a sorted table of the words' hashes.

    A table that is read ``whole`` is held by every process. Of another, a task
    reads through for as many texts at once as it can hold, and keeps the
    entries of these: neither the texts nor the table is shuffled or joined.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _gathered(_coded(batches, lines), 0 if whole else HELD_BYTES):
            if whole:
                table = last_used(("segments", folder), lambda: _read_table(folder, id_type))
            else:
                table = _read_entries(folder, id_type, np.unique(np.concatenate([some.hashes for some in run])))
            for some in run:
                yield _looked_up(some, *table)

    if digested:
        return docs.mapInArrow(releasing(lambda batches: _digests(rows(batches))), _DIGEST)
    return docs.mapInArrow(releasing(rows), "doc_id long, ids array<int>, round_trip boolean")


def _ranges(firsts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ranges, one range after the other, and where each range begins among them, and the end."""
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
    return np.arange(bounds[-1]) + np.repeat(firsts - bounds[:-1], sizes), bounds


def _by_join(docs: DataFrame, words: DataFrame, lines: bool) -> DataFrame:
    """Ids of the documents by a join of every segment, where hashes do not tell the segments apart."""
    rows = _segmented(docs, lines).withColumn("_row", F.monotonically_increasing_id())
    parts = rows.select("_row", "doc_id", "plain", F.posexplode_outer("segments").alias("at", "raw"))
    joined = parts.join(words, "raw", "left")
    grouped = joined.groupBy("_row", "doc_id", "plain").agg(
        F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"), F.bool_and("same").alias("same")
    )
    ids = F.flatten(F.transform(F.filter("parts", lambda p: p["ids"].isNotNull()), lambda p: p["ids"]))
    return grouped.select("doc_id", ids.alias("ids"), (F.coalesce("same", F.lit(True)) & F.col("plain")).alias("round_trip"))


def encode(
    df: DataFrame,
    vocab: Vocabulary,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_bytes: int = 1 << 27,
    digested: bool = False,
) -> DataFrame:
    """``doc_id, ids, round_trip`` of every row: ids of the whole text, and whether they decode to it.

    With ``digested`` the columns of ``digest`` of these rows, so that the ids do not leave their task.

    Null and empty texts have no ids. A text that holds the space sign itself
    decodes to a space there, so its round trip fails. Rows with a null or
    repeated id are kept, an empty table gives no rows, and other columns,
    whatever their names, are not read. The table of distinct segments is held
    by every Python process if it has at most ``broadcast_bytes``, and read through by tasks otherwise.
    """
    docs = df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.make_valid_utf8(df[text_col]).alias("text"),
        F.coalesce(~F.contains(df[text_col], F.lit(SPACE)), F.lit(True)).alias("plain"),
    )
    spark, lines = df.sparkSession, cut_lines(vocab)
    found = _distinct_segments(docs, lines).select(with_space(F.col("raw")).alias("word"))
    raw, raw_folder = _written(found)
    back = decode(encode_words(raw, vocab), vocab, ["word", "ids"])
    bare = F.when(F.startswith("word", F.lit(SPACE)), F.substring("word", 2, 1 << 30)).otherwise(F.col("word"))
    same = F.col("decoded") == F.translate("word", SPACE, " ")
    words, words_folder = _written(back.select(bare.alias("raw"), "ids", same.alias("same")))
    drop_folder(spark, raw_folder)
    del found, raw, back
    free_disk(spark)
    size = words.agg(
        F.count("*").alias("n"), F.count_distinct(F.xxhash64("raw")).alias("hashes"), F.sum(F.size("ids")).alias("ids")
    ).first()
    if size["n"] != size["hashes"]:
        joined = _by_join(docs, words, lines)
        return digest(joined) if digested else joined
    width = 2 if max((i for _, i, _ in vocab.pieces), default=0) < 1 << 16 else 4
    folder = _packed_table(words, f"<u{width}")
    drop_folder(spark, words_folder)
    del words
    free_disk(spark)
    whole = 9 * size["n"] + width * (size["ids"] or 0) <= broadcast_bytes
    return _by_table(docs, folder, f"<u{width}", lines, digested, whole)


_DIGEST = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, bounds = ids.flatten().to_numpy().astype("<u4"), ids.offsets.to_numpy()
        bounds = bounds - bounds[0]
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
        columns = [batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, batch.column("round_trip")], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])


def digest(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, round_trip``: the checksum is over little-endian unsigned 32-bit ids."""
    return encoded.mapInArrow(_digests, _DIGEST)

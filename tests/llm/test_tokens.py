"""Tokenization, packing and token files: exact round trips and brute force."""

import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from custvalue.llm import packing, tokenfile
from custvalue.llm.tokens import PieceTokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = [
    "a", "b", "It", " ", "  ", "\n", "\t", ".", ",", "'s", "é", "1", "²", "½", " ", "\x1c", "\x85", "​",
    "<|endoftext|>", "'", "!", "日本", "\U0001f600", "\x0b", "\r\n", "x" * 70, "<|", " don't", "naïve ", "é",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_pieces_give_the_ids_of_whole_texts(library):
    rng = random.Random(1)
    texts = ["".join(rng.choices(SIGNS, k=rng.randrange(25))) for _ in range(8000)]
    texts += ["", " ", "word " * 3000, "a\n" * 3000, "z" * 20_000, "\n" * 100]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    model = PieceTokenizer(PATH)
    for _ in range(2):  # with an empty and with a filled table
        assert [np.frombuffer(x, "<u4").tolist() for x in model.ids(texts)] == want


def ids_of(library, text, end):
    return library.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(library, rows, packed, limits, end=1):
    """Pieces cover every document once; sequences are gapless and within the limits."""
    docs = {}
    for doc, text, *_ in rows:
        docs.setdefault(doc, []).append(ids_of(library, text, end))
    pieces = {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == docs.keys()
    for doc, copies in docs.items():
        assert sum(r["length"] for r in pieces[doc]) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for r in sorted(pieces[doc], key=lambda r: r["start"]):
                own = copies[0][at : at + r["length"]]
                assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, crc(own), len(copies[0]))
                assert np.frombuffer(r["ids"], "<u4").tolist() == own
                at += r["length"]
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits.tokens and len(own) <= limits.segments and sum(r["loss_tokens"] for r in own) <= limits.loss_tokens
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding, len(sequences)


def test_documents_pack_without_padding(spark, library):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "zz", "é"], k=rng.choice([0, 1, 3, 40, 900, 4000])))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "no id"), (7, "a copy"), (7, "a copy")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, ids string, sequence_id int").repartition(3)
    limits = packing.Limits(tokens=256, segments=100, loss_tokens=256, pool_tokens=5000)
    packed = packing.pack(df, PATH, limits).collect()
    padding, sequences = check_packing(library, rows, packed, limits)
    assert padding == 0 and sequences > 50
    assert packing.pack(df.filter("false"), PATH).collect() == []


@pytest.mark.parametrize("limits", [packing.Limits(64, 3, 64, 500), packing.Limits(64, 50, 20, 500), packing.Limits(64, 4, 16, 100, False)])
def test_all_limits_hold_at_once(spark, library, limits):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["one", "two", "three"], k=rng.randrange(1, 150))), rng.choice([0, 5, 40, 400, None])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt long").coalesce(1)
    packed = packing.pack(df, PATH, limits, prompt_col="prompt").collect()
    check_packing(library, rows, packed, limits)
    for r in packed:
        prompt = next(p or 0 for i, _, p in rows if i == r["doc_id"])
        assert r["loss_tokens"] == sum(x >= prompt for x in range(r["start"], r["start"] + r["length"]))


def test_the_largest_inner_product_is_taken_first():
    pool = packing.Pool()
    for doc, (size, prompt) in enumerate([(10, 0), (40, 40), (30, 0), (40, 0)]):
        pool.add(packing.Piece(doc, np.zeros(size, "<u4"), 0, size, prompt))
    taken = packing._fill(pool, packing.Limits(100, 10, 60, 1000))
    assert [(p.doc, p.length) for p in taken] == [(3, 40), (1, 40), (0, 10), (2, 10)]


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 24, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001).astype("<u4")
    data = tokenfile.pack_bits(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (tokenfile.unpack_bits(data, 1001, bits) == ids).all()
    assert len(tokenfile.unpack_bits(b"", 0, bits)) == 0


def test_ids_must_fit():
    assert [tokenfile.bits_for(n) for n in (1, 2, 3, 256, 257, 50257, 65536)] == [1, 1, 2, 8, 9, 16, 16]
    with pytest.raises(ValueError):
        tokenfile.pack_bits(np.array([8], "<u4"), 3)


def test_random_access_to_documents_across_blocks(tmp_path):
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 1000, n).astype("<u4") for n in (0, 1, 5, 64, 200, 3, 0, 63)]
    with open(tmp_path / "x.tok", "wb") as stream:
        writer = tokenfile.Writer(stream, 10, 64)
        for i, ids in enumerate(docs):
            writer.add(i, ids)
        writer.close()
    import pyarrow.fs as pafs

    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "x.tok")) as file:
        reader = tokenfile.Reader(file)
        assert reader.docs.tolist() == list(range(8))
        for i in (4, 0, 7, 3, 6, 1, 5, 2):
            assert reader.ids(i).tolist() == docs[i].tolist()


@pytest.mark.parametrize("file_ids", [1 << 26, 50])
def test_written_files_read_back(spark, library, tmp_path, file_ids):
    rng = random.Random(5)
    rows = [(i * 7 % 101, " ".join(rng.choices(["alpha", "é", "it's"], k=rng.choice([0, 1, 30, 3000])))) for i in range(60)]
    rows += [(500, None), (None, "no id")] + [(600, "many copies")] * 30
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, start string").repartition(4)
    files = tokenfile.write(df, str(tmp_path), PATH, 50257, block=128, file_ids=file_ids)
    got = sorted(tokenfile.read(files, str(tmp_path), with_ids=True).collect(), key=lambda r: r["start"])
    want = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    at = 0
    for r, (doc, text) in zip(got, want, strict=True):
        ids = ids_of(library, text, 0)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, at, len(ids), crc(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        at += len(ids)
    assert not list(tmp_path.glob("*.tmp"))


def test_an_empty_table_writes_no_file(spark, tmp_path):
    files = tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "new"), PATH, 50257)
    assert files.count() == 0 and tokenfile.read(files, str(tmp_path / "new")).count() == 0


def test_ids_are_joined_in_little_memory():
    model = PieceTokenizer(PATH)
    model.ids(["some words of a text, and others"])
    numbers = np.random.default_rng(1).integers(0, len(model.known), 500_000)
    tracemalloc.start()
    found = model._joined(numbers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    parts = [model.flat[model.starts[i] : model.starts[i + 1]] for i in numbers.tolist()]
    assert found.tolist() == [i for part in parts for i in part] and peak < 20 * len(found)


def test_new_pieces_are_put_together_from_their_words(library, monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeé", k=8))
    texts = [" ".join(f"{word()}{rng.choice(['.', '&&&', f'.\n{word()}', f'-{word()}'])}" for _ in range(200)) for _ in range(10)]
    split, calls = PieceTokenizer._split, []
    monkeypatch.setattr(PieceTokenizer, "_split", lambda self, piece: calls.append(piece) or split(self, piece))
    got = PieceTokenizer(PATH).ids(texts)
    assert [x.tolist() for x in got] == [ids_of(library, t, 0)[:-1] for t in texts]
    assert len(calls) < 1000  # one for each of 2,000 pieces, and more, when each was encoded by itself


def test_ids_stay_right_while_the_table_shrinks(library, monkeypatch):
    monkeypatch.setattr("custvalue.llm.tokens.KNOWN_PIECES", 50)
    rng = random.Random(8)
    model = PieceTokenizer(PATH)
    for _ in range(40):
        texts = ["".join(rng.choices([*SIGNS, " one", " two.", " three\nFour", "5th", "½", "x½,"], k=30)) for _ in range(10)]
        assert [x.tolist() for x in model.ids(texts)] == [ids_of(library, t, 0)[:-1] for t in texts]
        assert list(model.known.values()) == list(range(len(model.starts) - 1))

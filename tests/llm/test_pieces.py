"""SentencePiece ids against the library, the Viterbi fold against all paths, and exact round trips."""

import itertools
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from xxhash import xxh64_intdigest

from custvalue.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, word string"


@pytest.fixture(scope="module")
def vocab():
    return P.vocabulary(PATH)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    signs = ["a", "be", "The", " ", "  ", "\n", "\t", "é", "日本", "\U0001f600", "1", ".", "###", "ing", "tion", "\x00"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(150)]
    texts += ["", " ", "   ", "\n\n", "x" * 300, "日" * 100, "\x00" * 300, "word " * 2000 + "end", "a\n b\n\nc"]
    return [(i, t) for i, t in enumerate(texts)] + [(500, None), (7, "a copy"), (None, "no id"), (600, "a▁b")]


@pytest.mark.parametrize("broadcast_bytes", [1 << 28, 0])
def test_ids_equal_the_library(spark, vocab, rows, broadcast_bytes):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = P.encode(df, vocab, broadcast_bytes=broadcast_bytes).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    want = [(i, library.encode(t or ""), "▁" not in (t or "")) for i, t in rows]
    assert sorted(((r["doc_id"], list(r["ids"]), r["round_trip"]) for r in got), key=key) == sorted(want, key=key)


def test_ids_decode_to_their_texts(spark, vocab, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    coded = [(i, library.encode(t)) for i, t in rows if t and "▁" not in t and i not in (7, None)]
    got = P.decode(spark.createDataFrame(coded + [(900, [])], "k long, ids array<int>"), vocab, ["k"]).collect()
    texts = {i: f" {t}" for i, t in rows}
    assert {r["k"]: r["decoded"] for r in got} == {i: texts[i] for i, _ in coded} | {900: ""}


def test_empty_tables(spark, vocab):
    assert P.encode(spark.createDataFrame([], SCHEMA), vocab).collect() == []
    assert P.digest(P.encode(spark.createDataFrame([(1, "", "", "")], SCHEMA), vocab)).collect() == [(1, 0, 0, True)]


def test_viterbi_takes_the_best_of_all_paths(spark):
    rng = random.Random(2)
    names = ["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "ca", "cab", "bca", "▁ab", "aa", "bb"]
    table = [(n, i + 1, -rng.random() * 10) for i, n in enumerate(names)]
    vocab = P.Vocabulary(tuple(table), 0, None, "unigram")
    words = ["▁" + "".join(w) for n in (1, 3, 6) for w in itertools.islice(itertools.product("abc", repeat=n), 0, None, 7)] + ["▁axb"]
    score = {n: s for n, _, s in table} | {"x": min(s for _, _, s in table) - 10}
    number = {n: i for n, i, _ in table} | {"x": 0}

    def best(word):
        if not word:
            return 0.0, []
        found = []
        for n in range(len(word), 0, -1):  # of equal paths, the longer last piece
            if word[-n:] in score:
                s, path = best(word[:-n])
                if s is not None:
                    found.append((s + score[word[-n:]], path + [number[word[-n:]]]))
        return max(found, key=lambda f: f[0]) if found else (None, [])

    got = P.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), vocab).collect()
    assert {r["word"]: list(r["ids"]) for r in got} == {w: best(w)[1] for w in words}


def test_long_segments_take_the_best_path_too(spark):
    rng = random.Random(3)
    names = ["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "ca", "cab", "bca", "cc", "aa", "bb"]
    vocab = P.Vocabulary(tuple((n, i + 1, -float(rng.randrange(1, 9))) for i, n in enumerate(names)), 0, None, "unigram")
    table = {n: (s, i) for n, i, s in vocab.pieces}
    unknown = min(s for s, _ in table.values()) - 10

    def best(word):
        found = [(0.0, [])]
        for end in range(1, len(word) + 1):
            options = []
            for n in range(min(3, end), 0, -1):  # of equal paths, the longer last piece
                part = word[end - n : end]
                if part in table or n == 1:
                    score, number = table.get(part, (unknown, 0))
                    options.append((found[end - n][0] + score, found[end - n][1] + [number]))
            found.append(max(options, key=lambda o: o[0]))
        return found[-1][1]

    words = ["▁" + "".join(rng.choices("abcx", (5, 5, 5, 1), k=n)) for n in (30, 60, 61, 62, 63, 64, 65, 500, 3000)]
    got = P.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), vocab).collect()
    assert {r["word"]: list(r["ids"]) for r in got} == {w: best(w) for w in words}


def test_decoding_takes_any_ids(spark, vocab):
    rows = [(1, None), (1, [None, 10**6, -1]), (None, [vocab.first_byte + 0xFF, vocab.first_byte + ord("a")])]
    got = P.decode(spark.createDataFrame(rows, "k long, ids array<int>"), vocab, ["k"]).collect()
    assert [tuple(r) for r in got] == [(1, ""), (1, ""), (None, "\ufffda")]


@pytest.mark.parametrize("lines", [True, False])
def test_segments_cut_by_arrow_follow_the_expression(lines):
    rng = random.Random(6)
    signs = ["a", "be", " ", "  ", "\n", " \n", "▁", "\t", "é", "日本", "\x85"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(8))) for _ in range(2000)] + ["", None]
    cut = re.compile("(?<=[^▁])(?=▁)" + "|(?=\n)" * lines)
    want = [[x.removeprefix("▁") for x in cut.split("▁" + t.replace(" ", "▁"))] if t else [] for t in texts]
    assert P.raw_segments(pa.array(["cut off", *texts])[1:], lines).to_pylist() == want


@pytest.mark.parametrize("broadcast_bytes", [1 << 28, 0])
def test_digests_in_the_task_equal_those_of_the_ids(spark, vocab, rows, broadcast_bytes):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    want = P.digest(P.encode(df, vocab)).collect()
    got = P.encode(df, vocab, broadcast_bytes=broadcast_bytes, digested=True)
    assert sorted(map(str, got.collect())) == sorted(map(str, want))


def test_texts_meet_their_table_by_one_number(spark, vocab):
    plan = P.lattices(spark.createDataFrame([("▁word",)], "word string"), vocab)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x]
    assert len(joins) == 2 and all(re.search(r"BroadcastHashJoin \[xxhash64\([^\]]*\)\], \[_key#\d+L\]", x) for x in joins)


def test_the_table_of_words_stays_out_of_the_driver(spark, vocab, monkeypatch):
    def refused(*_):
        raise AssertionError("the table is neither collected nor sent by the driver")

    df = spark.createDataFrame([(1, "some words"), (2, "of some\ntexts"), (3, None)], "doc_id long, text string")
    monkeypatch.setattr(type(df), "toArrow", refused)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    got = {r["doc_id"]: r["round_trip"] for r in P.encode(df, vocab).collect()}
    assert got == {1: True, 2: True, 3: True}


def test_a_large_table_of_words_is_neither_joined_nor_shuffled_with_the_texts(spark, vocab, rows):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    plan = P.encode(df, vocab, broadcast_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search("Exchange|Join", plan)


def test_entries_are_read_out_of_a_large_table(spark):
    ids = {f"w{i}": list(range(i % 5)) for i in range(300)} | {"long": list(range(700)), "longer": list(range(1000))}
    words = spark.createDataFrame([(w, x, w[-1] != "7") for w, x in ids.items()], "raw string, ids array<int>, same boolean")
    folder = P._packed_table(words, "<u2")
    hashes = {w: xxh64_intdigest(w, 42) - (1 << 64) * (xxh64_intdigest(w, 42) >> 63) for w in ids}
    some = ["w3", "longer", "w7", "w8", "long", "w299", "w0"]
    wanted = np.array(sorted(hashes[w] for w in some), np.int64)
    known, starts, flat, wrong = P._read_entries(folder, "<u2", wanted)
    got = {h: flat[a:b].tolist() for h, a, b in zip(known.tolist(), starts, starts[1:])}
    assert got == {hashes[w]: ids[w] for w in some} and wrong.tolist() == [hashes["w7"]]
    assert [len(x) for x in P._read_entries(folder, "<u2", wanted[:0])] == [0, 1, 0, 0]
    with pytest.raises(RuntimeError):
        P._read_entries(folder, "<u2", np.array([1], np.int64))


def test_texts_are_gathered_until_they_fill_a_run():
    texts = [f"word{i} of a text" for i in range(50)]
    batches = lambda: iter([pa.RecordBatch.from_pydict({"doc_id": [i], "plain": [True], "text": [t]}) for i, t in enumerate(texts)])
    one = next(P._coded(batches(), True)).nbytes
    runs = list(P._gathered(P._coded(batches(), True), 7 * one))
    assert [len(r) for r in runs] == [7] * 7 + [1]
    assert [d for r in runs for x in r for d in x.doc_id.to_pylist()] == list(range(50))
    assert [len(r) for r in P._gathered(P._coded(batches(), True), 0)] == [1] * 50


def test_texts_are_joined_where_hashes_are_not_enough(spark):
    words = spark.createDataFrame([("a", [1], True), ("b", [2, 3], False)], "raw string, ids array<int>, same boolean")
    docs = spark.createDataFrame([(1, "a b a", True), (1, "a", True), (None, None, True), (2, "a", False)], "doc_id long, text string, plain boolean")
    got = sorted(map(str, P._by_join(docs, words, True).collect()))
    want = [(1, [1, 2, 3, 1], False), (1, [1], True), (None, [], True), (2, [1], False)]
    assert got == sorted(f"Row(doc_id={d}, ids={i}, round_trip={r})" for d, i, r in want)

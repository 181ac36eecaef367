"""Collocations against plain counting, and their cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from custvalue.llm import collocations as C
from custvalue.llm.collocations import Settings, collocations, phrase_counts

SCHEMA = "text string, lang string"


def brute_counts(rows, longest):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return counts, totals


def brute(rows, s):
    counts, totals = brute_counts(rows, s.longest)
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= s.least}
        found = []
        for p, a in candidates.items():
            holders = [q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * candidates[q] >= s.inside_percent * a for q in holders):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[: s.first], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def texts_of(seed, n, vocabulary=12):
    rng = random.Random(seed)
    words = ["a", "B", "cé", "É", "été", "日本", "x y", "-", "q" * 30, "of", "The", "de"][:vocabulary]
    ends = [" ", "  ", "\t", ". ", ", ", "\n", "\r\n", "!?", " \x0b", "; "]
    weights = [60, 8, 6, 8, 6, 3, 2, 2, 1, 1]
    text = lambda: "".join(rng.choice(words) + rng.choices(ends, weights)[0] for _ in range(rng.randrange(60)))
    return [(text(), rng.choice(["en", "fr", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("longest, least", [(3, 10), (2, 3), (4, 4), (5, 2)])
def test_equals_plain_counting(spark, longest, least):
    rows = texts_of(longest, 120, 8)
    settings = Settings(longest=longest, least=least, first=40, shard_words=300, hashes_per_task=64)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, collocations(df, settings).collect()))
    assert got == brute(rows, settings) and len(got) > 20


def test_counts_are_whole_however_the_rows_are_dealt(spark):
    rows = texts_of(9, 80)
    want, _ = brute_counts(rows, 3)
    want = {(g, len(p), " ".join(p)): n for g, f in want.items() for p, n in f.items() if n >= 5}
    for parts, shard in ((1, 1 << 22), (7, 50)):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        found = phrase_counts(df, Settings(least=5, shard_words=shard)).collect()
        assert {(r["lang"], r["words"], r["phrase"]): r["f"] for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("seed", range(5))
def test_intervals_of_the_index(seed):
    rng = np.random.default_rng(seed)
    text = np.concatenate([[0], rng.integers(0, 5, 300), [0]]).astype(np.int32)
    depth = 3
    index = C.Index.of(text, 5, depth)
    forward = C._order(text, depth, 5, 1)
    backward = C._order(text, depth, 5, -1)
    phrases = index.words()
    for turn in range(2):
        phrases = index.extend(phrases, bool((seed + turn) % 2))
        size = phrases.words.shape[1]
        want = Counter(tuple(text[i : i + size]) for i in range(len(text) - size + 1) if 0 not in text[i : i + size])
        assert {tuple(w): n for w, n in zip(phrases.words, phrases.counts)} == want
        for words, n, a, b in zip(phrases.words, phrases.counts, phrases.forward, phrases.backward):
            assert {tuple(text[i : i + size]) for i in forward[a : a + n]} == {tuple(words)}
            assert {tuple(text[i - size + 1 : i + 1]) for i in backward[b : b + n]} == {tuple(words)}


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "one two. three  four\tfive " * 40
    whole, cut = C.Shard(), C.Shard()
    whole.add("en", [text, "six"])
    batch = C.pa.RecordBatch.from_pydict({"lang": ["en", "en"], "text": [text, "six"]})
    runs = list(C._runs([batch], 50))
    assert len(runs) > 10
    for run in runs:
        cut.add(*run)
    spell = lambda s: [s.names[i] for p in s.parts for i in p]
    assert spell(cut) == spell(whole)


def test_packed_shards_come_back_whole():
    shard = C.Shard()
    shard.add("en", ["a b a. c", ""])
    shard.add("x\ty\n", ["a b"])
    index, hashes, langs, texts = C.unpacked(shard.packed(), 2)
    assert texts.to_pylist() == [n.decode() for n in shard.names] and langs.to_pylist() == shard.langs
    assert shard.totals() == {"en": 4, "x\ty\n": 2} and len(set(hashes.tolist())) == len(hashes)
    assert index.words().counts.tolist() == [2, 1, 1, 1, 1]


def test_exact_scores_beyond_64_bits(spark):
    f = {"a": 9 * 10**13, "b": 8 * 10**13 + 1, "a b": 7 * 10**13 + 3}
    counts = spark.createDataFrame([("en", len(p.split()), p, n) for p, n in f.items()], "lang string, words int, phrase string, f long")
    (row,) = C._scored(counts, 2).collect()
    assert row["score"] == 10**6 * f["a b"] ** 2 // (f["a"] * f["b"])


def test_nulls_empty_texts_repeated_rows_and_clashing_columns(spark):
    rows = [("A b", "en", 1, "x")] * 12 + [(None, "en", 2, "y"), ("", None, 3, None), ("a b", None, 4, None), ("...", "fr", 5, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", rank long, phrase string")
    got = [tuple(r) for r in collocations(df).collect()]
    assert got == [("en", 1, "a b", 12, 12, 12, 24, 10**6)]


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_very_long_text(spark):
    rows = [("in the end " * 200_000, "en"), ("in the", "en")]
    got = [tuple(r) for r in collocations(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == brute(rows, Settings())

"""SimHash groups against brute force over all pairs."""

import random

import pytest
import xxhash

from custvalue.llm import simhash as S
from custvalue.llm.components import connected_components


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def slow_fingerprint(text, n=3):
    """The definition, bit by bit."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(values, distance):
    """Least value reachable from each value over links of at most ``distance`` bits."""
    roots = {v: v for v in values}

    def root(v):
        while roots[v] != v:
            v = roots[v]
        return v

    for a in values:
        for b in values:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance:
                x, y = sorted((root(a), root(b)))
                roots[y] = x
    return {v: root(v) for v in values}


def clustered(seed, n=250):
    rng, out = random.Random(seed), set()
    while len(out) < n:
        base = rng.choice(sorted(out)) & (2**64 - 1) if out and rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 4)):
            base ^= 1 << rng.randrange(64)
        out.add(signed(base))
    return sorted(out)


@pytest.mark.parametrize("distance,crowded", [(2, 4096), (2, 1), (0, 4096), (1, 2), (3, 3), (4, 2), (5, 4096)])
def test_links_equal_all_pairs_within_the_distance(spark, distance, crowded):
    values = clustered(distance)
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
    found = S.links(spark.createDataFrame([(v,) for v in values], "fp long"), distance, crowded).collect()
    assert {tuple(sorted(r)) for r in found} == want


def test_crowded_segments_find_the_same_links(spark):
    rng = random.Random(3)
    values = sorted({signed((0x2BCD1234 << 32) | (1 << rng.randrange(32)) | (1 << rng.randrange(32))) for _ in range(300)})
    values += [v ^ (1 << 40) for v in values[::3]]
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    found = S.links(spark.createDataFrame([(v,) for v in values], "fp long"), 2, crowded=20).collect()
    assert {tuple(sorted(r)) for r in found} == want


def test_fingerprints_follow_the_definition(spark):
    texts = ["", None, " \t\n", "One", "one  TWO", "a b c", "A B C d", "a a a a a a", "É b c\x0bd", "x " * 5000, "\x1cq r s t"]
    found = S.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 3)
    assert [r["fp"] for r in found.orderBy("id").collect()] == [signed(slow_fingerprint(t)) for t in texts]


def test_fingerprints_of_many_chunks_of_shingles(monkeypatch):
    monkeypatch.setattr(S, "_CHUNK", 4)
    for n in (3, 6, 7, 10, 11, 12, 13, 40):
        for text in ("a b " * n, " ".join(f"w{i}" for i in range(n))):
            assert S.fingerprint(text.encode(), 3) == signed(slow_fingerprint(text))


def test_components_are_the_brute_force_groups(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(120):
        if texts and rng.random() < 0.6:
            edited = rng.choice(texts).split()
            edited[rng.randrange(len(edited))] = rng.choice(words)
            texts.append(" ".join(edited))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.choice([40, 400]))))
    texts += [texts[0]] * 20 + ["", None, " "]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids), ids)), "doc_id long, text string, fp string, component_id long")
    prints = [signed(slow_fingerprint(t)) for t in texts]
    roots = slow_roots(sorted(set(prints)), 2)
    least = {}
    for i, p in zip(ids, prints):
        least[roots[p]] = min(i, least.get(roots[p], i))
    want = {i: (f"{p & (2**64 - 1):016x}", least[roots[p]]) for i, p in zip(ids, prints)}
    found = S.near_duplicates(rows).collect()
    assert len(found) == len(texts) and {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == want
    kept = S.one_of_each_group(rows)
    assert kept.columns == rows.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "quite another text here"), (7, None)]
    found = S.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in found) == [(-1, -1), (-1, 4), (4, 4), (4, 4), (7, 7)]
    assert S.one_of_each_group(spark.createDataFrame(rows, schema)).count() == 4
    empty = spark.createDataFrame([], schema)
    assert S.near_duplicates(empty).collect() == [] and S.one_of_each_group(empty).collect() == []


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    a, b, c = ("one two three four five six seven", "quite another text that stays by itself", "no word of this is in the rest at all")
    rows = [(5, a), (5, b), (3, b), (None, c), (None, c), (None, c), (6, c + " x"), (6, "p q r s t"), (6, "p q r s t")]
    rows += [(9, f"text number {i} has words w{i} x{i} y{i} z{i}") for i in range(50)]
    frame = spark.createDataFrame([(*r, 1, n) for n, r in enumerate(rows)], "doc_id long, text string, _row int, id int")
    prints = [signed(slow_fingerprint(t)) for _, t in rows]
    roots = slow_roots(sorted(set(prints)), 2)
    first, nameless = {}, {}
    for n, ((i, _), p) in enumerate(zip(rows, prints)):
        least = first if i is not None else nameless
        least[roots[p]] = min((i or 0, n), least.get(roots[p], (i or 0, n)))
    kept = S.one_of_each_group(frame)
    assert kept.columns == frame.columns
    assert sorted(r["id"] for r in kept.collect()) == sorted(n for _, n in [*first.values(), *nameless.values()])


def test_components_of_long_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, i) for i in range(1001, 1200)]
    edges = path[::-1] + star + [(5000, 5000), (7, 3), (3, 7), (None, 4), (2000, 2001), (2002, 2001)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "x long, y long")).collect()))
    assert found == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1200)} | {i: 2000 for i in (2000, 2001, 2002)}
    assert connected_components(spark.createDataFrame([], "x long, y long")).collect() == []

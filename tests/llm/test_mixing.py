"""Mixing against the definition in plain Python, and its cases."""

import re
from collections import Counter
from fractions import Fraction

import pytest

from custvalue.llm import mixing
from custvalue.llm.mixing import Mix, mix_documents, mix_plan

SCHEMA = "doc_id long, text string, source string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def resharing(sizes, mix):
    """Targets by sharing again and again what sources above their limit cannot take."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(names)}
    cap = {s: Fraction(sizes[s] * mix.most) for s in names}
    words_left, open_, target = Fraction(mix.share) * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: words_left * weight[s] / total for s in open_}
        over = {s for s in open_ if share[s] > cap[s]}
        if not over:
            return target | share
        target |= {s: cap[s] for s in over}
        words_left -= sum(cap[s] for s in over)
        open_ -= over
    return target


def rows_of(n):
    return [(i, "w " * (1 + i * 7 % 13), f"s{min(i % 11, i % 5)}" if i % 17 else None) for i in range(n)]


@pytest.mark.parametrize("mix", [Mix(), Mix((1, 5), 0.7, 3, 4), Mix((2,), 1.0, 1, 1)])
def test_targets_and_copies(spark, mix):
    rows = rows_of(400)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    want = resharing(sizes, mix)
    got = mix_plan(spark.createDataFrame(rows, SCHEMA), mix).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == words(rows[r["id"]][1]) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12)
        rate = r["target"] / r["source_size"]
        assert int(rate) <= r["copies"] <= min(mix.most, int(rate) + 1)


def test_sources_come_near_their_targets(spark):
    rows = [(i, "word " * (1 + (i * i) % 300), f"s{i % 7}") for i in range(3000)]
    taken, target = Counter(), {}
    for r in mix_plan(spark.createDataFrame(rows, SCHEMA)).collect():
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) < 0.01 * target[s] for s in target)


def test_reruns_agree_however_rows_are_dealt(spark):
    df = spark.createDataFrame(rows_of(500), SCHEMA)
    first = sorted(map(tuple, mix_plan(df).collect()), key=str)
    assert first == sorted(map(tuple, mix_plan(df.repartition(13, "text")).collect()), key=str)


def test_documents_are_emitted_with_all_columns(spark):
    rows = [(i, "a b c", f"s{i % 3}", i * 2, "x", "y") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA + ", size long, _size string, copies string")
    plan = {r["id"]: r["copies"] for r in mix_plan(df).collect()}
    out = mix_documents(df)
    assert out.schema == df.schema
    found = out.collect()
    assert Counter(r["doc_id"] for r in found) == Counter({i: n for i, n in plan.items() if n})
    assert all(tuple(r) == rows[r["doc_id"]] for r in found)


def test_a_large_table_of_sources_is_not_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(200), SCHEMA)
    want = sorted(map(tuple, mix_plan(df).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mix_plan(df).collect()), key=str) == want


def test_nulls_empty_texts_and_repeated_rows(spark):
    rows = [(None, "a b", "s"), (None, "a b", "s"), (1, None, "s"), (1, "", None), (2, "x" * 200_000 + " y", None), (3, None, "empty")]
    got = sorted(map(tuple, mix_plan(spark.createDataFrame(rows, SCHEMA)).select("id", "source", "size", "source_size").collect()), key=str)
    want = [(None, "s", 2, 4), (None, "s", 2, 4), (1, "s", 0, 4), (1, None, 0, 2), (2, None, 2, 2), (3, "empty", 0, 0)]
    assert got == sorted(want, key=str)
    alike = [r["copies"] for r in mix_plan(spark.createDataFrame(rows[:2], SCHEMA)).collect()]
    assert len(set(alike)) == 1
    empty = mix_plan(spark.createDataFrame([(1, "", "a"), (2, None, "b")], SCHEMA)).collect()
    assert [(r["target"], r["copies"]) for r in empty] == [(0.0, 0), (0.0, 0)]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mix_plan(df).collect() == [] and mix_documents(df).collect() == []


def test_no_python_in_the_plan(spark):
    df = mix_plan(spark.createDataFrame(rows_of(50), SCHEMA))
    text = df._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", text)

"""Language identification and toxicity: accuracy on held-out texts, kernels by definition, and odd rows."""

import random
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest

from custvalue.llm import langid, toxicity
from custvalue.llm.labelled import remainder, sample_per_class

WORDS = {
    "en": "the of and to in was that house with water morning evening under".split(),
    "de": "der die und ist nicht Haus mit Wasser Morgen Abend unter über schön".split(),
    "fr": "le la et est pas maison avec eau matin soir sous été garçon".split(),
}
SMALL = toxicity.Settings(per_class=200, buckets=1 << 14, document_sample=100)


def sentence(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang], k=n))


def test_kernel_outputs_follow_the_definition():
    settings = langid.Settings(landmarks=2, ridge=1e-2)
    rng = random.Random(1)
    texts = [sentence(rng, y, 30) for y in ("de", "en") for _ in range(6)]
    labels = ["de"] * 6 + ["en"] * 6
    model = langid.fit(texts, labels, settings)
    sets = [set(langid.grams(t, settings).tolist()) for t in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    marks = [sets[i] for i in (0, 1, 6, 7)]
    kmm = np.array([[kernel(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(kmm)
    whiten = vector / np.sqrt(value)
    x = np.array([[kernel(a, b) for b in marks] for a in sets]) @ whiten / np.sqrt(6)
    y = np.where(np.array(labels)[:, None] == np.array(["de", "en"]), 1, -1) / np.sqrt(6)
    solved = np.linalg.solve(x.T @ x + 1e-2 * np.eye(4), x.T @ y)
    new = [sentence(rng, "en", 9), "Haus und Wasser", "zzz"]
    found = [langid.grams(t, settings) for t in new]
    want = np.array([[kernel(set(g.tolist()), m) for m in marks] for g in found]) @ whiten @ solved
    assert np.allclose(model.outputs(found), want, atol=1e-4)


def test_n_grams_are_the_distinct_ones_of_whole_texts():
    settings = langid.Settings()
    count = lambda t: len(langid.grams(t, settings))
    padded = " abc ab "
    assert count("Abc, 1 ab") == len({padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)})
    assert count(None) == count("") == count("12 $%") == 0
    assert set(langid.grams("a " * 50_000 + "q", settings)) > set(langid.grams("a " * 50_000, settings))


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, y, rng.choice([1, 5, 80])), y) for i, y in enumerate(rng.choices(list(WORDS), k=400))]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 34!", "fr"), (None, "the house", None), (3, "der die das", "de")]
    return rows


def test_languages_of_held_out_rows(spark, texts):
    df = spark.createDataFrame([(i, t, y, "clash", 0.5) for i, t, y in texts], "doc_id long, text string, lang string, lang_pred string, score double")
    taught = df.filter((remainder(df["doc_id"], 4) != 2) & df["lang"].isNotNull())
    model = langid.fit_on(taught, langid.Settings(per_language=50, landmarks=10), "doc_id", "text", "lang")
    got = langid.predict_languages(df, model).collect()
    assert len(got) == len(texts)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] != 3}
    assert [found[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert found[None][0] == "en" and all(0 <= s <= 1 for _, s in found.values())
    right = [found[i][0] == y for i, _, y in texts if i is not None and i < 1000 and i != 3]
    assert np.mean(right) > 0.98
    kept = langid.keep_languages(df, model, least=0.3)
    assert kept.schema == df.schema and {1000, 1001, 1002} & {r["doc_id"] for r in kept.collect()} == set()
    assert {r["lang"] for r in langid.keep_languages(df, model, ["de"]).collect()} <= {"de", None, "en", "fr"}


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    model = langid.fit([], [])
    assert {r["lang_pred"] for r in langid.predict_languages(df, model).collect()} == {"und"}
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert [r["score"] for r in toxicity.score_documents(df, labels, SMALL).collect()] == [pytest.approx(0, abs=1e-6)] * 2
    empty = df.filter("false")
    assert toxicity.score_documents(empty, labels, SMALL).collect() == []
    assert langid.predict_languages(empty, model).collect() == []


def toxic_rows(n=500):
    rng = random.Random(3)
    bad = ["fool", "dunce", "nitwit"]
    rows = []
    for i in range(n):
        words = rng.choices([w for x in WORDS.values() for w in x], k=rng.choice([1, 4, 30, 400]))
        if i % 3 == 0:
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_toxic_documents_long_short_and_misspelt(spark):
    rows = toxic_rows()
    df = spark.createDataFrame([(i, t, "clash", 0.0) for i, t, _ in rows] + [(900, None, "", 0.0), (901, "", "", 0.0), (None, "a fool", "", 0.0)], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(900, None), (None, 1), (1, 0)], "doc_id long, label int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(df, labels, SMALL).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i % 5 == 0]
    assert np.mean(held) > 0.97 and got[None] >= 0.5 and got[900] < 0.5 and got[901] < 0.5
    kept = toxicity.drop_toxic(df, labels, settings=SMALL)
    assert kept.schema == df.schema
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}
    learnt = [(t, y) for i, t, y in rows if i % 5]
    model = toxicity.fit([t for t, _ in learnt], [y for _, y in learnt], SMALL)
    scorer = toxicity.Scorer(model.weights, model.offset, SMALL)
    assert min(scorer.scores(["the fooool was in the house", "nitwitt!", "what a DUNCE."])) > max(scorer.scores(["the house was with water", "Abend"]))
    long = " ".join(["water"] * 30_000)
    assert scorer.scores([long + " fool " + long])[0] > 0.5 > scorer.scores([long])[0]


def test_toxic_words_late_in_runs_without_spaces():
    rows = toxic_rows()
    model = toxicity.fit([t for _, t, _ in rows], [y for *_, y in rows], SMALL)
    scorer = toxicity.Scorer(model.weights, model.offset, SMALL)
    for sign in ",_/|。":
        clean = sign.join(["water", "house", "morning"] * 40)
        bad, good = scorer.scores([sign.join([clean, "fool", clean]), clean])
        assert bad > 0.5 > good
    clean = "waterhousemorning" * 30
    bad, good = scorer.scores([clean + "nitwit" + clean, clean])
    assert bad > 0.5 > good


def test_long_runs_keep_all_their_n_grams():
    grams = lambda w: {w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)}
    rng = random.Random(5)
    for n in (41, 42, 56, 57, 200, 201, 1000):
        run = "".join(chr(0x0E01 + rng.randrange(40)) for _ in range(n))
        parts = toxicity.words(f"a {run} b")
        assert parts[0] == "a" and parts[-1] == "b" and set().union(*map(grams, parts[1:-1])) == grams(run)
    assert toxicity.words("-" * 500) == [] and toxicity.words("a," * 30) == ["a"] * 30


def test_fitted_sample_of_a_table_with_a_hot_id(spark, monkeypatch):
    rows = toxic_rows(90)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, settings: sorted(zip(texts, labels)))
    read = lambda df, n: toxicity.fit_on(df, labels, toxicity.Settings(per_class=n), "doc_id", "text")
    table = lambda more: spark.createDataFrame(more + [(i, t) for i, t, _ in rows], "doc_id long, text string")
    copies = table([(0, rows[0][1])] * 2000)
    assert read(copies, 90) == sorted({(t, y) for _, t, y in rows})
    others = table([(1, f"text {i}") for i in range(2000)])
    got = read(others, 90)
    assert len(got) <= 90 + toxicity.TEXTS_PER_ID and {(t, y) for i, t, y in rows if i != 1} <= set(got)
    assert got == read(others.repartition(7), 90)
    twice = spark.createDataFrame([(i, f"{t} {n}") for i, t, _ in rows for n in range(2)], "doc_id long, text string")
    assert read(twice, 90) == sorted({(f"{t} {n}", y) for _, t, y in rows for n in range(2)})
    few = read(others, 20)
    assert {y for _, y in few} == {0, 1} and few == read(others.repartition(7), 20)


def test_scores_equal_the_model_layer_by_layer():
    model = toxicity.fit([t for _, t, _ in toxic_rows(90)], [y for *_, y in toxic_rows(90)], SMALL)
    text = "the fool, fool and water"
    scores = []
    for window in (["the"], ["fool,", "fool"], ["and", "water"]):  # five words in runs of at most two
        hidden = np.zeros(SMALL.dim)
        for word in window:
            *grams, own = toxicity.subwords([word], SMALL)[0]
            hidden += (model.table[grams].mean(axis=0) + SMALL.own * model.table[own]) / SMALL.window
        logits = hidden @ model.layer + model.bias
        scores.append(np.exp(logits[1]) / np.exp(logits).sum())
    got = toxicity.Scorer(model.weights, model.offset, SMALL).scores([text])[0]
    assert got == pytest.approx(max(scores), rel=1e-4)


def test_held_out_toxic_documents_of_all_languages_are_found():
    folder = "/root/testdata/sf0.1"
    sql = f"select doc_id, text, toxic from '{folder}/documents.parquet' join '{folder}/labels.parquet' using (doc_id) order by 1"
    rows = duckdb.sql(sql).fetchall()
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows]
    learnt = [r for r, h in zip(rows, held) if not h]
    model = toxicity.fit([t for _, t, _ in learnt], [y for *_, y in learnt])
    rest = [r for r, h in zip(rows, held) if h]
    z = np.array(toxicity.Scorer(model.weights, model.offset, model.settings).logits([t for _, t, _ in rest]))
    toxic = np.array([y for *_, y in rest]) == 1
    assert (z[toxic] >= 0).mean() > 0.88 and (z[~toxic] >= 0).mean() < 0.02
    assert (z[toxic] > np.quantile(z[~toxic], 0.99)).mean() > 0.87


def test_samples_are_bounded_and_repeatable(spark):
    df = spark.range(4000).selectExpr("id", "if(id % 100 = 0, 'rare', 'common') as c").union(spark.sql("select null, 'x'"))
    rows = sample_per_class(df, "c", "id", 60)
    assert [sum(r["c"] == c for r in rows) for c in ("rare", "common")] == [40, 60]
    assert [r["id"] for r in rows] == [r["id"] for r in sample_per_class(df.repartition(7), "c", "id", 60)]


def test_fit_takes_few_bytes_a_word():
    rng = random.Random(8)
    named = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(30_000)]
    texts = [" ".join(rng.choices(named, k=2000)) + " vile" * (i % 2) for i in range(200)]
    settings = toxicity.Settings(buckets=1 << 14, document_sample=10, document_epochs=1, window_rounds=1, windows_seen=0)
    tracemalloc.start()
    model = toxicity.fit(texts, [i % 2 for i in range(200)], settings)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(model.weights).all() and peak < 100 * 400_000

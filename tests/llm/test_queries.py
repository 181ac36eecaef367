"""Registered queries: contracts on the test tables, and the pipeline stage by stage."""

import zlib

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from custvalue.llm import queries as Q
from custvalue.llm import simhash
from tests.check_oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_topk": "query_id long, rank int, vec_id long, score long",
    "op2_html": "page_id long, url string, text string, n_chars long",
    "op3_sentencepiece": "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean",
    "op4_simhash": "doc_id long, fingerprint string, component_id long",
    "op5_ann": "query_id long, rank int, vec_id long, score double",
    "op6_langid": "doc_id long, held_out boolean, lang_pred string, score double",
    "op7_packing": "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    "op8_url_filter": "page_id long, host string, path string, rule string, verdict string",
    "op9_token_file": "doc_id long, start long, n_tokens long, ids_crc32 long",
    "op10_toxicity": "doc_id long, held_out boolean, score double, predicted int",
    "op11_whitening": "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double",
    "op12_collocations": "lang string, rank long, phrase string, a long, l long, r long, n long, score long",
    "op13_mixing": "doc_id long, size long, source_size long, target double, taken long",
}


def test_all_are_registered():
    assert set(COLUMNS) | {"pipeline"} <= set(entry_points.queries())
    assert list(Q.QUERIES) == list(COLUMNS)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_of_the_contract(spark, name):
    want = [x.split() for x in COLUMNS[name].split(", ")]
    got = entry_points.queries()[name](spark, SF_DIR)
    assert [[c, t.replace("bigint", "long")] for c, t in got.dtypes] == want


@pytest.mark.parametrize("name", ["op1_topk", "op8_url_filter", "op12_collocations", "op13_mixing"])
def test_equals_sql(spark, name):
    assert compare(spark, connect(SF_DIR), SF_DIR, name) is None


def test_held_out_documents(spark):
    for name, divisor, rest in (("op6_langid", 4, 2), ("op10_toxicity", 5, 0)):
        for r in entry_points.queries()[name](spark, SF_DIR).collect():
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % divisor == rest)


def test_stages_keep_the_columns_and_act(spark):
    docs = Q.table(spark, SF_DIR, "documents")
    toxic, language, single, packed = [f for _, f in corpus_pipeline.STAGES]
    scores = {r["doc_id"]: r["predicted"] for r in Q.op10_toxicity(spark, SF_DIR).collect()}
    clean = toxic(spark, docs, SF_DIR).checkpoint()
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, bad in scores.items() if not bad}
    kept = language(spark, clean, SF_DIR).checkpoint()
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} - {r["doc_id"] for r in kept.collect()} <= {
        r["doc_id"] for r in clean.collect() if not any(map(str.isalpha, r["text"] or ""))
    }
    one = single(spark, kept, SF_DIR).checkpoint()
    groups = simhash.near_duplicates(kept, shingle_words=3, distance=2).collect()
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({r["component_id"] for r in groups})
    pieces = packed(spark, one, SF_DIR).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in one.collect()}
    whole = {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in pieces}
    run = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sum(r["length"] for r in run) == sum(x[2] for x in whole)


def test_stages_of_an_empty_table(spark):
    docs = Q.table(spark, SF_DIR, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.collect() == []
        docs = Q.table(spark, SF_DIR, "documents").filter("false")

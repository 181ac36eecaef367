"""A pipeline over documents: drop toxic ones, keep known languages, drop near-duplicates, pack the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from custvalue.llm import langid, packing, queries, simhash, toxicity
from custvalue.session import materialise

LEAST_LANGUAGE_SCORE = 0.3  # of languages scored as one, no more than chance


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not call toxic."""
    return toxicity.drop_toxic(docs, queries.toxic_labels(spark, sf_dir))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters, or scored no better than chance, go."""
    return langid.keep_languages(docs, queries.language_model(docs), least=LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates."""
    return simhash.one_of_each_group(docs, shingle_words=3, distance=2)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, as pieces of sequences of at most 2048 tokens, with their ids."""
    return packing.pack(docs, queries.TOKENIZER, packing.Limits(tokens=2048), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("language id", keep_known_languages),
    ("near-duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # classifiers and tokenizers have no SQL; tests compare stages with their definitions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each but the last is written to the checkpoint folder."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

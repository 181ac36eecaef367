"""The registered queries of this subpackage: thin digests of the operators, under the names of their contracts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custvalue.llm import ann, collocations, html, langid, mixing, packing, pieces, simhash, tokenfile, topk, toxicity, urls, whitening
from custvalue.llm.labelled import remainder

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER, VOCABULARY = public_tokenizers.path("byte_bpe_50k.json"), 50257
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")

URL_RULES = (
    urls.Rule("allow", "com/"),
    urls.Rule("block", "example.com/en/"),
    urls.Rule("allow", "www.example.com/en/"),
    urls.Rule("block", "net/es/"),
    urls.Rule("block", "net/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer scores of every fiftieth vector against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    found = topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of the pieces of every document, and whether they decode to its text."""
    vocab = pieces.vocabulary(PIECE_MODEL)
    return pieces.encode(table(spark, sf_dir, "documents"), vocab, digested=True)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, distance=2)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors found for every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    found = ann.nearest(vectors.filter("vec_id % 20 = 0"), vectors, k=20)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def language_model(docs: DataFrame) -> langid.Model:
    """The model learned from texts and languages of the documents that are not held out."""
    taught = docs.filter((remainder(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull())
    return langid.fit_on(taught, langid.Settings(), "doc_id", "text", "lang")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict_languages(docs, language_model(docs))
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and packed into sequences of at most 2048 tokens."""
    packed = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, packing.Limits(tokens=2048), end_id=1, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page urls; a page's labelled outcome is the label of its id: bad if toxic or of low quality."""
    labels = table(spark, sf_dir, "labels")
    bad = F.greatest(F.col("toxic"), 1 - F.col("quality")).cast("int")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    judged = urls.filter_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES)
    rates = [F.round(c, 6).alias(c) for c in ("bound", "limit")]
    return judged.select("page_id", "host", "path", "rule", "verdict", "n", "bad", *rates)


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to bit-packed files and read back from them."""
    folder = tokenfile.new_folder(spark, "token-files")
    files = tokenfile.write(table(spark, sf_dir, "documents"), folder, TOKENIZER, VOCABULARY, end_id=0)
    return tokenfile.read(files, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, label`` of the labelled documents that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 5) != 0)
    return labels.select("doc_id", F.col("toxic").alias("label"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), toxic_labels(spark, sf_dir))
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened scores of every vector along the first 32 principal components."""
    white = whitening.whiten(table(spark, sf_dir, "embeddings"), components=32, scale=whitening.Scale(64, 1_000_000))
    return white.withColumn("deviation", F.col("deviation").cast("long"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two or three words of each language."""
    settings = collocations.Settings(longest=3, least=10, inside_percent=50, first=2000)
    return collocations.collocations(table(spark, sf_dir, "documents"), settings)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document: half as many again as there are, sources weighed 3, 1, 2 in turn."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"), mixing.Mix(weights=(3, 1, 2), share=1.5, most=2))
    return plan.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


QUERIES: dict[str, Query] = {
    "op1_topk": op1_topk,
    "op2_html": op2_html,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_simhash": op4_simhash,
    "op5_ann": op5_ann,
    "op6_langid": op6_langid,
    "op7_packing": op7_packing,
    "op8_url_filter": op8_url_filter,
    "op9_token_file": op9_token_file,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_collocations": op12_collocations,
    "op13_mixing": op13_mixing,
}

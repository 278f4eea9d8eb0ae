"""The operators of this subpackage, each over its whole driver table."""

from __future__ import annotations

import importlib

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, divergence, itq, licenses, negatives, packing, quality, secrets, sentencepiece, simhash, tokencounts, toxicity
from .common import table

PACK_TOKENIZER = "word_bpe_49k.json"


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every row whose vec_id is divisible by 20, among all rows."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.expr("id % 20 = 0"), k=20)


def op2_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of all paragraphs, confirmed by a notice."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, links at two bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_open_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 4,096."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path(PACK_TOKENIZER), with_ids=False).drop("ids")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, checked by the library's ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False).drop("ids")


def op6_itq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and whether it is kept of every vector, at a cosine of 0.9."""
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def _fold(of: int, out: int) -> Column:
    return (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of)) == out).alias("held_out")


def op7_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of a third of the ids are left out of the fit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(quality.labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", 3, 1))
    return quality.score(docs, model).select("doc_id", _fold(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from documents encoded whole."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencounts.count_by_section(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, counted and listed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(docs, secrets.train(docs)))


def op10_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of a fourth of the ids are left out of the fit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", _fold(4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_winnowed_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a window of the benchmark, and the items."""
    docs, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.contamination(docs, bench))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ, in pairs and by their own terms."""
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five negatives for each positive of every row whose vec_id is divisible by 100; labels are shifted where it is divisible by 7."""
    shifted = F.expr("if(id % 7 = 0, (label + 1) % 10, label)")
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.expr("id % 100 = 0"), shifted)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_permutation_index, op2_license_paragraphs, op3_simhash_bk_trees, op4_open_window_packing, op5_sentencepiece,
        op6_itq_near_duplicates, op7_byte_cnn_quality, op8_section_tokens, op9_markov_secrets, op10_pu_toxicity,
        op11_winnowed_contamination, op12_source_divergence, op13_hard_negatives, pipeline,
    )
}


def oracles() -> dict[str, str]:
    """SQL where an operator has an SQL form; tests/llm compare the others with brute force."""
    return {
        "op2_license_paragraphs": licenses.oracle_sql(), "op11_winnowed_contamination": decontaminate.oracle_sql(),
        "op12_source_divergence": divergence.oracle_sql(), "op13_hard_negatives": negatives.oracle_sql(),
    }

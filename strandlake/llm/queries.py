"""The queries of the training-data operators with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, fmindex, html, licences, lines, lm, ngram_join, oracles, pii, quality, toxicity
from strandlake.llm.common import read

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.quality(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES), public_tokenizers.PATTERN).drop("lang", "text")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path(BYTE_BPE)))
    encoded = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(encoded, vocabulary).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(read(spark, sf_dir, "documents"), n=4, percent=85)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.held_out(F.col("doc_id"), 1)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    among = F.coalesce(~out, F.lit(True))
    scored = lm.score(docs, docs.where(among), among=among)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_spans")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = fmindex.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id"), 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_byte_bpe, op3_ngram_join, op4_lm_scoring, op5_pii, op6_decontamination, op7_line_dedup, op8_toxicity, op9_licence_scan, op10_html_extraction)}
ORACLES: dict[str, str] = {"op3_ngram_join": oracles.similarity(), "op6_decontamination": oracles.decontamination(), "op7_line_dedup": oracles.line_dedup()}

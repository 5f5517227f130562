"""The queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratiform.llm import bpe_replay, decontaminate, html_crf, ngram_join, ogg, pii_bootstrap, quotes, suffix_dedup, token_alignment, token_counts, toxicity_pu, vector_codes, warc
from stratiform.llm.common import table
from stratiform.llm.oracles import ORACLES
from stratiform.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ogg.media_features(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return html_crf.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity_pu.toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op4_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pii_bootstrap.digests(pii_bootstrap.find(table(spark, sf_dir, "documents", "doc_id", "text")))


def op5_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe_replay.token_digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffix_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return warc.roundtrip(table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_alignment.align(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_ogg_media, op2_html_crf, op3_toxicity_pu, op4_pii_bootstrap, op5_bpe_replay, op6_suffix_dedup, op7_quotation_links, op8_wu_manber, op9_ngram_join, op10_warc_reader, op11_vector_codes, op12_token_alignment, op13_token_counts)}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

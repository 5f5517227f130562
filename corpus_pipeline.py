"""A corpus pipeline of five of the operators, each stage over all that its predecessor kept.

Toxic documents go; of each group of near copies the document with the smallest id stays; documents
contaminated by the benchmark go; personal data is replaced by its kind in brackets; the rest is
tokenised. All stages but the last return the columns of ``documents``. Rows that a stage keeps keep
their other columns (n_chars follows the text).

Defined cases: null text and empty text pass every filter; a null id has no label and is no copy of
anything, its text is searched for benchmark passages and personal data as any other; of rows equal in
id and text the near-copy stage keeps one (the smallest by lang, source and n_chars), rows that share an
id but not the text are documents of their own; ids are whole numbers of up to 64 bits (or their text): others are
refused by the near-copy stage; an empty table stays empty; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratiform.llm import bitmap, bpe_replay, decontaminate, ngram_join, pii_bootstrap, toxicity_pu
from stratiform.llm.common import Scratch, pick, small_batches, table
from stratiform.shipping import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    ship(spark)
    small_batches(spark)
    docs = pick(docs, *COLUMNS)
    model = toxicity_pu.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity_pu.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    ship(spark)
    small_batches(spark)
    docs = pick(docs, *COLUMNS)
    # A row is told by its id and text: in the order of the ids, which the decimal form with an offset keeps.
    row = F.concat(F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0"), F.md5(F.coalesce("text", F.lit(""))))
    keyed = docs.withColumn("row_", row).withColumn("at_", F.xxhash64("row_"))
    scratch = Scratch(spark, "near-copies")
    judged = scratch.keep(ngram_join.classes(keyed.filter("row_ is not null"), "row_").select("row_", F.expr("coalesce(row_ <> component_id, false)").alias("gone")))
    # only rows that may go, or that stand there several times, are shuffled with their texts
    doubtful = scratch.keep(judged.groupBy("row_").agg(F.max("gone").alias("gone"), F.count("*").alias("n")).filter("gone or n > 1").select("row_", "gone", F.xxhash64("row_").alias("at_")))
    open_, clear = bitmap.parted(keyed, bitmap.build(doubtful, "at_"), "at_")
    first = Window.partitionBy("row_").orderBy("lang", "source", "n_chars")
    known = open_.filter("row_ is not null").join(doubtful.filter("gone").select("row_"), "row_", "left_anti").withColumn("n_", F.row_number().over(first)).filter("n_ = 1")
    return known.select(*COLUMNS).unionByName(clear.filter("row_ is not null").select(*COLUMNS)).unionByName(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    ship(spark)
    small_batches(spark)
    docs = pick(docs, *COLUMNS)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind in brackets."""
    ship(spark)
    small_batches(spark)
    docs = pick(docs, *COLUMNS)
    found = pii_bootstrap.find(docs).filter(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("spans"))
    keyed = pii_bootstrap.with_key(docs)
    text = pii_bootstrap.redact("text", "spans")
    masked = keyed.join(found, "key", "left").withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(text))
    return masked.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded bytes of every document left."""
    ship(spark)
    small_batches(spark)
    return bpe_replay.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("tokens", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    The tables of earlier stages are removed as soon as the next one is written, the last when the driver ends.
    """
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs

"""Sinks that name what they wrote: digests of runs and vectors, texts by content, reports of small tables."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.sources.artifacts import append_new
from stratiform.sources.files import vectors_problem, write_run
from stratiform.sources.layers import Stale, run_digest


def write_pinned_run(run: DataFrame, path: str) -> str:
    """Write a run and return its digest."""
    write_run(run, path)
    return run_digest(run)


def vector_digests(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, sha256) of every vector as 32-bit floats in text, the same for equal values."""
    text = F.array_join(F.transform(vector, lambda x: x.cast("float").cast("string")), ",")
    return vectors.select(key, F.sha2(text, 256).alias("sha256"))


def write_vectors(vectors: DataFrame, path: str, identity: Mapping[str, str], size: int, key: str = "vec_id", vector: str = "embedding") -> None:
    """Write unit vectors of one size next to their identity, and read them back: what is stored must hash as what was given."""
    if bad := vectors_problem(vectors, vector, size).limit(1).collect():
        raise ValueError(f"no unit vector of {size}: {bad[0][key]}")
    spark = vectors.sparkSession
    vectors.write.mode("errorifexists").parquet(f"{path}/vectors")
    back, given = vector_digests(spark.read.parquet(f"{path}/vectors"), key, vector), vector_digests(vectors, key, vector)
    if given.exceptAll(back).union(back.exceptAll(given)).limit(1).collect():
        raise Stale("vectors read back differ from those written")
    rows = spark.createDataFrame(sorted((k, str(v)) for k, v in identity.items()), "name string, value string")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/identity")


def read_vectors(spark: SparkSession, path: str, identity: Mapping[str, str]) -> DataFrame:
    """Vectors whose identity is the one asked for, field by field."""
    found = {r.name: r.value for r in spark.read.parquet(f"{path}/identity").collect()}
    asked = {k: str(v) for k, v in identity.items()}
    if found != asked:
        raise Stale("another identity: " + ", ".join(f"{k}: {found.get(k)} for {asked.get(k)}" for k in sorted(found.keys() | asked.keys()) if found.get(k) != asked.get(k)))
    return spark.read.parquet(f"{path}/vectors")


def put(texts: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Store texts by the SHA-256 of their bytes, each once, and return (sha256, text) of those given; what is there already stays as it is."""
    rows = texts.filter(F.col(text).isNotNull()).select(F.sha2(F.encode(F.col(text), "UTF-8"), 256).alias("sha256"), F.col(text).alias("text")).dropDuplicates(["sha256"])
    append_new(rows, path, ["sha256"])
    return rows


def get(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(sha256, text) of wanted digests; a missing one, or a text that no longer has its digest, is an error."""
    found = wanted.select("sha256").distinct().join(spark.read.parquet(path), "sha256", "left")
    if bad := found.filter(F.col("text").isNull() | (F.sha2(F.encode("text", "UTF-8"), 256) != F.col("sha256"))).limit(1).collect():
        raise Stale(f"no such artifact, or another text: {bad[0].sha256}")
    return found


def report(table: DataFrame, title: str, limit: int = 1000) -> str:
    """A small table as Markdown; more rows than ``limit`` are an error, a report is no dump."""
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are no report")
    cell = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else json.dumps(x, ensure_ascii=False) if isinstance(x, list) else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(table.columns) + " |", "|" + "-|" * len(table.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""])

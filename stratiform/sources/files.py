"""Typed readers and validated writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One record a line; a bad line stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def checked(df: DataFrame, **rules) -> DataFrame:
    """``df`` with every rule (a boolean column) enforced as rows are read or written."""
    for name, rule in rules.items():
        first = df.columns[0]
        df = df.withColumn(first, F.when(F.coalesce(rule, F.lit(False)), F.col(first)).otherwise(F.raise_error(F.lit(f"rule broken: {name}")).cast(df.schema[first].dataType)))
    return df


def write_run(run: DataFrame, path: str) -> None:
    """A run (query_id, rank, doc_id, score) as JSON lines of aligned lists, one a query."""
    rows = run.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("x"))
    rows.select("query_id", F.col("x.doc_id").alias("doc_ids"), F.col("x.score").alias("scores")).write.mode("error").json(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    rows = read_jsonl(spark, path, T.StructType([T.StructField("query_id", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType()))]))
    return rows.select("query_id", F.posexplode(F.arrays_zip("doc_ids", "scores")).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.doc_ids").alias("doc_id"), F.col("x.scores").alias("score"))


def vectors_problem(df: DataFrame, vector: str, size: int, tolerance: float = 1e-3) -> DataFrame:
    """Rows whose vector has a wrong size, a value that isn't finite, or isn't of unit length."""
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x * x))
    bad = (F.size(vector) != size) | F.exists(vector, lambda x: F.isnan(x) | F.isnull(x)) | (F.abs(norm - 1) > tolerance)
    return df.filter(F.coalesce(bad, F.lit(True)))

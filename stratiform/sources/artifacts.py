"""Sinks that can be run again: append of new keys, sealed folders. Both work on any file system Spark writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key isn't there yet; a known key with other values stops the write before anything is written.

    A batch may repeat a key with the same values. A null key is a key like any other.
    """
    spark = df.sparkSession
    new = df.dropDuplicates()
    values = F.sha2(F.to_json(F.struct(*[c for c in df.columns if c not in keys]), {"ignoreNullFields": "false"}), 256)
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    marked = new.withColumn("values_", values)
    old = _existing(spark, path, df)
    every = marked.unionByName(old.withColumn("values_", values))
    clash = every.groupBy(*keys).agg(F.count_distinct("values_").alias("n")).filter("n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"key with other values: {clash[0].asDict()}")
    fresh = new.alias("a").join(old.select(*keys).distinct().alias("b"), same("a", "b"), "left_anti")
    fresh.write.mode("append").parquet(path)


def _existing(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return df.limit(0)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the data files of a folder, read by the executors."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def seal(df: DataFrame, path: str, problems: list[DataFrame]) -> None:
    """Write a folder and, next to it, its sealed manifest; with any problem row nothing is written."""
    for p in problems:
        if bad := p.limit(1).collect():
            raise ValueError(f"not sealed: {bad[0].asDict()}")
    df.write.mode("errorifexists").parquet(f"{path}/data")
    _files(df.sparkSession, f"{path}/data").coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")


def read_sealed(spark: SparkSession, path: str) -> DataFrame:
    """The data of a sealed folder; changed, missing or added files are an error."""
    held, sealed = _files(spark, f"{path}/data"), spark.read.parquet(f"{path}/manifest")
    if other := held.exceptAll(sealed).union(sealed.exceptAll(held)).limit(1).collect():
        raise ValueError(f"not as sealed: {other[0].name}")
    return spark.read.parquet(f"{path}/data")

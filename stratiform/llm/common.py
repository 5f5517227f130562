"""Helpers shared by the operators of this package: column picking, batches, scratch tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.scratch import BATCH_ROWS, Scratch, shared_dir, small_batches  # noqa: F401

#: Output batches of the Arrow operators are closed at this many payload bytes, so that a run of
#: very long texts never builds one huge batch.
BATCH_BYTES = 8 << 20


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, whatever else ``df`` holds (also names that differ only in case)."""
    at = [df.columns.index(n) for n in names]
    renamed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a Parquet table of the data folder."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return pick(df, *columns) if columns else df


def id_field(df: DataFrame, name: str) -> T.StructField:
    """The field of an id column, nullable."""
    return T.StructField(name, df.schema[name].dataType, True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], fields: list[T.StructField]) -> DataFrame:
    """``mapInArrow`` with the output given as Spark fields; a worker gives back what it freed when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()

    return df.mapInArrow(run, T.StructType(fields))


def release() -> None:
    """Return freed memory to the system: workers are used again by other stages, whose needs would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own house
        pass


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if "<" in kind else _ATOMS[kind], True)


_ATOMS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def apart(df: DataFrame, key: str, check: str, scratch: Scratch) -> DataFrame:
    """``df`` less ``check``, an independent second hash of what ``key`` is a 64-bit hash of: where one key has
    several checks, the rows get new keys made of both, so that together they are of 128 bits.

    Of keys that clash a large corpus has some hundreds; they are joined, not collected.
    """
    clash = scratch.keep(df.groupBy(key).agg(F.min(check).alias("lo_"), F.max(check).alias("hi_")).filter("lo_ <> hi_").select(F.col(key).alias("clash_")))
    if clash.isEmpty():
        return df.drop(check)
    marked = df.join(clash, F.col(key) == F.col("clash_"), "left")
    return marked.withColumn(key, F.when(F.col("clash_").isNull(), F.col(key)).otherwise(F.xxhash64(key, check))).select(*[c for c in df.columns if c != check])


def with_identity(df: DataFrame, text_col: str, name: str, scratch: Scratch) -> DataFrame:
    """Adds a long that is the same for equal texts only (null counts as empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = df.select(F.xxhash64(text).alias("k"), F.xxhash64(F.md5(text)).alias("c"))
    clash = keys.groupBy("k").agg(F.min("c").alias("lo_"), F.max("c").alias("hi_")).filter("lo_ <> hi_").select(F.col("k").alias("clash_"))
    clash = scratch.keep(clash)
    keyed = df.withColumn(name, F.xxhash64(text))
    if clash.isEmpty():
        return keyed
    marked = keyed.join(clash, F.col(name) == F.col("clash_"), "left")
    return marked.withColumn(name, F.when(F.col("clash_").isNull(), F.col(name)).otherwise(F.xxhash64(name, F.md5(text)))).select(*df.columns, name)

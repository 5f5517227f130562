"""Running sums over a whole table in the order of a value, without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratiform.scratch import Scratch


def running(df: DataFrame, order: str, weight: str, name: str = "below") -> DataFrame:
    """Adds ``name``: the sum of ``weight`` over all rows whose ``order`` (distinct values) is smaller.

    Rows are dealt by ranges of ``order`` and summed there; the ranges' totals, one row a range, are what a single
    window adds up. The dealt table lies in the shared folder, so that both passes see the same ranges.
    """
    dealt = Scratch(df.sparkSession, "prefix").keep(df.repartitionByRange(order).withColumn("range_", F.spark_partition_id()))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("range_").agg(F.sum(weight).alias("t_")).select("range_", F.coalesce(F.sum("t_").over(before().orderBy("range_")), F.lit(0)).alias("start_"))
    inside = F.coalesce(F.sum(weight).over(before("range_").orderBy(order)), F.lit(0))
    return dealt.withColumn("inside_", inside).join(totals, "range_").withColumn(name, F.col("start_") + F.col("inside_")).drop("range_", "start_", "inside_")

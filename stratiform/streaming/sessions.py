"""Sessions, late events and joins of two streams; every function takes batch frames, too, and gives the same rows.

A stream's watermark after a micro-batch is the latest event time seen, less the allowed delay. ``lateness`` says
the same of a table whose rows carry the number of their micro-batch, so that what a stream dropped can be
found again: Spark drops an event in a session window that would have closed at or before the watermark of the
micro-batch *before* the current one, and closes sessions at the watermark of the current one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stratiform.scratch import Scratch


def sessions(events: DataFrame, key: str, at: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """(key, start, end, n, first, last): runs of a key's events of which each is no more than ``gap`` behind another.

    On a stream, in output mode append, a session comes out once, when the watermark has passed its end.
    """
    marked = events.withWatermark(at, delay) if events.isStreaming else events
    each = marked.groupBy(key, F.session_window(at, gap).alias("w_")).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    return each.select(key, F.col("w_.start").alias("start"), F.col("w_.end").alias("end"), "n", "first", "last")


def lateness(events: DataFrame, batch: str, at: str, delay_s: float) -> DataFrame:
    """Adds ``watermark`` (of the micro-batch; null before the first) and ``filter`` (of the one before it) to rows with micro-batch numbers.

    One row a micro-batch goes into the window; it meets the events in a join on the number.
    """
    tops = events.groupBy(F.col(batch).alias("b_")).agg(F.max(at).alias("top"))
    order = Window.orderBy("b_")
    before = F.max("top").over(order.rowsBetween(Window.unboundedPreceding, -1)) - F.expr(f"interval {delay_s} seconds")
    marks = tops.select("b_", F.date_trunc("millisecond", before).alias("watermark")).withColumn("filter", F.lag("watermark").over(order))
    return events.join(marks, F.col(batch) == F.col("b_")).drop("b_")


def split_late(events: DataFrame, batch: str, at: str, gap_s: float, delay_s: float) -> tuple[DataFrame, DataFrame]:
    """(in time, late) events of a session stream: late are those whose own window of ``gap_s`` had closed by the filter's watermark."""
    marked = lateness(events, batch, at, delay_s)
    late = F.coalesce(F.col(at) + F.expr(f"interval {gap_s} seconds") <= F.col("filter"), F.lit(False))
    return marked.filter(~late).select(*events.columns), marked.filter(late).select(*events.columns, "filter")


def held_back(events: DataFrame, batch: str, at: str, gap_s: float, delay_s: float) -> DataFrame:
    """The events in time, for a stream with a delay of ``delay_s + gap_s``, and a last micro-batch that ends it.

    A stream closes a session as soon as the watermark has passed its end, and an event in time that would still have
    belonged to it begins another. One gap later none can come any more: with that delay every session is whole. The
    last micro-batch holds one event without a key a gap behind the latest, which takes the watermark to where
    it stands without the longer delay; its own session never comes out.
    """
    good, _ = split_late(events, batch, at, gap_s, delay_s)
    last = events.agg((F.max(batch) + 1).alias("b_"), (F.max(at) + F.expr(f"interval {gap_s} seconds")).alias("t_")).filter("t_ is not null")
    empty = [F.col({batch: "b_", at: "t_"}[f.name]).cast(f.dataType).alias(f.name) if f.name in (batch, at) else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
    return good.unionByName(last.select(*empty))


def replayed(events: DataFrame, batch: str, key: str, at: str, gap_s: float, delay_s: float) -> DataFrame:
    """What ``sessions`` puts out of a stream of the given micro-batches, in batch jobs: (key, start, end, n, first, last).

    A round is a micro-batch: its events in time join the open sessions, and those whose end the watermark has
    passed come out. An event that would have belonged to a session already closed begins another, as on the
    stream. Rounds are the micro-batches, one to close what the last watermark passes; the open
    sessions lie in the shared folder between them.
    """
    scratch = Scratch(events.sparkSession, "sessions")
    gap = F.expr(f"interval {gap_s} seconds")
    good, _ = split_late(events, batch, at, gap_s, delay_s)
    tops = sorted((r[0], r[1]) for r in events.groupBy(batch).agg(F.max(at)).collect())
    single = scratch.keep(good.select(F.col(batch).alias("b_"), key, F.col(at).alias("first"), F.col(at).alias("last"), F.lit(1).cast("long").alias("n")))
    open_, out, top = single.filter("false").drop("b_"), None, None
    for number, latest in [*tops, (None, None)]:
        now = single.filter(F.col("b_") == number).drop("b_") if number is not None else single.filter("false").drop("b_")
        order = Window.partitionBy(key).orderBy("first", "last")
        reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
        runs = open_.unionByName(now).withColumn("new_", F.coalesce(F.col("first") > reach + gap, F.lit(True)).cast("int")).withColumn("run_", F.sum("new_").over(order))
        state = scratch.keep(runs.groupBy(key, "run_").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("run_"))
        passed = F.col("last") + gap <= F.date_trunc("millisecond", F.lit(top)) - F.expr(f"interval {delay_s} seconds") if top is not None else F.lit(False)
        done = state.filter(passed)
        out, open_ = done if out is None else out.unionByName(done), state.filter(~passed)
        top = latest if top is None else top if latest is None else max(top, latest)
    return out.select(key, F.col("first").alias("start"), (F.col("last") + gap).alias("end"), "n", "first", "last")


def followed(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, within: str, left_delay: str = "10 minutes", right_delay: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Events of ``left`` with those of ``right`` of the same key that follow within a time; ``how`` inner or left_outer.

    Both sides have watermarks of their own and the bound on time lets Spark drop what can't meet any more. ``right``'s
    columns but the key are its own names. A left event without a partner comes out when none can come any more.
    """
    a = left.withWatermark(left_at, left_delay) if left.isStreaming else left
    b = (right.withWatermark(right_at, right_delay) if right.isStreaming else right).withColumnRenamed(key, "key_")
    met = (F.col(key) == F.col("key_")) & (F.col(right_at) >= F.col(left_at)) & (F.col(right_at) <= F.col(left_at) + F.expr(f"interval {within}"))
    return a.join(b, met, how).drop("key_")


def numbered(events: DataFrame, order: str, batches: int) -> DataFrame:
    """Adds ``batch``: equal shares of the events by their order, counted without one task that sees them all."""
    spread = events.agg(F.min(order).alias("low_"), F.max(order).alias("high_"))
    share = F.floor((F.col(order) - F.col("low_")) * F.lit(batches) / (F.col("high_") - F.col("low_") + 1)).cast("long")
    return events.crossJoin(F.broadcast(spread)).withColumn("batch", share).drop("low_", "high_")


def feed(events: DataFrame, path: str, batch: str = "batch") -> tuple[T.StructType, int]:
    """Write a table as the files of a stream, one a micro-batch and in their order; schema of the files and their number.

    A replay for tests and rehearsals: each micro-batch is one file, so it must fit a task.
    """
    numbers = sorted(r[0] for r in events.select(batch).distinct().collect())
    for n in numbers:
        events.filter(F.col(batch) == n).coalesce(1).write.mode("append").parquet(path)
    return events.schema, len(numbers)


def replay(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stream of ``feed``'s files, one a micro-batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stream over all that is there, in output mode append, into Parquet files at ``path``; run again it goes on where it stopped."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def instant(column: str) -> Column:
    """A time to the microsecond as text."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")

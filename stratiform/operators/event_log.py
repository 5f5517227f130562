"""Keyed, hash-chained logs: an append that may be repeated, and a verification that reads no log in order.

A store holds any number of logs. Each event has its place in its log (``seq`` from 1), and a digest (``own``)
that covers the digest before it (``previous``) and all the event says. A key is recorded once in a log: the same
kind and payload again add nothing, others are refused before anything is written.

An append writes its events and the new heads of the logs it touched into folders of their own and then a commit
file that names them, which no two writers can both create. Readers see committed folders only, so a run that
broke off leaves nothing behind, and one that is started again with the same batch name adds nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.scratch import Scratch
from stratiform.shipping import ship

GENESIS = "0" * 64
SAYS = ("key", "kind", "at", "payload")


class Diverged(ValueError):
    """A key is recorded with another kind or payload."""


class Conflict(RuntimeError):
    """Another writer committed first."""


def canonical(*columns: str) -> Column:
    """JSON of the columns in the order of their names, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def said() -> Column:
    """What an event's digest covers beside its place and the digest before it."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in SAYS]), {"ignoreNullFields": "false"})


def digest() -> Column:
    return F.sha2(F.concat_ws("\t", "previous", F.col("seq").cast("string"), said()), 256)


def linked(fresh: DataFrame, order: list[str]) -> DataFrame:
    """Adds seq, previous and own to events (log, key, kind, at, payload, head_seq, head_own).

    A log's new events are chained in order, one after the other; of the logs of a task one digest is held.
    """
    rows = fresh.withColumn("said_", said()).repartition("log").sortWithinPartitions("log", *order)
    at = [rows.columns.index(c) for c in ("log", "head_seq", "head_own", "said_")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, seq, last = object(), 0, GENESIS
        for batch in batches:
            places, before, own = [], [], []
            for name, n, head, text in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                if name != log:
                    log, seq, last = name, n or 0, head or GENESIS
                seq += 1
                places.append(seq)
                before.append(last)
                last = hashlib.sha256(f"{last}\t{seq}\t{text}".encode("utf-8", "surrogatepass")).hexdigest()
                own.append(last)
            kept = [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(places, pa.int64()), pa.array(before, pa.string()), pa.array(own, pa.string())], names)

    keep = [rows.columns.index(c) for c in ("log", *SAYS)]
    schema = T.StructType([*(rows.schema.fields[k] for k in keep), T.StructField("seq", T.LongType()), T.StructField("previous", T.StringType()), T.StructField("own", T.StringType())])
    names = schema.fieldNames()
    return rows.mapInArrow(run, schema)


def problems(events: DataFrame, heads: DataFrame) -> DataFrame:
    """(log, seq, problem) of events that aren't what they were when they were appended.

    Every row's digest is worked out where the row lies, and each place of a log meets the digest of the one
    before it: rows are dealt by (log, seq), so that one huge log is checked by all tasks. ``digest``: the row isn't
    what its digest covers; ``link``: it doesn't follow the digest before it; ``gap``: the place before it is empty;
    ``repeated``: its place is taken twice; ``key``: its key stands in the log before; ``head``: the log doesn't
    end where its head (log, seq, own) says.
    """
    rows = events.select("log", "seq", "key", "previous", "own", (~F.col("own").eqNullSafe(digest())).alias("forged"))
    here = rows.select("log", "seq", "previous", F.lit(None).cast("string").alias("before"), "forged", F.lit(1).alias("n"))
    behind = rows.select("log", (F.col("seq") + 1).alias("seq"), F.lit(None).cast("string").alias("previous"), F.col("own").alias("before"), F.lit(False).alias("forged"), F.lit(0).alias("n"))
    met = here.unionByName(behind).groupBy("log", "seq").agg(F.sum("n").alias("n"), F.max("forged").alias("forged"), F.min("previous").alias("low"), F.max("previous").alias("previous"), F.min("before").alias("other"), F.max("before").alias("before"))
    first = F.col("seq") == 1
    before = F.when(first, F.lit(GENESIS)).otherwise(F.col("before"))
    off = lambda c: ~F.col(c).eqNullSafe(before)
    either = F.when(first, False).otherwise(F.coalesce(F.col("other") != F.col("before"), F.lit(False)))
    marks = F.array_compact(F.array(F.when(F.col("forged"), "digest"), F.when(~first & F.col("before").isNull(), "gap").when((off("low") | off("previous")) & ~either, "link"), F.when(F.col("n") > 1, "repeated")))
    broken = met.filter("n > 0").select("log", "seq", F.explode(marks).alias("problem"))
    ends = met.filter("n = 0 and seq > 1").select("log", (F.col("seq") - 1).alias("seq"), F.col("before").alias("own"))
    lost = heads.select("log", "seq", "own").join(ends, ["log", "seq", "own"], "left_anti").select("log", "seq", F.lit("head").alias("problem"))
    beyond = ends.join(heads.select("log", "seq", "own"), ["log", "seq", "own"], "left_anti").join(heads.select("log", F.col("seq").alias("end_")), "log", "left").filter("end_ is null or seq > end_").select("log", "seq", F.lit("head").alias("problem"))
    again = rows.filter("key is not null").groupBy("log", "key").agg(F.min("seq").alias("least_"), F.count("*").alias("n_")).filter("n_ > 1")
    twice = rows.join(again, ["log", "key"]).filter("seq > least_").select("log", "seq", F.lit("key").alias("problem"))
    return broken.unionByName(lost).unionByName(beyond).unionByName(twice)


class EventLog:
    """The store at ``path``, on any file system Spark writes. ``kind``: Spark type of the log column."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "string") -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T._parse_datatype_string(f"log {kind}, key string, kind string, at string, payload string, seq long, previous string, own string")
        self._heads = T._parse_datatype_string(f"log {kind}, seq long, own string")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """What was committed, oldest first; a compaction stands for all before it."""
        at, fs = self._fs(f"{self.path}/commits")
        if not fs.exists(at):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if not s.getPath().getName().startswith("."))
        rows = self.spark.read.text([f"{self.path}/commits/{n}" for n in names], wholetext=True).collect() if names else []
        return sorted((json.loads(r.value) for r in rows), key=lambda c: c["number"])

    def _live(self) -> list[dict]:
        found = self.commits()
        last = max((i for i, c in enumerate(found) if c["compacts"]), default=0)
        return found[last:]

    def _read(self, part: str, schema: T.StructType) -> DataFrame:
        folders = [f"{self.path}/{part}/{c['folder']}" for c in self._live()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        """(log, key, kind, at, payload, seq, previous, own) of all committed events."""
        return self._read("events", self.schema)

    def heads(self) -> DataFrame:
        """(log, seq, own): the last event of every log."""
        return self._read("heads", self._heads).groupBy("log").agg(F.max("seq").alias("seq"), F.max_by("own", "seq").alias("own"))

    def _commit(self, number: int, folder: str, batch: str | None, n: int, compacts: bool) -> None:
        at, fs = self._fs(f"{self.path}/commits/{number:012d}")
        fs.mkdirs(at.getParent())
        try:
            out = fs.create(at, False)
        except Exception as e:
            raise Conflict(f"commit {number} exists: another writer was first") from e
        out.write(bytearray(json.dumps({"number": number, "folder": folder, "batch": batch, "events": n, "compacts": compacts}).encode()))
        out.close()

    def append(self, df: DataFrame, order: tuple[str, ...] = ("at", "key"), batch: str | None = None) -> int:
        """Record the events (log, key, kind, at, payload) that aren't yet, in order of ``order`` inside a log; how many were new.

        Rows without a key are always new. ``batch`` names the append: one of that name that was committed is not
        repeated. A key of another kind or payload, in the batch or recorded, raises ``Diverged``; a null log ValueError.
        """
        ship(self.spark)
        done = self.commits()
        if batch is not None and any(c["batch"] == batch for c in done):
            return 0
        scratch = Scratch(self.spark, "append")
        columns = ["log", *SAYS, *[c for c in order if c not in ("log", *SAYS)]]
        kinds = {f.name: f.dataType for f in self.schema.fields}
        rows = scratch.keep(df.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in columns]))
        if not rows.filter("log is null").isEmpty():
            raise ValueError("an event without a log")
        says = F.sha2(F.to_json(F.struct("kind", "payload"), {"ignoreNullFields": "false"}), 256)
        keyed = rows.filter("key is not null")
        asked = keyed.select("log", "key").distinct()
        held = self.events().filter("key is not null").select("log", "key", says.alias("says_"), F.lit(1).alias("old_")).join(asked, ["log", "key"], "left_semi")
        told = scratch.keep(keyed.select("log", "key", says.alias("says_"), F.lit(0).alias("old_")).unionByName(held).groupBy("log", "key").agg(F.min("says_").alias("a_"), F.max("says_").alias("b_"), F.max("old_").alias("old_")))
        if clash := told.filter("a_ <> b_").limit(1).collect():
            raise Diverged(f"key {clash[0].key!r} of log {clash[0].log!r} is recorded with another kind or payload")
        once = Window.partitionBy("log", "key").orderBy(*order)
        new = keyed.join(told.filter("old_ = 1").select("log", "key"), ["log", "key"], "left_anti").withColumn("k_", F.row_number().over(once)).filter("k_ = 1").drop("k_")
        fresh = new.unionByName(rows.filter("key is null")).join(self.heads().select("log", F.col("seq").alias("head_seq"), F.col("own").alias("head_own")), "log", "left")
        number, folder = (done[-1]["number"] + 1 if done else 0), uuid.uuid4().hex
        linked(fresh, list(order)).write.parquet(f"{self.path}/events/{folder}")
        written = self.spark.read.schema(self.schema).parquet(f"{self.path}/events/{folder}")
        written.groupBy("log").agg(F.max("seq").alias("seq"), F.max_by("own", "seq").alias("own")).write.parquet(f"{self.path}/heads/{folder}")
        n = written.count()
        self._commit(number, folder, batch, n, False)
        scratch.drop(rows, told)
        return n

    def sink(self, name: str, order: tuple[str, ...] = ("at", "key")) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: micro-batches are appends named by the stream and their number."""

        def append(df: DataFrame, number: int) -> None:
            self.append(df, order, f"{name}/{number}")

        return append

    def compact(self) -> None:
        """All events in one folder, dealt by log; readers of the old folders are not disturbed."""
        found = self.commits()
        if found:
            folder = uuid.uuid4().hex
            self.events().repartition("log", F.floor(F.col("seq") / 1_000_000)).write.parquet(f"{self.path}/events/{folder}")
            self.heads().write.parquet(f"{self.path}/heads/{folder}")
            self._commit(found[-1]["number"] + 1, folder, None, 0, True)

    def verify(self) -> DataFrame:
        """(log, seq, problem) of the committed events; empty if all is as it was appended."""
        return problems(self.events(), self.heads())

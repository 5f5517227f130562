"""Intermediate tables in the folder that the driver and all executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Seconds between two releases of finished shuffles.
RELEASE_S = 2.0


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir. Where it is unset, a session of
    one machine gets a temporary one that goes with the interpreter; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="stratiform-")
        atexit.register(shutil.rmtree, folder, True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of an Arrow batch where texts are read: those of Spark's default would hold tens of megabytes on each side.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows, if they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Intermediate tables of one operator, written to the shared folder to cut the lineage.

    ``keep`` writes a table and reads it again, ``drop`` removes those no longer needed. What a
    returned DataFrame still reads stays until the interpreter ends.
    """

    _released = 0.0

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._end)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        self._release()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _release(self) -> None:
        """Spark removes the shuffle files of what nothing refers to any more when the driver's JVM collects;
        an idle driver seldom does, and the files of every finished step would stay on the executors' disks."""
        if time.monotonic() - Scratch._released > RELEASE_S:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            Scratch._released = time.monotonic()

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _remove(self.spark, t._scratch_path)

    def _end(self) -> None:
        try:
            _remove(self.spark, self.root)
        except Exception:  # the session has ended before the interpreter
            pass

"""Chained logs: appends that overlap, diverge, repeat and break off; verification of forged, lost and cut rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from stratiform.operators import event_log
from stratiform.operators.event_log import Conflict, Diverged, EventLog

SCHEMA = "log string, key string, kind string, at string, payload string"


def rows(spark, *items):
    return spark.createDataFrame([(log, key, kind, f"2024-01-01T00:00:{at:02d}", payload) for log, key, kind, at, payload in items], SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return EventLog(spark, f"file://{tmp_path}/log")


def plain_chain(events):
    """(log, seq) -> own by hand, from rows in order."""
    out, heads = {}, {}
    for log, key, kind, at, payload in events:
        seq, last = heads.get(log, (0, event_log.GENESIS))
        said = {k: v for k, v in zip(("key", "kind", "at", "payload"), (key, kind, at, payload), strict=True)}
        own = hashlib.sha256(f"{last}\t{seq + 1}\t{json.dumps(said, separators=(',', ':'), ensure_ascii=False)}".encode()).hexdigest()
        heads[log] = (seq + 1, own)
        out[log, seq + 1] = own
    return out


def test_appends_that_overlap_make_one_chain(spark, store):
    a = [("x", "k1", "put", 1, "é"), ("x", "k2", "put", 2, None), ("y", "k1", "put", 1, "p")]
    b = [("x", "k2", "put", 2, None), ("x", "k3", "del", 3, "r"), ("x", None, "note", 4, "s"), ("z", "k1", "put", 1, "q"), ("z", "k1", "put", 5, "q")]
    assert store.append(rows(spark, *a)) == 3
    assert store.append(rows(spark, *b)) == 3
    said = [(log, k, kind, f"2024-01-01T00:00:{t:02d}", p) for log, k, kind, t, p in [*a, b[1], b[2], b[3]]]
    assert {(r.log, r.seq): r.own for r in store.events().collect()} == plain_chain(said)
    assert {(r.log, r.seq) for r in store.heads().collect()} == {("x", 4), ("y", 1), ("z", 1)}
    assert store.verify().collect() == []


def test_a_divergence_writes_nothing(spark, store):
    store.append(rows(spark, ("x", "k1", "put", 1, "p")))
    before = store.events().count(), len(store.commits())
    for bad in ([("x", "k2", "put", 2, "n"), ("x", "k1", "put", 1, "other")], [("x", "k1", "del", 1, "p")], [("x", "k5", "put", 1, "a"), ("x", "k5", "put", 1, "b")]):
        with pytest.raises(Diverged):
            store.append(rows(spark, *bad))
    with pytest.raises(ValueError):
        store.append(rows(spark, (None, "k", "put", 1, "p")))
    assert (store.events().count(), len(store.commits())) == before
    assert store.append(rows(spark, ("w", "k1", "put", 1, "other"))) == 1  # a key is its log's


def test_repeated_and_broken_runs_add_nothing(spark, store):
    batch = rows(spark, ("x", "k1", "put", 1, "p"), ("x", None, "note", 2, "q"))
    assert store.append(batch, batch="run/0") == 2
    assert store.append(batch, batch="run/0") == 0
    assert store.append(batch) == 1  # without a name the keyed one is known, the note is new
    # a run that broke off before its commit left a folder nobody reads
    event_log.linked(batch.withColumn("head_seq", F.lit(0).cast("long")).withColumn("head_own", F.lit(None).cast("string")), ["at"]).write.parquet(f"{store.path}/events/lost")
    assert store.events().count() == 3 and store.verify().collect() == []
    with pytest.raises(Conflict):
        store._commit(0, "other", None, 1, False)


def test_compaction_keeps_the_chain(spark, store):
    for k in range(3):
        store.append(rows(spark, *[("x", f"k{k}{i}", "put", i, "p") for i in range(4)]))
    before = sorted(store.events().collect())
    store.compact()
    assert sorted(store.events().collect()) == before and len(store._live()) == 1
    assert store.append(rows(spark, ("x", "k00", "put", 0, "p"), ("x", "new", "put", 9, "p"))) == 1
    assert store.verify().collect() == [] and store.heads().collect()[0].seq == 13


def test_verification_names_what_was_done(spark, store):
    store.append(spark.range(2000).select(F.when(F.col("id") < 1900, "hot").otherwise("cold").alias("log"), F.concat(F.lit("k"), "id").alias("key"), F.lit("put").alias("kind"), F.lpad("id", 6, "0").alias("at"), F.col("id").cast("string").alias("payload")))
    events, heads = store.events().cache(), store.heads().cache()
    found = lambda e, h=heads: sorted((r.log, r.seq, r.problem) for r in event_log.problems(e, h).collect())
    assert found(events) == []
    at = (F.col("log") == "hot") & (F.col("seq") == 700)
    assert found(events.withColumn("payload", F.when(at, "forged").otherwise(F.col("payload")))) == [("hot", 700, "digest")]
    own = events.withColumn("payload", F.when(at, "forged").otherwise(F.col("payload"))).withColumn("own", F.when(at, event_log.digest()).otherwise(F.col("own")))
    assert found(own) == [("hot", 701, "link")]  # a digest made to fit breaks the next link
    assert found(events.filter(~at)) == [("hot", 701, "gap")]
    assert found(events.filter("not (log = 'hot' and seq > 1890)")) == [("hot", 1900, "head")]
    assert found(events.filter("log = 'hot'")) == [("cold", 100, "head")]
    assert found(events, heads.filter("log = 'hot'")) == [("cold", 100, "head")]
    twice = found(events.unionByName(events.filter(at).withColumn("own", F.lit("f"))))
    assert ("hot", 700, "repeated") in twice and ("hot", 700, "digest") in twice
    again = events.unionByName(events.filter(at).withColumn("seq", F.lit(1901).cast("long")))
    assert ("hot", 1901, "key") in found(again)


def test_a_huge_log_is_not_read_by_one_task(spark, store):
    """The verification deals one log's rows over all tasks: no window, and no shuffle by the log alone."""
    store.append(rows(spark, *[("x", f"k{i}", "put", i % 60, "p") for i in range(50)]))
    plan = store.verify()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert "hashpartitioning(log#" in plan and all("seq#" in x or "key#" in x or "log#" in x for x in plan.split("hashpartitioning(")[1:])


def test_a_stream_appends_once(spark, store, tmp_path):
    path, check = f"file://{tmp_path}/in", f"file://{tmp_path}/check"
    for k in range(3):
        rows(spark, *[(f"l{i % 2}", f"k{i}", "put", i, "p") for i in range(2 * k, 2 * k + 4)]).coalesce(1).write.mode("append").parquet(path)

    def run(checkpoint):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
        stream.writeStream.foreachBatch(store.sink("feed")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run(check)
    assert store.events().count() == 8 and store.verify().collect() == []
    first = sorted(store.events().collect())
    run(check)
    run(f"{check}-lost")  # the stream's own record is gone: the batches' names and the keys hold
    assert sorted(store.events().collect()) == first

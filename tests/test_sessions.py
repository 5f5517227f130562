"""Session streams and joins of two streams against batch jobs, row by row, with events that come late."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stratiform.streaming import sessions as S

START = dt.datetime(2024, 3, 1, 12)


def arrivals(seed, n=160, batches=5):
    """Events of four users over five micro-batches, some of earlier times than those before."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        batch = i * batches // n
        at = START + dt.timedelta(seconds=batch * 3000 + rnd.randrange(3000) - (rnd.choice([0, 2500, 5000, 9000]) if rnd.random() < 0.3 else 0), microseconds=rnd.randrange(10**6))
        out.append((i, f"u{rnd.randrange(4)}", at, batch))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_of_a_stream_are_those_of_batch_jobs(spark, tmp_path, seed):
    events = spark.createDataFrame(arrivals(seed), "id long, user string, at timestamp, batch long")
    schema, n = S.feed(events, f"file://{tmp_path}/in")
    assert n == 5
    out = S.sessions(S.replay(spark, f"file://{tmp_path}/in", schema), "user", "at", "240 seconds", "600 seconds")
    S.drain(out, f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    S.drain(S.sessions(S.replay(spark, f"file://{tmp_path}/in", schema), "user", "at", "240 seconds", "600 seconds"), f"file://{tmp_path}/out", f"file://{tmp_path}/check")  # nothing is left to do
    got = sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").collect()))
    want = sorted(map(tuple, S.replayed(events, "batch", "user", "at", 240, 600).collect()))
    assert got == want and len(got) > 40
    good, late = S.split_late(events, "batch", "at", 240, 600)
    assert late.count() > 3 and good.count() + late.count() == 160
    # every event is in a session that came out, late, or in one that was still open
    assert sum(r[3] for r in got) <= good.count()


def test_late_events_are_those_whose_window_had_closed(spark):
    s = lambda x: START + dt.timedelta(seconds=x)
    rows = [(0, s(1000), 0), (1, s(2000), 1), (2, s(10), 1), (3, s(10), 2), (4, s(190), 2), (5, s(191), 2), (6, s(3000), 2), (7, s(1000), 3)]
    events = spark.createDataFrame(rows, "id long, at timestamp, batch long")
    _, late = S.split_late(events, "batch", "at", 60, 750)
    # micro-batch 2 filters by the watermark of micro-batch 1 (1000 - 750 s), 3 by that of 2 (2000 - 750 s)
    assert sorted(r.id for r in late.collect()) == [3, 4, 7]
    marks = {r.id: (r.watermark, r.filter) for r in S.lateness(events, "batch", "at", 750).collect()}
    assert marks[0] == (None, None) and marks[1] == (s(250), None) and marks[3] == (s(1250), s(250)) and marks[7] == (s(2250), s(1250))


def test_sessions_of_a_table(spark):
    s = lambda x: START + dt.timedelta(seconds=x)
    events = spark.createDataFrame([("a", s(0)), ("a", s(59)), ("a", s(120)), ("b", s(0)), (None, s(5))], "user string, at timestamp")
    got = sorted((str(r.user), r.n, r.first, r.last) for r in S.sessions(events, "user", "at", "60 seconds").collect())
    assert got == [("None", 1, s(5), s(5)), ("a", 1, s(120), s(120)), ("a", 2, s(0), s(59)), ("b", 1, s(0), s(0))]


@pytest.mark.parametrize("how", ["inner", "left_outer"])
def test_two_streams_join_as_two_tables(spark, tmp_path, how):
    rnd = random.Random(7)
    rows = [(i, f"u{rnd.randrange(3)}", START + dt.timedelta(seconds=i * 40 + rnd.randrange(-100, 100)), i * 4 // 200, rnd.random() < 0.5) for i in range(200)]
    every = spark.createDataFrame(rows, "id long, user string, at timestamp, batch long, buys boolean")
    left = every.filter("not buys").select("id", "user", "at", "batch")
    right = every.filter("buys").select(F.col("id").alias("other"), "user", F.col("at").alias("bought"), "batch")
    streams = []
    for name, side in (("l", left), ("r", right)):
        schema, _ = S.feed(side, f"file://{tmp_path}/{name}")
        streams.append(S.replay(spark, f"file://{tmp_path}/{name}", schema).drop("batch"))
    out = S.followed(*streams, "user", "at", "bought", "5 minutes", "10 minutes", "10 minutes", how)
    S.drain(out, f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    got = {(r.id, r.other) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    want = {(r.id, r.other) for r in S.followed(left.drop("batch"), right.drop("batch"), "user", "at", "bought", "5 minutes", how=how).collect()}
    assert {p for p in got if p[1] is not None} == {p for p in want if p[1] is not None}
    if how == "left_outer":  # those without a partner come out once none can come any more
        alone = {p[0] for p in got if p[1] is None}
        assert alone <= {p[0] for p in want if p[1] is None} and len(alone) > 5
        end = min(r[0] for r in (left.agg(F.max("at")).first(), right.agg(F.max("bought")).first())) - dt.timedelta(minutes=10)
        assert {p[0] for p in want if p[1] is None} - alone <= {r.id for r in left.filter(F.col("at") >= end - dt.timedelta(minutes=6)).collect()}


def test_numbered_shares(spark):
    got = sorted((r.id, r.batch) for r in S.numbered(spark.range(10, 20), "id", 4).collect())
    assert [b for _, b in got] == [0, 0, 0, 1, 1, 2, 2, 2, 3, 3] and S.numbered(spark.range(0), "id", 4).count() == 0


def test_event_in_time_joins_a_session_whose_end_has_passed(spark, tmp_path):
    from pyspark.sql import functions as F

    from stratiform.streaming import sessions as S

    rows = [(0, 1, 0), (0, 3, 87), (0, 2, 100), (1, 2, 101), (2, 3, 90), (2, 1, 5), (2, 2, 200), (2, None, 199)]
    events = spark.createDataFrame(rows, "batch long, k long, s long").select("batch", "k", F.timestamp_seconds("s").alias("at"))
    schema, n = S.feed(S.held_back(events, "batch", "at", 10, 2), f"{tmp_path}/in")
    assert n == 4
    out = S.sessions(S.replay(spark, f"{tmp_path}/in", schema), "k", "at", "10 seconds", "12 seconds")
    S.drain(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").select("k", F.col("start").cast("long"), F.col("end").cast("long"), "n")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 10, 1), (2, 100, 111, 2), (3, 87, 100, 2)]
    assert not S.held_back(events.filter("false"), "batch", "at", 10, 2).count()

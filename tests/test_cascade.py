"""Cascades against a plain fold, and running sums dealt by ranges."""

import random

import pytest
from pyspark.sql import functions as F

from stratiform.operators import cascade, prefix


def plain(rows, share):
    cases = {}
    for case, positive, stage, answered, hit, claims, passed in rows:
        cases.setdefault(case, (positive, {}))[1][stage] = (answered, hit, claims, passed)
    rate = {s: sum(r[6] for r in rows if r[1] and r[2] == s) / sum(r[5] for r in rows if r[1] and r[2] == s) for s in (1, 2, 3)}
    out = []
    for s in (2, 3):
        rescued = broader = lost = after = before = 0
        for positive, by in cases.values():
            first = next((k for k in range(1, s) if by[k][0]), None)
            had, own = first is not None and by[first][1], by[s][0] and by[s][1]
            rescued += positive and first is None and own
            broader += positive and not had and own
            lost += positive and had and not own
            after += not positive and (first is not None or by[s][0])
            before += not positive and first is not None
        drop = rate[1] - rate[s]
        gates = [rescued >= 3, after <= before, drop <= 0.05, None if share.get(s) is None else share[s] >= 0.9]
        out.append((s, rescued, broader, lost, after, before, round(drop, 6), *gates, all(g is True for g in gates), "supported" if gates[3] is None else ""))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stages(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for case in range(120):
        positive = rnd.random() < 0.7
        for stage in (1, 2, 3):
            claims = rnd.randint(1, 5)
            rows.append((case, positive, stage, rnd.random() < 0.3 if positive else rnd.random() < 0.02, rnd.random() < 0.7, claims, claims - (rnd.random() < 0.3 / stage)))
    df = spark.createDataFrame(rows, "case int, positive boolean, stage int, answered boolean, hit boolean, claims int, passed int").repartition(3)
    support = spark.createDataFrame([(2, 0.9)] if seed < 3 else [(2, 0.85), (3, 0.95)], "stage int, share double")
    got = [tuple(r) for r in cascade.stages(df, support).orderBy("stage").collect()]
    assert got == plain(rows, {2: 0.9} if seed < 3 else {2: 0.85, 3: 0.95})
    assert cascade.stages(df).filter("unresolved = ''").count() == 0


def test_a_stage_without_claims_is_degraded(spark):
    df = spark.createDataFrame([(1, True, 1, True, True, 2, 2), (1, True, 2, False, False, 0, 0)], "case int, positive boolean, stage int, answered boolean, hit boolean, claims int, passed int")
    row = cascade.stages(df).first()
    assert row.drop is None and row.not_degraded is False and row.justified is False


def test_running_sums(spark):
    rnd = random.Random(4)
    rows = [(v, rnd.randrange(5)) for v in rnd.sample(range(10_000), 1500)]
    df = spark.createDataFrame(rows, "v long, w int").repartition(5)
    total, want = 0, {}
    for v, w in sorted(rows):
        want[v] = total
        total += w
    out = prefix.running(df, "v", "w")
    assert {r.v: r.below for r in out.collect()} == want
    assert prefix.running(df.limit(0), "v", "w").count() == 0
    assert df.agg(F.sum("w")).first()[0] == total

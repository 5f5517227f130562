"""Seeded draws against random.Random, dealing against its own optimum, at sizes that no driver list holds."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from stratiform.operators import design, draws


def groups(df):
    out = {}
    for g, place, x in df.collect():
        out.setdefault(g, []).append((place, x))
    return {g: [x for _, x in sorted(rows)] for g, rows in out.items()}


def test_draws_are_pythons(spark):
    rows = [(f"g{i % 7}", i) for i in range(200)] + [("ü", 5), (None, 6), (None, 4)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(5)
    items = {}
    for g, x in rows:
        items.setdefault(g, []).append(x)
    shuffled, sampled, chosen = ({} for _ in range(3))
    for g, own in items.items():
        mine = sorted(own)
        random.Random(f"s:{g}").shuffle(mine)
        shuffled[g] = mine
        sampled[g] = random.Random(f"s:{g}").sample(sorted(own), min(4, len(own)))
        rng = random.Random(f"s:{g}")
        chosen[g] = [rng.choice(sorted(own)) for _ in range(3)]
    assert groups(draws.shuffled(df, "g", "x", "s")) == shuffled
    assert groups(draws.sampled(df, "g", "x", "s", 4)) == sampled
    assert groups(draws.chosen(df, "g", "x", "s", 3)) == chosen
    assert {r.g: r["items"] for r in draws.together(df, "g", "x", "s").collect()} == shuffled
    assert draws.shuffled(df.limit(0), "g", "x", "s").count() == 0


def test_replicates_are_one_sequence(spark, monkeypatch):
    for seed, n, reps, size in ((7, 13, 50, 100), ("text", 5, 9, 5), (0, 1, 3, 10), (2**70, 300, 4, 1000)):
        monkeypatch.setattr(draws, "TASK_DRAWS", size)
        rng = random.Random(seed)
        want = [(rep, place) for rep in range(reps) for place in rng.choices(range(n), k=n)]
        got = {}
        for rep, place in draws.replicates(spark, n, reps, seed).collect():
            got.setdefault(rep, []).append(place)
        assert [(rep, p) for rep in sorted(got) for p in got[rep]] == want
    assert draws.replicates(spark, 0, 5, 1).count() == 0 and draws.replicates(spark, 5, 0, 1).count() == 0


def test_quotas_can_not_be_bettered():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes, batches = rng.integers(2, 4, 3), int(rng.integers(2, 5))
        profiles = [p for p in itertools.product(*map(range, sizes)) if rng.random() < 0.7] or [(0, 0, 0)]
        counts = rng.integers(1, 12, len(profiles))
        values = np.array([[int(p[k] == v) for k in range(3) for v in range(sizes[k])] for p in profiles])
        taken = design.quotas(counts, values, batches)
        assert (taken >= 0).all() and (taken.sum(1) == counts).all() and np.ptp(taken.sum(0)) <= 1

        def distance(t, values=values, counts=counts, batches=batches):
            return float((((t.T @ values) - counts @ values / batches) ** 2).sum())

        now = distance(taken)
        for a, b in itertools.permutations(range(batches), 2):
            for p, q in itertools.product(range(len(profiles)), repeat=2):
                if p != q and taken[p, a] and taken[q, b]:
                    other = taken.copy()
                    other[[p, p, q, q], [a, b, b, a]] += [-1, 1, -1, 1]
                    assert distance(other) >= now - 1e-9


def test_many_rows_are_dealt(spark):
    """A hundred thousand rows, half of them of one profile."""
    df = spark.range(100_001).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") % 37).cast("string")).alias("p"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("q"))
    dealt = df.join(design.deal(df, "id", ["p", "q"], 4), "id").cache()
    assert sorted(r["count"] for r in dealt.groupBy("batch").count().collect()) == [25_000, 25_000, 25_000, 25_001]
    spread = dealt.groupBy("p", "q").pivot("batch", [0, 1, 2, 3]).count().na.fill(0)
    assert spread.filter(F.greatest("0", "1", "2", "3") - F.least("0", "1", "2", "3") > 4).count() == 0
    again = {r.id: r.batch for r in design.deal(df.repartition(7), "id", ["p", "q"], 4).filter("id < 2000").collect()}
    assert again == {r.id: r.batch for r in dealt.filter("id < 2000").collect()}

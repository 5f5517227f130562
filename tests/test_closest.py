"""Top-k set similarity join against all pairs, and how few pairs it meets."""

import random

import pytest

from stratiform.operators import closest as closest_module
from stratiform.operators.closest import closest


def plain(items, top):
    sets = {k: set(w or []) for k, w in items}
    out = []
    for a, x in sets.items():
        scored = sorted((-round(len(x & y) / len(x | y), 9) if x | y else 0.0, b) for b, y in sets.items() if b != a)
        out += [(a, b, -s + 0.0, r) for r, (s, b) in enumerate(scored[:top], 1)]
    return sorted(out)


def run(spark, items, top, rounds=None):
    df = spark.createDataFrame(items, "id long, w array<string>").repartition(3)
    return sorted((r.a, r.b, r.jaccard, r["rank"]) for r in closest(df, "id", "w", top, rounds).collect())


def texts(seed, n, vocabulary, size):
    """Sets of words of falling frequency; some are copies or near copies of others."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if out and rnd.random() < 0.4:
            w = list(rnd.choice(out)[1])
            w = w if rnd.random() < 0.4 else [x if rnd.random() < 0.8 else f"w{rnd.randrange(vocabulary)}" for x in w]
        else:
            w = [f"w{int(vocabulary * rnd.random() ** 3)}" for _ in range(rnd.randint(1, size))]
        out.append((i, w))
    return out


@pytest.mark.parametrize("seed,n,vocabulary,size,top,part", [(1, 120, 40, 8, 3, 20_000), (2, 150, 2000, 30, 2, 5), (3, 60, 9, 4, 5, 20_000), (4, 40, 3000, 60, 1, 3)])
def test_all_pairs(spark, monkeypatch, seed, n, vocabulary, size, top, part):
    monkeypatch.setattr(closest_module, "PART", part)
    items = texts(seed, n, vocabulary, size)
    assert run(spark, items, top) == plain(items, top)


def test_odd_items(spark):
    items = [(1, None), (2, []), (3, ["a"]), (4, ["a", "a"]), (5, ["b"]), (6, ["a", "b", None])]
    assert run(spark, [(k, w if w is None else [x for x in w if x]) for k, w in items], 2) == plain([(k, [x for x in w or [] if x]) for k, w in items], 2)
    assert run(spark, [], 3) == [] and run(spark, [(1, ["a"])], 3) == []
    copies = [(i, ["x", "y"]) for i in range(30)]
    assert run(spark, copies, 3) == plain(copies, 3)


def test_far_fewer_pairs_are_met_than_there_are(spark):
    """Every item shares its most common words with most others, and has a near partner by its rare ones."""
    rnd = random.Random(6)
    items = []
    for i in range(300):
        common = [f"c{k}" for k in rnd.sample(range(20), 6)]
        own = [f"r{i // 3}x{k}" for k in range(10)]
        items.append((i, common + own[: rnd.randint(8, 10)]))
    rounds = []
    assert run(spark, items, 2, rounds) == plain(items, 2)
    assert sum(pairs for _, pairs in rounds) < 0.05 * 300 * 299 and rounds[0][0] >= 290

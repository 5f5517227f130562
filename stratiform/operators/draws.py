"""Seeded draws as Python's ``random.Random`` makes them, on the executors: one generator a group, or one long stream of draws in parts.

A group's generator is seeded by text (the seed and the group), so its draws depend on nothing but that; they
are the same on any cluster and in a plain script. The items of a group are put in order before they are drawn,
and one task draws a group, as a shuffle is one sequence. What it holds of a group are its items' keys.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.shipping import ship

#: Draws of a task of ``replicates``.
TASK_DRAWS = 2_000_000


def _drawn(df: DataFrame, group: str, item: str, seed: str, draw: Callable[[random.Random, list], list]) -> DataFrame:
    """(group, place, item): ``draw`` applied to each group's ordered items with a generator of its own."""
    ship(df.sparkSession)
    rows = df.select(group, item).repartition(group).sortWithinPartitions(group, item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            out = draw(random.Random(f"{seed}:{now}"), held)
            return pa.RecordBatch.from_arrays([pa.array([now] * len(out), kinds[0]), pa.array(range(1, len(out) + 1), pa.int64()), pa.array(out, kinds[1])], names)

        kinds, begun = None, False
        for batch in batches:
            kinds = batch.schema.types
            for g, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if begun and g != now:
                    yield close()
                    held = []
                begun, now = True, g
                held.append(x)
        if begun:
            yield close()

    names = [group, "place", item]
    return rows.mapInArrow(run, T.StructType([T.StructField(group, df.schema[group].dataType), T.StructField("place", T.LongType()), T.StructField(item, df.schema[item].dataType)]))


def shuffled(df: DataFrame, group: str, item: str, seed: str) -> DataFrame:
    """(group, place, item): every group's items, in order, then as ``random.Random(f"{seed}:{group}").shuffle`` leaves them."""

    def draw(rng: random.Random, items: list) -> list:
        rng.shuffle(items)
        return items

    return _drawn(df, group, item, seed, draw)


def sampled(df: DataFrame, group: str, item: str, seed: str, k: int) -> DataFrame:
    """(group, place, item): ``sample(items, k)`` of every group, all its items in drawn order where it has fewer."""
    return _drawn(df, group, item, seed, lambda rng, items: rng.sample(items, min(k, len(items))))


def chosen(df: DataFrame, group: str, item: str, seed: str, k: int = 1) -> DataFrame:
    """(group, place, item): k draws with ``choice``, one after the other, of every group."""
    return _drawn(df, group, item, seed, lambda rng, items: [rng.choice(items) for _ in range(k)])


def skipped(seed: int | str, draws: int) -> np.random.RandomState:
    """Numpy's generator in the state of ``random.Random(seed)`` after so many of its ``random()``."""
    _, state, _ = random.Random(seed).getstate()
    rng = np.random.RandomState()
    rng.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
    while draws > 0:
        rng.random_sample(min(draws, 1 << 20))
        draws -= 1 << 20
    return rng


def replicates(spark: SparkSession, n: int, reps: int, seed: int | str) -> DataFrame:
    """(rep, place): what one ``random.Random(seed)`` draws with ``choices(range(n), k=n)``, replicate by replicate.

    Replicates are dealt to tasks; each runs the generator up to its first one (some nanoseconds a draw) and goes on
    from there, so the draws are those of one sequence and the driver makes none of them.
    """
    ship(spark)
    each = max(1, TASK_DRAWS // max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rng, first = skipped(seed, k * each * n), k * each
                for rep in range(first, min(reps, first + each)):
                    place = np.floor(rng.random_sample(n) * float(n)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, rep, np.int64)), pa.array(place)], ["rep", "place"])

    tasks = -(-reps // each) if n else 0
    return spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(run, "rep long, place int")


def together(df: DataFrame, group: str, item: str, seed: str) -> DataFrame:
    """(group, items): each group's shuffled items in one array."""
    return shuffled(df, group, item, seed).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", item))), lambda x: x[item]).alias("items"))

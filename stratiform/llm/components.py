"""Connected components of a graph given by its edges, by alternating large and small stars.

Every step is a partial aggregation and a join that adaptive execution can split; lineage is cut by
tables in the shared folder; nothing of the graph goes to the driver but a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.llm import common as C


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of u goes to the smallest of u and its neighbours. Small: every smaller one, and u."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        joined = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return joined.filter("a <> b").distinct()


def components(edges: DataFrame, scratch: C.Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge (a, b); the component is its smallest node.

    Rounds grow with the logarithm of the longest path; ``rounds`` is only a guard, and passing it an error.
    """
    state = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        new = scratch.keep(_star(_star(state, True), False))
        scratch.drop(state)
        state = new
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are unfinished after {rounds} rounds")
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Designing a test set: the salted sampling bank, balanced dealing, strata of multi-valued keys, ledgers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.scratch import Scratch

#: Ranges of a key's hash in which the rows of a profile are numbered.
RANGES = 1 << 10


def drawn(salt: str, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(salt), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]), 256)


def bank(slots: DataFrame, units: DataFrame, salt: str, universe: int) -> DataFrame:
    """Candidates of a salted bank: (slot, copy, rank, act, article, node, earlier).

    ``slots`` (slot, act): every slot gives universe // n candidates, and one more the first universe % n slots in a draw. Candidates
    stand in the order of a draw of their name. The i-th demand of an act takes article i of its own drawn order, wrapping around;
    inside the article, the k-th use takes the k-th of ``units`` (act, article, node) after a drawn start.
    """
    names = slots.select("slot").distinct()
    n = max(1, names.count())
    extra = names.withColumn("draw_", drawn(salt, F.lit("extra"), "slot")).orderBy("draw_").limit(universe % n).select("slot", F.lit(1).alias("more_"))
    size = F.lit(universe // n) + F.coalesce("more_", F.lit(0))
    copies = slots.join(extra, "slot", "left").filter(size > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), size)))
    named = copies.withColumn("priority", drawn(salt, F.lit("priority"), "slot", "copy"))
    first = Window.partitionBy("act").orderBy("priority", "slot", "copy")
    demand = named.withColumn("i_", F.row_number().over(first) - 1)
    articles = units.groupBy("act", "article").agg(F.array_sort(F.collect_set("node")).alias("nodes_"))
    order = articles.withColumn("a_", F.row_number().over(Window.partitionBy("act").orderBy(drawn(salt, F.lit("article"), "act", "article"), "article")) - 1)
    sized = order.withColumn("m_", F.count("*").over(Window.partitionBy("act")))
    m = sized.groupBy("act").agg(F.max("m_").alias("m_"))
    placed = demand.join(m, "act").withColumn("a_", F.col("i_") % F.col("m_")).join(sized.drop("m_"), ["act", "a_"])
    earlier = F.floor(F.col("i_") / F.col("m_"))
    start = F.conv(F.substring(drawn(salt, F.lit("provision"), "act", "article"), 1, 8), 16, 10).cast("long")
    node = F.get("nodes_", ((start + earlier) % F.size("nodes_")).cast("int"))
    ranks = named.groupBy("slot", "copy").agg(F.min("priority").alias("priority")).select("slot", "copy", F.row_number().over(Window.orderBy("priority", "slot", "copy")).alias("rank"))
    return placed.select("slot", "copy", "act", "article", node.alias("node"), earlier.cast("long").alias("earlier")).join(ranks, ["slot", "copy"])


def imbalance(values: np.ndarray, batch: np.ndarray, batches: int) -> float:
    """Squared distance of the counts of every value in every batch from its even share; ``values`` are 0/1 columns."""
    share = values.sum(0) / batches
    return float(sum(((values[batch == b].sum(0) - share) ** 2).sum() for b in range(batches)))


def quotas(counts: np.ndarray, values: np.ndarray, batches: int) -> np.ndarray:
    """How many rows of each profile go to each batch: (profiles, batches) from their counts and 0/1 columns of attribute values.

    Every batch takes an even share of every profile. Of what is left over, fewer than ``batches`` rows a profile, each
    goes where the squared distance of the counts from their even shares grows least; then a row of one profile and one of
    another change batches while that lowers it. Batches are of equal size, the first ones one larger where rows are left.
    """
    taken = np.repeat((counts // batches)[:, None], batches, 1)
    share = (counts @ values) / batches
    have = (taken.T @ values).astype(float)
    room = [int(counts.sum()) // batches + (b < counts.sum() % batches) - int(taken[:, b].sum()) for b in range(batches)]
    for p in range(len(counts)):
        for _ in range(int(counts[p] % batches)):
            cost = [np.round(((have[b] + values[p] - share) ** 2 - (have[b] - share) ** 2).sum(), 9) if room[b] else np.inf for b in range(batches)]
            b = int(np.argmin(cost))
            taken[p, b] += 1
            have[b] += values[p]
            room[b] -= 1
    weight = values.sum(1)
    common = values @ values.T
    apart = weight[:, None] + weight[None, :] - 2 * common  # squared distance of two profiles
    improved = True
    while improved:
        improved = False
        for a in range(batches):
            for b in range(a + 1, batches):
                while True:
                    # gain of moving one row of p from a to b and one of q back: have changes by d = q - p and -d
                    pull = values @ (have[a] - have[b])
                    gain = 2 * (pull[None, :] - pull[:, None]) + 2 * apart
                    gain = np.where((taken[:, a] > 0)[:, None] & (taken[:, b] > 0)[None, :], gain, 0)
                    p, q = np.unravel_index(int(np.argmin(gain)), gain.shape)
                    if gain[p, q] >= -1e-9:
                        break
                    d = values[q] - values[p]
                    have[a] += d
                    have[b] -= d
                    taken[[p, p, q, q], [a, b, b, a]] += [-1, 1, -1, 1]
                    improved = True
    return taken


def deal(profiles: DataFrame, key: str, attributes: list[str], batches: int = 3) -> DataFrame:
    """(key, batch): batches of equal size, each close to the whole in every attribute; no swap of two rows would bring them closer.

    What is weighed are the distinct profiles with their counts, not the rows: the driver holds one row a profile. The rows of
    a profile then go to its batches in the order of their keys' hashes: they are counted by hash range and numbered inside
    one, so that no profile is one task's. Rows over a multiple of ``batches`` go to the first ones; null is a value; keys are
    distinct.
    """
    scratch = Scratch(profiles.sparkSession, "dealt")
    named = [f"a{k}_" for k in range(len(attributes))]
    rows = profiles.select(F.col(key), *[F.to_json(F.struct(F.col(a).cast("string").alias("v")), {"ignoreNullFields": "false"}).alias(n) for a, n in zip(attributes, named, strict=True)])
    rows = scratch.keep(rows.withColumn("range_", F.xxhash64(key).bitwiseAND(F.lit(RANGES - 1))))
    counted = sorted(tuple(r) for r in rows.groupBy(*named).agg(F.count("*").alias("n")).collect())
    at = {v: i for i, v in enumerate(sorted({(k, v) for r in counted for k, v in enumerate(r[:-1])}))}
    values = np.zeros((len(counted), len(at)), np.int64)
    for i, r in enumerate(counted):
        values[i, [at[k, v] for k, v in enumerate(r[:-1])]] = 1
    taken = quotas(np.array([r[-1] for r in counted], np.int64), values, batches) if counted else np.zeros((0, batches), np.int64)
    until = np.cumsum(taken, 1)
    schema = ", ".join([f"{n} string" for n in named] + ["until_ array<long>"])
    plan = profiles.sparkSession.createDataFrame([(*r[:-1], u) for r, u in zip(counted, until.tolist(), strict=True)], schema)
    before = Window.partitionBy(*named).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*named, "range_").agg(F.count("*").alias("m_")).withColumn("start_", F.coalesce(F.sum("m_").over(before), F.lit(0))).drop("m_")
    place = F.row_number().over(Window.partitionBy(*named, "range_").orderBy(F.xxhash64(key, F.lit("deal")), key)) + F.col("start_")
    placed = rows.join(starts, [*named, "range_"]).withColumn("place_", place).join(plan, named)
    return placed.select(key, F.size(F.filter("until_", lambda u: u < F.col("place_"))).alias("batch"))


def group_means(rows: DataFrame, keys: str, value: str, need: str, few: int = 5) -> DataFrame:
    """Mean of ``value`` in every group of an array column; a row without groups is in ``(none)``. Groups of few needs are marked."""
    each = rows.withColumn("group", F.explode_outer(F.array_distinct(keys))).withColumn("group", F.coalesce("group", F.lit("(none)")))
    return each.groupBy("group").agg(F.round(F.avg(value), 6).alias("mean"), F.count_distinct(need).alias("needs")).withColumn("few", F.col("needs") < few)


def attempts(events: DataFrame, key: str, kind: str, failure: Column, excused: Column, most: int = 3) -> DataFrame:
    """Failures that count (not excused ones) by job and kind; exhausted from ``most`` on."""
    out = events.groupBy(key, kind).agg(F.count(F.when(failure & ~excused, 1)).alias("failures"), F.count(F.when(excused, 1)).alias("excused"))
    return out.withColumn("exhausted", F.col("failures") >= most)


def planned_realised(planned: DataFrame, realised: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of a plan (keys, n) against those of what there is: (keys, planned, realised, gap)."""
    got = realised.groupBy(*keys).agg(F.count("*").alias("realised"))
    both = planned.select(*keys, F.col("n").alias("planned")).join(got, keys, "full_outer")
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return both.select(*keys, z("planned").alias("planned"), z("realised").alias("realised"), (z("realised") - z("planned")).alias("gap"))


def ranges(rows: DataFrame, value: str, bounds: list[int]) -> DataFrame:
    """Rows by range of a value: (range, n), upper bounds inclusive, the last one open."""
    label, low = F, 0
    for b in bounds:
        label = label.when(F.col(value) <= b, f"{low}-{b}")
        low = b + 1
    return rows.filter(F.col(value).isNotNull()).groupBy(label.otherwise(f"{low}+").alias("range")).agg(F.count("*").alias("n"))

"""Decisions over intervals and scenarios: shared resamples, t intervals, claims, coverage states, paths."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Margins and labels of the decision rules.
DELTA_RECALL = 0.02
INFERIOR, SUPPORTED, STRONG, VIOLATED = "inferior beyond delta", "supported improvement", "strong practical improvement evidence", "violated"
DISCARD, DISPLACE, FRONTIER = "discard", "displace", "frontier"


def limits(deltas: DataFrame, key: str, metrics: list[str], reps: int, salt: str = "r", draws: DataFrame | None = None) -> DataFrame:
    """(metric, mean, low2, high2, low1, high1): percentile limits, two-sided and one-sided, of all metrics over the same resamples.

    The draws (rep, place) are hashes of replicate and place, or those given (see ``draws.replicates``), so a comparison made
    again sees the same; needs are ordered by key.
    Needs of an evaluation are few: they are numbered in one window, and each replicate is a sum over its draws.
    """
    from pyspark.sql import Window

    rows = deltas.select(*[F.col(m).cast("double") for m in metrics], (F.row_number().over(Window.orderBy(key)) - 1).alias("place"))
    n = rows.count()
    if draws is None:
        spots = F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n else F.explode(F.array().cast("array<int>"))
        hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), "rep", "k")), 1, 8), 16, 10).cast("long")
        draws = rows.sparkSession.range(reps).select(F.col("id").alias("rep"), spots.alias("k")).select("rep", (hashed % max(1, n)).cast("int").alias("place"))
    drawn = draws.join(F.broadcast(rows), "place")
    means = drawn.groupBy("rep").agg(*[F.avg(m).alias(m) for m in metrics])
    lists = means.agg(*[F.array_sort(F.collect_list(F.round(m, 12))).alias(m) for m in metrics])
    centre = rows.agg(*[F.avg(m).alias(f"c_{m}") for m in metrics])
    at = lambda m, i: F.round(F.get(F.col(m), F.lit(i)), 6)
    places = int(0.025 * reps), int(0.975 * reps) - 1, int(0.05 * reps), int(0.95 * reps) - 1
    each = [F.struct(F.lit(m).alias("metric"), F.round(f"c_{m}", 6).alias("mean"), *[at(m, i).alias(c) for c, i in zip(("low2", "high2", "low1", "high1"), places, strict=True)]) for m in metrics]
    return lists.crossJoin(centre).select(F.explode(F.array(*each)).alias("x")).select("x.*")


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t for p above 0.5, by bisection over its distribution function (a finite sum for whole degrees)."""

    def cdf(t: float) -> float:
        theta = math.atan2(t, math.sqrt(df))
        c, s = math.cos(theta), math.sin(theta)
        term, total = (c if df % 2 else 1.0), 0.0
        for k in range(2 + df % 2, df + 1, 2):
            total += term
            term *= c * c * (k - 1) / k
        area = 2 / math.pi * (theta + s * total) if df % 2 else s * total
        return 0.5 + area / 2

    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def t_interval(deltas: DataFrame, value: str = "delta", level: float = 0.95) -> DataFrame:
    """One row: needs, mean and the paired t interval; no interval for a single need."""
    x = deltas.agg(F.count(value).alias("needs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    n = x.first().needs
    half = F.lit(t_quantile((1 + level) / 2, n - 1)) * F.col("sd") / math.sqrt(n) if n > 1 else F.lit(None).cast("double")
    return x.select("needs", F.round("mean", 6).alias("mean"), F.round(F.col("mean") - half, 6).alias("low"), F.round(F.col("mean") + half, 6).alias("high"))


def verdict(low: Column, high: Column) -> Column:
    """Where an interval lies of 0."""
    return F.when(low > 0, "confirms").when(high < 0, "reverses").otherwise("inconclusive")


def claim(recall: Column, ndcg: Column) -> Column:
    """What two verdicts allow to say: a reversal first, then both, one, none."""
    worse = F.concat_ws(" and ", F.when(recall == "reverses", "Recall@10"), F.when(ndcg == "reverses", "nDCG@10"))
    return (
        F.when((recall == "reverses") | (ndcg == "reverses"), F.concat(F.lit("worse on "), worse))
        .when((recall == "confirms") & (ndcg == "confirms"), "better on both")
        .when(recall == "confirms", "better on Recall@10 only")
        .when(ndcg == "confirms", "better on nDCG@10 only")
        .otherwise("no difference shown")
    )


def action(latency: Column, label: Column, guardrail: Column) -> Column:
    """Of a candidate against the base: discard, displace or keep on the frontier."""
    better = label.isin(SUPPORTED, STRONG) & (guardrail != VIOLATED)
    return F.when(label == INFERIOR, DISCARD).when((latency == "fast") & better, DISPLACE).otherwise(FRONTIER)


def coverage_state(scenarios: DataFrame, act: Callable[[Column, Column, Column], Column] = action) -> DataFrame:
    """(comparison, state, label) of scenarios (comparison, scenario, latency, label, guardrail): whether the unjudged could change the label, or what is done about it. ``act`` gives the action of a row."""
    rows = scenarios.withColumn("act_", act(F.col("latency"), F.col("label"), F.col("guardrail")))
    one = rows.groupBy("comparison").agg(F.countDistinct("label", "guardrail").alias("labels"), F.countDistinct("act_").alias("acts"), F.max(F.when(F.col("scenario") == "primary", F.col("label"))).alias("primary"))
    state = F.when(F.col("labels") == 1, "coverage_robust").when(F.col("acts") == 1, "coverage_affected").otherwise("not_evaluable")
    return one.select("comparison", state.alias("state")).join(one.select("comparison", "primary"), "comparison").select("comparison", "state", F.when(F.col("state") == "not_evaluable", "not evaluable").otherwise(F.col("primary")).alias("label"))


def certified(low1: Column, guardrail: Column, delta: float = DELTA_RECALL) -> Column:
    """Whether non-inferiority within delta lets a cheaper system dominate."""
    return (low1 > -delta + 1e-9) & (guardrail != VIOLATED)


def assign_paths(actions: Mapping[str, str], dominance: Mapping[tuple[str, str], bool], base: str, quality: str, challengers: list[str], prefer: str | None = None) -> dict[str, object]:
    """The fast and the quality path, who is discarded and why, and who stays on the frontier; a few systems, on the driver.

    Inferior systems go first, then those a certified cheaper one dominates (the quality system never). The fast path is
    the one challenger left that displaces the base; of several the preferred one, else the first; else the base."""
    gone = {s: "inferior" for s, a in sorted(actions.items()) if a == DISCARD and s != quality}
    for (winner, loser), holds in sorted(dominance.items()):
        if holds and loser != quality:
            gone.setdefault(loser, f"dominated by {winner}")
    left = [s for s in challengers if actions.get(s) == DISPLACE and s not in gone]
    fast = prefer if prefer in left else left[0] if left else base
    return {"fast": fast, "quality": quality, "discarded": gone, "frontier": sorted(s for s in {base, *actions} - {fast, quality} if s not in gone)}


def gate(rescued: Column, lost: Column, needed: int) -> Column:
    """Whether a second stage is kept: it must rescue ``needed`` more cases than it loses."""
    return F.when(rescued - lost >= needed, "keep").when(rescued > lost, "undecided").otherwise("drop")

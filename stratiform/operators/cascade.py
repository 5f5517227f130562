"""A cascade of answering stages: a later stage is asked where all before it abstain; what each rescues, loses and lets through."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The preregistered gates.
RESCUES, MOST_DROP, SUPPORT = 3, 0.05, 0.9


def folded(outcomes: DataFrame) -> DataFrame:
    """Adds to (case, stage, answered, hit): ``open`` (no earlier stage answered), ``reached`` (any stage up to this one answered) and ``found`` (the answer that the cascade gives, up to here, is a hit; false without one)."""
    before = Window.partitionBy("case").orderBy("stage").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("case").orderBy("stage").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(F.when(F.col("answered"), F.col("hit")), ignorenulls=True).over(upto)
    return outcomes.withColumn("open", ~F.coalesce(F.max("answered").over(before), F.lit(False))).withColumn("reached", F.max("answered").over(upto)).withColumn("found", F.coalesce(first, F.lit(False)))


def stages(outcomes: DataFrame, support: DataFrame | None = None, rescues: int = RESCUES, most_drop: float = MOST_DROP, least_support: float = SUPPORT) -> DataFrame:
    """One row a stage but the first, of (case, positive, stage, answered, hit, claims, passed): is it worth adding?

    ``rescued``: positive cases on which all earlier stages abstain and this one answers with a hit; ``broader``: those on
    which the cascade so far has no hit and this stage has; ``lost``: the other way round. ``undesired`` and
    ``undesired_before``: negative cases that the cascade with, and without, this stage answers. ``drop``: the
    share of claims that pass, the first stage's less this one's. The gates: ``enough`` rescues, ``no_extra``
    undesired answers, the claims not ``degraded`` by more than ``most_drop`` (without claims: they are), ``supported`` by
    people (share per stage in ``support`` (stage, share); null: not known). ``justified``: all of them hold; ``unresolved``
    names those not known.
    """
    rows = folded(outcomes)
    earlier = Window.partitionBy("case").orderBy("stage")
    rows = rows.withColumn("had_", F.coalesce(F.lag("found").over(earlier), F.lit(False))).withColumn("let_", F.coalesce(F.lag("reached").over(earlier), F.lit(False)))
    own = F.col("answered") & F.col("hit")
    count = lambda c: F.count(F.when(c, 1))
    positive = F.col("positive")
    per = rows.groupBy("stage").agg(
        count(positive & F.col("open") & own).alias("rescued"),
        count(positive & ~F.col("had_") & own).alias("broader"),
        count(positive & F.col("had_") & ~own).alias("lost"),
        count(~positive & F.col("reached")).alias("undesired"),
        count(~positive & F.col("let_")).alias("undesired_before"),
        (F.sum(F.when(positive, F.col("passed"))) / F.nullif(F.sum(F.when(positive, F.col("claims"))), F.lit(0))).alias("pass"),
    )
    base = per.agg(F.min_by("pass", "stage").alias("base_"), F.min("stage").alias("first_"))
    told = support if support is not None else outcomes.sparkSession.createDataFrame([], f"stage {outcomes.schema['stage'].dataType.simpleString()}, share double")
    out = per.crossJoin(F.broadcast(base)).filter("stage > first_").join(told, "stage", "left")
    drop = F.col("base_") - F.col("pass")
    gates = {"enough": F.col("rescued") >= rescues, "no_extra": F.col("undesired") <= F.col("undesired_before"), "not_degraded": F.coalesce(drop <= most_drop + 1e-12, F.lit(False)), "supported": F.col("share") >= least_support}
    every = F.lit(True)
    for g in gates.values():
        every = every & F.coalesce(g, F.lit(False))
    unknown = F.array_compact(F.array(*[F.when(g.isNull(), n) for n, g in gates.items()]))
    return out.select("stage", "rescued", "broader", "lost", "undesired", "undesired_before", F.round(drop, 6).alias("drop"), *[g.alias(n) for n, g in gates.items()], every.alias("justified"), F.array_join(unknown, ",").alias("unresolved"))

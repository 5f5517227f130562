"""Retrieval metrics over a run and judgments, all denominators from the judged queries.

Judgments are (query_id, doc_id, grade); ``rel`` is the lowest relevant grade. A query the run lacks
scores 0 and still counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratiform.operators.prefix import running

from stratiform.operators.retrieval import discount


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10, rel: int = 2) -> DataFrame:
    """recall, mrr (cut at k), ndcg (linear gain, ideal from all judged), judged (share of those returned), first (rank of the first relevant, uncut), ap."""
    judged = run.join(qrels, ["query_id", "doc_id"], "left")
    top, good = F.col("rank") <= k, F.coalesce(F.col("grade"), F.lit(-1)) >= rel
    running = F.sum(F.when(good, 1).otherwise(0)).over(Window.partitionBy("query_id").orderBy("rank"))
    hits = judged.withColumn("seen", running).groupBy("query_id").agg(
        F.sum(F.when(top & good, 1).otherwise(0)).alias("found"),
        F.min(F.when(good, F.col("rank"))).alias("first"),
        F.sum(F.when(top & (F.col("grade") > 0), F.col("grade") * discount(F.col("rank")))).alias("dcg"),
        F.sum(F.when(top & F.col("grade").isNotNull(), 1).otherwise(0)).alias("judged_n"),
        F.sum(F.when(top, 1).otherwise(0)).alias("returned"),
        F.sum(F.when(good & top, F.col("seen") / F.col("rank"))).alias("precisions"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "doc_id"))
    ideal = qrels.withColumn("place", place).groupBy("query_id").agg(
        F.sum(F.when((F.col("place") <= k) & (F.col("grade") > 0), F.col("grade") * discount(F.col("place")))).alias("idcg"),
        F.sum(F.when(F.col("grade") >= rel, 1).otherwise(0)).alias("relevant"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.filter("relevant > 0").join(hits, "query_id", "left").select(
        "query_id",
        F.round(zero(F.col("found") / F.col("relevant")), 6).alias("recall"),
        F.round(F.when(F.col("first") <= k, 1 / F.col("first")).otherwise(0.0), 6).alias("mrr"),
        F.round(zero(F.col("dcg") / F.col("idcg")), 6).alias("ndcg"),
        F.round(zero(F.col("judged_n") / F.nullif(F.col("returned"), F.lit(0))), 6).alias("judged"),
        F.col("first").cast("long").alias("first_relevant"),
        F.round(zero(F.col("precisions") / F.col("relevant")), 6).alias("ap"),
    )


def recall_at_tokens(run: DataFrame, tokens: DataFrame, qrels: DataFrame, budget: int, rel: int = 2) -> DataFrame:
    """Whole documents in rank order until the first that doesn't fit; tokens are at least 1, so a prefix sum tells."""
    w = Window.partitionBy("query_id").orderBy("rank")
    taken = run.join(tokens, "doc_id").withColumn("used", F.sum("n_tokens").over(w)).filter(F.col("used") <= budget)
    need = qrels.filter(F.col("grade") >= rel)
    got = need.join(taken.select("query_id", "doc_id", F.lit(1).alias("got")), ["query_id", "doc_id"], "left")
    return got.groupBy("query_id").agg(F.round(F.count("got") / F.count("*"), 6).alias("recall"))


def macro(rows: DataFrame, value: str, inner: list[str], outer: list[str]) -> DataFrame:
    """Mean of means: per inner and outer group, then per outer group."""
    first = rows.groupBy(*outer, *inner).agg(F.avg(value).alias("m"), F.count("*").alias("n"))
    return first.groupBy(*outer).agg(F.round(F.avg("m"), 6).alias("mean"), F.count("*").alias("groups"), F.sum("n").alias("rows"))


def strata(rows: DataFrame, value: str, sets: list[list[str]]) -> DataFrame:
    """The same mean over several groupings in one pass (GROUPING SETS)."""
    columns = sorted({c for s in sets for c in s})
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("n"))


def wilson(rows: DataFrame, groups: list[str], hit: str, z: float = 1.96) -> DataFrame:
    """Share of ``hit`` with its Wilson interval."""
    agg = rows.groupBy(*groups).agg(F.sum(F.col(hit).cast("int")).alias("x"), F.count("*").alias("n"))
    p, n = F.col("x") / F.col("n"), F.col("n")
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return agg.select(*groups, "x", "n", F.round(p, 6).alias("share"), F.round(mid - half, 6).alias("low"), F.round(mid + half, 6).alias("high"))


def auroc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by average ranks: scores are counted, and the counts summed up by ranges of the score."""
    counted = rows.groupBy(score).agg(F.sum(F.col(positive).cast("int")).alias("p"), F.count("*").alias("n"))
    ranks = running(counted, score, "n").withColumn("mid", F.col("below") + (F.col("n") + 1) / 2)
    total = ranks.agg(F.sum(F.col("p") * F.col("mid")).alias("s"), F.sum("p").alias("a"), F.sum(F.col("n") - F.col("p")).alias("b"))
    return total.select(F.round((F.col("s") - F.col("a") * (F.col("a") + 1) / 2) / (F.col("a") * F.col("b")), 6).alias("auroc"), F.col("a").alias("positives"), F.col("b").alias("negatives"))

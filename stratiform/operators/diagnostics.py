"""What stands behind a number: coverage, discovery, transitions, profiles. Runs are (query_id, doc_id, rank), relevant (query_id, doc_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.operators.prefix import running

from stratiform.operators.retrieval import discount


def full_evidence(run: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, full): whether every relevant document is among the first k."""
    found = relevant.join(run.filter(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return found.groupBy("query_id").agg((F.count("*") == F.count("hit")).alias("full"))


def first_k_recall(run: DataFrame, relevant: DataFrame, cutoffs: list[int]) -> DataFrame:
    """(query_id, recall_k for every cutoff) of a list that needn't be a final ranking; a query without a list has 0."""
    ranked = relevant.join(run.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    share = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}")
    return ranked.groupBy("query_id").agg(*map(share, cutoffs))


def first_correct(run: DataFrame, relevant: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: MRR of the first correct document, and how often it is among the first 1, 3, 5, 10."""
    first = relevant.join(run, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("first"))
    hit = lambda k: F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 6).alias(f"hit_{k}")
    return first.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), *map(hit, cutoffs))


def gain_at_k(run: DataFrame, grades: DataFrame, k: int = 10, most: int = 3) -> DataFrame:
    """(query_id, gain): discounted gain on a fixed scale, that of k documents of the highest grade."""
    ceiling = run.sparkSession.range(1, k + 1).agg(F.sum(most * discount(F.col("id"))).alias("ceiling"))
    top = run.filter(F.col("rank") <= k).join(grades, ["query_id", "doc_id"], "left")
    gain = top.groupBy("query_id").agg(F.sum(F.coalesce("grade", F.lit(0)) * discount(F.col("rank"))).alias("g"))
    return gain.crossJoin(F.broadcast(ceiling)).select("query_id", F.round(F.col("g") / F.col("ceiling"), 6).alias("gain"))


def judged_at(run: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """(query_id, judged): share of the first k places that hold judged documents; k is the divisor whatever is returned."""
    top = run.filter(F.col("rank") <= k).join(judged.select("query_id", "doc_id", F.lit(1).alias("j")), ["query_id", "doc_id"], "left")
    return top.groupBy("query_id").agg(F.round(F.count("j") / k, 6).alias("judged"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    """One row: n, min, q1, median, q3, max, mean; quartiles interpolated at q(n+1), as exclusive quartiles are."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    # row numbers are running sums of the distinct values' counts
    placed = running(counted, "v", "c").withColumn("hi", F.col("below") + F.col("c")).withColumn("lo", F.col("below") + 1)
    size = counted.agg(F.sum("c").alias("n"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 6).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    at = lambda p: F.max(F.when((F.col("lo") <= p) & (p <= F.col("hi")), F.col("v")))

    def quartile(q: float, name: str) -> Column:
        place = F.col("n") + 1
        low = F.greatest(F.lit(1), F.least(F.floor(place * q), F.col("n") - 1))
        # a single value is every quartile; beyond the ends the outer pair is extended
        step = place * q - low
        return F.when(F.max("n") == 1, F.max("max")).otherwise(F.round(at(low) + (at(low + 1) - at(low)) * F.max(step), 6)).alias(name)

    return placed.crossJoin(F.broadcast(size)).agg(F.max("n").alias("n"), F.max("min").alias("min"), quartile(0.25, "q1"), quartile(0.5, "median"), quartile(0.75, "q3"), F.max("max").alias("max"), F.max("mean").alias("mean"))


def discovery(sources: DataFrame, relevant: DataFrame, depths: list[int]) -> DataFrame:
    """(contributor, depth, share): mean over queries of the relevant documents that each contributor, and all together ("union"), found by a depth. sources: (query_id, doc_id, contributor, rank)."""
    size = relevant.groupBy("query_id").agg(F.count("*").alias("size"))
    found = sources.join(relevant, ["query_id", "doc_id"])
    first = found.groupBy("query_id", "doc_id", "contributor").agg(F.min("rank").alias("rank"))
    every = first.unionByName(found.groupBy("query_id", "doc_id").agg(F.lit("union").alias("contributor"), F.min("rank").alias("rank")).select("query_id", "doc_id", "contributor", "rank"))
    by_depth = every.withColumn("depth", F.explode(F.filter(F.array(*map(F.lit, depths)), lambda d: d >= F.col("rank"))))
    hits = by_depth.groupBy("query_id", "contributor", "depth").agg(F.count("*").alias("k")).join(size, "query_id")
    n = relevant.select("query_id").distinct().agg(F.count("*").alias("queries"))
    return hits.groupBy("contributor", "depth").agg(F.sum(F.col("k") / F.col("size")).alias("s")).crossJoin(F.broadcast(n)).select("contributor", "depth", F.round(F.col("s") / F.col("queries"), 6).alias("share"))


def transitions(a: DataFrame, b: DataFrame, step: float = 0.01) -> DataFrame:
    """(query_id, label) of two systems' metrics (query_id, recall, ndcg, first_relevant): who fails, who mends it."""
    fails = lambda r, f: (r < 1) | F.coalesce(f > 10, F.lit(True))
    x = a.select("query_id", F.col("recall").alias("ra"), F.col("ndcg").alias("na"), fails(F.col("recall"), F.col("first_relevant")).alias("fa"))
    y = b.select("query_id", F.col("recall").alias("rb"), F.col("ndcg").alias("nb"), fails(F.col("recall"), F.col("first_relevant")).alias("fb"))
    same = F.col("ra") == F.col("rb")
    label = (
        F.when(F.col("fa") & ~F.col("fb"), "A fixed by B")
        .when(~F.col("fa") & F.col("fb"), "D worse (a new failure)")
        .when(~F.col("fa"), "not failing under either")
        .when((F.col("rb") < F.col("ra")) | (same & (F.col("nb") < F.col("na") - step)), "D worse")
        .when((F.col("rb") > F.col("ra")) | (same & (F.col("nb") > F.col("na") + step)), "B improved but still failing")
        .otherwise("C same failure")
    )
    return x.join(y, "query_id").select("query_id", label.alias("label"))


def influence(deltas: DataFrame, key: str, value: str = "delta", top: int = 3) -> DataFrame:
    """One row: mean, mean without the needs of the ``top`` largest changes, and the share of all gains that the ``top`` largest gains are."""
    d = deltas.select(F.col(key).alias("key"), F.col(value).alias("d"))
    # places among the largest only: two small sorts in place of one of everything
    large = d.orderBy(F.abs("d").desc(), "key").limit(top).agg(F.sum("d").alias("ls"), F.count("*").alias("lc"))
    gains = d.filter("d > 0").orderBy(F.col("d").desc(), "key").limit(top).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("gs"))
    every = d.agg(F.count("*").alias("n"), F.sum("d").alias("s"), F.sum(F.when(F.col("d") > 0, F.col("d"))).alias("g"))
    return every.crossJoin(large).crossJoin(gains).select(
        F.col("n").alias("needs"),
        F.round(F.col("s") / F.col("n"), 6).alias("mean"),
        F.when(F.col("n") > F.col("lc"), F.round((F.col("s") - F.col("ls")) / (F.col("n") - F.col("lc")), 6)).alias("mean_without"),
        F.when(F.col("g") > 0, F.round(F.col("gs") / F.col("g"), 6)).alias("share_of_gains"),
    )


def leaderboard(scores: DataFrame, base: str, metrics: list[str], digits: int = 3) -> DataFrame:
    """Systems (system, metrics) with rounded differences to a base system, ordered by the metrics in turn; ``best`` marks the first."""
    b = scores.filter(F.col("system") == base).select(*[F.col(m).alias(f"b_{m}") for m in metrics])
    rows = scores.crossJoin(F.broadcast(b)).select("system", *[F.round(m, digits).alias(m) for m in metrics], *[F.round(F.col(m) - F.col(f"b_{m}"), digits).alias(f"delta_{m}") for m in metrics])
    order = Window.orderBy(*[F.col(m).desc() for m in metrics], "system")
    return rows.withColumn("place", F.row_number().over(order)).withColumn("best", F.col("place") == 1)


def graph_summary(edges: DataFrame) -> DataFrame:
    """(what, value): edges (source, act, source_act, form, path, resolved, target, skipped) counted by what became of them."""
    counts = {
        "references_followed": F.col("skipped").isNull() & F.col("resolved").isNotNull(),
        "cross_act": F.col("skipped").isNull() & (F.col("act") != F.col("source_act")),
        "resolved_to_an_ancestor": F.col("skipped").isNull() & (F.col("resolved") != F.col("path")),
        "unresolved": F.col("skipped").isNull() & F.col("resolved").isNull(),
        "skipped_anaphora": F.col("skipped") == "anaphora",
        "skipped_outside_the_corpus": F.col("skipped") == "outside_the_corpus",
    }
    totals = edges.agg(*[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(k) for k, c in counts.items()], F.countDistinct(F.when((F.col("target") != F.col("source")) & F.col("skipped").isNull(), F.col("source"))).alias("sources_with_a_target"))
    names = [*counts, "sources_with_a_target"]
    long = totals.select(F.explode(F.array(*[F.struct(F.lit(k).alias("what"), F.coalesce(F.col(k), F.lit(0)).alias("value")) for k in names])).alias("x")).select("x.*")
    return long.unionByName(edges.filter("skipped is null").groupBy(F.concat(F.lit("form "), "form").alias("what")).agg(F.count("*").alias("value")))


def profile(df: DataFrame, value: str, bounds: list[int], key: str, top: int = 10) -> DataFrame:
    """(what, name, n): a histogram by upper bounds, and the keys with the most rows, ties by key."""
    bucket = F.lit(f"> {bounds[-1]}")
    for b in reversed(bounds):
        bucket = F.when(F.col(value) <= b, f"<= {b}").otherwise(bucket)
    shape = df.groupBy(bucket.alias("name")).agg(F.count("*").alias("n")).select(F.lit("size").alias("what"), "name", "n")
    most = df.groupBy(F.col(key).cast("string").alias("name")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(top)
    return shape.unionByName(most.select(F.lit("most").alias("what"), "name", "n"))


def lexical_profile(df: DataFrame, group: str, text: str) -> DataFrame:
    """Words of the texts of every group: number of texts, least, median, most and mean."""
    n = df.select(group, F.size(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("([a-z0-9]+)"), 1)).alias("w"))
    return n.groupBy(group).agg(F.count("*").alias("n"), F.min("w").alias("least"), F.expr("percentile(w, 0.5)").alias("median"), F.max("w").alias("most"), F.round(F.avg("w"), 3).alias("mean"))


def figure_density(df: DataFrame, group: str, text: str) -> DataFrame:
    """(group, texts, share): the share of texts with a figure or a date."""
    return df.groupBy(group).agg(F.count("*").alias("texts"), F.round(F.avg(F.coalesce(F.col(text), F.lit("")).rlike(r"[0-9]").cast("double")), 6).alias("share"))


def union_recall(a: DataFrame, b: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall): what a perfect choice between two lists' first k could reach."""
    both = a.filter(F.col("rank") <= k).select("query_id", "doc_id").union(b.filter(F.col("rank") <= k).select("query_id", "doc_id")).distinct().withColumn("hit", F.lit(1))
    return relevant.join(both, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def windows(run: DataFrame, size: int) -> DataFrame:
    """``window``: the list in runs of ``size`` places, from 0."""
    return run.withColumn("window", F.floor((F.col("rank") - 1) / size))


def contexts(run: DataFrame, grades: DataFrame, k: int, most: int, least: int) -> DataFrame:
    """(query_id, context, place, doc_id): the relevant documents by grade ("gold"), the first k ("top"), and the first
    ``most`` of grade 0 or 1 in run order where there are ``least`` of them ("insufficient")."""
    by = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    gold = grades.filter("grade >= 2").withColumn("place", by(F.col("grade").desc(), "doc_id")).select("query_id", F.lit("gold").alias("context"), "place", "doc_id")
    top = run.filter(F.col("rank") <= k).select("query_id", F.lit("top").alias("context"), F.col("rank").alias("place"), "doc_id")
    poor = run.join(grades.filter("grade < 2"), ["query_id", "doc_id"]).withColumn("place", by("rank")).filter(F.col("place") <= most)
    enough = poor.groupBy("query_id").count().filter(F.col("count") >= least).select("query_id")
    return gold.unionByName(top).unionByName(poor.join(enough, "query_id", "left_semi").select("query_id", F.lit("insufficient").alias("context"), "place", "doc_id"))


def dependent_recall(run: DataFrame, evidence: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, anchor_hit): recall of the evidence that depends on other evidence, and whether any anchor is among the first k. evidence: (query_id, doc_id, role)."""
    top = run.filter(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit"))
    found = evidence.join(top, ["query_id", "doc_id"], "left")
    dependent = F.col("role") == "dependent"
    return found.groupBy("query_id").agg(F.round(F.count(F.when(dependent, F.col("hit"))) / F.count(F.when(dependent, F.lit(1))), 6).alias("recall"), (F.count(F.when(~dependent, F.col("hit"))) > 0).alias("anchor_hit")).filter("recall is not null")


def latency(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, n, p50, p95, most, mean): nearest-rank percentiles of each stage."""
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by `{value}`)")
    return df.filter(F.col(value).isNotNull()).groupBy(*groups).agg(F.count("*").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"))


def position_shifts(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, shared, same_places, most_moved) of two rankings' first k: documents in both, places with the same document, the largest change of rank."""
    x, y = (r.filter(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").alias(n)) for r, n in ((a, "x"), (b, "y")))
    both = x.join(y, ["query_id", "doc_id"], "full_outer")
    return both.groupBy("query_id").agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("shared"), F.count(F.when(F.col("x") == F.col("y"), 1)).alias("same_places"), F.max(F.abs(F.col("x") - F.col("y"))).alias("most_moved"))

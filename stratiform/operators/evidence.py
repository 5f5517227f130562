"""Evidence sets, citation checks, answer admission, hard negatives, packing and comparisons of two rankings.

Runs are (query_id, doc_id, score, rank).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from stratiform.functions import text as T

#: Least number of parts over which items are dealt that are kept in memory while they are counted.
PARTS = 200
TOLERANCE = 1e-9


def evidence_set(base: DataFrame, probability: DataFrame, head: int, supports: int, threshold: float) -> DataFrame:
    """The first ``head`` of the base; then at most ``supports`` candidates whose best probability under one of these
    reaches the threshold, best first, ties by the anchor's rank, then the id; then the rest of the base.

    ``probability``: (query_id, anchor, doc_id, p).
    """
    kept = base.filter(F.col("rank") <= head).select("query_id", "doc_id", "rank")
    anchored = probability.join(kept.select("query_id", F.col("doc_id").alias("anchor"), F.col("rank").alias("anchor_rank")), ["query_id", "anchor"])
    best = anchored.groupBy("query_id", "doc_id").agg(F.max(F.struct("p", (-F.col("anchor_rank")).alias("r"))).alias("b"))
    fresh = best.join(kept, ["query_id", "doc_id"], "left_anti").filter(F.col("b.p") >= threshold)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("b.p").desc(), F.col("b.r").desc(), "doc_id"))
    chosen = fresh.withColumn("n", place).filter(F.col("n") <= supports).select("query_id", "doc_id", F.lit(1).alias("tier"), "n")
    tiers = base.select("query_id", "doc_id", F.when(F.col("rank") <= head, 0).otherwise(2).alias("tier"), F.col("rank").alias("n")).unionByName(chosen)
    first = tiers.groupBy("query_id", "doc_id").agg(F.min(F.struct("tier", "n")).alias("k"))
    return first.select("query_id", "doc_id", F.col("k.tier").alias("tier"), F.row_number().over(Window.partitionBy("query_id").orderBy("k", "doc_id")).alias("rank"))


def hard_negatives(run: DataFrame, correct: DataFrame, hardest: int = 2, salt: str = "n") -> DataFrame:
    """The first wrong documents of every query, and one more drawn by hash from the rest: (query_id, doc_id, drawn)."""
    wrong = run.join(correct, ["query_id", "doc_id"], "left_anti")
    w = Window.partitionBy("query_id")
    numbered = wrong.withColumn("n", F.row_number().over(w.orderBy("rank", "doc_id")))
    draw = F.sha2(F.concat_ws(":", F.lit(salt), "query_id", "doc_id"), 256)
    rest = numbered.filter(F.col("n") > hardest).groupBy("query_id").agg(F.min_by("doc_id", F.struct(draw, "doc_id")).alias("doc_id"))
    return numbered.filter(F.col("n") <= hardest).select("query_id", "doc_id", F.lit(False).alias("drawn")).unionByName(rest.withColumn("drawn", F.lit(True)))


def candidate_list(base: DataFrame, pool: DataFrame, n: int) -> DataFrame:
    """The first n of the base, then the pool (query_id, doc_id, score) best first, then the rest of the base."""
    keys = base.select("query_id", "doc_id", F.when(F.col("rank") <= n, 0).otherwise(2).alias("tier"), F.col("rank").cast("double").alias("key")).unionByName(pool.select("query_id", "doc_id", F.lit(1).alias("tier"), (-F.col("score")).cast("double").alias("key")))
    first = keys.groupBy("query_id", "doc_id").agg(F.min(F.struct("tier", "key")).alias("k"))
    return first.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("k", "doc_id")).alias("rank"))


def citation_checks(citations: DataFrame, texts: DataFrame, shortest: int = 5, longest: int = 80) -> DataFrame:
    """Adds ``failures`` to citations (claim_id, doc_id, quote, shown): unknown document, one that wasn't shown, quotes too
    short, too long or not literal after NFC and single spaces.

    ``texts``: (doc_id, text), one row a document.
    """
    plain = lambda c: T.collapsed(T.nfc(F.coalesce(c, F.lit(""))))
    known = texts.select("doc_id", plain(F.col("text")).alias("text_"), F.lit(True).alias("known_"))
    rows = citations.withColumn("quote_", plain(F.col("quote"))).join(known, "doc_id", "left")
    n = F.when(F.col("quote_") == "", 0).otherwise(F.size(F.split("quote_", " ")))
    found = F.array(
        F.when(F.col("known_").isNull(), "unknown"),
        F.when(~F.coalesce("shown", F.lit(False)), "not shown"),
        F.when(n < shortest, "too short").when(n > longest, "too long"),
        F.when(F.col("known_") & (n >= shortest) & ~F.col("text_").contains(F.col("quote_")), "not literal"),
    )
    return rows.withColumn("failures", F.array_compact(found)).drop("known_", "quote_")


def answered(checked: DataFrame, claims: DataFrame, sufficient: DataFrame) -> DataFrame:
    """The three abstention rules by answer: its own word, the checks, both.

    ``checked``: citations with ``failures`` and ``text_``; ``claims``: (answer_id, claim_id, text); ``sufficient``:
    (answer_id, sufficient), one row an answer. A claim without citation, or with figures its cited documents lack, fails.
    """
    cited = checked.groupBy("claim_id").agg(F.max(F.size("failures")).alias("bad"), F.array_distinct(F.flatten(F.collect_list(T.figures(F.col("text_"))))).alias("figures_"))
    claim = claims.join(cited, "claim_id", "left")
    passes = F.coalesce((F.col("bad") == 0) & (F.size(F.array_except(T.figures(F.col("text")), F.col("figures_"))) == 0), F.lit(False))
    every = claim.groupBy("answer_id").agg(F.min(passes).alias("all_pass"))
    out = sufficient.join(every, "answer_id", "left").withColumn("b", F.coalesce("all_pass", F.lit(False)))
    return out.select("answer_id", F.col("sufficient").alias("a"), "b", (F.col("sufficient") & F.col("b")).alias("c"))


def admission(given: DataFrame, returned: DataFrame, job: str, item: str) -> DataFrame:
    """Every job whose reply doesn't name exactly the items it was given: (job, missing, unknown, repeated)."""
    parts = max(PARTS, int(given.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = given.select(job, item, F.lit(1).alias("given_"), F.lit(0).alias("n_")).unionByName(returned.select(job, item, F.lit(0).alias("given_"), F.lit(1).alias("n_")))
    # a null names nothing: given and returned ones don't meet
    side = F.when(F.col(job).isNull() | F.col(item).isNull(), F.col("given_"))
    # dealt once and by a number of parts, which is kept as it is; merged parts would hold more items at once
    each = every.repartition(parts, job).groupBy(job, item, side.alias("side_")).agg(F.max("given_").alias("given_"), F.sum("n_").alias("n_"))
    out = each.groupBy(job).agg(
        F.count(F.when(F.col("n_") == 0, 1)).alias("missing"), F.count(F.when(F.col("given_") == 0, 1)).alias("unknown"), F.count(F.when(F.col("n_") > 1, 1)).alias("repeated")
    )
    return out.filter("missing + unknown + repeated > 0")


def packed(groups: DataFrame, owner: str, order: str, nodes: str, tokens: str, max_nodes: int, max_tokens: int) -> DataFrame:
    """Adds ``batch``: groups in order, a batch closed before the group that would overfill it; empty groups are left out.

    A fold over an owner's groups, which a pool's depth bounds.
    """
    own = groups.filter(F.col(nodes) > 0).groupBy(owner).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(nodes).cast("long").alias("n"), F.col(tokens).cast("long").alias("t")))).alias("g"))
    zero = F.lit(0).cast("long")
    start = F.struct(F.array().cast("array<struct<o:bigint,b:bigint>>").alias("out"), F.lit(1).cast("long").alias("b"), zero.alias("n"), zero.alias("t"))

    def step(acc: Column, x: Column) -> Column:
        over = (acc["n"] > 0) & ((acc["n"] + x["n"] > max_nodes) | (acc["t"] + x["t"] > max_tokens))
        b = F.when(over, acc["b"] + 1).otherwise(acc["b"])
        grown = lambda k: F.when(over, x[k]).otherwise(acc[k] + x[k]).alias(k)
        return F.struct(F.concat(acc["out"], F.array(F.struct(x["o"].cast("long").alias("o"), b.alias("b")))).alias("out"), b.alias("b"), grown("n"), grown("t"))

    return own.select(owner, F.explode(F.aggregate("g", start, step)["out"]).alias("x")).select(owner, F.col("x.o").alias(order), F.col("x.b").alias("batch"))


def score_comparison(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """One row: exact, within tolerance or differs; other keys always differ."""
    both = a.select(*keys, F.col("score").alias("x")).join(b.select(*keys, F.col("score").alias("y")), keys, "full_outer")
    gap = both.agg(F.coalesce(F.max(F.abs(F.col("x") - F.col("y"))), F.lit(0.0)).alias("largest"), F.count(F.when(F.col("x").isNull() | F.col("y").isNull(), 1)).alias("alone"), F.count(F.col("x") + F.col("y")).alias("compared"))
    outcome = F.when(F.col("alone") > 0, "differs").when(F.col("largest") == 0, "exact").when(F.col("largest") <= tolerance, "within tolerance").otherwise("differs")
    return gap.select(outcome.alias("outcome"), "largest", "alone", "compared")


def margins(run: DataFrame, top: int = 10) -> DataFrame:
    """Per query the exact ties and least gaps between neighbours, at full depth and around the first ``top``."""
    gap = F.col("score") - F.lead("score").over(Window.partitionBy("query_id").orderBy("rank"))
    return run.withColumn("gap", gap).groupBy("query_id").agg(F.count(F.when(F.col("gap") == 0, 1)).alias("ties"), F.min("gap").alias("least"), F.min(F.when(F.col("rank") <= top, F.col("gap"))).alias("least_top"))


def fragile(run: DataFrame, moved: DataFrame, threshold: float, top: int = 10) -> DataFrame:
    """Neighbours among the first ``top`` + 1 closer than the threshold, with their gap in the moved run."""
    w = Window.partitionBy("query_id").orderBy("rank")
    pairs = run.withColumn("next", F.lead("doc_id").over(w)).withColumn("gap", F.col("score") - F.lead("score").over(w)).filter((F.col("rank") <= top) & (F.col("gap") < threshold))
    m = lambda a, b: moved.select("query_id", F.col("doc_id").alias(a), F.col("score").alias(b))
    out = pairs.join(m("doc_id", "x"), ["query_id", "doc_id"], "left").join(m("next", "y"), ["query_id", "next"], "left")
    return out.select("query_id", "rank", "doc_id", "next", "gap", (F.col("x") - F.col("y")).alias("moved_gap"))


def without_contributor(pooled: DataFrame, names: list[str]) -> DataFrame:
    """Pooled documents once for each contributor left out: those that it alone found go. (out, query_id, doc_id)"""
    each = pooled.withColumn("out", F.explode(F.array(*map(F.lit, names))))
    alone = (F.size("contributors") == 1) & (F.get("contributors", F.lit(0)) == F.col("out"))
    return each.filter(~alone).select("out", "query_id", "doc_id")


def binary_metrics(run: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, ndcg, map, mrr) at k with gain 1 for every relevant (query_id, doc_id); unranked ones count, a query without a run scores 0."""
    rel = relevant.select("query_id", "doc_id").distinct()
    total = rel.groupBy("query_id").agg(F.count("*").alias("total"))
    hits = run.filter(F.col("rank") <= k).join(rel, ["query_id", "doc_id"]).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    got = hits.groupBy("query_id").agg(F.count("*").alias("found"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("n") / F.col("rank")).alias("precisions"), F.min("rank").alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("total", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return total.join(got, "query_id", "left").select("query_id", z(F.col("found") / F.col("total")).alias("recall"), z(F.col("dcg") / ideal).alias("ndcg"), z(F.col("precisions") / F.col("total")).alias("map"), z(1 / F.col("first")).alias("mrr"))


def uses(nodes: DataFrame, terms: DataFrame, act: str, text: str, pattern: Column) -> DataFrame:
    """Nodes with the terms of their own act that they use, at the first place: adds ``at`` (from 1).

    Every text meets the terms of one act, its glossary: a join on the act with a pattern.
    """
    own = terms.withColumn("pattern_", pattern)
    both = nodes.join(own, act).withColumn("at", F.expr(f"regexp_instr({text}, pattern_)"))
    return both.filter("at > 0").drop("pattern_")


def inside(rows: DataFrame, areas: DataFrame, group: str, value: str) -> DataFrame:
    """Rows with the area (group, area, low, high) that holds their value; ``area`` is null outside. Areas of a group don't overlap.

    The area that starts last at or below a value is the only one that can hold it, so areas are merged into the rows by
    order, and a long list of areas costs no more than a sort.
    """
    marks = areas.select(group, F.col("low").alias("at_"), F.struct("area", "high").alias("open_"), F.lit(0).alias("side_"), F.lit(None).alias("row_"))
    points = rows.select(group, F.col(value).alias("at_"), F.lit(None).alias("open_"), F.lit(1).alias("side_"), F.struct("*").alias("row_"))
    last = F.last("open_", ignorenulls=True).over(Window.partitionBy(group).orderBy("at_", "side_"))
    return marks.union(points).withColumn("last_", last).filter("side_ = 1").select("row_.*", F.when(F.col("at_") <= F.col("last_.high"), F.col("last_.area")).alias("area"))


def similar_pairs(df: DataFrame, key: str, words: str, percent: int = 50) -> DataFrame:
    """Pairs (a, b, jaccard) of distinct word sets that share at least ``percent`` of their union, with members by ``set_of``.

    Prefix filter: of sets that are so alike, the rarest few words of both must meet; sizes must agree as well. Rows with the
    same set are one class, so copies make no pairs.
    """
    classes = set_of(df, key, words).groupBy("class").agg(F.first("set").alias("set"))
    each = classes.select("class", F.size("set").alias("n"), F.explode("set").alias("w"))
    df_ = each.groupBy("w").agg(F.count("*").alias("df"))
    ordered = each.join(df_, "w").withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("df", "w")))
    prefix = ordered.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("class", "n", "w")
    x, y = prefix.toDF("a", "na", "w"), prefix.toDF("b", "nb", "w")
    near = (F.col("a") < F.col("b")) & (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    pairs = x.join(y, "w").filter(near).select("a", "b").distinct()
    s = lambda c, v: classes.toDF(c, v)
    full = pairs.join(s("a", "x"), "a").join(s("b", "y"), "b")
    i, u = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    return full.filter(i * 100 >= u * percent).select("a", "b", F.round(i / u, 6).alias("jaccard"))


def set_of(df: DataFrame, key: str, words: str) -> DataFrame:
    """(key, class, set): the class of a row is the digest of its word set; rows without words have none."""
    rows = df.select(F.col(key), F.array_sort(F.array_distinct(words)).alias("set")).filter(F.size("set") > 0)
    return rows.withColumn("class", F.md5(F.array_join("set", "\x1f")))


def sensitivity(run: DataFrame, readings: dict[str, DataFrame], metric: str, k: int = 10) -> DataFrame:
    """A binary metric of one run under several readings of the judgments, all in one pass: (scenario, metric, queries)."""
    named = [r.select(F.struct(F.lit(name).alias("scenario"), "query_id").alias("query_id"), "doc_id") for name, r in readings.items()]
    relevant = named[0]
    for r in named[1:]:
        relevant = relevant.unionByName(r)
    each = run.withColumn("query_id", F.explode(F.array(*[F.struct(F.lit(name).alias("scenario"), "query_id") for name in readings])))
    return binary_metrics(each, relevant, k).groupBy(F.col("query_id.scenario").alias("scenario")).agg(F.round(F.avg(metric), 6).alias(metric), F.count("*").alias("queries"))


def word_uses(nodes: DataFrame, terms: DataFrame, act: str, key: str, text: str) -> DataFrame:
    """(act, key, term): the one-word terms of its act that a text uses, in any case, in the singular or a plain plural.

    Texts become their distinct words, which meet the terms' forms on (act, word): a join on an equality whatever the
    size of the glossary. Terms of several words go through ``uses``.
    """
    y = F.col("term").rlike("[^aeou]y$") | (F.col("term") == "y")
    forms = F.when(y, F.array(F.col("term"), F.concat(F.expr("substring(term, 1, length(term) - 1)"), F.lit("ies")))).otherwise(F.array(F.col("term"), F.concat("term", F.lit("s")), F.concat("term", F.lit("es"))))
    wanted = terms.select(act, F.lower("term").alias("term")).distinct().select(act, "term", F.explode(forms).alias("word_"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([\p{L}\p{N}_-]+)"), 1))
    return nodes.select(act, key, F.explode(words).alias("word_")).join(wanted, [act, "word_"]).select(act, key, "term").distinct()


def search(df: DataFrame, key: str, text: str, pattern: str, scope: Column | None = None, before: int = 90, after: int = 110) -> DataFrame:
    """(key, pos, snippet, place): every match of a pattern in any case, in text order; ``pos`` counts from 1. ``scope`` filters the rows first."""
    hit = StructType([StructField("pos", LongType()), StructField("snippet", StringType()), StructField("place", LongType())])

    @F.pandas_udf(ArrayType(hit))
    def run(texts: pd.Series) -> pd.Series:
        found = re.compile(pattern, re.I)
        return texts.map(lambda t: [{"pos": m.start() + 1, "snippet": t[max(0, m.start() - before) : m.start() + after], "place": k} for k, m in enumerate(found.finditer(t), 1)])

    rows = df if scope is None else df.filter(scope)
    # the JVM's quick look keeps texts without a match out of Python
    return rows.filter(F.col(text).rlike(f"(?iu){pattern}")).select(key, F.explode(run(F.col(text))).alias("m_")).select(key, "m_.*")

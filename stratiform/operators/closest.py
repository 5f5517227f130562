"""Top-k set similarity join: every item's closest others by Jaccard, without meeting all holders of common words.

Words stand in the order of their rarity. A round looks up the next words of the items that are still open (as many
as all before) among all items: whoever shares none of an item's first i words has at most (n - i) of its n words in
common, so once the item's k-th best Jaccard is above (n - i) / n, it is settled. Only items without near
partners go on to their frequent words. In a round, an item's bound rises with what it has found: a holder whose size,
or whose words behind the shared one, can't reach the k-th best is not met. Items of equal words are one class that
is met once, and stands for as many of its members as a list can hold.

Words that very many classes hold are dealt into parts, which their few askers visit one by one; the tables of a
round lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.scratch import Scratch

#: Classes of a word's part.
PART = 20_000
#: Jaccards are compared to so many places; bounds keep a little more than one of them.
PLACES, SLACK = 9, 2e-9


def _bound(shared: Column, n: str | Column, m: str | Column) -> Column:
    size = (F.col(n) if isinstance(n, str) else n) + (F.col(m) if isinstance(m, str) else m)
    return shared / (size - shared)


def classes(items: DataFrame, key: str, words: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """(key, class) of every item with words, and (class, n, words, low): the distinct words from the rarest on, and the class's ``keep`` smallest keys."""
    own = items.select(key, F.array_sort(F.array_distinct(F.coalesce(words, F.array().cast("array<string>")))).alias("w")).filter(F.size("w") > 0)
    member = own.withColumn("class", F.xxhash64(F.to_json("w"), F.md5(F.to_json("w"))))
    first = member.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy(key))).filter(F.col("r") <= keep)
    low = first.groupBy("class").agg(F.array_sort(F.collect_list(key)).alias("low"), F.max_by("w", -F.col("r")).alias("w"))
    each = low.select("class", F.explode("w").alias("word"))
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    ordered = each.join(df, "word").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("words"))
    return member.select(key, "class"), ordered.join(low.drop("w"), "class").select("class", F.size("words").alias("n"), "words", "low")


def search(sets: DataFrame, keep: int, scratch: Scratch) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(class, b, jaccard) of the ``keep`` closest members for every class of ``sets`` (class, n, words, low), its own among them; and the rounds' (open classes, pairs met)."""
    parts = lambda df: F.ceil(df / PART).cast("int")
    held_by = sets.select(F.col("class").alias("b"), F.col("n").alias("m"), F.posexplode("words").alias("j", "x")).select("b", "m", "j", F.col("x.word").alias("word"), F.pmod(F.hash("b"), parts(F.col("x.df"))).alias("part"))
    index = scratch.keep(held_by)
    best = scratch.keep(sets.select("class", F.col("class").alias("other"), F.lit(1.0).alias("jaccard"), F.explode("low").alias("b")))
    open_ = scratch.keep(_state(sets, best, keep))
    log, done = [], 0
    while not open_.isEmpty():
        upto = max(1, 2 * done)
        mine = open_.select("class", "n", "least", F.explode(F.slice(F.transform("words", lambda x, i: F.struct(i.alias("i"), x["word"].alias("word"), x["df"].alias("df"))), done + 1, upto - done)).alias("x"))
        asked = mine.filter("x.df > 1").select("class", "n", "least", "x.i", "x.word", F.explode(F.sequence(F.lit(0), parts(F.col("x.df")) - 1)).alias("part"))
        behind = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))  # with the word itself
        near = (F.col("class") != F.col("b")) & (_bound(behind, "n", "m") >= F.col("least") - SLACK)
        pairs = asked.join(index, ["word", "part"]).filter(near).select("class", "b").distinct()
        new = scratch.keep(pairs.join(best.select("class", F.col("other").alias("b")).distinct(), ["class", "b"], "left_anti"))
        names = lambda a, b, c: sets.select(F.col("class").alias(a), F.transform("words", lambda x: x["word"]).alias(b), F.col("low").alias(c))
        full = new.join(names("class", "x", "own"), "class").join(names("b", "y", "low"), "b")
        i = F.size(F.array_intersect("x", "y"))
        scored = full.select("class", F.col("b").alias("other"), F.round(i / (F.size("x") + F.size("y") - i), PLACES).alias("jaccard"), F.explode("low").alias("b"))
        order = Window.partitionBy("class").orderBy(F.col("jaccard").desc(), "b")
        better = scratch.keep(best.unionByName(scored.select(best.columns)).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep).drop("r"))
        log.append((open_.count(), new.count()))
        done = upto
        left = scratch.keep(_state(open_.select("class", "n", "words", "low"), better, keep).filter((F.col("n") > done) & ((F.col("n") - done) / F.col("n") >= F.col("least") - SLACK)))
        scratch.drop(best, open_, new)
        best, open_ = better, left
    return best.select("class", "b", "jaccard"), log


def _state(sets: DataFrame, best: DataFrame, keep: int) -> DataFrame:
    """Adds ``least``: the Jaccard that a new partner must reach, 0 while there are fewer than ``keep``."""
    reached = best.groupBy("class").agg(F.when(F.count("*") >= keep, F.min("jaccard")).otherwise(0.0).alias("least"))
    return sets.join(reached, "class", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))


def closest(items: DataFrame, key: str, words: str, top: int = 3, rounds: list[tuple[int, int]] | None = None) -> DataFrame:
    """(a, b, jaccard, rank): the ``top`` other items of the highest Jaccard of their distinct words, ties by key.

    Where fewer than ``top`` items share a word with one, others follow by key with Jaccard 0; the first 2 * ``top`` keys
    and one more are enough for those. Items without words (or null) have only such partners. Keys are distinct and
    not null. ``rounds``, a list, is filled with each round's open classes and pairs met.
    """
    scratch = Scratch(items.sparkSession, "closest")
    member, sets = classes(items, key, words, top + 1)
    sets, member = scratch.keep(sets), scratch.keep(member)
    best, log = search(sets, top + 1, scratch)
    if rounds is not None:
        rounds.extend(log)
    met = member.withColumnRenamed(key, "a").join(best, "class").filter(F.col("a") != F.col("b")).select("a", "b", "jaccard")
    few = items.select(F.col(key).alias("a")).join(met.groupBy("a").agg(F.count("*").alias("k_")), "a", "left").filter(F.coalesce("k_", F.lit(0)) < top).select("a")
    first = items.select(F.col(key).alias("b")).orderBy("b").limit(2 * top + 1)
    rest = few.crossJoin(F.broadcast(first)).filter(F.col("a") != F.col("b")).join(met.select("a", "b"), ["a", "b"], "left_anti").withColumn("jaccard", F.lit(0.0))
    order = Window.partitionBy("a").orderBy(F.col("jaccard").desc(), "b")
    return met.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

"""Quotation linking in conversations, in DataFrame functions only.

A line's quote level is the number of ``>`` it begins with. Consecutive lines of one level above 0
are a passage; its text without the marks, in lower case (A-Z) and with single spaces, is hashed and
joined to the messages of the same conversation: to a whole message without its quotes, to one of its
paragraphs, or to one of its lines. The latest earlier turn with the same hash is the original. A passage
of several lines that no earlier turn has so is looked up as a run of consecutive lines (blank ones left
out); runs are made of the lengths that are asked for in that conversation only.

A message replies to the latest original among its passages of the lowest level linked; without a
link to the turn before it; the first turn replies to none. ``depth`` counts the replies up to the
start, by pointer doubling: each round doubles the distance every message knows, so rounds are the
logarithm of the longest chain. Ordered by (conversation, depth, turn) a message follows what it
replies to.

Hot keys: the search for the latest earlier turn is in two steps, inside blocks of ``BLOCK`` turns and
over one row a block, so one hash that fills a huge conversation never meets in one task; every other
join is on (conversation, turn).

Defined cases: null text counts as empty; rows with a null conversation or turn are kept, without
links and with depth 0; repeated (conversation, turn) rows all get the links of their own text and
are one point of the reply graph (it replies to the latest of their originals); messages without own
text are fine; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.llm import common as C

BLOCK = 1024
_MARKS = r"^((?:[ \t]*>)+)[ \t]?"
_QUOTED = r"^[ \t]*>"


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1)


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[ \t]", ""))


def normalised(text: Column) -> Column:
    """Lower case A-Z, single spaces, trimmed."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, "[ \t\n\u000b\f\r]+", " "))


def own_text(text: Column) -> Column:
    """The text without quoted lines, trimmed of white space at both ends."""
    kept = F.array_join(F.filter(_lines(text), lambda x: ~x.rlike(_QUOTED)), "\n")
    return F.regexp_replace(kept, r"^[ \t\n\u000b\f\r]+|[ \t\n\u000b\f\r]+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, text_key, level, run, hash, n): the quoted passages of messages (conv, turn, text), and their lines that aren't blank."""
    quoting = messages.filter(F.col("text").rlike(r"(?m)^[ \t]*>") | F.col("text").contains("\r")).withColumn("text_key", F.md5("text")).select("conv", "turn", "text_key", "text").distinct()
    lines = quoting.select("conv", "turn", "text_key", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    levels = lines.select("conv", "turn", "text_key", "pos", quote_level(F.col("line")).alias("level"), F.regexp_replace("line", _MARKS, "").alias("body"))
    message = Window.partitionBy("conv", "turn", "text_key").orderBy("pos")
    runs = levels.withColumn("run", F.sum((F.col("level") != F.coalesce(F.lag("level").over(message), F.lit(-1))).cast("int")).over(message))
    whole = runs.filter("level > 0").groupBy("conv", "turn", "text_key", "run", "level").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("x"))
    text = normalised(F.array_join(F.col("x.body"), " "))
    n = F.size(F.filter("x.body", lambda b: normalised(b) != ""))
    return whole.select("conv", "turn", "text_key", "level", "run", text.alias("t"), n.alias("n")).filter("t <> ''").select("conv", "turn", "text_key", "level", "run", F.sha2("t", 256).alias("hash"), "n")


def originals(messages: DataFrame) -> DataFrame:
    """(conv, turn, hash): what later messages may quote of each one's own text."""
    own = own_text(F.col("text"))
    units = F.array_union(F.array(own), F.array_union(F.split(own, r"\n[ \t]*\n"), F.split(own, "\n")))
    every = F.array_distinct(F.transform(units, normalised))
    return messages.select("conv", "turn", F.explode(F.filter(every, lambda u: u != "")).alias("u")).select("conv", "turn", F.sha2("u", 256).alias("hash")).distinct()


def line_runs(messages: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, turn, hash): runs of consecutive lines of each one's own text, of the lengths (conv, lengths) of its conversation."""
    lines = F.filter(F.transform(F.split(own_text(F.col("text")), "\n"), normalised), lambda x: x != "")
    rows = messages.join(lengths, "conv").select("conv", "turn", "lengths", lines.alias("lines"))
    of = lambda m: F.transform(F.sequence(F.lit(1), F.size("lines") - m + 1), lambda i: F.sha2(F.array_join(F.slice("lines", i, m), " "), 256))
    every = F.flatten(F.transform(F.filter("lengths", lambda m: m <= F.size("lines")), of))
    return rows.select("conv", "turn", F.explode(F.array_distinct(every)).alias("hash"))


def latest_before(asks: DataFrame, facts: DataFrame) -> DataFrame:
    """``asks`` (conv, turn, hash, ...) with ``found``: the latest turn of ``facts`` (conv, turn, hash) before its own, or null."""
    block = F.floor(F.col("turn") / BLOCK)
    wanted = asks.select("conv", "hash").distinct()
    facts = facts.join(wanted, ["conv", "hash"], "left_semi").withColumn("block", block)
    points = asks.select("conv", "hash", "turn").distinct().withColumn("block", block)
    inside = Window.partitionBy("conv", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    both = points.withColumn("fact", F.lit(None).cast("long")).unionByName(facts.withColumn("fact", F.col("turn")))
    near = both.withColumn("near", F.max("fact").over(inside)).filter("fact is null").drop("fact")
    last = facts.groupBy("conv", "hash", "block").agg(F.max("turn").alias("last"))
    asked = points.groupBy("conv", "hash", "block").agg(F.lit(None).cast("long").alias("last"))
    before = Window.partitionBy("conv", "hash").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    carried = last.unionByName(asked).groupBy("conv", "hash", "block").agg(F.max("last").alias("last")).withColumn("carry", F.max("last").over(before)).drop("last")
    answer = near.join(carried, ["conv", "hash", "block"], "left").select("conv", "hash", "turn", F.coalesce("near", "carry").alias("found"))
    return asks.join(answer, ["conv", "hash", "turn"], "left")


def depths(parents: DataFrame) -> DataFrame:
    """(conv, turn, depth) from (conv, turn, parent): replies up to the start, by pointer doubling."""
    scratch = C.Scratch(parents.sparkSession, "quotes")
    state = scratch.keep(parents.select("conv", "turn", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    longest = state.groupBy("conv").count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        # only those that haven't come to a start are looked up again
        top = state.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        open_ = state.filter("up is not null").join(top, ["conv", "up"], "left").select("conv", "turn", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"))
        new = scratch.keep(open_.unionByName(state.filter("up is null").select("conv", "turn", "up", "depth")))
        scratch.drop(state)
        state = new
        if state.filter("up is not null").isEmpty():
            break
    return state.select("conv", "turn", "depth")


def link(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, own_text, n_quotes, n_linked, reply_to, depth): conversations without quotes; order them by (conv, depth, turn)."""
    src = C.pick(df, conv_col, turn_col, role_col, text_col).toDF("conv", "turn", "role", "text")
    known = src.filter(F.col("conv").isNotNull() & F.col("turn").isNotNull()).select("conv", F.col("turn").cast("long").alias("turn"), "text")
    scratch = C.Scratch(df.sparkSession, "quotes")
    asked = scratch.keep(passages(known))
    # only conversations that quote at all are taken apart
    quoting = known.join(asked.select("conv").distinct(), "conv", "left_semi")
    whole = scratch.keep(latest_before(asked, originals(quoting)))
    missing = whole.filter("found is null and n > 1").drop("found")
    lengths = missing.groupBy("conv").agg(F.collect_set("n").alias("lengths"))
    quoted = scratch.keep(whole.filter("found is not null or n = 1").unionByName(latest_before(missing, line_runs(quoting, lengths))))
    per_text = quoted.groupBy("conv", "turn", "text_key").agg(
        F.count("*").alias("n_quotes"),
        F.count("found").alias("n_linked"),
        F.min(F.when(F.col("found").isNotNull(), F.struct(F.col("level").alias("level"), (-F.col("found")).alias("back")))).alias("best"),
    )
    turns = known.groupBy("conv", "turn").agg(F.lit(0).alias("one")).drop("one")
    previous = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = previous.withColumn("p", F.lag("turn").over(Window.partitionBy("conv", "block").orderBy("turn")))
    lasts = previous.groupBy("conv", "block").agg(F.max("turn").alias("last")).withColumn("carry", F.lag("last").over(Window.partitionBy("conv").orderBy("block"))).drop("last")
    chain = inside.join(lasts, ["conv", "block"]).select("conv", "turn", F.coalesce("p", "carry").alias("previous"))
    linked = per_text.groupBy("conv", "turn").agg(F.min("best").alias("best"))
    parents = scratch.keep(chain.join(linked, ["conv", "turn"], "left").select("conv", "turn", F.coalesce(-F.col("best.back"), F.col("previous")).alias("parent")))
    graph = parents.join(depths(parents), ["conv", "turn"])
    keyed = src.withColumn("at_", F.col("turn").cast("long")).withColumn("key_", F.md5("text"))
    counts = per_text.select(F.col("conv"), F.col("turn").alias("at_"), F.col("text_key").alias("key_"), "n_quotes", "n_linked")
    out = keyed.join(graph.withColumnRenamed("turn", "at_"), ["conv", "at_"], "left").join(counts, ["conv", "at_", "key_"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        own_text(F.col("text")).alias("own_text"),
        zero("n_quotes"),
        zero("n_linked"),
        F.col("parent").alias("reply_to"),
        zero("depth"),
    )

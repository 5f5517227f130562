"""Legal units to chunks: rendering, governing ancestors, budgeted chunks with their texts, model inputs, truncation.

nodes are (article, path, kind, marker, own_text, ordinal); an article's node has the article's path. The token count is a
column function of a text, by default its words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.functions.text import ancestors, parent

LINE, SECTION = "\n", "\n\n"
#: Kinds whose text is a sibling of what stands beside them, not led in by what is above.
SUBDIVISIONS = ("subparagraph", "unnumbered")
Count = Callable[[Column], Column]


def words(text: Column) -> Column:
    """Default token count: runs without white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), 1))


def rendered(kind: Column, marker: Column, text: Column) -> Column:
    """A node's line: its marker as the law prints it, then its own text."""
    return F.when(kind == "apartado", F.concat(marker, F.lit(". "), text)).when(kind == "punto", F.concat(F.lit("("), marker, F.lit(") "), text)).otherwise(text)


def _lines(rows: DataFrame, *by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), LINE)


def governing(nodes: DataFrame) -> DataFrame:
    """(article, path, context): the rendered ancestors whose own text governs a node, from the article down.

    An ancestor is skipped where the step down from it is an explicit subdivision, or where it has no text.
    """
    up = nodes.select("article", "path", F.explode(F.slice(ancestors(F.col("path")), 1, F.size(F.split("path", r"\.")) - 1)).alias("above"))
    step = F.concat_ws(".", "above", F.get(F.split("path", r"\."), F.size(F.split("above", r"\."))))
    above = nodes.select("article", F.col("path").alias("above"), "ordinal", rendered(F.col("kind"), F.col("marker"), F.col("own_text")).alias("line")).filter(F.coalesce(F.col("own_text"), F.lit("")) != "")
    down = nodes.select("article", F.col("path").alias("step"), F.col("kind").alias("step_kind"))
    led = up.withColumn("step", step).join(down, ["article", "step"]).filter(~F.col("step_kind").isin(*SUBDIVISIONS)).join(above, ["article", "above"])
    return led.groupBy("article", "path").agg(_lines(led).alias("context"))


def chunks(nodes: DataFrame, headings: DataFrame, budget: int, count: Count = words) -> DataFrame:
    """(article, root, coverage, sources, context, text, tokens, over): the largest units whose whole text fits the budget.

    A unit is taken whole ("subtree") where it fits and nothing above it does, or where it has no parts; a unit that
    doesn't fit gives its own text ("own") and its parts are looked at. What is over the budget all the same says so.
    headings: (article, heading). The text of a subtree is put together inside one article, the unit of the law.
    """
    filled = nodes.filter(F.coalesce(F.col("own_text"), F.lit("")) != "").withColumn("line", rendered(F.col("kind"), F.col("marker"), F.col("own_text")))
    led = nodes.select("article", "path").join(governing(nodes), ["article", "path"], "left").join(headings, "article")
    context = F.when(F.col("context").isNull(), F.col("heading")).otherwise(F.concat("heading", F.lit(SECTION), "context"))
    led = led.select("article", F.col("path").alias("root"), context.alias("context"))
    below = filled.withColumn("root", F.explode(ancestors(F.col("path"))))
    sources = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "path"))), lambda x: x["path"]).alias("sources")
    trees = below.groupBy("article", "root").agg(_lines(below).alias("body"), sources).withColumn("coverage", F.lit("subtree"))
    own = filled.withColumn("root", F.col("path")).groupBy("article", "root").agg(_lines(filled).alias("body"), sources).withColumn("coverage", F.lit("own"))
    text = F.concat("context", F.lit(SECTION), "body")
    every = trees.unionByName(own).join(led, ["article", "root"]).withColumn("text", text).drop("body").withColumn("tokens", count(F.col("text")))
    parts = nodes.select("article", parent(F.col("path")).alias("root")).filter("root is not null").distinct().withColumn("parted", F.lit(True))
    sized = every.join(parts, ["article", "root"], "left").withColumn("fits", (F.col("tokens") <= budget) | F.col("parted").isNull())
    whole = sized.filter("coverage = 'subtree'")
    # a unit is looked at where no unit above it was taken whole
    taken = whole.filter("fits").select("article", F.col("root").alias("above"))
    strict = sized.select("article", "root", "coverage", F.explode(F.slice(ancestors(F.col("root")), 1, F.size(F.split("root", r"\.")) - 1)).alias("above"))
    shut = strict.join(taken, ["article", "above"], "left_semi").select("article", "root", "coverage").distinct()
    seen = sized.join(shut, ["article", "root", "coverage"], "left_anti")
    split = whole.filter("not fits").select("article", "root")
    kept = seen.filter("coverage = 'subtree' and fits").unionByName(seen.filter("coverage = 'own'").join(split, ["article", "root"], "left_semi").select(*seen.columns))
    over = F.when(F.col("tokens") > budget, F.when(F.col("coverage") == "own", "own_over_budget").otherwise("leaf_over_budget"))
    return kept.select("article", "root", "coverage", "sources", "context", "text", "tokens", over.alias("over"))


def source_spans(chunked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(article, root, coverage, path, start, end): where each source's line stands in a chunk's text."""
    lines = nodes.select("article", "path", F.length(rendered(F.col("kind"), F.col("marker"), F.col("own_text"))).alias("n"))
    each = chunked.select("article", "root", "coverage", F.length("context").alias("c"), F.posexplode("sources").alias("pos", "path")).join(lines, ["article", "path"])
    w = Window.partitionBy("article", "root", "coverage").orderBy("pos")
    end = F.col("c") + len(SECTION) + F.sum(F.col("n") + len(LINE)).over(w) - len(LINE)
    return each.withColumn("end", end).select("article", "root", "coverage", "path", (F.col("end") - F.col("n")).alias("start"), "end")


def model_inputs(df: DataFrame, key: str, text: str, limit: int, prefix: str = "", kind: str = "document", lead: int = 1, trail: int = 1) -> DataFrame:
    """(key, tokens, original, encoded, truncated, dropped, kept_chars): what a model with room for ``limit`` tokens is given.

    Tokens are runs without white space of prefix and text; ``lead`` and ``trail`` special ones stand around them. A
    document is cut at its tail, a query that is too long is an error.
    """
    whole = F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))
    found = F.regexp_extract_all(whole, F.lit(r"(\s*\S+)"), 1)
    rows = df.select(key, F.col(text).alias("t_"), found.alias("w_")).withColumn("original", F.size("w_") + lead + trail)
    room = limit - lead - trail
    if room < 1:
        raise ValueError("the limit leaves no room for text")
    over = F.col("original") > limit
    if kind == "query":
        rows = rows.withColumn("original", F.when(over, F.raise_error(F.concat(F.lit("a query over the limit is never cut: "), F.col(key).cast("string"))).cast("int")).otherwise(F.col("original")))
    kept = F.when(over, F.slice("w_", 1, room)).otherwise(F.col("w_"))
    chars = F.when(over, F.greatest(F.lit(0), F.length(F.array_join(kept, "")) - len(prefix))).otherwise(F.length(F.coalesce("t_", F.lit(""))))
    out = rows.withColumn("k_", kept).withColumn("kept_chars", chars)
    return out.select(key, F.transform("k_", lambda w: F.regexp_replace(w, r"^\s+", "")).alias("tokens"), "original", (F.size("k_") + lead + trail).alias("encoded"), over.alias("truncated"), (F.col("original") - F.size("k_") - lead - trail).alias("dropped"), "kept_chars")


def exposure(spans: DataFrame, inputs: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, need_id, grade, state): judged nodes whose text a truncated input loses, "cut" or "partly cut". spans: (keys, path, start, end)."""
    lost = spans.join(inputs.filter("truncated").select(*keys, "kept_chars"), keys).filter(F.col("end") > F.col("kept_chars"))
    state = F.when(F.col("start") < F.col("kept_chars"), "partly cut").otherwise("cut")
    return lost.join(judged, "path").select(*keys, "path", "need_id", "grade", state.alias("state"))

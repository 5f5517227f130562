"""Trees given by dotted paths: closures, nearest existing ancestors, budgeted chunks, spans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from stratiform.functions.text import ancestors


def closure(nodes: DataFrame, path: str = "path") -> DataFrame:
    """(…, ancestor): every node with each of its prefixes, itself included."""
    return nodes.withColumn("ancestor", F.explode(ancestors(F.col(path))))


def nearest_existing(refs: DataFrame, nodes: DataFrame, ref_path: str, path: str = "path") -> DataFrame:
    """Every reference with its longest prefix that is a node, or null."""
    prefixes = refs.select(ref_path, F.explode(ancestors(F.col(ref_path))).alias("prefix")).distinct()
    hits = prefixes.join(nodes.select(F.col(path).alias("prefix")).distinct(), "prefix")
    best = hits.groupBy(ref_path).agg(F.max_by("prefix", F.size(F.split("prefix", r"\."))).alias("resolved"))
    return refs.join(best, ref_path, "left")


def budget_chunks(nodes: DataFrame, budget: int, path: str = "path", tokens: str = "tokens") -> DataFrame:
    """Chunk of every node: the highest node whose whole subtree fits the budget while none above it does; a node
    none of whose subtrees fits is a chunk of its own text. (path, chunk, own_only).

    Subtree sizes are sums over the closure, pre-aggregated; the join back brings a root's rows together, which
    adaptive execution splits where a root is hot.
    """
    totals = closure(nodes, path).groupBy("ancestor").agg(F.sum(tokens).alias("total"))
    each = closure(nodes.select(path), path).join(totals, "ancestor")
    fitting = each.filter(F.col("total") <= budget).groupBy(path).agg(F.min_by("ancestor", F.size(F.split("ancestor", r"\."))).alias("root"))
    return nodes.join(fitting, path, "left").select(path, F.coalesce("root", path).alias("chunk"), F.col("root").isNull().alias("own_only"))


def spans(parts: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Offsets of parts joined by one character: (group, order, start, end)."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    w = Window.partitionBy(group).orderBy(order)
    return parts.withColumn("end", F.sum(n + 1).over(w) - 1).withColumn("start", F.col("end") - n)


PIECE = StructType([StructField("page", IntegerType()), StructField("text", StringType())])


def page_texts(text: str | None, limit: int) -> list[str]:
    """Pages of at most ``limit`` characters that joined give the text back: whole lines as far as they fit, a line longer than the limit in pieces of it."""
    out, held, size = [], [], 0

    def close() -> None:
        nonlocal size
        if held:
            out.append("".join(held))
            held.clear()
        size = 0

    for line in (text or "").splitlines(keepends=True):
        pieces = [line[i : i + limit] for i in range(0, len(line), limit)]
        if len(pieces) > 1 or size + len(line) > limit:
            close()
        out += pieces[:-1]
        held.append(pieces[-1])
        size += len(pieces[-1])
    close()
    return out or [""]


def pages(df: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """(key, page, text): the pages of every text, from 0; a null text is one empty page."""

    @F.pandas_udf(ArrayType(PIECE))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"page": k, "text": p} for k, p in enumerate(page_texts(t, limit))])

    return df.select(key, F.explode(run(F.col(text))).alias("p_")).select(key, "p_.page", "p_.text")


def changed(base: DataFrame, other: DataFrame, key: str, text: str) -> DataFrame:
    """Full outer difference of two versions: (key, change)."""
    both = base.select(key, F.col(text).alias("x"), F.lit(1).alias("i")).join(other.select(key, F.col(text).alias("y"), F.lit(1).alias("j")), key, "full_outer")
    kind = F.when(F.col("i").isNull(), "added").when(F.col("j").isNull(), "removed").when(~F.col("x").eqNullSafe(F.col("y")), "amended")
    return both.select(key, kind.alias("change")).filter("change is not null")


def explained(base: DataFrame, other: DataFrame, markers: DataFrame, key: str, text: str, act: str = "act") -> tuple[DataFrame, DataFrame]:
    """Two versions compared and checked against the later one's amendment markers (key, act): (changes, problems).

    changes (key, change, acts): what was added or amended, with the acts whose markers say so. problems (key, problem)
    contradict them: ``removed`` keys, ``unexplained`` changes without a marker, and ``silent`` markers of what didn't change.
    Changes are only good while there are no problems.
    """
    found = changed(base, other, key, text)
    acts = markers.groupBy(key).agg(F.array_sort(F.collect_set(act)).alias("acts"))
    both = found.join(acts, key, "full_outer")
    problem = F.when(F.col("change") == "removed", "removed").when(F.col("acts").isNull(), "unexplained").when(F.col("change").isNull(), "silent")
    judged = both.withColumn("problem", problem)
    return judged.filter("problem is null").select(key, "change", "acts"), judged.filter("problem is not null").select(key, "problem")

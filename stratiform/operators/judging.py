"""Judgments, chunk layers and runs held against each other: projection, evaluable needs, and the checks before any number is read.

qrels are (need_id, act, path, grade, ambiguous, text_sha256), owners (chunk_id, act, path), chunks (chunk_id, tokens).
Checks return violations as (rule, key, n): an empty result is a passed check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = ["act", "path"]


def _violations(df: DataFrame, rule: str, *keys: str) -> DataFrame:
    """One row a key that breaks a rule, with the number of rows that do."""
    return df.groupBy(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key")).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "key", "n")


def _all(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def judged(qrels: DataFrame) -> DataFrame:
    """Judgments that count: the ambiguous ones are as if unjudged."""
    return qrels.filter(~F.coalesce("ambiguous", F.lit(False)))


def project(qrels: DataFrame, owners: DataFrame) -> DataFrame:
    """(need_id, chunk_id, grade): the highest grade among the judged nodes a chunk owns. Judged nodes nobody owns are an error; see ``unowned``."""
    return judged(qrels).join(owners, NODE).groupBy("need_id", "chunk_id").agg(F.max("grade").alias("grade"))


def unowned(qrels: DataFrame, owners: DataFrame) -> DataFrame:
    return _violations(judged(qrels).join(owners, NODE, "left_anti"), "no chunk owns the node", *NODE)


def evaluable(needs: DataFrame, qrels: DataFrame, relevant: int = 2) -> DataFrame:
    """Needs (need_id, status, answerability) that are ready, can be answered and have relevant evidence."""
    ready = needs.filter((F.col("status") == "ready") & (F.col("answerability") != "none"))
    return ready.join(judged(qrels).filter(F.col("grade") >= relevant).select("need_id").distinct(), "need_id", "left_semi")


def run_problems(run: DataFrame, chunks: DataFrame, queries: DataFrame, depth: int, least: int) -> DataFrame:
    """A run's contract: requested depth, no longer lists, known queries, known chunks, none twice."""
    shallow = run.sparkSession.range(1).select(F.lit("depth below the minimum").alias("rule"), F.lit(str(depth)).alias("key"), F.lit(1).cast("long").alias("n")).filter(F.lit(depth < least))
    twice = run.groupBy("query_id", "doc_id").count().filter("count > 1")
    long = run.groupBy("query_id").count().filter(F.col("count") > depth)
    return _all(
        shallow,
        _violations(run.join(queries.select("query_id"), "query_id", "left_anti"), "query is not evaluated", "query_id"),
        _violations(long, "longer than the depth", "query_id"),
        _violations(twice, "ranked twice", "query_id", "doc_id"),
        _violations(run.join(chunks.select(F.col("chunk_id").alias("doc_id")), "doc_id", "left_anti"), "not in the layer", "query_id", "doc_id"),
    )


def layer_problems(owners: DataFrame, nodes: DataFrame, layer: DataFrame, manifest: DataFrame) -> DataFrame:
    """A layer's contract: same sources (act, source_sha256) as the manifest's, every node with text owned exactly once, none besides."""
    several = owners.groupBy(*NODE).agg(F.countDistinct("chunk_id").alias("c")).filter("c > 1")
    filled = nodes.filter(F.coalesce(F.col("own_text"), F.lit("")) != "")
    stale = layer.join(manifest.withColumnRenamed("source_sha256", "sealed"), "act", "full_outer").filter(~F.col("source_sha256").eqNullSafe(F.col("sealed")))
    return _all(
        _violations(stale, "another source", "act"),
        _violations(several, "owned by several chunks", *NODE),
        _violations(filled.join(owners, NODE, "left_anti"), "owned by no chunk", *NODE),
        _violations(owners.join(filled, NODE, "left_anti"), "owned but without text", *NODE),
    )


def text_problems(qrels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Judged nodes that are gone, or whose text is no longer the judged one."""
    both = qrels.join(nodes.select(*NODE, "own_text"), NODE, "left")
    gone = both.filter(F.col("own_text").isNull())
    changed = both.filter(F.col("own_text").isNotNull() & (F.sha2("own_text", 256) != F.col("text_sha256")))
    return _all(_violations(gone, "judged node is gone", "need_id", *NODE), _violations(changed, "judged text has changed", "need_id", *NODE))


def adjudication_problems(records: DataFrame, grades: Column | None = None) -> DataFrame:
    """Records (need_id, act, path, first, second, final, reason): grades of the scale, a second judge's difference settled by a reason, an agreement kept, one record a node."""
    scale = list(range(4))
    off = records.filter(~F.col("first").isin(scale) | ~F.coalesce(F.col("second"), F.lit(0)).isin(scale) | ~F.coalesce(F.col("final"), F.lit(0)).isin(scale))
    differ = F.col("second").isNotNull() & (F.col("first") != F.col("second"))
    keys = ["need_id", *NODE]
    return _all(
        _violations(off, "grade off the scale", *keys),
        _violations(records.filter(differ & (F.col("final").isNull() | (F.trim(F.coalesce("reason", F.lit(""))) == ""))), "difference not settled", *keys),
        _violations(records.filter(~differ & ~F.col("final").eqNullSafe(F.col("first"))), "agreement not kept", *keys),
        _violations(records.groupBy(*keys).count().filter("count > 1"), "several records", *keys),
    )


def dataset_problems(needs: DataFrame, queries: DataFrame, qrels: DataFrame, languages: list[str], excluded: DataFrame | None = None) -> DataFrame:
    """Rules over a whole dataset: unique keys and texts, no orphans, every language, evidence where there should be some, acts as the evidence says."""
    relevant = judged(qrels).filter("grade >= 2")
    acts = relevant.groupBy("need_id").agg(F.array_sort(F.collect_set("act")).alias("found"))
    wrong = needs.join(acts, "need_id").filter(F.array_sort(F.array_distinct("acts")) != F.col("found"))
    spoken = queries.groupBy("need_id").agg(F.collect_set("lang").alias("spoken"))
    missing = needs.select("need_id").join(spoken, "need_id", "left").filter(F.size(F.array_except(F.array(*map(F.lit, languages)), F.coalesce("spoken", F.array().cast("array<string>")))) > 0)
    checks = [
        _violations(needs.groupBy("need_id").count().filter("count > 1"), "need twice", "need_id"),
        _violations(queries.groupBy("query_id").count().filter("count > 1"), "query twice", "query_id"),
        _violations(qrels.groupBy("need_id", *NODE).count().filter("count > 1"), "judged twice", "need_id", *NODE),
        _violations(queries.withColumn("t", F.md5(F.lower(F.trim("text")))).groupBy("t").count().filter("count > 1"), "same text", "t"),
        _violations(queries.join(needs, "need_id", "left_anti"), "query without need", "query_id"),
        _violations(qrels.join(needs, "need_id", "left_anti"), "judgment without need", "need_id", *NODE),
        _violations(missing, "language missing", "need_id"),
        _violations(needs.filter("answerability <> 'none'").join(relevant, "need_id", "left_anti"), "no evidence", "need_id"),
        _violations(needs.filter("answerability = 'none'").join(relevant, "need_id", "left_semi"), "evidence against answerability", "need_id"),
        _violations(wrong, "acts are not those of the evidence", "need_id"),
    ]
    if excluded is not None:
        checks.append(_violations(qrels.join(excluded, NODE, "left_semi"), "excluded node", "need_id", *NODE))
    return _all(*checks)


def provenance(ids: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Asked ids (pos, chunk_id) with their chunk and document, ``known`` false where one is missing; order it by pos."""
    found = chunks.join(documents, "document_id")
    return ids.join(found, "chunk_id", "left").withColumn("known", F.col("document_id").isNotNull())


def evidence_overlap(a: DataFrame, b: DataFrame, grade: int = 3) -> DataFrame:
    """(a, b, nodes, articles): needs of two sets that share an article of the highest grade, and what they share."""
    top = lambda q, name: judged(q).filter(F.col("grade") == grade).select(F.col("need_id").alias(name), "act", F.substring_index("path", ".", 1).alias("article"), "path").distinct()
    x, y = top(a, "a"), top(b, "b")
    articles = x.select("a", "act", "article").distinct().join(y.select("b", "act", "article").distinct(), ["act", "article"])
    nodes = x.join(y, ["act", "article", "path"]).groupBy("a", "b").agg(F.array_sort(F.collect_set(F.concat_ws(":", "act", "path"))).alias("nodes"))
    shared = articles.groupBy("a", "b").agg(F.array_sort(F.collect_set(F.concat_ws(":", "act", "article"))).alias("articles"))
    return shared.join(nodes, ["a", "b"], "left").select("a", "b", F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"), "articles")


def evidence_strata(needs: DataFrame, overlap: DataFrame) -> DataFrame:
    shared = overlap.select(F.col("a").alias("need_id")).distinct().withColumn("hit", F.lit(True))
    return needs.select("need_id").join(shared, "need_id", "left").select("need_id", F.when(F.col("hit"), "shared_grade3_article").otherwise("no_shared_grade3").alias("stratum"))


def without_excluded(nodes: DataFrame, excluded: DataFrame) -> DataFrame:
    """Nodes (act, path, ...) of articles that no exclusion (act, article) names."""
    return nodes.withColumn("article", F.substring_index("path", ".", 1)).join(excluded.select("act", "article"), ["act", "article"], "left_anti").drop("article")


def titles(nodes: DataFrame) -> DataFrame:
    """Articles (act, path, title, place) in their order: by number, then by what follows it."""
    number = F.regexp_extract("path", r"^(\d*)", 1)
    order = Window.partitionBy("act").orderBy(F.when(number != "", number.cast("int")), F.regexp_extract("path", r"^\d*(.*)$", 1))
    return nodes.filter(~F.col("path").contains(".")).select("act", "path", "title").withColumn("place", F.row_number().over(order)).orderBy("act", "place")


def forbidden(texts: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term): terms (term, kind) found in texts: ``literal`` anywhere, ``folded`` in any case and spacing, ``exact`` the whole text, ``regex`` as pattern.

    The terms of a leak scan are a list; Spark broadcasts it as far as its size allows.
    """
    folded = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    pattern = F.col("term")
    t = F.coalesce(F.col(text), F.lit(""))
    hit = (
        F.when(F.col("kind") == "literal", t.contains(F.col("term")))
        .when(F.col("kind") == "folded", folded(t).contains(folded(F.col("term"))))
        .when(F.col("kind") == "exact", t == F.col("term"))
        .when(F.col("kind") == "regex", F.regexp_like(t, pattern))
    )
    return texts.select(key, text).join(terms, hit).select(key, "term")

"""Queries over judgments, layers and runs made from orders and customers by arithmetic; the same SQL makes the inputs on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.catalog import register
from stratiform.operators import judging as J
from stratiform.plans.evaluation import _OVERLAP, overlap_run

# Inputs, in SQL that both engines read.
NODES = "SELECT concat('A', CAST(c_nationkey % 3 AS STRING)) AS act, concat(CAST(c_nationkey AS STRING), '.', CAST(c_custkey AS STRING)) AS path, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS own_text, c_custkey AS k FROM customer"
QRELS = "SELECT k % 50 AS need_id, concat('A', CAST(c_nationkey % 3 AS STRING)) AS act, concat(CAST(c_nationkey AS STRING), '.', CAST(c_custkey AS STRING)) AS path, CAST(floor(k / 50) % 4 AS INT) AS grade, k % 13 = 0 AS ambiguous, k, c_name FROM (SELECT o_orderkey % 50 AS n, o_custkey AS cust, min(o_orderkey) AS k FROM orders GROUP BY o_orderkey % 50, o_custkey) x JOIN customer ON c_custkey = cust WHERE c_custkey % 11 > 0"
OWNERS = "SELECT concat('c', CAST(CAST(floor(c_custkey / 5) AS BIGINT) AS STRING)) AS chunk_id, concat('A', CAST(c_nationkey % 3 AS STRING)) AS act, concat(CAST(c_nationkey AS STRING), '.', CAST(c_custkey AS STRING)) AS path FROM customer WHERE c_custkey % 11 > 0"
NEEDS = "SELECT DISTINCT o_orderkey % 50 AS need_id, CASE WHEN o_orderkey % 50 % 7 = 0 THEN 'draft' ELSE 'ready' END AS status, CASE WHEN o_orderkey % 50 % 5 = 0 THEN 'none' ELSE 'complete' END AS answerability FROM orders"
QUERIES = "SELECT o_orderkey AS query_id, o_orderkey % 53 AS need_id, CASE o_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'es' ELSE 'it' END AS lang, concat('text ', CAST(o_custkey AS STRING), ' ', CAST(o_orderkey % 97 AS STRING)) AS text FROM orders WHERE o_orderkey % 10 = 1"
RUN = "SELECT o_orderkey % 23 AS query_id, concat('c', CAST(o_custkey % 31 AS STRING)) AS doc_id FROM orders WHERE o_orderkey % 40 = 1"
_WITH = f"nodes AS ({NODES}), qrels AS ({QRELS}), owners AS ({OWNERS}), needs AS ({NEEDS}), queries AS ({QUERIES}), run AS ({RUN}), good AS (SELECT * FROM qrels WHERE NOT ambiguous)"


def made(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    read = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "orders", "nation", "lineitem", "events", "documents", "benchmark")}
    for t in read:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **{t: d for t, d in read.items() if f"{{{t}}}" in sql})


def _key(*columns: str) -> str:
    return "concat_ws('|', " + ", ".join(f"{c}::VARCHAR" for c in columns) + ") AS key, count(*) AS n"


@register("projected_grades", f"WITH {_WITH} SELECT need_id, chunk_id, max(grade) AS grade FROM good JOIN owners USING (act, path) GROUP BY ALL")
def projected_grades(spark: SparkSession, sf: str) -> DataFrame:
    return J.project(made(spark, sf, QRELS), made(spark, sf, OWNERS))


@register("evaluable_needs", f"WITH {_WITH} SELECT need_id, status, answerability FROM needs WHERE status = 'ready' AND answerability <> 'none' AND need_id IN (SELECT need_id FROM good WHERE grade >= 2)")
def evaluable_needs(spark: SparkSession, sf: str) -> DataFrame:
    return J.evaluable(made(spark, sf, NEEDS), made(spark, sf, QRELS))


#: Runs of all orders: three of the 53 queries have no need, and documents of the last fifth of the customers no chunk.
_WHOLE_RUN = "SELECT o_orderkey % 53 AS query_id, concat('c', CAST(CAST(floor(o_custkey / 4) AS BIGINT) AS STRING)) AS doc_id FROM orders"


@register("run_contract", f"""WITH owners AS ({OWNERS}), needs AS ({NEEDS}), run AS ({_WHOLE_RUN}), q AS (SELECT need_id AS query_id FROM needs)
SELECT 'depth below the minimum' AS rule, '5' AS key, 1::BIGINT AS n
UNION ALL SELECT 'query is not evaluated', {_key("query_id")} FROM run WHERE query_id NOT IN (SELECT query_id FROM q) GROUP BY query_id
UNION ALL SELECT 'longer than the depth', query_id::VARCHAR, 1 FROM run GROUP BY query_id HAVING count(*) > 5
UNION ALL SELECT 'ranked twice', concat_ws('|', query_id, doc_id), 1 FROM run GROUP BY query_id, doc_id HAVING count(*) > 1
UNION ALL SELECT 'not in the layer', {_key("query_id", "doc_id")} FROM run WHERE doc_id NOT IN (SELECT chunk_id FROM owners) GROUP BY query_id, doc_id""")
def run_contract(spark: SparkSession, sf: str) -> DataFrame:
    chunks = made(spark, sf, OWNERS).select("chunk_id").distinct()
    return J.run_problems(made(spark, sf, _WHOLE_RUN), chunks, made(spark, sf, NEEDS).select(F.col("need_id").alias("query_id")), 5, 10)


@register("layer_contract", f"""WITH {_WITH}, o AS (SELECT * FROM owners WHERE path NOT LIKE '%7' UNION ALL SELECT 'extra', act, path FROM owners WHERE path LIKE '%13' UNION ALL SELECT 'e', act, path FROM nodes WHERE own_text = '' AND k % 3 = 0)
SELECT 'another source' AS rule, 'A1' AS key, 1::BIGINT AS n UNION ALL SELECT 'another source', 'A2', 1
UNION ALL SELECT 'owned by several chunks', concat_ws('|', act, path), 1 FROM o GROUP BY act, path HAVING count(DISTINCT chunk_id) > 1
UNION ALL SELECT 'owned by no chunk', concat_ws('|', act, path), 1 FROM nodes WHERE own_text <> '' AND (act, path) NOT IN (SELECT (act, path) FROM o)
UNION ALL SELECT 'owned but without text', {_key("act", "path")} FROM o WHERE (act, path) NOT IN (SELECT (act, path) FROM nodes WHERE own_text <> '') GROUP BY act, path""")
def layer_contract(spark: SparkSession, sf: str) -> DataFrame:
    nodes, owners = made(spark, sf, NODES), made(spark, sf, OWNERS)
    extra = owners.filter("path like '%13'").withColumn("chunk_id", F.lit("extra"))
    empty = nodes.filter("own_text = '' and k % 3 = 0").select(F.lit("e").alias("chunk_id"), "act", "path")
    layer, sealed = spark.createDataFrame([("A0", "x"), ("A1", "y")], "act string, source_sha256 string"), spark.createDataFrame([("A0", "x"), ("A1", "z"), ("A2", "x")], "act string, source_sha256 string")
    return J.layer_problems(owners.filter("path not like '%7'").unionByName(extra).unionByName(empty), nodes, layer, sealed)


@register("judged_texts", f"""WITH {_WITH}, j AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'x' ELSE sha256(c_name) END AS h FROM qrels), both_ AS (SELECT j.need_id, j.act, j.path, h, n.own_text FROM j LEFT JOIN (SELECT * FROM nodes WHERE k % 5 > 0) n USING (act, path))
SELECT 'judged node is gone' AS rule, {_key("need_id", "act", "path")} FROM both_ WHERE own_text IS NULL GROUP BY need_id, act, path
UNION ALL SELECT 'judged text has changed', {_key("need_id", "act", "path")} FROM both_ WHERE sha256(own_text) <> h GROUP BY need_id, act, path""")
def judged_texts(spark: SparkSession, sf: str) -> DataFrame:
    q = made(spark, sf, QRELS).withColumn("text_sha256", F.when(F.col("k") % 17 == 0, "x").otherwise(F.sha2("c_name", 256)))
    return J.text_problems(q, made(spark, sf, NODES).filter("k % 5 > 0"))


_RECORDS = "SELECT o_orderkey % 50 AS need_id, 'A' AS act, CAST(o_custkey AS STRING) AS path, o_orderkey % 5 AS first, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 END AS second, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 5 END AS final, CASE WHEN o_orderkey % 2 = 0 THEN 'because' ELSE ' ' END AS reason FROM orders"


@register("adjudication_rules", f"""WITH r AS ({_RECORDS})
SELECT 'grade off the scale' AS rule, {_key("need_id", "act", "path")} FROM r WHERE first > 3 OR final > 3 GROUP BY need_id, act, path
UNION ALL SELECT 'difference not settled', {_key("need_id", "act", "path")} FROM r WHERE second IS NOT NULL AND first <> second AND (final IS NULL OR trim(reason) = '') GROUP BY need_id, act, path
UNION ALL SELECT 'agreement not kept', {_key("need_id", "act", "path")} FROM r WHERE (second IS NULL OR first = second) AND final IS DISTINCT FROM first GROUP BY need_id, act, path
UNION ALL SELECT 'several records', concat_ws('|', need_id, act, path), 1 FROM r GROUP BY need_id, act, path HAVING count(*) > 1""")
def adjudication_rules(spark: SparkSession, sf: str) -> DataFrame:
    return J.adjudication_problems(made(spark, sf, _RECORDS))


@register("dataset_contract", f"""WITH {_WITH}, j AS (SELECT * FROM qrels UNION ALL SELECT * FROM qrels WHERE k % 19 = 0 UNION ALL SELECT 99, act, path, grade, ambiguous, k, c_name FROM qrels WHERE k % 43 = 0),
rel AS (SELECT * FROM j WHERE NOT ambiguous AND grade >= 2), acts AS (SELECT need_id, list_sort(list(DISTINCT act)) AS found FROM rel GROUP BY need_id),
sp AS (SELECT need_id, list(DISTINCT lang) AS l FROM queries GROUP BY need_id)
SELECT 'judged twice' AS rule, concat_ws('|', need_id, act, path) AS key, 1::BIGINT AS n FROM j GROUP BY need_id, act, path HAVING count(*) > 1
UNION ALL SELECT 'same text', md5(text), 1 FROM queries GROUP BY text HAVING count(*) > 1
UNION ALL SELECT 'query without need', query_id::VARCHAR, 1 FROM queries WHERE need_id NOT IN (SELECT need_id FROM needs)
UNION ALL SELECT 'judgment without need', {_key("need_id", "act", "path")} FROM j WHERE need_id NOT IN (SELECT need_id FROM needs) GROUP BY need_id, act, path
UNION ALL SELECT 'language missing', need_id::VARCHAR, 1 FROM needs LEFT JOIN sp USING (need_id) WHERE coalesce(len(list_intersect(l, ['en', 'es', 'it'])), 0) < 3
UNION ALL SELECT 'no evidence', need_id::VARCHAR, 1 FROM needs WHERE answerability <> 'none' AND need_id NOT IN (SELECT need_id FROM rel)
UNION ALL SELECT 'evidence against answerability', need_id::VARCHAR, 1 FROM needs WHERE answerability = 'none' AND need_id IN (SELECT need_id FROM rel)
UNION ALL SELECT 'acts are not those of the evidence', need_id::VARCHAR, 1 FROM needs JOIN acts USING (need_id) WHERE found <> ['A0', 'A1']
UNION ALL SELECT 'excluded node', {_key("need_id", "act", "path")} FROM j WHERE (act, path) IN (SELECT (act, path) FROM nodes WHERE k % 29 = 0) GROUP BY need_id, act, path""")
def dataset_contract(spark: SparkSession, sf: str) -> DataFrame:
    q = made(spark, sf, QRELS)
    j = q.unionByName(q.filter("k % 19 = 0")).unionByName(q.filter("k % 43 = 0").withColumn("need_id", F.lit(99).cast(q.schema["need_id"].dataType)))
    needs = made(spark, sf, NEEDS).withColumn("acts", F.array(F.lit("A1"), F.lit("A0"), F.lit("A1")))
    return J.dataset_problems(needs, made(spark, sf, QUERIES), j, ["en", "es", "it"], made(spark, sf, NODES).filter("k % 29 = 0").select("act", "path"))


@register("evidence_overlaps", f"""WITH {_WITH}, t AS (SELECT DISTINCT need_id, act, split_part(path, '.', 1) AS article, path FROM good WHERE grade = 3),
s AS (SELECT a.need_id AS a, b.need_id AS b, list_sort(list(DISTINCT a.act || ':' || a.article)) AS articles, coalesce(list_sort(list(DISTINCT a.act || ':' || a.path) FILTER (a.path = b.path)), []) AS nodes FROM t a JOIN t b USING (act, article) WHERE a.need_id % 2 = 0 AND b.need_id % 2 = 1 GROUP BY ALL)
SELECT a, b, array_to_string(nodes, ' ') AS nodes, array_to_string(articles, ' ') AS articles FROM s""")
def evidence_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Two test sets: the needs with even and those with odd numbers."""
    q = made(spark, sf, QRELS)
    return J.evidence_overlap(q.filter("need_id % 2 = 0"), q.filter("need_id % 2 = 1")).select("a", "b", F.array_join("nodes", " ").alias("nodes"), F.array_join("articles", " ").alias("articles"))


@register("evidence_strata", f"""WITH {_WITH}, t AS (SELECT DISTINCT need_id, act, split_part(path, '.', 1) AS article FROM good WHERE grade = 3)
SELECT need_id, CASE WHEN need_id IN (SELECT a.need_id FROM t a JOIN t b USING (act, article) WHERE a.need_id % 2 = 0 AND b.need_id % 2 = 1) THEN 'shared_grade3_article' ELSE 'no_shared_grade3' END AS stratum FROM needs""")
def evidence_strata(spark: SparkSession, sf: str) -> DataFrame:
    q = made(spark, sf, QRELS)
    return J.evidence_strata(made(spark, sf, NEEDS), J.evidence_overlap(q.filter("need_id % 2 = 0"), q.filter("need_id % 2 = 1")))


@register("chunk_provenance", """WITH c AS (SELECT c_custkey AS chunk_id, c_nationkey AS document_id FROM customer), i AS (SELECT o_orderkey AS pos, o_custkey + 3 AS chunk_id FROM orders)
SELECT pos, i.chunk_id, document_id, n_name AS title, document_id IS NOT NULL AS known FROM i LEFT JOIN (SELECT * FROM c JOIN nation ON n_nationkey = document_id AND n_nationkey < 20) x USING (chunk_id)""")
def chunk_provenance(spark: SparkSession, sf: str) -> DataFrame:
    ids = made(spark, sf, "SELECT o_orderkey AS pos, o_custkey + 3 AS chunk_id FROM orders")
    chunks = made(spark, sf, "SELECT c_custkey AS chunk_id, c_nationkey AS document_id FROM customer")
    documents = made(spark, sf, "SELECT n_nationkey AS document_id, n_name AS title FROM nation WHERE n_nationkey < 20")
    return J.provenance(ids, chunks, documents)


@register("excluded_articles", f"WITH {_WITH} SELECT act, path FROM nodes WHERE NOT (act = 'A1' AND split_part(path, '.', 1)::INT % 2 = 0) ")
def excluded_articles(spark: SparkSession, sf: str) -> DataFrame:
    nodes = made(spark, sf, NODES)
    excluded = nodes.select("act", F.substring_index("path", ".", 1).alias("article")).filter("act = 'A1' and cast(article as int) % 2 = 0").distinct()
    return J.without_excluded(nodes.select("act", "path"), excluded)


@register("article_titles", """WITH a AS (SELECT 'N' AS act, (n_nationkey % 7)::VARCHAR || CASE WHEN n_nationkey > 12 THEN 'a' || n_nationkey ELSE '' END AS path, n_name AS title FROM nation WHERE n_nationkey < 7 OR n_nationkey > 12)
SELECT act, path, title, row_number() OVER (ORDER BY regexp_extract(path, '^(\\d*)', 1)::INT, regexp_extract(path, '^\\d*(.*)$', 1)) AS place FROM a""")
def article_titles(spark: SparkSession, sf: str) -> DataFrame:
    a = made(spark, sf, "SELECT 'N' AS act, concat(CAST(n_nationkey % 7 AS STRING), CASE WHEN n_nationkey > 12 THEN concat('a', CAST(n_nationkey AS STRING)) ELSE '' END) AS path, n_name AS title FROM nation WHERE n_nationkey < 7 OR n_nationkey > 12")
    return J.titles(a.unionByName(a.withColumn("path", F.concat("path", F.lit(".1"))))).withColumn("place", F.col("place").cast("long"))


@register("forbidden_terms", r"""WITH t AS (SELECT unnest(['license', 'THE  the', 'no.?thing', '[0-9]{6}', '']) AS term, unnest(['literal', 'folded', 'regex', 'regex', 'exact']) AS kind)
SELECT doc_id, term FROM documents, t WHERE CASE kind WHEN 'literal' THEN contains(coalesce(text, ''), term) WHEN 'folded' THEN contains(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')), 'the the') WHEN 'exact' THEN coalesce(text, '') = term ELSE regexp_matches(coalesce(text, ''), term) END""")
def forbidden_terms(spark: SparkSession, sf: str) -> DataFrame:
    terms = spark.createDataFrame([("license", "literal"), ("THE  the", "folded"), ("no.?thing", "regex"), ("[0-9]{6}", "regex"), ("", "exact")], "term string, kind string")
    return J.forbidden(made(spark, sf, "SELECT * FROM documents"), terms, "doc_id", "text")


_BASE = f"{_OVERLAP}, base AS (SELECT query_id, doc_id, rank FROM overlap)"
_HITS = "hits AS (SELECT query_id, doc_id, list, pos, score FROM (SELECT query_id, doc_id, (doc_id % 3) AS list, row_number() OVER (PARTITION BY query_id, doc_id % 3 ORDER BY doc_id % 101, doc_id) AS pos, (doc_id % 7)::DOUBLE AS score FROM overlap) WHERE pos <= 5)"


def hits(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    run = overlap_run(spark, sf).select("query_id", "doc_id", (F.col("doc_id") % 3).alias("list"), (F.col("doc_id") % 7).cast("double").alias("score"))
    return run.withColumn("pos", F.row_number().over(Window.partitionBy("query_id", "list").orderBy(F.col("doc_id") % 101, "doc_id")))


#: The lists are disjoint here, so their turns are a sort; the fold for shared documents is tested by hand.
_DEALT = """top AS (SELECT * FROM base WHERE rank <= 10), named AS (SELECT DISTINCT query_id, doc_id FROM hits),
fresh AS (SELECT h.*, row_number() OVER (PARTITION BY query_id, list ORDER BY pos) AS turn FROM hits h WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM top)),
turns AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, list) - 1 AS t FROM fresh),
open AS (SELECT query_id, count(*) - count(*) FILTER ((query_id, doc_id) IN (SELECT (query_id, doc_id) FROM named)) AS slots FROM top WHERE rank > 6 GROUP BY query_id),
c AS (SELECT query_id, doc_id, CASE WHEN (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM named) THEN 0 ELSE 2 END AS tier, rank::DOUBLE AS k1, 0.0 AS k2 FROM top WHERE rank > 6 UNION ALL {added}),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, k1, k2, doc_id) AS r FROM c) WHERE r <= 4),
e AS (SELECT b.query_id, b.doc_id, b.rank, CASE WHEN b.rank <= 6 THEN 'kept' WHEN f.tier = 0 THEN 'corroborated' WHEN f.tier = 1 THEN 'added' WHEN f.tier = 2 THEN 'base' ELSE 'rest' END AS place FROM base b LEFT JOIN f USING (query_id, doc_id))
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY place = 'rest', rank) AS rank, place FROM e"""


@register("decomposition_merge", f"WITH {_BASE}, {_HITS}, {_DEALT.format(added='SELECT query_id, doc_id, 1, t::DOUBLE, 0.0 FROM turns')}")
def decomposition_merge(spark: SparkSession, sf: str) -> DataFrame:
    from stratiform.operators import retrieval as R

    return R.decomposition(overlap_run(spark, sf).select("query_id", "doc_id", "rank"), hits(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@register("scored_merge", f"WITH {_BASE}, {_HITS}, {_DEALT.format(added='SELECT query_id, doc_id, 1, -score, CASE WHEN t < coalesce(slots, 4) THEN t::DOUBLE ELSE 1e9 + rank END FROM turns LEFT JOIN open USING (query_id) JOIN base USING (query_id, doc_id)')}")
def scored_merge(spark: SparkSession, sf: str) -> DataFrame:
    from stratiform.operators import retrieval as R

    return R.decomposition(overlap_run(spark, sf).select("query_id", "doc_id", "rank"), hits(spark, sf), scored=True).withColumn("rank", F.col("rank").cast("long"))


@register("function_turns", f"WITH {_BASE}, t AS (SELECT query_id, doc_id, doc_id % 4 AS f, row_number() OVER (PARTITION BY query_id, doc_id % 4 ORDER BY rank) AS turn FROM base) SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY turn, f, doc_id) AS rank FROM t) WHERE rank <= 12")
def function_turns(spark: SparkSession, sf: str) -> DataFrame:
    from stratiform.operators import retrieval as R

    lists = overlap_run(spark, sf).select("query_id", "doc_id", (F.col("doc_id") % 4).alias("function"), F.col("rank").alias("pos"))
    return R.turns_over(lists, "function", 12).withColumn("rank", F.col("rank").cast("long"))

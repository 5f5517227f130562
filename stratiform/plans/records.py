"""Queries over records of judges and jobs, made from orders and line items by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.catalog import register
from stratiform.operators import curation as Q
from stratiform.plans.judging import made

_FIRST = "SELECT o_orderkey AS node, o_custkey % 4 AS grade, o_orderkey % 9 = 0 AS ambiguous FROM orders"
_SECOND = "SELECT o_orderkey AS node, (o_custkey + o_orderkey % 2) % 4 AS grade FROM orders WHERE o_orderkey % 3 > 0"
_THIRD = "SELECT o_orderkey AS node, o_custkey % 3 AS grade FROM orders WHERE o_orderkey % 5 = 0"
_DECISIVE = "SELECT o_orderkey AS node FROM orders WHERE o_orderkey % 7 = 0"


@register("judgments_owed", f"""WITH a AS ({_FIRST}), b AS ({_SECOND}), d AS ({_DECISIVE})
SELECT node, CASE WHEN grade >= 1 THEN 'graded' WHEN ambiguous THEN 'ambiguous' ELSE 'decisive' END AS reason FROM a WHERE (grade >= 1 OR ambiguous OR node IN (SELECT node FROM d)) AND node NOT IN (SELECT node FROM b)""")
def judgments_owed(spark: SparkSession, sf: str) -> DataFrame:
    return Q.owed(made(spark, sf, _FIRST), made(spark, sf, _SECOND), made(spark, sf, _DECISIVE), ["node"])


@register("judgment_disputes", f"WITH a AS ({_FIRST}), b AS ({_SECOND}), c AS ({_THIRD}) SELECT node, a.grade AS g1, b.grade AS g2 FROM a JOIN b USING (node) WHERE a.grade <> b.grade AND node NOT IN (SELECT node FROM c)")
def judgment_disputes(spark: SparkSession, sf: str) -> DataFrame:
    return Q.disputes(made(spark, sf, _FIRST), made(spark, sf, _SECOND), made(spark, sf, _THIRD), ["node"])


@register("three_judges", f"""WITH j AS (SELECT node, grade FROM ({_FIRST}) UNION ALL SELECT * FROM ({_SECOND}) UNION ALL SELECT * FROM ({_THIRD})), g AS (SELECT node, list_sort(list(grade)) AS g, count(*) AS judges FROM j GROUP BY node)
SELECT node, judges, CASE WHEN judges = 3 THEN g[2] END AS grade, CASE WHEN judges < 3 THEN 'incomplete' WHEN len(list_distinct(g)) = 1 THEN 'unanimous' WHEN len(list_distinct(g)) = 2 THEN 'majority' ELSE 'middle' END AS outcome FROM g""")
def three_judges(spark: SparkSession, sf: str) -> DataFrame:
    a, b, c = (made(spark, sf, x).select("node", F.lit(k).alias("judge"), "grade") for k, x in enumerate((_FIRST, _SECOND, _THIRD)))
    return Q.assembled(a.unionByName(b).unionByName(c), ["node"])


@register("judge_agreement", f"""WITH x AS (SELECT a.grade AS a, b.grade AS b FROM ({_FIRST}) a JOIN ({_SECOND}) b USING (node)),
s AS (SELECT count(*) AS n, avg((a = b)::INT) AS same, avg(((a >= 2) = (b >= 2))::INT) AS agree, avg((a >= 2)::INT) AS x, avg((b >= 2)::INT) AS y FROM x)
SELECT n, round(same, 6) AS same, round(agree, 6) AS agree, round((agree - (x * y + (1 - x) * (1 - y))) / (1 - (x * y + (1 - x) * (1 - y))), 6) AS kappa FROM s""")
def judge_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return Q.review_summary(made(spark, sf, _FIRST), made(spark, sf, _SECOND), ["node"])


_JOBS = "SELECT o_orderkey AS job, concat('ask ', CAST(o_custkey AS STRING)) AS request FROM orders"
_RECORDS = "SELECT o_orderkey AS job, concat('ask ', CAST(o_custkey AS STRING)) AS request, o_orderstatus AS answer FROM orders WHERE o_orderkey % 3 = 0"


@register("resumed_jobs", f"WITH j AS ({_JOBS}), r AS ({_RECORDS}) SELECT job, j.request, answer, r.job IS NULL AS \"open\" FROM j LEFT JOIN r USING (job)")
def resumed_jobs(spark: SparkSession, sf: str) -> DataFrame:
    left, told = Q.resumed(made(spark, sf, _JOBS), made(spark, sf, _RECORDS), "job", "request")
    return told.withColumn("open", F.lit(False)).unionByName(left.withColumn("answer", F.lit(None).cast("string")).withColumn("open", F.lit(True)))


_RUNS = "list_distinct([array_to_string(w[i:i + 7], ' ') FOR i IN range(1, len(w) - 6)])"


@register("cross_set_contamination", f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1) AS w FROM documents), b AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1) AS w FROM benchmark),
m AS (SELECT doc_id, unnest({_RUNS}) AS run FROM w), r AS (SELECT DISTINCT unnest({_RUNS}) AS run FROM b)
SELECT doc_id, count(*) AS runs, count(r.run) AS shared FROM m LEFT JOIN r USING (run) GROUP BY doc_id HAVING count(r.run) > 0""")
def cross_set_contamination(spark: SparkSession, sf: str) -> DataFrame:
    return Q.contamination(made(spark, sf, "SELECT * FROM documents"), made(spark, sf, "SELECT * FROM benchmark"), "doc_id", "text")

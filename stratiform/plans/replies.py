"""Queries over replies of judges and authors, built as text from orders and line items and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.catalog import register
from stratiform.operators import admission as A
from stratiform.operators import replies as R
from stratiform.shipping import ship


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@register("reply_violations", """WITH e AS (SELECT l_orderkey AS job, 'L' || l_linenumber || CASE WHEN l_partkey % 20 = 0 THEN 'x' ELSE '' END AS item, l_suppkey % 5 AS grade, l_partkey % 7 = 0 AS unsaid, l_suppkey % 11 = 0 AS blank, l_partkey % 2 = 1 AS bare,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem),
n AS (SELECT job, item, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT DISTINCT l_orderkey AS job, 'L' || l_linenumber AS item FROM lineitem)
SELECT job, '$.grades[' || i || '].ambiguous' AS path, 'not given' AS rule FROM e WHERE unsaid
UNION ALL SELECT job, '$.grades[' || i || '].grade', 'not 0 to 3' FROM e WHERE grade = 4
UNION ALL SELECT job, '$.grades[' || i || '].reason', 'no text' FROM e WHERE blank
UNION ALL SELECT job, '$.grades[' || i || ']', 'no scope basis for grade 0' FROM e WHERE grade = 0 AND bare AND NOT unsaid AND NOT blank
UNION ALL SELECT job, '$.grades', 'named twice: ' || item FROM n WHERE n > 1
UNION ALL SELECT job, '$.grades', 'unknown: ' || item FROM n WHERE (job, item) NOT IN (SELECT (job, item) FROM g)
UNION ALL SELECT job, '$.grades', 'missing: ' || item FROM g WHERE (job, item) NOT IN (SELECT (job, item) FROM n)""")
def reply_violations(spark: SparkSession, sf: str) -> DataFrame:
    """What keeps the pool judges' replies from admission: one reply an order, an entry a line item."""
    said = F.to_json(
        F.struct(
            F.concat(F.lit("L"), "l_linenumber", F.when(F.col("l_partkey") % 20 == 0, "x").otherwise("")).alias("item_id"),
            (F.col("l_suppkey") % 5).alias("grade"),
            F.when(F.col("l_partkey") % 7 != 0, False).alias("ambiguous"),
            F.when(F.col("l_suppkey") % 11 == 0, " ").otherwise("as the text says").alias("reason"),
            F.when(F.col("l_partkey") % 2 == 0, F.array(F.lit("X:1"))).otherwise(F.array().cast("array<string>")).alias("scope_basis"),
        ),
        {"ignoreNullFields": "false"},
    )
    rows = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job"), F.struct("l_linenumber", "l_partkey", "l_suppkey", said.alias("said")).alias("x"))
    lists = rows.groupBy("job").agg(F.array_sort(F.collect_list("x")).alias("x"))
    replies = lists.select("job", F.concat(F.lit('{"grades": ['), F.array_join(F.transform("x", lambda e: e["said"]), ", "), F.lit("]}")).alias("reply"), F.array_distinct(F.transform("x", lambda e: F.concat(F.lit("L"), e["l_linenumber"].cast("string")))).alias("ids"))
    judged = replies.withColumn("v", A.read("reply")).withColumn("targets", F.map_from_arrays("ids", F.transform("ids", lambda i: F.concat(F.lit("X:"), i))))
    return A.violations(judged, ["job"], A.pooled(F.col("v"), F.col("targets")))


_NOISE = """CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN concat('```json\n', j, '\n```') WHEN 1 THEN concat('Sure: ', j, ' and [1, {"x": "]"}]') WHEN 2 THEN concat('a stray { he said "no" and then ', j) WHEN 3 THEN substring(j, 1, 30) ELSE 'no braces at all' END"""
_JSON = """concat('{"note": "a } of ', o_orderpriority, ' in quotes", "id": ', CAST(o_orderkey AS STRING), ', "more": {"s": "', o_orderstatus, '"}}')"""


@register("noisy_replies", f"""WITH r AS (SELECT o_orderkey, {_JSON.replace("STRING", "VARCHAR")} AS j, o_orderkey % 5 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 1 THEN 2 WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE 1 END AS n_values, CASE WHEN k IN (0, 1) THEN j END AS object,
  CASE k WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'invalid_json' WHEN 4 THEN 'no_json_object' END AS error, k IN (1, 2, 4) AS extra, CASE WHEN k <= 2 THEN o_orderkey END AS id FROM r""")
def noisy_replies(spark: SparkSession, sf: str) -> DataFrame:
    """JSON found in replies with words around it, braces in strings, stray braces, or an end cut off."""
    ship(spark)
    rows = _t(spark, sf, "orders").withColumn("j", F.expr(_JSON)).select("o_orderkey", F.expr(_NOISE).alias("t"))
    read = rows.withColumn("v", R.json_values(F.col("t"))).withColumn("x", R.first_object(F.col("t"), F.col("v")))
    number = F.try_variant_get(F.try_parse_json(F.get(F.filter("v", lambda x: x["json"].startswith("{")), F.lit(0))["json"]), "$.id", "bigint")
    return read.select("o_orderkey", F.size("v").alias("n_values"), F.col("x.json").alias("object"), F.col("x.error").alias("error"), F.col("x.extra").alias("extra"), number.alias("id"))


_LIST = """concat('Some words\n- not this one\nRequirements:\n- ', o_orderpriority, '\n2) the  status ', o_orderstatus, '\n* ', lower(o_orderpriority), '\n- <question>number ', CAST(o_orderkey AS STRING), '</question>\n• <question>\n3. ', CASE WHEN o_orderkey % 3 = 0 THEN 'last' ELSE concat('THE STATUS ', o_orderstatus) END)"""


@register("requirement_lists", """SELECT o_orderkey, array_to_string(list_concat([o_orderpriority, 'the status ' || o_orderstatus, 'number ' || o_orderkey], CASE WHEN o_orderkey % 3 = 0 THEN ['last'] ELSE [] END), '|') AS items, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS dropped FROM orders""")
def requirement_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The items below a heading, distinct in any case, without the form's placeholder."""
    rows = _t(spark, sf, "orders").select("o_orderkey", F.expr(_LIST).alias("t"))
    return rows.withColumn("x", R.listed(F.col("t"), "REQUIREMENTS", 4)).select("o_orderkey", F.array_join("x.items", "|").alias("items"), F.col("x.dropped").alias("dropped"))

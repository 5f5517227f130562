"""Chunking queries over a small statute a nation: articles by nation, paragraphs and points by customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.catalog import register
from stratiform.operators import chunking as C
from stratiform.plans.judging import made

_NODES = """SELECT a AS article, a AS path, 'articulo' AS kind, '' AS marker, CASE WHEN n % 2 = 0 THEN concat('General rule of ', a) ELSE '' END AS own_text, 0 AS ordinal FROM (SELECT DISTINCT CAST(c_nationkey AS STRING) AS a, c_nationkey AS n FROM customer) x
UNION ALL SELECT a, concat(a, '.', p), CASE WHEN p = '2' THEN 'unnumbered' ELSE 'apartado' END, p, CASE WHEN p = '3' THEN '' ELSE concat('Paragraph ', p, ' says that') END, k * 100000 FROM (SELECT DISTINCT CAST(c_nationkey AS STRING) AS a, CAST(c_custkey % 4 + 1 AS STRING) AS p, c_custkey % 4 + 1 AS k FROM customer) y
UNION ALL SELECT CAST(c_nationkey AS STRING), concat(CAST(c_nationkey AS STRING), '.', CAST(c_custkey % 4 + 1 AS STRING), '.', CAST(c_custkey AS STRING)), 'punto', CAST(c_custkey AS STRING), concat(c_name, ' pays in ', c_mktsegment), (c_custkey % 4 + 1) * 100000 + c_custkey + 1 FROM customer"""
_HEAD = "SELECT DISTINCT CAST(c_nationkey AS STRING) AS article, concat('Act Article ', CAST(c_nationkey AS STRING)) AS heading FROM customer"
_LINE = "CASE kind WHEN 'apartado' THEN marker || '. ' || own_text WHEN 'punto' THEN '(' || marker || ') ' || own_text ELSE own_text END"
_TREE = f"""nodes AS ({_NODES}), head AS ({_HEAD}), up AS (SELECT article, path, unnest(range(1, len(string_split(path, '.')))) AS i FROM nodes),
steps AS (SELECT article, path, array_to_string(string_split(path, '.')[1:i], '.') AS above, array_to_string(string_split(path, '.')[1:i + 1], '.') AS step FROM up),
gov AS (SELECT s.article, s.path, string_agg({_LINE.replace("kind", "n.kind").replace("marker", "n.marker").replace("own_text", "n.own_text")}, chr(10) ORDER BY n.ordinal) AS context
 FROM steps s JOIN nodes d ON d.path = s.step AND d.kind NOT IN ('subparagraph', 'unnumbered') JOIN nodes n ON n.path = s.above AND n.own_text <> '' GROUP BY s.article, s.path)"""
_CHUNKS = f"""{_TREE}, led AS (SELECT n.article, n.path AS root, heading || coalesce(chr(10) || chr(10) || context, '') AS context FROM nodes n JOIN head USING (article) LEFT JOIN gov USING (path)),
cl AS (SELECT article, path, ordinal, {_LINE} AS line, array_to_string(string_split(path, '.')[1:i], '.') AS root FROM (SELECT *, unnest(range(1, len(string_split(path, '.')) + 1)) AS i FROM nodes WHERE own_text <> '')),
b AS (SELECT article, root, 'subtree' AS coverage, string_agg(line, chr(10) ORDER BY ordinal) AS body, string_agg(path, ' ' ORDER BY ordinal) AS sources FROM cl GROUP BY article, root UNION ALL SELECT article, path, 'own', {_LINE}, path FROM nodes WHERE own_text <> ''),
t AS (SELECT b.article, b.root, coverage, sources, led.context, led.context || chr(10) || chr(10) || body AS text FROM b JOIN led ON led.root = b.root),
z AS (SELECT *, len(regexp_extract_all(text, '(\\S+)', 1)) AS tokens, EXISTS (SELECT 1 FROM nodes n WHERE starts_with(n.path, t.root || '.')) AS parted FROM t),
taken AS (SELECT root FROM z WHERE coverage = 'subtree' AND (tokens <= 60 OR NOT parted)),
open AS (SELECT * FROM z WHERE NOT EXISTS (SELECT 1 FROM taken WHERE starts_with(z.root, taken.root || '.'))),
ch AS (SELECT * FROM open WHERE coverage = 'subtree' AND (tokens <= 60 OR NOT parted) UNION ALL SELECT * FROM open WHERE coverage = 'own' AND root IN (SELECT root FROM z WHERE coverage = 'subtree' AND tokens > 60 AND parted))"""


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return made(spark, sf, _NODES)


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunks(_nodes(spark, sf), made(spark, sf, _HEAD), 60)


@register("governing_ancestors", f"WITH {_TREE} SELECT article, path, context FROM gov")
def governing_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return C.governing(_nodes(spark, sf))


@register("structural_chunks", f"WITH {_CHUNKS} SELECT article, root, coverage, sources, context, text, tokens::INT AS tokens, CASE WHEN tokens > 60 THEN CASE coverage WHEN 'own' THEN 'own_over_budget' ELSE 'leaf_over_budget' END END AS over FROM ch")
def structural_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).withColumn("sources", F.array_join("sources", " "))


@register("chunk_spans", f"""WITH {_CHUNKS}, p AS (SELECT root, coverage, context, unnest(string_split(sources, ' ')) AS path, generate_subscripts(string_split(sources, ' '), 1) AS pos FROM ch),
l AS (SELECT p.root, coverage, context, p.path, pos, length({_LINE}) AS n, article FROM p JOIN nodes ON nodes.path = p.path)
SELECT article, root, coverage, path, e - n AS start, e AS "end" FROM (SELECT *, length(context) + 2 + sum(n + 1) OVER (PARTITION BY root, coverage ORDER BY pos) - 1 AS e FROM l)""")
def chunk_spans(spark: SparkSession, sf: str) -> DataFrame:
    return C.source_spans(_chunks(spark, sf), _nodes(spark, sf))


_INPUTS = """w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all('passage: ' || coalesce(text, ''), '(\\s*\\S+)', 1) AS w FROM documents),
i AS (SELECT doc_id, len(w) + 2 AS original, least(len(w), 48) + 2 AS encoded, len(w) > 48 AS truncated, greatest(len(w) - 48, 0) AS dropped, CASE WHEN len(w) > 48 THEN greatest(0, length(array_to_string(w[1:48], '')) - 9) ELSE length(t) END AS kept_chars, array_to_string(list_transform(w[1:48], lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), '|') AS tokens FROM w)"""


def _inputs(spark: SparkSession, sf: str) -> DataFrame:
    return C.model_inputs(made(spark, sf, "SELECT * FROM documents"), "doc_id", "text", 50, "passage: ")


@register("model_inputs", f"WITH {_INPUTS} SELECT * FROM i")
def model_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return _inputs(spark, sf).withColumn("tokens", F.array_join("tokens", "|"))


@register("truncation_exposure", f"""WITH {_INPUTS}, s AS (SELECT doc_id, 'p' || j AS path, 100 * j AS start, 100 * j + 100 AS "end" FROM documents, range(6) r(j)), q AS (SELECT 'p' || j AS path, k AS need_id, (j + k) % 4 AS grade FROM range(6) r(j), range(3) n(k) WHERE (j + k) % 2 = 0)
SELECT doc_id, path, need_id, grade, CASE WHEN start < kept_chars THEN 'partly cut' ELSE 'cut' END AS state FROM s JOIN i USING (doc_id) JOIN q USING (path) WHERE truncated AND "end" > kept_chars""")
def truncation_exposure(spark: SparkSession, sf: str) -> DataFrame:
    part = spark.range(6).withColumnRenamed("id", "j")
    spans = made(spark, sf, "SELECT doc_id FROM documents").crossJoin(F.broadcast(part)).select("doc_id", F.concat(F.lit("p"), "j").alias("path"), (100 * F.col("j")).alias("start"), (100 * F.col("j") + 100).alias("end"))
    judged = part.crossJoin(spark.range(3).withColumnRenamed("id", "need_id")).filter("(j + need_id) % 2 = 0").select(F.concat(F.lit("p"), "j").alias("path"), "need_id", ((F.col("j") + F.col("need_id")) % 4).alias("grade"))
    return C.exposure(spans, _inputs(spark, sf), judged, ["doc_id"])

"""Retrieval, fusion, metrics and decisions over documents, benchmark items, labels and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratiform.catalog import register
from stratiform.functions import text as T
from stratiform.operators import curation, metrics, stats
from stratiform.operators import retrieval as R
from stratiform.plans import porter_sql
from stratiform.shipping import ship

_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
_WORDS = r"list_filter(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[''’]s\b', '', 'g'), '([\p{L}\p{N}]+)', 1), lambda x: x NOT IN " + _STOP + ")"

_BM25 = f"""
bw AS (SELECT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw0 AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d),
every AS (SELECT term FROM bw UNION SELECT term FROM dw0),
{porter_sql.stems("every")},
q AS (SELECT query_id, stem AS term, count(*) AS qtf FROM bw JOIN stems USING (term) GROUP BY ALL),
size AS (SELECT count(*) AS n, avg(len(w)) AS avg_dl FROM d),
post AS (SELECT doc_id, dl, stem AS term, count(*) AS tf FROM dw0 JOIN stems USING (term) WHERE stem IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl))), 9) AS score
  FROM q JOIN post USING (term) JOIN df USING (term), size GROUP BY query_id, doc_id),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 50)"""

_OVERLAP = r"""
qw AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '([a-z]{6,})', 1)) AS term FROM benchmark),
dw AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-z]{6,})', 1)) AS term FROM documents),
overlap AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM qw JOIN dw USING (term) GROUP BY ALL) QUALIFY rank <= 50),
qrels AS (SELECT item_id AS query_id, doc_id, ((doc_id + item_id) % 4)::INT AS grade FROM benchmark, labels WHERE (doc_id * 7 + item_id) % 5 < 3)"""


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet")


def bm25_run(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return R.bm25(_benchmark(spark, sf), _documents(spark, sf), 50, query_id="item_id", query_text="text", doc_id="doc_id", doc_text="text")


def overlap_run(spark: SparkSession, sf: str) -> DataFrame:
    """A plain second system: number of shared words of six letters or more."""
    ship(spark)
    return R.overlap(_benchmark(spark, sf), _documents(spark, sf), 50, query_id="item_id", query_text="text", doc_id="doc_id", doc_text="text")


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Synthetic judgments of labelled documents, by arithmetic on the ids: each document is joined to the items of three residues of five, by an equality."""
    q = _benchmark(spark, sf).select(F.col("item_id").alias("query_id")).withColumn("m", F.col("query_id") % 5)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.explode(F.filter(F.array(*[F.lit(k).cast("long") for k in range(5)]), lambda m: (F.col("doc_id") * 7 + m) % 5 < 3)).alias("m"))
    return labels.join(q, "m").select("query_id", "doc_id", ((F.col("doc_id") + F.col("query_id")) % 4).cast("int").alias("grade"))


@register("bm25_topk", f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return bm25_run(spark, sf).filter("rank <= 10").select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("overlap_topk", f"WITH {_OVERLAP} SELECT query_id, doc_id, score, rank FROM overlap WHERE rank <= 10")
def overlap_topk(spark: SparkSession, sf: str) -> DataFrame:
    return overlap_run(spark, sf).filter("rank <= 10").withColumn("rank", F.col("rank").cast("long"))


_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@register("dense_exact_topk", f"""
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({_DOT}, 9) AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 9) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= 10""")
def dense_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 100, against all."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    return R.dense_topk(v.filter("vec_id % 100 = 0"), v, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("rrf_truncated", f"""WITH {_BM25}, {_OVERLAP},
u AS (SELECT query_id, doc_id, rank, 1.0 / (60 + rank) AS w FROM bm25 UNION ALL SELECT query_id, doc_id, rank, 1.0 / (60 + rank) FROM overlap),
f AS (SELECT query_id, doc_id, round(sum(w), 12) AS score, min(rank) AS best FROM u GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, best, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, doc_id) AS rank FROM f QUALIFY rank <= 20""")
def rrf_truncated(spark: SparkSession, sf: str) -> DataFrame:
    fused = R.rrf([(bm25_run(spark, sf), 1.0), (overlap_run(spark, sf), 1.0)], 60, 50).filter("rank <= 20")
    return fused.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("best").cast("long").alias("best"), F.col("rank").cast("long").alias("rank"))


@register("quota_merge", f"""WITH {_OVERLAP},
c AS (SELECT query_id, doc_id, rank AS p FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS r2 FROM overlap WHERE rank > 7) WHERE r2 <= 3),
fresh AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM c),
t AS (SELECT query_id, doc_id, 0 AS tier, rank FROM overlap WHERE rank <= 7 UNION ALL SELECT query_id, doc_id, 1, rank FROM fresh UNION ALL SELECT query_id, doc_id, 2, rank FROM overlap),
m AS (SELECT query_id, doc_id, min(tier * 1000 + rank) AS k FROM t GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY k, doc_id) AS rank FROM m""")
def quota_merge(spark: SparkSession, sf: str) -> DataFrame:
    base = overlap_run(spark, sf)
    candidates = base.select("query_id", "doc_id", (-F.col("doc_id")).cast("double").alias("score"), "rank")
    return R.quota(base, candidates, 10, 3).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@register("one_hop_expansion", f"""WITH {_OVERLAP},
e AS (SELECT doc_id AS src, doc_id + k AS dst, k AS pos FROM documents, (SELECT unnest([1, 2]) AS k) WHERE doc_id % 3 = 0),
t AS (SELECT query_id, doc_id, 0 AS t, rank AS r, -1 AS p FROM overlap WHERE rank <= 5
  UNION ALL SELECT query_id, dst, 0, rank, pos FROM overlap JOIN e ON src = doc_id WHERE rank <= 5
  UNION ALL SELECT query_id, doc_id, 1, rank, 0 FROM overlap),
f AS (SELECT query_id, doc_id, min({{'t': t, 'r': r, 'p': p}}) AS k FROM t GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY k, doc_id) AS rank, CASE WHEN k.t = 1 THEN 'rest' WHEN k.p < 0 THEN 'anchor' ELSE 'target' END AS place, CASE WHEN k.t = 0 THEN k.r END AS via FROM f""")
def one_hop_expansion(spark: SparkSession, sf: str) -> DataFrame:
    edges = _documents(spark, sf).filter("doc_id % 3 = 0").select(F.col("doc_id").alias("src"), F.explode(F.array(F.lit(1), F.lit(2))).alias("pos")).withColumn("dst", F.col("src") + F.col("pos"))
    return R.one_hop(overlap_run(spark, sf), edges, 5).withColumn("rank", F.col("rank").cast("long"))


_METRICS = """,
judged AS (SELECT r.*, q.grade, sum(CASE WHEN q.grade >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY r.query_id ORDER BY rank) AS seen FROM overlap r LEFT JOIN qrels q USING (query_id, doc_id)),
hits AS (SELECT query_id, sum((rank <= 10 AND coalesce(grade, -1) >= 2)::INT) AS found, min(rank) FILTER (grade >= 2) AS first,
  sum(grade * ln(2) / ln(rank + 1)) FILTER (rank <= 10 AND grade > 0) AS dcg, sum((rank <= 10 AND grade IS NOT NULL)::INT) AS judged_n, sum((rank <= 10)::INT) AS returned,
  sum(seen / rank) FILTER (rank <= 10 AND grade >= 2) AS precisions FROM judged GROUP BY query_id),
ideal AS (SELECT query_id, sum(grade * ln(2) / ln(place + 1)) FILTER (place <= 10 AND grade > 0) AS idcg, sum((grade >= 2)::INT) AS relevant
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS place FROM qrels) GROUP BY query_id),
m AS (SELECT query_id, round(coalesce(found / relevant, 0), 6) AS recall, round(CASE WHEN first <= 10 THEN 1 / first ELSE 0 END, 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg,
  round(coalesce(judged_n / nullif(returned, 0), 0), 6) AS judged, first AS first_relevant, round(coalesce(precisions / relevant, 0), 6) AS ap
  FROM ideal LEFT JOIN hits USING (query_id) WHERE relevant > 0)"""


@register("metrics_per_query", f"WITH {_OVERLAP}{_METRICS} SELECT * FROM m")
def metrics_per_query(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.per_query(overlap_run(spark, sf), qrels(spark, sf))


@register("metrics_macro", f"WITH {_OVERLAP}{_METRICS} SELECT lang, round(avg(x), 6) AS mean, count(*) AS groups, sum(n)::BIGINT AS rows FROM (SELECT query_id % 4 AS lang, query_id % 12 AS need, avg(ndcg) AS x, count(*) AS n FROM m GROUP BY ALL) GROUP BY lang")
def metrics_macro(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics_per_query(spark, sf).select((F.col("query_id") % 4).alias("lang"), (F.col("query_id") % 12).alias("need"), "ndcg")
    return metrics.macro(rows, "ndcg", ["need"], ["lang"])


@register("recall_at_tokens", f"""WITH {_OVERLAP},
t AS (SELECT r.query_id, r.doc_id, sum(n) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM overlap r JOIN (SELECT doc_id, greatest(1, coalesce(n_chars, 1)) AS n FROM documents) USING (doc_id)),
g AS (SELECT query_id, doc_id FROM qrels WHERE grade >= 2)
SELECT g.query_id, round(count(t.doc_id) / count(*), 6) AS recall FROM g LEFT JOIN (SELECT * FROM t WHERE used <= 20000) t USING (query_id, doc_id) GROUP BY g.query_id""")
def recall_at_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = _documents(spark, sf).select("doc_id", F.greatest(F.lit(1), F.coalesce("n_chars", F.lit(1))).alias("n_tokens"))
    return metrics.recall_at_tokens(overlap_run(spark, sf), tokens, qrels(spark, sf), 20000)


@register("strata_quality", """SELECT lang, source, round(avg(quality), 6) AS mean, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), (lang, source))""")
def strata_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = _documents(spark, sf).select("doc_id", "lang", "source").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    return metrics.strata(rows, "quality", [["lang"], ["source"], ["lang", "source"]])


@register("wilson_quality", """WITH a AS (SELECT lang, sum((quality = 1)::INT) AS x, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, x::BIGINT AS x, n, round(x / n, 6) AS share,
 round((x / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(x / n * (1 - x / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS low,
 round((x / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(x / n * (1 - x / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS high FROM a""")
def wilson_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = _documents(spark, sf).select("doc_id", "lang").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").withColumn("hit", F.col("quality") == 1)
    return metrics.wilson(rows, ["lang"], "hit")


@register("auroc_length", """WITH r AS (SELECT n_chars AS s, quality = 1 AS p FROM documents JOIN labels USING (doc_id)),
k AS (SELECT p, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS mid FROM r),
t AS (SELECT sum(mid) FILTER (p) AS s, count(*) FILTER (p) AS a, count(*) FILTER (NOT p) AS b FROM k)
SELECT round((s - a * (a + 1) / 2) / (a * b), 6) AS auroc, a AS positives, b AS negatives FROM t""")
def auroc_length(spark: SparkSession, sf: str) -> DataFrame:
    rows = _documents(spark, sf).select("doc_id", "n_chars").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").withColumn("p", F.col("quality") == 1)
    return metrics.auroc(rows, "n_chars", "p")


@register("decisive_documents", f"""WITH {_BM25}, {_OVERLAP}, a AS (SELECT query_id, doc_id FROM bm25 WHERE rank <= 10), b AS (SELECT query_id, doc_id FROM overlap WHERE rank <= 10)
SELECT *, 'first' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'second' FROM (FROM b EXCEPT FROM a)""")
def decisive_documents(spark: SparkSession, sf: str) -> DataFrame:
    return curation.decisive(bm25_run(spark, sf), overlap_run(spark, sf))


@register("pooled_documents", f"""WITH {_BM25}, {_OVERLAP}, u AS (SELECT query_id, doc_id, rank, 'bm25' AS c FROM bm25 WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank, 'overlap' FROM overlap WHERE rank <= 20)
SELECT query_id, doc_id, string_agg(DISTINCT c, ',' ORDER BY c) AS contributors, min(rank) AS best FROM u GROUP BY ALL""")
def pooled_documents(spark: SparkSession, sf: str) -> DataFrame:
    return curation.pool([("bm25", bm25_run(spark, sf)), ("overlap", overlap_run(spark, sf))], 20).withColumn("best", F.col("best").cast("long"))


_DELTAS = "SELECT custkey AS need, round(b - a, 9) AS delta FROM (SELECT o_custkey % 97 AS custkey, avg((o_orderkey % 7) / 7.0) AS a, avg((o_orderkey % 11) / 11.0) AS b FROM orders GROUP BY ALL)"


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").groupBy((F.col("o_custkey") % 97).alias("need"))
    a, b = o.agg(F.avg((F.col("o_orderkey") % 7) / 7.0).alias("v")), o.agg(F.avg((F.col("o_orderkey") % 11) / 11.0).alias("v"))
    return stats.paired(a, b, "need", "v")


@register("paired_bootstrap", f"""WITH d AS ({_DELTAS}), n AS (SELECT row_number() OVER (ORDER BY need) - 1 AS pos_, delta, count(*) OVER () AS c FROM d),
m AS (SELECT rep, sum(delta) / any_value(c) AS m FROM (SELECT rep, j, ('0x' || substr(md5('r:' || rep || ':' || j), 1, 12))::BIGINT % (SELECT count(*) FROM d) AS pos_
  FROM range(1000) r(rep), range((SELECT count(*) FROM d)) s(j)) JOIN n USING (pos_) GROUP BY rep),
k AS (SELECT m, row_number() OVER (ORDER BY m) AS k FROM m), e AS (SELECT round(max(m) FILTER (k = 26), 6) AS low, round(max(m) FILTER (k = 975), 6) AS high FROM k)
SELECT round(avg(delta), 6) AS mean, sum((delta > 1e-9)::INT)::BIGINT AS better, sum((abs(delta) <= 1e-9)::INT)::BIGINT AS equal, sum((delta < -1e-9)::INT)::BIGINT AS worse, any_value(low) AS low, any_value(high) AS high,
 CASE WHEN any_value(low) > 1e-9 THEN 'better' WHEN any_value(high) < -1e-9 THEN 'worse' ELSE 'undecided' END AS verdict FROM d, e""")
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return stats.bootstrap(_deltas(spark, sf), "need", 1000)


@register("effect_size", f"WITH d AS ({_DELTAS}) SELECT round(stddev_samp(delta), 6) AS sd, round(avg(delta) / stddev_samp(delta), 6) AS d_z, round((sum(delta) - arg_max(delta, abs(delta))) / (count(*) - 1), 6) AS without_top FROM d")
def effect_size(spark: SparkSession, sf: str) -> DataFrame:
    return stats.effect(_deltas(spark, sf))


@register("percentile_dialects", """WITH p AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
q AS (SELECT *, greatest(floor((n + 1) * 0.25), 1) AS low FROM p)
SELECT event_type, max(v) FILTER (k = ceil(n * 0.95)) AS nearest95, max(v) FILTER (k = round_even((n - 1) * 0.5, 0) + 1) AS rounded50, max(v) FILTER (k = least(floor(n * 0.95) + 1, n)) AS floored95,
 max(v) FILTER (k = CASE WHEN floor(n * 0.95) < 1 THEN n ELSE floor(n * 0.95) END) AS less_one95, round(quantile_cont(v, 0.95), 6) AS linear95,
 round(max(v) FILTER (k = low) + (max(v) FILTER (k = least(low + 1, n)) - max(v) FILTER (k = low)) * max((n + 1) * 0.25 - low), 6) AS exclusive25 FROM q GROUP BY event_type""")
def percentile_dialects(spark: SparkSession, sf: str) -> DataFrame:
    return stats.percentiles(spark.read.parquet(f"{sf}/events.parquet"), ["event_type"], "value")


@register("cost_dominance", """WITH s AS (SELECT l_returnflag || l_linestatus || l_linenumber AS name, avg(l_extendedprice) AS x, avg(l_quantity) AS y, count(*)::DOUBLE AS z, (l_linenumber % 3) AS p, l_linenumber // 3 AS q, l_linenumber % 2 AS r FROM lineitem GROUP BY 1, l_linenumber)
SELECT a.name AS winner, b.name AS loser FROM s a, s b WHERE a.name <> b.name AND (a.x * 1.1::DOUBLE <= b.x OR NOT b.x * 1.1::DOUBLE <= a.x) AND (a.y * 1.1::DOUBLE <= b.y OR NOT b.y * 1.1::DOUBLE <= a.y) AND (a.z * 1.1::DOUBLE <= b.z OR NOT b.z * 1.1::DOUBLE <= a.z)
 AND a.p <= b.p AND a.q <= b.q AND a.r <= b.r AND (a.x * 1.1::DOUBLE <= b.x OR a.y * 1.1::DOUBLE <= b.y OR a.z * 1.1::DOUBLE <= b.z OR a.p < b.p OR a.q < b.q OR a.r < b.r)""")
def cost_dominance(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    s = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.concat("l_returnflag", "l_linestatus", n.cast("string")).alias("name"), n).agg(F.avg("l_extendedprice").alias("x"), F.avg("l_quantity").alias("y"), F.count("*").cast("double").alias("z"))
    costs = s.select("name", "x", "y", "z", F.array(n % 3, F.floor(n / 3)).alias("parts"), (n % 2).alias("port"))
    return stats.dominance(costs, "name", ["x", "y", "z"], ["parts"], ["port"])


@register("coverage_envelope", """WITH u AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS w FROM orders),
k AS (SELECT DISTINCT o_custkey AS query_id, o_custkey % 3 AS base_found, o_custkey % 4 AS cand_found, 4 AS relevant FROM orders),
g AS (SELECT *, row_number() OVER a AS k, sum(w) OVER a AS up, row_number() OVER b AS k2, sum(w) OVER b AS down FROM u WINDOW a AS (PARTITION BY query_id ORDER BY w DESC, doc_id), b AS (PARTITION BY query_id ORDER BY w, doc_id)),
e AS (SELECT query_id, (cand_found - base_found + up) / (relevant + k) AS hi, (cand_found - base_found + down) / (relevant + k2) AS lo FROM g JOIN k USING (query_id)
 UNION ALL SELECT query_id, (cand_found - base_found) / relevant, (cand_found - base_found) / relevant FROM k)
SELECT query_id, round(min(lo), 6) AS least, round(max(hi), 6) AS greatest FROM e GROUP BY query_id""")
def coverage_envelope(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"))
    w = F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, -1).otherwise(0)
    known = o.select("query_id").distinct().select("query_id", (F.col("query_id") % 3).alias("base_found"), (F.col("query_id") % 4).alias("cand_found"), F.lit(4).alias("relevant"))
    return stats.recall_envelope(o.withColumn("w", w), known)


@register("inversions", f"""WITH {_OVERLAP}, r AS (SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY doc_id % 17, doc_id) AS other FROM overlap)
SELECT a.query_id, count(*) AS pairs FROM r a JOIN r b ON a.query_id = b.query_id AND a.rank < b.rank AND b.rank <= a.rank + 5 AND a.other > b.other GROUP BY a.query_id""")
def inversions(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs at most 5 ranks apart that a second ranking has the other way round; a run holds 50 ranks a query."""
    r = overlap_run(spark, sf).withColumn("other", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("doc_id") % 17, "doc_id")))
    a, b = r.alias("a"), r.alias("b")
    near = (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.rank") < F.col("b.rank")) & (F.col("b.rank") <= F.col("a.rank") + 5) & (F.col("a.other") > F.col("b.other"))
    return a.join(b, near).groupBy("a.query_id").agg(F.count("*").alias("pairs"))


@register("sign_flip_test", f"""WITH d AS ({_DELTAS}), s AS (SELECT rep, round(abs(sum(delta * CASE WHEN ('0x' || substr(md5('f:' || rep || ':' || need), 1, 1))::INT < 8 THEN 1 ELSE -1 END)), 9) AS s FROM d, range(500) r(rep) GROUP BY rep)
SELECT round((1 + sum((s >= (SELECT round(abs(sum(delta)), 9) FROM d))::INT)) / (1 + count(*)), 6) AS p, count(*) AS reps FROM s""")
def sign_flip_test(spark: SparkSession, sf: str) -> DataFrame:
    return stats.sign_flip(_deltas(spark, sf), "need", 500)


@register("unique_contribution", f"""WITH {_BM25}, {_OVERLAP}, u AS (SELECT query_id, doc_id, 'bm25' AS c FROM bm25 WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, 'overlap' FROM overlap WHERE rank <= 20),
n AS (SELECT *, count(*) OVER (PARTITION BY query_id, doc_id) AS k FROM u) SELECT c AS contributor, count(*) AS found, sum((k = 1)::INT)::BIGINT AS alone FROM n GROUP BY c""")
def unique_contribution(spark: SparkSession, sf: str) -> DataFrame:
    return curation.unique_contribution(pooled_documents(spark, sf))


@register("softmax_scores", f"WITH {_OVERLAP} SELECT query_id, doc_id, round(exp(score - m) / sum(exp(score - m)) OVER w, 6) AS p FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM overlap) WINDOW w AS (PARTITION BY query_id)")
def softmax_scores(spark: SparkSession, sf: str) -> DataFrame:
    return R.softmax(overlap_run(spark, sf)).select("query_id", "doc_id", F.round("p", 6).alias("p"))


@register("interleaved_lists", f"""WITH {_OVERLAP}, l AS (SELECT query_id, doc_id, doc_id % 3 AS list, row_number() OVER (PARTITION BY query_id, doc_id % 3 ORDER BY rank) AS pos FROM overlap)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY pos, list, doc_id) AS rank FROM l""")
def interleaved_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = overlap_run(spark, sf).withColumn("list", F.col("doc_id") % 3).withColumn("pos", F.row_number().over(Window.partitionBy("query_id", "list").orderBy("rank")))
    return R.interleaved(lists).withColumn("rank", F.col("rank").cast("long"))


def reference_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(node, score): seeded propagation over customers halved by id."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("node"))
    edges = c.select(F.col("node").alias("src"), F.floor(F.col("node") / 2).alias("dst"), F.lit(1.0).alias("weight")).join(c.withColumnRenamed("node", "dst"), "dst", "left_semi")
    chosen = F.col("node") % 100 == 0
    seeds = c.crossJoin(F.broadcast(c.filter(chosen).agg(F.count("*").alias("k")))).select("node", F.when(chosen, 1 / F.col("k")).otherwise(0.0).alias("s"))
    return R.pagerank(edges, seeds)


#: Every node has one way out, to its half (0 to itself), so the fixed point is a sum over the ways up from the seeds, scaled by what dangling nodes give back.
@register("reference_pagerank", """WITH RECURSIVE c AS (SELECT c_custkey AS node FROM customer), s AS (SELECT node, 1.0::DOUBLE / count(*) OVER () AS m FROM c WHERE node % 100 = 0),
up AS (SELECT node, m FROM s UNION ALL SELECT c.node, 0.3::DOUBLE * up.m FROM up JOIN c ON c.node = up.node // 2 WHERE up.node > 0),
x AS (SELECT node, sum(m) / if(node = 0, 0.7::DOUBLE, 1) AS x FROM up GROUP BY node), d AS (SELECT coalesce(sum(x), 0) AS x FROM x WHERE node // 2 NOT IN (SELECT node FROM c)),
k AS (SELECT 0.7::DOUBLE + 0.3::DOUBLE * 0.7::DOUBLE * d.x / (1 - 0.3::DOUBLE * d.x) AS k FROM d) SELECT node, round(coalesce(x * k, 0), 9) AS score FROM c LEFT JOIN x USING (node), k""")
def reference_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    return reference_scores(spark, sf).select("node", F.round("score", 9).alias("score"))

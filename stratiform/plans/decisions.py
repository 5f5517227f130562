"""Evidence, comparison, test-set design and decision queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.catalog import register
from stratiform.functions import legal as L
from stratiform.functions import rules
from stratiform.functions import text as T
from stratiform.operators import cascade, design, draws, stats
from stratiform.operators import evidence as E
from stratiform.plans.evaluation import _BM25, _OVERLAP, bm25_run, overlap_run, pooled_documents, qrels
from stratiform.plans.judging import made


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_PROB = "pr AS (SELECT a.query_id, a.doc_id AS anchor, b.doc_id, ((a.doc_id * 31 + b.doc_id * 17) % 100) / 100 AS p FROM overlap a JOIN overlap b USING (query_id) WHERE a.rank <= 8 AND b.rank > 3 AND b.rank <= 30)"


@register("evidence_sets", f"""WITH {_OVERLAP}, {_PROB},
best AS (SELECT pr.query_id, pr.doc_id, max((p, -o.rank)) AS b FROM pr JOIN overlap o ON o.query_id = pr.query_id AND o.doc_id = pr.anchor AND o.rank <= 5 GROUP BY ALL),
ch AS (SELECT b.query_id, b.doc_id, row_number() OVER (PARTITION BY b.query_id ORDER BY b.b DESC, b.doc_id) AS n FROM best b JOIN overlap o USING (query_id, doc_id) WHERE o.rank > 5 AND b.b[1] >= 0.9 QUALIFY n <= 3),
t AS (SELECT o.query_id, o.doc_id, CASE WHEN o.rank <= 5 THEN 0 WHEN ch.n IS NOT NULL THEN 1 ELSE 2 END AS tier, coalesce(CASE WHEN o.rank > 5 THEN ch.n END, o.rank) AS k FROM overlap o LEFT JOIN ch USING (query_id, doc_id))
SELECT query_id, doc_id, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier, k, doc_id) AS rank FROM t""")
def evidence_sets(spark: SparkSession, sf: str) -> DataFrame:
    run = overlap_run(spark, sf)
    a = run.filter("rank <= 8").select("query_id", F.col("doc_id").alias("anchor"))
    b = run.filter("rank > 3 and rank <= 30").select("query_id", "doc_id")
    p = a.join(b, "query_id").withColumn("p", ((F.col("anchor") * 31 + F.col("doc_id") * 17) % 100) / 100)
    return E.evidence_set(run, p, 5, 3, 0.9).withColumn("rank", F.col("rank").cast("long"))


@register("hard_negatives", f"""WITH {_OVERLAP}, w AS (SELECT o.query_id, o.doc_id, row_number() OVER (PARTITION BY o.query_id ORDER BY o.rank) AS n FROM overlap o ANTI JOIN (SELECT * FROM qrels WHERE grade >= 2) q USING (query_id, doc_id)),
r AS (SELECT query_id, arg_min(doc_id, sha256('n:' || query_id || ':' || doc_id)) AS doc_id FROM w WHERE n > 2 GROUP BY query_id)
SELECT query_id, doc_id, false AS drawn FROM w WHERE n <= 2 UNION ALL SELECT query_id, doc_id, true FROM r""")
def hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return E.hard_negatives(overlap_run(spark, sf), qrels(spark, sf).filter("grade >= 2"))


@register("candidate_lists", f"""WITH {_BM25}, {_OVERLAP}, t AS (SELECT query_id, doc_id, 0 AS tier, rank::DOUBLE AS k FROM bm25 WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 1, -score FROM overlap WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, 2, rank FROM bm25 WHERE rank > 10),
f AS (SELECT query_id, doc_id, min((tier, k)) AS k FROM t GROUP BY ALL) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY k, doc_id) AS rank FROM f""")
def candidate_lists(spark: SparkSession, sf: str) -> DataFrame:
    return E.candidate_list(bm25_run(spark, sf), overlap_run(spark, sf).filter("rank <= 20"), 10).withColumn("rank", F.col("rank").cast("long"))


@register("binary_metrics", f"""WITH {_OVERLAP}, r AS (SELECT DISTINCT query_id, doc_id FROM qrels WHERE grade >= 2), n AS (SELECT query_id, count(*) AS total FROM r GROUP BY query_id),
h AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM overlap SEMI JOIN r USING (query_id, doc_id) WHERE rank <= 10),
g AS (SELECT query_id, count(*) AS found, sum(ln(2) / ln(rank + 1)) AS dcg, sum(n / rank) AS ap, min(rank) AS first FROM h GROUP BY query_id)
SELECT query_id, round(coalesce(found / total, 0), 6) AS recall, round(coalesce(dcg / list_sum([ln(2) / ln(i + 1) FOR i IN range(1, least(total, 10) + 1)]), 0), 6) AS ndcg, round(coalesce(ap / total, 0), 6) AS map, round(coalesce(1 / first, 0), 6) AS mrr FROM n LEFT JOIN g USING (query_id)""")
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.binary_metrics(overlap_run(spark, sf), qrels(spark, sf).filter("grade >= 2"))


_CLAIMS = r"""d AS (SELECT doc_id, trim(regexp_replace(nfc_normalize(coalesce(text, '')), '\s+', ' ', 'g')) AS t FROM documents),
w AS (SELECT *, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w FROM d),
c AS (SELECT doc_id AS claim, doc_id % 50 AS answer, array_to_string(w[3:(CASE WHEN doc_id % 9 = 0 THEN 5 WHEN doc_id % 11 = 0 THEN 90 ELSE 12 END)], ' ') AS quote, array_to_string(w[3:12], ' ') AS claim_text, CASE WHEN doc_id % 7 = 0 THEN doc_id + 1 ELSE doc_id END AS cited, doc_id % 13 > 0 AS shown FROM w),
v AS (SELECT c.*, e.t, CASE WHEN quote = '' THEN 0 ELSE len(string_split(quote, ' ')) END AS n FROM c LEFT JOIN d e ON e.doc_id = cited),
k AS (SELECT *, list_filter([CASE WHEN t IS NULL THEN 'unknown' END, CASE WHEN NOT shown THEN 'not shown' END, CASE WHEN n < 5 THEN 'too short' WHEN n > 80 THEN 'too long' END, CASE WHEN t IS NOT NULL AND n >= 5 AND NOT contains(t, quote) THEN 'not literal' END], lambda x: x IS NOT NULL) AS failures FROM v)"""


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", T.collapsed(T.nfc(F.coalesce("text", F.lit("")))).alias("t"))
    k = F.col("doc_id")
    last = F.when(k % 9 == 0, 5).when(k % 11 == 0, 90).otherwise(12)
    words = lambda n: F.array_join(F.slice(F.split("t", " "), F.lit(3), n - 2), " ")
    return d.select(k.alias("claim_id"), (k % 50).alias("answer_id"), words(last).alias("quote"), words(F.lit(12)).alias("text"), F.when(k % 7 == 0, k + 1).otherwise(k).alias("doc_id"), (k % 13 > 0).alias("shown"))


@register("citation_checks", f"WITH {_CLAIMS} SELECT claim AS claim_id, array_to_string(failures, ', ') AS failures FROM k")
def citation_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes cut from every document, some too short or long, some citing the next document."""
    checked = E.citation_checks(_claims(spark, sf).drop("text"), _t(spark, sf, "documents").select("doc_id", "text"))
    return checked.select("claim_id", F.array_join("failures", ", ").alias("failures"))


_FIG = "list_transform(regexp_extract_all({}, '([0-9]{{1,3}}(?:[ ][0-9]{{3}})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?)', 1), lambda x: translate(replace(x, ' ', ''), ',', '.'))"


@register("abstention_rules", f"""WITH {_CLAIMS}, p AS (SELECT answer, len(failures) = 0 AND len(list_filter({_FIG.format("claim_text")}, lambda x: NOT list_contains({_FIG.format("coalesce(t, '')")}, x))) = 0 AS pass FROM k),
a AS (SELECT answer AS answer_id, answer % 3 > 0 AS a, bool_and(pass) AS b FROM p GROUP BY ALL) SELECT *, a AND b AS c FROM a""")
def abstention_rules(spark: SparkSession, sf: str) -> DataFrame:
    claims = _claims(spark, sf)
    checked = E.citation_checks(claims.select("claim_id", "doc_id", "quote", "shown"), _t(spark, sf, "documents").select("doc_id", "text"))
    said = claims.select("answer_id").distinct().withColumn("sufficient", F.col("answer_id") % 3 > 0)
    return E.answered(checked, claims.select("answer_id", "claim_id", "text"), said)


@register("answer_admission", """WITH g AS (SELECT DISTINCT l_orderkey AS job, l_linenumber AS item FROM lineitem), r AS (SELECT l_orderkey AS job, CASE WHEN l_partkey % 20 = 0 THEN l_linenumber + 1 ELSE l_linenumber END AS item, count(*) AS n FROM lineitem WHERE l_suppkey % 10 > 0 GROUP BY ALL)
SELECT * FROM (SELECT coalesce(g.job, r.job) AS job, sum((r.n IS NULL)::INT)::BIGINT AS missing, sum((g.item IS NULL)::INT)::BIGINT AS unknown, sum((coalesce(r.n, 0) > 1)::INT)::BIGINT AS repeated FROM g FULL JOIN r ON g.job = r.job AND g.item = r.item GROUP BY 1) WHERE missing + unknown + repeated > 0""")
def answer_admission(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "lineitem")
    given = rows.select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").cast("long").alias("item"))
    back = rows.filter("l_suppkey % 10 > 0").select(F.col("l_orderkey").alias("job"), F.when(F.col("l_partkey") % 20 == 0, F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber")).cast("long").alias("item"))
    return E.admission(given, back, "job", "item")


@register("batch_packing", f"""WITH RECURSIVE {_OVERLAP}, g AS (SELECT query_id, rank, doc_id % 4 + 1 AS n, (doc_id * 37) % 900 AS t FROM overlap),
f AS (SELECT query_id, rank, n, t, 1::BIGINT AS batch FROM g WHERE rank = 1 UNION ALL
 SELECT g.query_id, g.rank, CASE WHEN f.n + g.n > 8 OR f.t + g.t > 1500 THEN g.n ELSE f.n + g.n END, CASE WHEN f.n + g.n > 8 OR f.t + g.t > 1500 THEN g.t ELSE f.t + g.t END, f.batch + (f.n + g.n > 8 OR f.t + g.t > 1500)::INT
 FROM f JOIN g ON g.query_id = f.query_id AND g.rank = f.rank + 1) SELECT query_id, rank, batch FROM f""")
def batch_packing(spark: SparkSession, sf: str) -> DataFrame:
    g = overlap_run(spark, sf).select("query_id", "rank", (F.col("doc_id") % 4 + 1).alias("n"), (F.col("doc_id") * 37 % 900).alias("t"))
    return E.packed(g, "query_id", "rank", "n", "t", 8, 1500)


_MOVED = "mv AS (SELECT query_id, doc_id, rank, score + (doc_id % 3) / 10000000 AS score FROM overlap)"


def _moved(run: DataFrame) -> DataFrame:
    return run.withColumn("score", F.col("score") + F.col("doc_id") % 3 / 10000000)


@register("score_comparison", f"WITH {_OVERLAP}, {_MOVED} SELECT CASE WHEN max(abs(a.score - b.score)) <= 1e-6 THEN 'within tolerance' ELSE 'differs' END AS outcome, round(max(abs(a.score - b.score)), 9) AS largest, 0::BIGINT AS alone, count(*) AS compared FROM overlap a JOIN mv b USING (query_id, doc_id)")
def score_comparison(spark: SparkSession, sf: str) -> DataFrame:
    run = overlap_run(spark, sf)
    return E.score_comparison(run, _moved(run), ["query_id", "doc_id"]).withColumn("largest", F.round("largest", 9))


@register("rank_margins", f"""WITH {_BM25}, g AS (SELECT query_id, rank, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS gap FROM bm25)
SELECT query_id, sum(coalesce(gap = 0, false)::INT)::BIGINT AS ties, round(min(gap), 6) AS least, round(min(gap) FILTER (rank <= 10), 6) AS least_top FROM g GROUP BY query_id""")
def rank_margins(spark: SparkSession, sf: str) -> DataFrame:
    return E.margins(bm25_run(spark, sf)).select("query_id", "ties", F.round("least", 6).alias("least"), F.round("least_top", 6).alias("least_top"))


@register("fragile_pairs", f"""WITH {_OVERLAP}, {_MOVED}, g AS (SELECT query_id, rank, doc_id, lead(doc_id) OVER w AS next, score - lead(score) OVER w AS gap FROM overlap WINDOW w AS (PARTITION BY query_id ORDER BY rank))
SELECT g.query_id, g.rank, g.doc_id, g.next, g.gap, round(a.score - b.score, 8) AS moved_gap FROM g JOIN mv a ON a.query_id = g.query_id AND a.doc_id = g.doc_id JOIN mv b ON b.query_id = g.query_id AND b.doc_id = g.next WHERE g.rank <= 10 AND gap < 0.5""")
def fragile_pairs(spark: SparkSession, sf: str) -> DataFrame:
    run = overlap_run(spark, sf)
    return E.fragile(run, _moved(run), 0.5).withColumn("rank", F.col("rank").cast("long")).withColumn("moved_gap", F.round("moved_gap", 8))


@register("leave_one_out", f"""WITH {_BM25}, {_OVERLAP}, u AS (SELECT query_id, doc_id, 'bm25' AS c FROM bm25 WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, 'overlap' FROM overlap WHERE rank <= 20),
p AS (SELECT query_id, doc_id, list(DISTINCT c) AS cs FROM u GROUP BY ALL) SELECT o.out, count(*) AS kept FROM p, (SELECT unnest(['bm25', 'overlap']) AS out) o WHERE NOT (len(cs) = 1 AND cs[1] = o.out) GROUP BY o.out""")
def leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    return E.without_contributor(pooled_documents(spark, sf).withColumn("contributors", F.split("contributors", ",")), ["bm25", "overlap"]).groupBy("out").agg(F.count("*").alias("kept"))


@register("area_lookup", """WITH a AS (SELECT n_nationkey AS g, k AS area, k * 100 AS low, k * 100 + 60 AS high FROM nation, range(0, 120) r(k))
SELECT c_custkey, area FROM customer c LEFT JOIN a ON a.g = c_nationkey AND floor(c_acctbal + 1000) BETWEEN low AND high""")
def area_lookup(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(119).cast("long"))).alias("area"))
    areas = n.select("g", "area", (F.col("area") * 100).alias("low"), (F.col("area") * 100 + 60).alias("high"))
    rows = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), "c_custkey", F.floor(F.col("c_acctbal") + 1000).alias("v"))
    return E.inside(rows, areas, "g", "v").select("c_custkey", "area")


@register("driver_means", """WITH r AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN ['(none)'] ELSE list_distinct(['d' || c_custkey % 7, 'd' || c_nationkey % 4]) END AS g FROM customer)
SELECT "group", round(avg(c_acctbal), 6) AS mean, count(DISTINCT c_custkey) AS needs, count(DISTINCT c_custkey) < 5 AS few FROM (SELECT c_custkey, c_acctbal, unnest(g) AS "group" FROM r) GROUP BY 1""")
def driver_means(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    g = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("d"), (k % 7).cast("string")), F.concat(F.lit("d"), (F.col("c_nationkey") % 4).cast("string"))))
    return design.group_means(_t(spark, sf, "customer").withColumn("g", g), "g", "c_acctbal", "c_custkey")


@register("attempt_counts", """SELECT user_id, event_type, sum((value > 40 AND value <= 90)::INT)::BIGINT AS failures, sum((value > 90)::INT)::BIGINT AS excused, coalesce(sum((value > 40 AND value <= 90)::INT), 0) >= 3 AS exhausted FROM (SELECT user_id, event_type, coalesce(value, 0) AS value FROM events) GROUP BY ALL""")
def attempt_counts(spark: SparkSession, sf: str) -> DataFrame:
    v = F.coalesce("value", F.lit(0.0))
    return design.attempts(_t(spark, sf, "events"), "user_id", "event_type", v > 40, v > 90)


@register("planned_realised", """WITH p AS (SELECT n_nationkey AS k, 10 + n_nationkey % 3 AS n FROM nation WHERE n_nationkey % 6 > 0), r AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey % 5 > 0 GROUP BY 1)
SELECT coalesce(p.k, r.k) AS k, coalesce(p.n, 0)::BIGINT AS planned, coalesce(r.n, 0) AS realised, coalesce(r.n, 0) - coalesce(p.n, 0) AS gap FROM p FULL JOIN r ON p.k = r.k""")
def planned_realised(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "nation").filter("n_nationkey % 6 > 0").select(F.col("n_nationkey").alias("k"), (10 + F.col("n_nationkey") % 3).alias("n"))
    return design.planned_realised(p, _t(spark, sf, "customer").filter("c_nationkey % 5 > 0").select(F.col("c_nationkey").alias("k")), ["k"])


@register("length_ranges", """SELECT CASE WHEN n <= 50 THEN '0-50' WHEN n <= 200 THEN '51-200' WHEN n <= 500 THEN '201-500' ELSE '501+' END AS range, count(*) AS n FROM (SELECT len(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1)) AS n FROM documents) GROUP BY 1""")
def length_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return design.ranges(_t(spark, sf, "documents").select(F.size(T.ascii_words(F.col("text"))).alias("words")), "words", [50, 200, 500])


@register("sampling_bank", """WITH n AS (SELECT n_nationkey AS slot, 'r' || n_regionkey AS act FROM nation), c AS (SELECT count(*) AS c FROM n),
x AS (SELECT slot FROM n ORDER BY sha256('s:extra:' || slot) LIMIT 90 % (SELECT c FROM c)),
cp AS (SELECT slot, act, unnest(range(1, (90 // (SELECT c FROM c) + (slot IN (FROM x))::INT + 1)::BIGINT))::INT AS copy FROM n),
d AS (SELECT *, sha256('s:priority:' || slot || ':' || copy) AS p, row_number() OVER (PARTITION BY act ORDER BY sha256('s:priority:' || slot || ':' || copy)) - 1 AS i, row_number() OVER (ORDER BY sha256('s:priority:' || slot || ':' || copy)) AS rank FROM cp),
u AS (SELECT 'r' || (s_nationkey % 5) AS act, s_suppkey % 4 AS article, list_sort(list(DISTINCT s_suppkey)) AS nodes FROM supplier GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY act ORDER BY sha256('s:article:' || act || ':' || article)) - 1 AS a, count(*) OVER (PARTITION BY act) AS m FROM u)
SELECT slot, copy, d.act, article, nodes[1 + (('0x' || substr(sha256('s:provision:' || d.act || ':' || article), 1, 8))::BIGINT + i // m) % len(nodes)] AS node, i // m AS earlier, rank FROM d JOIN o ON o.act = d.act AND i % m = a""")
def sampling_bank(spark: SparkSession, sf: str) -> DataFrame:
    slots = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("slot"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("act"))
    units = _t(spark, sf, "supplier").select(F.concat(F.lit("r"), (F.col("s_nationkey") % 5).cast("string")).alias("act"), (F.col("s_suppkey") % 4).alias("article"), F.col("s_suppkey").alias("node"))
    return design.bank(slots, units, "s", 90).withColumn("rank", F.col("rank").cast("long"))


@register("dealt_batches", """WITH n AS (SELECT count(*) AS n FROM orders) SELECT b AS batch, n // 3 + (b < n % 3)::INT AS size, CAST(0 AS BIGINT) AS improving FROM n, range(3) t(b)""")
def dealt_batches(spark: SparkSession, sf: str) -> DataFrame:
    """All orders dealt into three batches by status, priority and size: their sizes, and the swaps of two profiles between it and another batch that would bring them closer to the whole."""
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.floor(F.col("o_totalprice") / 50_000).alias("size"))
    names = ["o_orderstatus", "o_orderpriority", "size"]
    rows = orders.join(design.deal(orders, "o_orderkey", names), "o_orderkey")
    profile = F.array(*[F.concat_ws("=", F.lit(c), F.col(c).cast("string")) for c in names])
    counts = rows.select("batch", F.explode(profile).alias("value")).groupBy("batch", "value").agg(F.count("*").alias("c"))
    have = counts.groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("value", "c"))).alias("have"))
    held = rows.select("batch", profile.alias("p")).distinct().join(have, "batch")
    a, b = held.toDF("batch", "p", "x"), held.toDF("other", "q", "y")
    # moving one row of p to the other batch and one of q back changes the squared distance by 2 (d . gap) + 2 |d|^2
    gap = lambda v: F.coalesce(F.try_element_at("x", v), F.lit(0)) - F.coalesce(F.try_element_at("y", v), F.lit(0))
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + gap(v))
    only_p, only_q = F.array_except("p", "q"), F.array_except("q", "p")
    gain = 2 * (total(only_q) - total(only_p)) + 2 * (F.size(only_p) + F.size(only_q))
    swaps = a.join(b, F.col("batch") != F.col("other")).withColumn("better", (gain < 0).cast("int")).groupBy("batch").agg(F.sum("better").alias("improving"))
    return rows.groupBy("batch").agg(F.count("*").alias("size")).join(swaps, "batch").select("batch", "size", "improving")


_STAGED = """SELECT o_orderkey AS case, o_orderkey % 4 > 0 AS positive, s.stage AS stage, (o_orderkey * (s.stage + 3) + o_custkey) % (5 - s.stage) = 0 AS answered, (o_orderkey + o_custkey * s.stage) % 3 > 0 AS hit, o_custkey % 4 + s.stage AS claims, o_custkey % 4 + s.stage - CASE WHEN o_orderkey % (3 + s.stage) = 0 THEN 1 ELSE 0 END AS passed
FROM orders CROSS JOIN (SELECT CAST(1 AS INT) AS stage UNION ALL SELECT CAST(2 AS INT) UNION ALL SELECT CAST(3 AS INT)) s"""


@register("cascade_gates", f"""WITH o AS ({_STAGED.replace("AS case", 'AS "case"')}), p AS (SELECT "case", any_value(positive) AS positive, bool_or(answered) FILTER (stage = 1) AS a1, bool_or(answered) FILTER (stage = 2) AS a2, bool_or(answered) FILTER (stage = 3) AS a3,
  bool_or(hit) FILTER (stage = 1) AS h1, bool_or(hit) FILTER (stage = 2) AS h2, bool_or(hit) FILTER (stage = 3) AS h3 FROM o GROUP BY "case"),
c AS (SELECT stage, sum(passed)::DOUBLE / sum(claims) AS pass FROM o WHERE positive GROUP BY stage),
x AS (SELECT 2 AS stage, count(*) FILTER (positive AND NOT a1 AND a2 AND h2) AS rescued, count(*) FILTER (positive AND NOT (a1 AND h1) AND a2 AND h2) AS broader, count(*) FILTER (positive AND a1 AND h1 AND NOT (a2 AND h2)) AS lost,
  count(*) FILTER (NOT positive AND (a1 OR a2)) AS undesired, count(*) FILTER (NOT positive AND a1) AS undesired_before FROM p
 UNION ALL SELECT 3, count(*) FILTER (positive AND NOT a1 AND NOT a2 AND a3 AND h3), count(*) FILTER (positive AND NOT (CASE WHEN a1 THEN h1 ELSE a2 AND h2 END) AND a3 AND h3), count(*) FILTER (positive AND (CASE WHEN a1 THEN h1 ELSE a2 AND h2 END) AND NOT (a3 AND h3)),
  count(*) FILTER (NOT positive AND (a1 OR a2 OR a3)), count(*) FILTER (NOT positive AND (a1 OR a2)) FROM p),
g AS (SELECT x.*, (SELECT pass FROM c WHERE stage = 1) - pass AS d, CASE WHEN stage = 2 THEN 0.95 END AS share FROM x JOIN c USING (stage))
SELECT stage, rescued, broader, lost, undesired, undesired_before, round(d, 6) AS drop, rescued >= 3 AS enough, undesired <= undesired_before AS no_extra, d <= 0.05 AS not_degraded, share >= 0.9 AS supported,
  rescued >= 3 AND undesired <= undesired_before AND d <= 0.05 AND coalesce(share >= 0.9, FALSE) AS justified, CASE WHEN share IS NULL THEN 'supported' ELSE '' END AS unresolved FROM g""")
def cascade_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Three answering stages over the orders as cases: is the second, and the third, worth adding?"""
    outcomes = made(spark, sf, _STAGED)
    return cascade.stages(outcomes, spark.createDataFrame([(2, 0.95)], "stage int, share double"))


@register("seeded_order")
def seeded_order(spark: SparkSession, sf: str) -> DataFrame:
    """The orders of every customer in the order in which a generator seeded by the customer's key shuffles them."""
    return draws.shuffled(_t(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", "audit")


@register("cluster_bootstrap", """WITH d AS (SELECT c_nationkey AS g, round(c_acctbal / 1000 - 4, 6) AS delta FROM customer), k AS (SELECT g, sum(delta) AS s, count(*) AS c, row_number() OVER (ORDER BY g) - 1 AS pos_ FROM d GROUP BY g), n AS (SELECT count(*) AS n FROM k),
m AS (SELECT rep, sum(s) / sum(c) AS m FROM (SELECT rep, ('0x' || substr(md5('c:' || rep || ':' || j), 1, 12))::BIGINT % n AS pos_ FROM n, range(500) r(rep), range((SELECT n FROM n)) q(j)) JOIN k USING (pos_) GROUP BY rep),
o AS (SELECT m, row_number() OVER (ORDER BY m) AS i FROM m)
SELECT (SELECT round(avg(delta), 6) FROM d) AS mean, (SELECT n FROM n) AS clusters, round(max(m) FILTER (i = 13), 6) AS low, round(max(m) FILTER (i = 487), 6) AS high FROM o""")
def cluster_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    deltas = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), F.round(F.col("c_acctbal") / 1000 - 4, 6).alias("delta"))
    return stats.cluster_bootstrap(deltas, "g", 500)


_STATS = "s AS (SELECT user_id, round(avg(value) / 1000 - 0.05, 9) AS mean, round(stddev_samp(value) / 1000 / sqrt(count(value)), 9) AS se, round(max(value) / 20, 9) AS p95, round(min(value) + 1, 9) AS m1, round(avg(value) + 1, 9) AS m2 FROM events GROUP BY user_id HAVING count(value) > 1)"


@register("decision_labels", f"""WITH {_STATS}, i AS (SELECT *, mean - 1.96 * se AS low2, mean + 1.96 * se AS high2, mean - 1.645 * se AS low1, mean + 1.645 * se AS high1, mean - se AS drop_one FROM s),
g AS (SELECT *, CASE WHEN mean <= -0.02 + 1e-9 THEN 'violated' WHEN low1 > -0.02 + 1e-9 THEN 'passed' ELSE 'unresolved' END AS guard FROM i)
SELECT user_id, guard, CASE WHEN low2 > 0 THEN 'holds' WHEN high2 < 0 THEN 'reverses' ELSE 'inconclusive' END AS verdict,
 CASE WHEN mean >= 0.03 - 1e-9 THEN CASE WHEN drop_one < 0.03 - 1e-9 THEN 'fragile' WHEN low2 > 0.03 + 1e-9 THEN 'strong' WHEN low2 > 1e-9 THEN 'supported' ELSE 'material' END
 WHEN low2 > 1e-9 THEN 'below material' WHEN high1 < -0.03 - 1e-9 THEN 'inferior' WHEN low1 > -0.03 + 1e-9 AND guard <> 'violated' THEN 'non-inferior' ELSE 'unresolved' END AS label,
 CASE WHEN p95 <= 10 + 1e-9 THEN 'fast' WHEN p95 <= 30 + 1e-9 THEN 'mid' ELSE 'slow' END AS latency,
 CASE WHEN greatest(m1, m2) / least(m1, m2) - 1 <= 0.1 + 1e-9 THEN 'valid' WHEN user_id % 2 = 0 THEN 'needs repeat' WHEN greatest(m1, m1 * 1.05) / least(m1, m1 * 1.05) - 1 <= 0.1 + 1e-9 THEN 'valid after repeat' ELSE 'unstable' END AS passes FROM g""")
def decision_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every decision rule over figures of the users' events."""
    v = F.col("value")
    s = _t(spark, sf, "events").groupBy("user_id").agg(
        F.count("value").alias("n"), F.round(F.avg(v) / 1000 - 0.05, 9).alias("mean"), F.round(F.stddev_samp(v) / 1000 / F.sqrt(F.count("value")), 9).alias("se"), F.round(F.max(v) / 20, 9).alias("p95"), F.round(F.min(v) + 1, 9).alias("m1"), F.round(F.avg(v) + 1, 9).alias("m2")
    ).filter("n > 1")
    m, se = F.col("mean"), F.col("se")
    low1, high1, low2, high2 = m - 1.645 * se, m + 1.645 * se, m - 1.96 * se, m + 1.96 * se
    guard = rules.guardrail(m, low1)
    again = F.when(F.col("user_id") % 2 == 1, F.col("m1") * 1.05)
    return s.select("user_id", guard.alias("guard"), rules.verdict(low2, high2).alias("verdict"), rules.recall_label(m, low2, low1, high1, m - se, guard).alias("label"), rules.latency_class(F.col("p95")).alias("latency"), rules.pass_status(F.col("m1"), F.col("m2"), again).alias("passes"))


@register("float_spacing", "SELECT event_id, CASE WHEN abs(value::FLOAT::DOUBLE) < pow(2.0, -126) THEN pow(2.0, -149) ELSE pow(2.0, floor(log2(abs(value::FLOAT::DOUBLE))) - 23) END AS ulp FROM events WHERE value IS NOT NULL")
def float_spacing(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").filter("value is not null").select("event_id", L.ulp(F.col("value")).alias("ulp"))


@register("sensitivity", f"""WITH {_OVERLAP}, s AS (SELECT unnest(['main', 'strict', 'no threes', 'lenient']) AS scenario), g AS (SELECT scenario, query_id, doc_id, grade, CASE scenario WHEN 'strict' THEN 3 WHEN 'lenient' THEN 1 ELSE 2 END AS rel FROM qrels, s WHERE NOT (scenario = 'no threes' AND grade = 3)),
r AS (SELECT scenario, query_id, count(*) AS total FROM g WHERE grade >= rel GROUP BY ALL), h AS (SELECT scenario, query_id, count(*) AS found FROM g JOIN overlap o USING (query_id, doc_id) WHERE grade >= rel AND rank <= 10 GROUP BY ALL)
SELECT scenario, round(avg(round(coalesce(found / total, 0), 6)), 6) AS recall, count(*) AS queries FROM r LEFT JOIN h USING (scenario, query_id) GROUP BY scenario""")
def sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """The recall of one run under four readings of the judgments."""
    run, judged = overlap_run(spark, sf).persist(), qrels(spark, sf)
    readings = {"main": judged.filter("grade >= 2"), "strict": judged.filter("grade >= 3"), "no threes": judged.filter("grade = 2"), "lenient": judged.filter("grade >= 1")}
    return E.sensitivity(run, readings, "recall")

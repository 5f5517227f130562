"""Diagnostics, verdicts and dependency queries over the runs of ``evaluation`` and inputs made by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.catalog import register
from stratiform.operators import dependencies as P
from stratiform.operators import diagnostics as D
from stratiform.operators import verdicts as V
from stratiform.plans.evaluation import _METRICS, _OVERLAP, metrics_per_query, overlap_run, qrels
from stratiform.plans.judging import made

_REL = f"{_OVERLAP}, relevant AS (SELECT query_id, doc_id FROM qrels WHERE grade >= 2)"


def _relevant(spark: SparkSession, sf: str) -> DataFrame:
    return qrels(spark, sf).filter("grade >= 2").select("query_id", "doc_id")


@register("full_evidence", f"WITH {_REL} SELECT r.query_id, bool_and(o.doc_id IS NOT NULL) AS \"full\" FROM relevant r LEFT JOIN (SELECT * FROM overlap WHERE rank <= 10) o USING (query_id, doc_id) GROUP BY r.query_id")
def full_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return D.full_evidence(overlap_run(spark, sf), _relevant(spark, sf))


@register("first_k_recall", f"WITH {_REL} SELECT r.query_id, round(avg(coalesce((rank <= 20)::INT, 0)), 6) AS recall_20, round(avg(coalesce((rank <= 50)::INT, 0)), 6) AS recall_50 FROM relevant r LEFT JOIN overlap USING (query_id, doc_id) GROUP BY r.query_id")
def first_k_recall(spark: SparkSession, sf: str) -> DataFrame:
    return D.first_k_recall(overlap_run(spark, sf), _relevant(spark, sf), [20, 50])


@register("first_correct", f"""WITH {_REL}, f AS (SELECT r.query_id, min(rank) AS first FROM relevant r LEFT JOIN overlap USING (query_id, doc_id) GROUP BY r.query_id)
SELECT count(*) AS queries, round(avg(coalesce(1 / first, 0)), 6) AS mrr, {", ".join(f"round(avg(coalesce((first <= {k})::INT, 0)), 6) AS hit_{k}" for k in (1, 3, 5, 10))} FROM f""")
def first_correct(spark: SparkSession, sf: str) -> DataFrame:
    return D.first_correct(overlap_run(spark, sf), _relevant(spark, sf))


@register("fixed_gain", f"""WITH {_OVERLAP} SELECT o.query_id, round(sum(coalesce(grade, 0) * ln(2) / ln(rank + 1)) / (SELECT sum(3 * ln(2) / ln(i + 1)) FROM range(1, 11) r(i)), 6) AS gain FROM overlap o LEFT JOIN qrels USING (query_id, doc_id) WHERE rank <= 10 GROUP BY o.query_id""")
def fixed_gain(spark: SparkSession, sf: str) -> DataFrame:
    return D.gain_at_k(overlap_run(spark, sf), qrels(spark, sf))


_JUDGED = f"{_OVERLAP}, j AS (SELECT o.query_id, round(count(grade) / 20, 6) AS judged FROM overlap o LEFT JOIN qrels USING (query_id, doc_id) WHERE rank <= 20 GROUP BY o.query_id)"


@register("judged_share", f"WITH {_JUDGED} SELECT * FROM j")
def judged_share(spark: SparkSession, sf: str) -> DataFrame:
    return D.judged_at(overlap_run(spark, sf), qrels(spark, sf), 20)


def _quartile(q: float) -> str:
    return f"CASE WHEN max(n) = 1 THEN max(v) ELSE round(max(v) FILTER (k = l{int(q * 100)}) + (max(v) FILTER (k = l{int(q * 100)} + 1) - max(v) FILTER (k = l{int(q * 100)})) * max((n + 1) * {q}::DOUBLE - l{int(q * 100)}), 6) END"


@register("size_distribution", f"""WITH x AS (SELECT n_chars::DOUBLE AS v FROM documents WHERE n_chars IS NOT NULL), p AS (SELECT v, row_number() OVER (ORDER BY v) AS k, count(*) OVER () AS n FROM x),
l AS (SELECT *, greatest(1, least(floor((n + 1) * 0.25), n - 1)) AS l25, greatest(1, least(floor((n + 1) * 0.5), n - 1)) AS l50, greatest(1, least(floor((n + 1) * 0.75), n - 1)) AS l75 FROM p)
SELECT max(n) AS n, min(v) AS min, {_quartile(0.25)} AS q1, {_quartile(0.5)} AS median, {_quartile(0.75)} AS q3, max(v) AS max, round(sum(v) / count(*), 6) AS mean FROM l""")
def size_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return D.distribution(made(spark, sf, "SELECT n_chars FROM documents"), "n_chars")


@register("discovery_by_depth", f"""WITH {_REL}, s AS (SELECT query_id, doc_id, 'c' || doc_id % 3 AS contributor, rank FROM overlap), h AS (SELECT s.* FROM s JOIN relevant USING (query_id, doc_id)),
f AS (SELECT query_id, doc_id, contributor, min(rank) AS rank FROM h GROUP BY ALL UNION ALL SELECT query_id, doc_id, 'union', min(rank) FROM h GROUP BY query_id, doc_id),
k AS (SELECT query_id, contributor, depth, count(*) AS k FROM f, (SELECT unnest([5, 10, 50]) AS depth) WHERE rank <= depth GROUP BY ALL), z AS (SELECT query_id, count(*) AS size FROM relevant GROUP BY query_id)
SELECT contributor, depth, round(sum(k / size) / (SELECT count(*) FROM z), 6) AS share FROM k JOIN z USING (query_id) GROUP BY contributor, depth""")
def discovery_by_depth(spark: SparkSession, sf: str) -> DataFrame:
    sources = overlap_run(spark, sf).select("query_id", "doc_id", F.concat(F.lit("c"), F.col("doc_id") % 3).alias("contributor"), "rank")
    return D.discovery(sources, _relevant(spark, sf), [5, 10, 50])


@register("failure_transitions", f"""WITH {_OVERLAP}{_METRICS}, b AS (SELECT query_id, CASE query_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE recall END AS recall, CASE WHEN query_id % 5 = 2 THEN ndcg + 0.5 ELSE ndcg END AS ndcg, CASE WHEN query_id % 5 = 0 THEN 1 ELSE first_relevant END AS f FROM m),
x AS (SELECT query_id, m.recall AS ra, b.recall AS rb, m.ndcg AS na, b.ndcg AS nb, m.recall < 1 OR coalesce(m.first_relevant > 10, TRUE) AS fa, b.recall < 1 OR coalesce(b.f > 10, TRUE) AS fb FROM m JOIN b USING (query_id))
SELECT query_id, CASE WHEN fa AND NOT fb THEN 'A fixed by B' WHEN NOT fa AND fb THEN 'D worse (a new failure)' WHEN NOT fa THEN 'not failing under either' WHEN rb < ra OR rb = ra AND nb < na - 0.01 THEN 'D worse' WHEN rb > ra OR rb = ra AND nb > na + 0.01 THEN 'B improved but still failing' ELSE 'C same failure' END AS label FROM x""")
def failure_transitions(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics_per_query(spark, sf).select("query_id", "recall", "ndcg", "first_relevant")
    k = F.col("query_id") % 5
    b = m.select("query_id", F.when(k == 0, 1.0).when(k == 1, 0.0).otherwise(F.col("recall")).alias("recall"), F.when(k == 2, F.col("ndcg") + 0.5).otherwise(F.col("ndcg")).alias("ndcg"), F.when(k == 0, 1).otherwise(F.col("first_relevant")).alias("first_relevant"))
    return D.transitions(m, b)


_D = "SELECT c_custkey AS need, CAST((c_custkey * 37) % 101 - 45 AS DOUBLE) / 100 AS delta, CAST((c_custkey * 53) % 89 - 44 AS DOUBLE) / 100 AS other FROM customer"


@register("influential_needs", f"""WITH d AS ({_D}), l AS (SELECT delta FROM d ORDER BY abs(delta) DESC, need LIMIT 3), g AS (SELECT delta FROM d WHERE delta > 0 ORDER BY delta DESC, need LIMIT 3)
SELECT count(*) AS needs, round(avg(delta), 6) AS mean, round((sum(delta) - (SELECT sum(delta) FROM l)) / (count(*) - 3), 6) AS mean_without, round((SELECT sum(delta) FROM g) / sum(delta) FILTER (delta > 0), 6) AS share_of_gains FROM d""")
def influential_needs(spark: SparkSession, sf: str) -> DataFrame:
    return D.influence(made(spark, sf, _D), "need")


_BOARD = "SELECT concat('s', CAST(c_nationkey AS STRING)) AS system, avg(CAST(c_custkey % 17 AS DOUBLE) / 17) AS recall, avg(CAST(c_custkey % 13 AS DOUBLE) / 13) AS ndcg FROM customer GROUP BY c_nationkey"


@register("leaderboard", f"""WITH s AS ({_BOARD}), b AS (SELECT recall AS br, ndcg AS bn FROM s WHERE system = 's3'),
r AS (SELECT system, round(recall, 3) AS recall, round(ndcg, 3) AS ndcg, round(recall - br, 3) AS delta_recall, round(ndcg - bn, 3) AS delta_ndcg FROM s, b)
SELECT *, row_number() OVER (ORDER BY recall DESC, ndcg DESC, system) AS place, row_number() OVER (ORDER BY recall DESC, ndcg DESC, system) = 1 AS best FROM r""")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return D.leaderboard(made(spark, sf, _BOARD), "s3", ["recall", "ndcg"]).withColumn("place", F.col("place").cast("long"))


_EDGES = "SELECT concat('c', CAST(o_custkey AS STRING)) AS source, CASE WHEN o_orderkey % 5 = 0 THEN 'B' ELSE 'A' END AS act, 'A' AS source_act, CASE o_orderkey % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'paragraphs' ELSE 'points' END AS form, CAST(o_orderkey AS STRING) AS path, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'x' ELSE CAST(o_orderkey AS STRING) END AS resolved, CASE WHEN o_orderkey % 7 > 0 THEN concat('c', CAST(o_orderkey % 40 AS STRING)) END AS target, CASE o_orderkey % 11 WHEN 0 THEN 'anaphora' WHEN 1 THEN 'outside_the_corpus' END AS skipped FROM orders"


@register("graph_summary", f"""WITH e AS ({_EDGES}), k AS (SELECT * FROM e WHERE skipped IS NULL)
SELECT 'references_followed' AS what, count(*) FILTER (resolved IS NOT NULL) AS value FROM k UNION ALL SELECT 'cross_act', count(*) FILTER (act <> source_act) FROM k
UNION ALL SELECT 'resolved_to_an_ancestor', count(*) FILTER (resolved <> path) FROM k UNION ALL SELECT 'unresolved', count(*) FILTER (resolved IS NULL) FROM k
UNION ALL SELECT 'skipped_' || skipped, count(*) FROM e WHERE skipped IS NOT NULL GROUP BY skipped UNION ALL SELECT 'sources_with_a_target', count(DISTINCT source) FILTER (target <> source) FROM k
UNION ALL SELECT 'form ' || form, count(*) FROM k GROUP BY form""")
def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    return D.graph_summary(made(spark, sf, _EDGES))


@register("table_profile", """SELECT 'size' AS what, CASE WHEN n_chars <= 100 THEN '<= 100' WHEN n_chars <= 1000 THEN '<= 1000' ELSE '> 1000' END AS name, count(*) AS n FROM documents GROUP BY 2
UNION ALL (SELECT 'most', source, count(*) FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 3)""")
def table_profile(spark: SparkSession, sf: str) -> DataFrame:
    return D.profile(made(spark, sf, "SELECT * FROM documents"), "n_chars", [100, 1000], "source", 3)


@register("lexical_profile", """WITH w AS (SELECT lang, len(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1)) AS w FROM documents)
SELECT lang, count(*) AS n, min(w)::INT AS least, median(w)::DOUBLE AS median, max(w)::INT AS most, round(avg(w), 3) AS mean FROM w GROUP BY lang""")
def lexical_profile(spark: SparkSession, sf: str) -> DataFrame:
    return D.lexical_profile(made(spark, sf, "SELECT * FROM documents"), "lang", "text")


@register("figure_density", "SELECT lang, count(*) AS texts, round(avg(regexp_matches(coalesce(text, ''), '[0-9]')::INT), 6) AS share FROM documents GROUP BY lang")
def figure_density(spark: SparkSession, sf: str) -> DataFrame:
    return D.figure_density(made(spark, sf, "SELECT * FROM documents"), "lang", "text")


_OTHER = "other AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id % 17, doc_id) AS rank FROM overlap)"


def _other(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    return overlap_run(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("doc_id") % 17, "doc_id")))


@register("union_recall", f"WITH {_REL}, {_OTHER}, u AS (SELECT query_id, doc_id FROM overlap WHERE rank <= 10 UNION SELECT query_id, doc_id FROM other WHERE rank <= 10) SELECT r.query_id, round(count(u.doc_id) / count(*), 6) AS recall FROM relevant r LEFT JOIN u USING (query_id, doc_id) GROUP BY r.query_id")
def union_recall(spark: SparkSession, sf: str) -> DataFrame:
    return D.union_recall(overlap_run(spark, sf), _other(spark, sf), _relevant(spark, sf))


@register("list_windows", f'WITH {_OVERLAP} SELECT query_id, (rank - 1) // 8 AS "window", count(*) AS n, min(rank) AS first FROM overlap GROUP BY ALL')
def list_windows(spark: SparkSession, sf: str) -> DataFrame:
    return D.windows(overlap_run(spark, sf), 8).groupBy("query_id", F.col("window").cast("long").alias("window")).agg(F.count("*").alias("n"), F.min("rank").cast("long").alias("first"))


@register("answer_contexts", f"""WITH {_OVERLAP}, p AS (SELECT o.query_id, o.doc_id, row_number() OVER (PARTITION BY o.query_id ORDER BY rank) AS place FROM overlap o JOIN qrels USING (query_id, doc_id) WHERE grade < 2 QUALIFY place <= 4)
SELECT query_id, 'gold' AS context, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS place, doc_id FROM qrels WHERE grade >= 2
UNION ALL SELECT query_id, 'top', rank, doc_id FROM overlap WHERE rank <= 5
UNION ALL SELECT query_id, 'insufficient', place, doc_id FROM p WHERE query_id IN (SELECT query_id FROM p GROUP BY query_id HAVING count(*) >= 2)""")
def answer_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts of every question, as an answering study draws them."""
    return D.contexts(overlap_run(spark, sf), qrels(spark, sf), 5, 4, 2).withColumn("place", F.col("place").cast("long"))


@register("dependent_recall", f"""WITH {_REL}, e AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'anchor' ELSE 'dependent' END AS role FROM relevant), t AS (SELECT e.query_id, role, o.doc_id AS hit FROM e LEFT JOIN (SELECT * FROM overlap WHERE rank <= 10) o USING (query_id, doc_id))
SELECT query_id, round(count(hit) FILTER (role = 'dependent') / count(*) FILTER (role = 'dependent'), 6) AS recall, count(hit) FILTER (role = 'anchor') > 0 AS anchor_hit FROM t GROUP BY query_id HAVING count(*) FILTER (role = 'dependent') > 0""")
def dependent_recall(spark: SparkSession, sf: str) -> DataFrame:
    e = _relevant(spark, sf).withColumn("role", F.when(F.col("doc_id") % 3 == 0, "anchor").otherwise("dependent"))
    return D.dependent_recall(overlap_run(spark, sf), e)


@register("shared_resamples", f"""WITH d AS ({_D}), p AS (SELECT delta, other, row_number() OVER (ORDER BY need) - 1 AS place, count(*) OVER () AS n FROM d),
w AS (SELECT rep, k, ('0x' || substr(md5('r:' || rep || ':' || k), 1, 8))::BIGINT % (SELECT max(n) FROM p) AS place FROM range(200) r(rep), range((SELECT max(n) FROM p)) s(k)),
m AS (SELECT rep, round(avg(delta), 12) AS delta, round(avg(other), 12) AS other FROM w JOIN p USING (place) GROUP BY rep),
l AS (SELECT 'delta' AS metric, list_sort(list(delta)) AS v, (SELECT round(avg(delta), 6) FROM p) AS mean FROM m UNION ALL SELECT 'other', list_sort(list(other)), (SELECT round(avg(other), 6) FROM p) FROM m)
SELECT metric, mean, round(v[6], 6) AS low2, round(v[195], 6) AS high2, round(v[11], 6) AS low1, round(v[190], 6) AS high1 FROM l""")
def shared_resamples(spark: SparkSession, sf: str) -> DataFrame:
    return V.limits(made(spark, sf, _D), "need", ["delta", "other"], 200)


_Z = 1.959963984540054
#: Student's 97.5 % quantile for ``df`` degrees of freedom by its expansion in 1 / df; from 100 on it is exact to nine places.
_T = " + ".join(f"({c!r}) / pow(n - 1, {k})" for k, c in enumerate((_Z, (_Z**3 + _Z) / 4, (5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96, (3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384, (79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160)))


@register("paired_t_interval", f"""WITH d AS ({_D}), f AS (SELECT count(*) AS n, avg(delta) AS mean, stddev_samp(delta) / sqrt(count(*)) AS se FROM d)
SELECT n AS needs, round(mean, 6) AS mean, round(mean - ({_T}) * se, 6) AS low, round(mean + ({_T}) * se, 6) AS high FROM f""")
def paired_t_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Of all needs; the SQL has the quantile by its expansion."""
    return V.t_interval(made(spark, sf, _D))


_IV = "SELECT c_custkey AS k, CAST((c_custkey * 7) % 23 - 11 AS DOUBLE) AS a, CAST((c_custkey * 5) % 19 - 9 AS DOUBLE) AS b FROM customer"


@register("claims", f"""WITH x AS ({_IV}), v AS (SELECT k, CASE WHEN a - 3 > 0 THEN 'confirms' WHEN a + 3 < 0 THEN 'reverses' ELSE 'inconclusive' END AS r, CASE WHEN b - 3 > 0 THEN 'confirms' WHEN b + 3 < 0 THEN 'reverses' ELSE 'inconclusive' END AS n FROM x)
SELECT k, r AS recall, n AS ndcg, CASE WHEN r = 'reverses' AND n = 'reverses' THEN 'worse on Recall@10 and nDCG@10' WHEN r = 'reverses' THEN 'worse on Recall@10' WHEN n = 'reverses' THEN 'worse on nDCG@10' WHEN r = 'confirms' AND n = 'confirms' THEN 'better on both' WHEN r = 'confirms' THEN 'better on Recall@10 only' WHEN n = 'confirms' THEN 'better on nDCG@10 only' ELSE 'no difference shown' END AS claim FROM v""")
def claims(spark: SparkSession, sf: str) -> DataFrame:
    x = made(spark, sf, _IV).select("k", V.verdict(F.col("a") - 3, F.col("a") + 3).alias("recall"), V.verdict(F.col("b") - 3, F.col("b") + 3).alias("ndcg"))
    return x.withColumn("claim", V.claim(F.col("recall"), F.col("ndcg")))


_SC = f"SELECT c_custkey AS comparison, s AS scenario, CASE WHEN c_custkey % 2 = 0 THEN 'fast' ELSE 'slow' END AS latency, CASE (c_custkey + CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN s = 'low' THEN 1 ELSE 0 END) % 4 WHEN 0 THEN '{V.INFERIOR}' WHEN 1 THEN '{V.SUPPORTED}' WHEN 2 THEN '{V.STRONG}' ELSE 'unresolved' END AS label, CASE WHEN c_custkey % 5 = 0 AND s = 'high' THEN 'violated' ELSE 'held' END AS guardrail FROM customer CROSS JOIN (SELECT 'primary' AS s UNION ALL SELECT 'high' UNION ALL SELECT 'low') t"


@register("coverage_states", f"""WITH x AS ({_SC}), a AS (SELECT *, CASE WHEN label = '{V.INFERIOR}' THEN 'discard' WHEN latency = 'fast' AND label IN ('{V.SUPPORTED}', '{V.STRONG}') AND guardrail <> 'violated' THEN 'displace' ELSE 'frontier' END AS act FROM x),
g AS (SELECT comparison, count(DISTINCT label || guardrail) AS l, count(DISTINCT act) AS c, max(label) FILTER (scenario = 'primary') AS label FROM a GROUP BY comparison)
SELECT comparison, CASE WHEN l = 1 THEN 'coverage_robust' WHEN c = 1 THEN 'coverage_affected' ELSE 'not_evaluable' END AS state, CASE WHEN l > 1 AND c > 1 THEN 'not evaluable' ELSE label END AS label FROM g""")
def coverage_states(spark: SparkSession, sf: str) -> DataFrame:
    return V.coverage_state(made(spark, sf, _SC))


# Chunks are customers of one nation key modulo 20; references go from orders, definitions stand at every tenth customer.
_OWN = "SELECT concat('c', CAST(c_custkey % 20 AS STRING)) AS chunk_id, 'A' AS act, concat(CAST(c_nationkey AS STRING), '.', CAST(c_custkey AS STRING)) AS path FROM customer"
_DEF = "SELECT 'A' AS act, concat(CAST(c_nationkey AS STRING), '.', CAST(c_custkey AS STRING)) AS path, concat('t', CAST(c_custkey % 30 AS STRING)) AS term FROM customer WHERE c_custkey % 10 = 0"
_USE = "SELECT 'A' AS act, concat(CAST(c_nationkey AS STRING), '.', CAST(c_custkey AS STRING)) AS path, concat('t', CAST(c_custkey % 60 AS STRING)) AS term FROM customer"
_REF = "SELECT 'A' AS source_act, concat(CAST(x.c_nationkey AS STRING), '.', CAST(x.c_custkey AS STRING)) AS source_path, concat('ref ', CAST(x.c_custkey % 9 AS STRING)) AS text, 'A' AS act, CASE WHEN x.c_custkey % 4 = 0 THEN CAST(y.c_nationkey AS STRING) ELSE concat(CAST(y.c_nationkey AS STRING), '.', CAST(y.c_custkey AS STRING)) END AS resolved FROM (SELECT * FROM customer WHERE c_custkey % 10 IN (0, 3)) x JOIN (SELECT c_custkey * 3 AS triple, c_nationkey, c_custkey FROM customer) y ON y.triple = x.c_custkey"
_RELATED = f"""own AS ({_OWN}), def AS ({_DEF}), us AS ({_USE}), ref AS ({_REF}),
below AS (SELECT DISTINCT act, path, chunk_id AS target FROM own UNION SELECT DISTINCT act, split_part(path, '.', 1), chunk_id FROM own),
edge AS (SELECT source_act, source_path, text, r.act || ':' || resolved AS node, target FROM ref r JOIN below b ON b.act = r.act AND b.path = r.resolved),
used AS (SELECT DISTINCT o.chunk_id, u.act, d.path AS spot, u.term FROM us u JOIN def d ON d.act = u.act AND d.term = u.term AND d.path <> u.path JOIN own o ON o.act = u.act AND o.path = u.path),
related AS (SELECT chunk_id, 'reference' AS kind, text AS detail, node, target FROM own JOIN edge ON source_act = act AND source_path = path
 UNION SELECT u.chunk_id, 'definition', term, u.act || ':' || spot, o.chunk_id FROM used u JOIN own o ON o.act = u.act AND o.path = spot
 UNION SELECT u.chunk_id, 'definition_reference', term, node, target FROM used u JOIN edge ON source_act = u.act AND source_path = spot)"""
_RANKED = "SELECT query_id, concat('c', CAST(k AS STRING)) AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY first, k) AS rank FROM (SELECT o_custkey AS query_id, o_orderkey % 20 AS k, min(o_orderkey) AS first FROM orders GROUP BY o_custkey, o_orderkey % 20)"
_RUN = f"run AS ({_RANKED})"


def _related(spark: SparkSession, sf: str) -> DataFrame:
    return P.relations(made(spark, sf, _REF), made(spark, sf, _OWN), made(spark, sf, _DEF), made(spark, sf, _USE))


def _run(spark: SparkSession, sf: str) -> DataFrame:
    """A run of every customer: the chunks of their orders, the earliest first."""
    return made(spark, sf, _RANKED)


@register("chunk_relations", f"WITH {_RELATED} SELECT * FROM related")
def chunk_relations(spark: SparkSession, sf: str) -> DataFrame:
    return _related(spark, sf)


_FOUND = f"{_RELATED}, {_RUN}, found AS (SELECT query_id, doc_id AS anchor, rank AS anchor_rank, kind, detail, node, target AS candidate FROM run JOIN related ON chunk_id = doc_id WHERE rank <= 3 AND target <> doc_id)"


@register("anchor_relations", f"WITH {_FOUND} SELECT * FROM found")
def anchor_relations(spark: SparkSession, sf: str) -> DataFrame:
    return P.anchor_relations(_run(spark, sf), _related(spark, sf), 3).withColumn("anchor_rank", F.col("anchor_rank").cast("long"))


_TERMS = "terms AS (SELECT DISTINCT chunk_id, term FROM us JOIN own USING (act, path))"


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return made(spark, sf, _USE).join(made(spark, sf, _OWN), ["act", "path"]).select("chunk_id", "term").distinct()


@register("bridge_choice", f"""WITH {_FOUND}, {_TERMS}, t AS (SELECT query_id, term, min(rank) AS anchor_rank FROM run JOIN terms ON chunk_id = doc_id WHERE rank <= 3 GROUP BY ALL),
s AS (SELECT *, (substr(term, 2)::INT * 13 + query_id) % 7 AS score FROM t) SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, anchor_rank, term) AS rank FROM s QUALIFY rank <= 4""")
def bridge_choice(spark: SparkSession, sf: str) -> DataFrame:
    t = P.anchor_terms(_run(spark, sf), _terms(spark, sf), 3)
    similarity = t.select("query_id", "term", ((F.substring("term", 2, 9).cast("int") * 13 + F.col("query_id")) % 7).alias("score"))
    return P.choose_bridges(t, similarity, 4).withColumn("rank", F.col("rank").cast("long"))


@register("candidate_pairs", f"""WITH {_FOUND}, {_TERMS}, hits AS (SELECT query_id, 't' || (query_id % 60) AS term, 'c' || (query_id % 20) AS candidate FROM (SELECT DISTINCT query_id FROM run)),
l AS (SELECT query_id, anchor, anchor_rank, candidate, kind || ': ' || detail AS link FROM found UNION SELECT r.query_id, r.doc_id, r.rank, h.candidate, 'bridge: ' || h.term FROM run r JOIN terms t ON t.chunk_id = r.doc_id JOIN hits h ON h.query_id = r.query_id AND h.term = t.term WHERE r.rank <= 3 AND h.candidate <> r.doc_id)
SELECT query_id, anchor, anchor_rank, candidate, array_to_string(list_sort(list(DISTINCT link)), ' | ') AS links FROM l WHERE (query_id, candidate) NOT IN (SELECT (query_id, doc_id) FROM run WHERE rank <= 5) GROUP BY ALL""")
def candidate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    run = _run(spark, sf)
    hits = run.select("query_id").distinct().select("query_id", F.concat(F.lit("t"), F.col("query_id") % 60).alias("term"), F.concat(F.lit("c"), F.col("query_id") % 20).alias("candidate"))
    out = P.population(run, _related(spark, sf), hits, _terms(spark, sf), 3, 5)
    return out.select("query_id", "anchor", F.col("anchor_rank").cast("long").alias("anchor_rank"), "candidate", F.array_join("links", " | ").alias("links"))


@register("expanded_population", f"""WITH {_FOUND}, asked AS (SELECT query_id, 't0' AS term, 'c' || (query_id % 20) AS chunk_id FROM (SELECT DISTINCT query_id FROM run)),
step AS (SELECT DISTINCT chunk_id AS source, target AS chunk_id, kind FROM related WHERE kind <> 'definition_reference' AND chunk_id <> target),
one AS (SELECT query_id, candidate AS chunk_id, CASE kind WHEN 'definition_reference' THEN 2 ELSE 1 END AS hop, anchor AS source, kind FROM found UNION SELECT query_id, chunk_id, 1, 'question', 'question_term' FROM asked),
r AS (SELECT query_id, doc_id AS chunk_id, 0 AS hop, 'question' AS source, 'retrieved' AS kind FROM run WHERE rank <= 6 UNION SELECT * FROM one UNION SELECT s.query_id, step.chunk_id, 2, step.source, step.kind FROM (SELECT DISTINCT query_id, chunk_id FROM one WHERE hop = 1) s JOIN step ON step.source = s.chunk_id),
n AS (SELECT query_id, chunk_id AS source, min(hop) AS h FROM r GROUP BY ALL HAVING min(hop) < 2), e AS (SELECT * FROM r UNION SELECT n.query_id, step.chunk_id, h + 1, n.source, 'definition' FROM n JOIN step ON step.source = n.source AND step.kind = 'definition')
SELECT query_id, chunk_id, min(hop) AS hop, string_agg(hop || ' ' || source || ' ' || kind, ' | ' ORDER BY hop, source <> 'question', source, kind) AS routes FROM e GROUP BY query_id, chunk_id""")
def expanded_population(spark: SparkSession, sf: str) -> DataFrame:
    run, related = _run(spark, sf), P.steps(_related(spark, sf))
    asked = run.select("query_id").distinct().select("query_id", F.lit("t0").alias("term"), F.concat(F.lit("c"), F.col("query_id") % 20).alias("chunk_id"))
    out = P.expanded(run, P.anchor_relations(run, related, 3), asked, related, 6)
    return out.select("query_id", "chunk_id", "hop", F.array_join("routes", " | ").alias("routes"))


_CH = "SELECT concat('k', CAST(c_custkey AS STRING)) AS chunk_id, c_nationkey AS article, c_mktsegment AS own, concat(CASE WHEN c_custkey % 3 = 0 THEN 'HOUSEHOLD and ' ELSE '' END, c_name, ' ', CASE WHEN c_custkey % 2 = 0 THEN 'BUILDING' ELSE '' END) AS context FROM customer"


@register("visible_chunks", f"WITH c AS ({_CH}) SELECT a.chunk_id, b.chunk_id AS holder FROM c a JOIN c b ON a.article = b.article AND a.chunk_id <> b.chunk_id AND contains(b.context, a.own) WHERE a.own <> ''")
def visible_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return P.visible(made(spark, sf, _CH))


# Statements are orders: pairs are those of one customer, articles hold six orders each.
_PAIRS = "SELECT x.o_orderkey AS a, y.o_orderkey AS b, CAST((x.o_orderkey + y.o_orderkey) % 17 AS DOUBLE) / 20 AS jaccard FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey WHERE x.o_orderkey <> y.o_orderkey"
_ITEMS = "SELECT o_orderkey AS item, (o_orderkey * 7919) % 2147483647 AS rank FROM orders"
_ARTS = "SELECT o_orderkey AS item, CAST(floor(o_orderkey / 6) AS BIGINT) AS article FROM orders"


@register("statement_neighbourhoods", f"""WITH p AS ({_PAIRS}), i AS ({_ITEMS}), a AS ({_ARTS}),
n AS (SELECT a AS item, b AS other, jaccard, row_number() OVER (PARTITION BY a ORDER BY jaccard DESC, b) AS p FROM p JOIN i x ON x.item = p.a JOIN i y ON y.item = p.b WHERE y.rank < x.rank),
s AS (SELECT DISTINCT x.item, y.item AS other FROM a x JOIN a y ON x.article = y.article AND x.item <> y.item JOIN i u ON u.item = x.item JOIN i v ON v.item = y.item WHERE v.rank < u.rank),
b AS (SELECT coalesce(n.item, s.item) AS item, coalesce(n.other, s.other) AS other, coalesce(jaccard, 0) AS j, p, s.item IS NOT NULL OR coalesce(jaccard >= 0.5, FALSE) AS mandatory FROM n FULL JOIN s ON s.item = n.item AND s.other = n.other)
SELECT item, other, mandatory, row_number() OVER (PARTITION BY item ORDER BY NOT mandatory, j DESC, other) AS place FROM b WHERE mandatory OR p <= 3""")
def statement_neighbourhoods(spark: SparkSession, sf: str) -> DataFrame:
    return P.neighbourhoods(made(spark, sf, _ITEMS), made(spark, sf, _PAIRS), made(spark, sf, _ARTS), 3).withColumn("place", F.col("place").cast("long"))


@register("stage_latency", "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type")
def stage_latency(spark: SparkSession, sf: str) -> DataFrame:
    return D.latency(made(spark, sf, "SELECT * FROM events"), ["event_type"], "value")


@register("position_shifts", f"""WITH {_OVERLAP}, {_OTHER}, x AS (SELECT query_id, doc_id, rank AS x FROM overlap WHERE rank <= 10), y AS (SELECT query_id, doc_id, rank AS y FROM other WHERE rank <= 10)
SELECT query_id, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS shared, count(*) FILTER (x = y) AS same_places, max(abs(x - y)) AS most_moved FROM x FULL JOIN y USING (query_id, doc_id) GROUP BY query_id""")
def position_shifts(spark: SparkSession, sf: str) -> DataFrame:
    return D.position_shifts(overlap_run(spark, sf), _other(spark, sf)).withColumn("most_moved", F.col("most_moved").cast("long"))

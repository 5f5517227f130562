"""Structure, curation, constraints and event-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.catalog import register
from stratiform.functions import text as T
from stratiform.operators import curation as Q
from stratiform.operators import evidence as E
from stratiform.operators import structure as S
from stratiform.operators.closest import closest
from stratiform.plans.judging import made
from stratiform.shipping import ship


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_PATHS = """n AS (SELECT DISTINCT (c_nationkey || '.' || (c_custkey % 7) || '.' || c_custkey) AS path, (c_custkey % 50 + 1) AS tokens FROM customer),
cl AS (SELECT path, tokens, array_to_string(string_split(path, '.')[1:i], '.') AS ancestor, i AS depth FROM n, (SELECT unnest([1, 2, 3]) AS i))"""


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer")
    return c.select(F.concat_ws(".", "c_nationkey", F.col("c_custkey") % 7, "c_custkey").alias("path"), (F.col("c_custkey") % 50 + 1).alias("tokens")).distinct()


@register("path_closure", f"WITH {_PATHS} SELECT ancestor, count(*) AS nodes, sum(tokens)::BIGINT AS tokens FROM cl GROUP BY ancestor")
def path_closure(spark: SparkSession, sf: str) -> DataFrame:
    return S.closure(_nodes(spark, sf)).groupBy("ancestor").agg(F.count("*").alias("nodes"), F.sum("tokens").alias("tokens"))


@register("budget_chunks", f"""WITH {_PATHS}, t AS (SELECT ancestor, sum(tokens) AS total FROM cl GROUP BY ancestor),
f AS (SELECT path, arg_min(ancestor, depth) AS root FROM cl JOIN t USING (ancestor) WHERE total <= 600 GROUP BY path)
SELECT path, coalesce(root, path) AS chunk, root IS NULL AS own_only FROM n LEFT JOIN f USING (path)""")
def budget_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return S.budget_chunks(_nodes(spark, sf), 600)


@register("nearest_ancestor", """WITH n AS (SELECT DISTINCT (c_nationkey || '.' || (c_custkey % 7)) AS path FROM customer WHERE c_custkey % 3 = 0 UNION SELECT DISTINCT c_nationkey::VARCHAR FROM customer WHERE c_nationkey % 2 = 0),
r AS (SELECT DISTINCT (c_nationkey || '.' || (c_custkey % 7) || '.' || c_custkey) AS ref FROM customer),
h AS (SELECT ref, arg_max(path, i) AS resolved FROM (SELECT ref, i, array_to_string(string_split(ref, '.')[1:i], '.') AS path FROM r, (SELECT unnest([1, 2, 3]) AS i)) JOIN n USING (path) GROUP BY ref)
SELECT ref, resolved FROM r LEFT JOIN h USING (ref)""")
def nearest_ancestor(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer")
    nodes = c.filter("c_custkey % 3 = 0").select(F.concat_ws(".", "c_nationkey", F.col("c_custkey") % 7).alias("path")).union(c.filter("c_nationkey % 2 = 0").select(F.col("c_nationkey").cast("string"))).distinct()
    return S.nearest_existing(_nodes(spark, sf).select(F.col("path").alias("ref")), nodes, "ref")


@register("line_spans", """SELECT conv_id, turn, (e - length(text))::BIGINT AS start, e::BIGINT AS "end" FROM (SELECT conv_id, turn, coalesce(text, '') AS text, sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS e FROM conversations)""")
def line_spans(spark: SparkSession, sf: str) -> DataFrame:
    return S.spans(_t(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "start", "end")


@register("text_pages", r"""WITH RECURSIVE lines AS (SELECT conv_id, turn AS k, regexp_replace(coalesce(text, ''), '[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]', ' ', 'g') || chr(10) AS line FROM conversations),
pieces AS (SELECT conv_id, k, j, (length(line) - 1) // 400 AS last, substr(line, 1 + 400 * j, 400) AS piece FROM (SELECT *, unnest(range((length(line) - 1) // 400 + 1)) AS j FROM lines)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k, j) AS p FROM pieces),
w AS (SELECT conv_id, p, piece, length(piece) AS used, 0 AS page, j < last AS closed FROM o WHERE p = 1
 UNION ALL SELECT conv_id, p, piece, CASE WHEN new THEN n ELSE before + n END, page + new::INT, closed
  FROM (SELECT o.conv_id, o.p, o.piece, length(o.piece) AS n, w.used AS before, w.page, o.j < o.last AS closed, w.closed OR (o.j = 0 AND o.last > 0) OR w.used + length(o.piece) > 400 AS new FROM w JOIN o ON o.conv_id = w.conv_id AND o.p = w.p + 1))
SELECT conv_id, page::BIGINT AS page, string_agg(piece, '' ORDER BY p) AS text FROM w GROUP BY conv_id, page""")
def text_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations in pages of 400 characters at most, a turn being a line."""
    ship(spark)
    line = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]", " "), F.lit("\n"))
    turns = _t(spark, sf, "conversations").select("conv_id", "turn", line.alias("x"))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "x"))), lambda t: t["x"]), "").alias("text"))
    return S.pages(whole, "conv_id", "text", 400).select("conv_id", F.col("page").cast("long").alias("page"), "text")


@register("amended_rows", """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 < 8), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 5 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 10 > 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'amended' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s IS DISTINCT FROM b.s""")
def amended_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return S.changed(o.filter("k % 10 < 8"), o.filter("k % 10 > 1").withColumn("s", F.when(F.col("k") % 10 == 5, "X").otherwise(F.col("s"))), "k", "s")


_OLD = "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 < 9 OR o_orderkey % 1000 = 9"
_NEW = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 5 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 500 <> 3"
_MARKS = "SELECT o_orderkey AS k, concat('M', CAST(o_orderkey % 3 AS STRING)) AS act FROM orders WHERE (o_orderkey % 10 IN (5, 9) AND o_orderkey % 70 <> 5) OR o_orderkey % 300 = 2 UNION ALL SELECT o_orderkey, 'M9' FROM orders WHERE o_orderkey % 20 = 5 AND o_orderkey % 70 <> 5"


@register("explained_changes", f"""WITH a AS ({_OLD}), b AS ({_NEW}), m AS (SELECT k, list_sort(list(DISTINCT act)) AS acts FROM ({_MARKS.replace("STRING", "VARCHAR")}) GROUP BY k),
c AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'amended' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s <> b.s)
SELECT coalesce(c.k, m.k) AS k, CASE WHEN change = 'removed' THEN 'problem: removed' WHEN acts IS NULL THEN 'problem: unexplained' WHEN change IS NULL THEN 'problem: silent' ELSE change || ' by ' || array_to_string(acts, ' ') END AS finding FROM c FULL JOIN m ON m.k = c.k""")
def explained_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of the orders against the markers of the later one, both ways."""
    changes, problems = S.explained(made(spark, sf, _OLD), made(spark, sf, _NEW), made(spark, sf, _MARKS), "k", "s")
    said = changes.select("k", F.concat_ws(" by ", "change", F.array_join("acts", " ")).alias("finding"))
    return said.unionByName(problems.select("k", F.concat(F.lit("problem: "), "problem").alias("finding")))


_POOLED = "SELECT CASE CAST(l_suppkey % 3 AS INT) WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS contributor, l_orderkey AS query_id, l_partkey AS doc_id, min(l_linenumber) AS rank FROM lineitem GROUP BY l_suppkey % 3, l_orderkey, l_partkey"
_ASKED = "SELECT o_orderkey AS query_id, o_custkey AS need_id FROM orders"
_ANCHORED = "SELECT c_custkey AS need_id, c_custkey * 3 + 1 AS doc_id FROM customer"


@register("pools_of_needs", f"""WITH r AS ({_POOLED}), q AS ({_ASKED}), f AS (SELECT need_id, doc_id, contributor, query_id, rank FROM r JOIN q USING (query_id) WHERE rank <= CASE contributor WHEN 'a' THEN 4 WHEN 'b' THEN 2 END
 UNION SELECT need_id, doc_id, 'anchor', NULL, 0 FROM ({_ANCHORED}))
SELECT need_id, doc_id, string_agg(contributor || ':' || coalesce(query_id::VARCHAR, '') || ':' || rank, ' ' ORDER BY contributor, query_id, rank) AS sources FROM f GROUP BY ALL""")
def pools_of_needs(spark: SparkSession, sf: str) -> DataFrame:
    """Pools of customers as needs: two contributors of their own depths, and an anchor each, with provenance."""
    pooled = Q.pool_of_needs(made(spark, sf, _POOLED), made(spark, sf, _ASKED), {"a": 4, "b": 2}, made(spark, sf, _ANCHORED))
    named = F.transform("sources", lambda x: F.concat_ws(":", x["contributor"], F.coalesce(x["query_id"].cast("string"), F.lit("")), x["rank"].cast("string")))
    return pooled.select("need_id", "doc_id", F.array_join(named, " ").alias("sources"))


@register("figures", r"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '([0-9]{1,3}(?:[\x{00a0}\x{202f} ][0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?)', 1)) AS x FROM documents),
c AS (SELECT DISTINCT doc_id, replace(regexp_replace(x, '[\x{00a0}\x{202f} ]', '', 'g'), ',', '.') AS x FROM f)
SELECT doc_id, string_agg(x, ' ' ORDER BY x) AS figures, count(*) AS n FROM c GROUP BY doc_id""")
def figures(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", T.figures(F.col("text")).alias("f")).filter(F.size("f") > 0).select("doc_id", F.array_join("f", " ").alias("figures"), F.size("f").cast("long").alias("n"))


@register("text_search", r"""WITH h AS (SELECT doc_id, text, lower(text) AS low, unnest(range(1, length(text) + 1)) AS pos FROM documents WHERE regexp_matches(text, '(?i)licen[cs]e')),
m AS (SELECT doc_id, text, pos FROM h WHERE substr(low, pos, 7) IN ('license', 'licence'))
SELECT doc_id, pos, substr(text, greatest(1, pos - 90), least(pos - 1, 90) + 110) AS snippet, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM m""")
def text_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every place of a pattern in every text, with what stands 90 characters before and 110 from it on."""
    ship(spark)
    return E.search(_t(spark, sf, "documents"), "doc_id", "text", "licen[cs]e")


@register("item_overlap", f"""WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z]+)', 1), lambda x: length(x) > 2 AND x NOT IN ({", ".join(f"'{w}'" for w in T.STOP_WORDS)}))) AS w FROM benchmark),
j AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS u FROM w a, w b WHERE a.item_id <> b.item_id)
SELECT a, b, round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 6) AS jaccard, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 9) DESC, b) AS rank FROM j) WHERE rank <= 3""")
def item_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """The three closest statements of every benchmark item."""
    w = _t(spark, sf, "benchmark").select("item_id", T.content_words(F.col("text")).alias("w"))
    return closest(w, "item_id", "w").select("a", "b", F.round("jaccard", 6).alias("jaccard"), F.col("rank").cast("long").alias("rank"))


@register("closest_parts", """WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name || ' ' || lower(p_type), ' ')) AS w FROM part),
j AS (SELECT a.p_partkey AS a, b.p_partkey AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS s FROM w a, w b WHERE a.p_partkey <> b.p_partkey)
SELECT a, b, round(i / (s - i), 9) AS jaccard, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(i / (s - i), 9) DESC, b) AS rank FROM j) WHERE rank <= 5""")
def closest_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The five closest parts of every part by the words of name and type, many of which very many parts share."""
    w = _t(spark, sf, "part").select("p_partkey", F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ").alias("w"))
    return closest(w, "p_partkey", "w", 5).select("a", "b", "jaccard", F.col("rank").cast("long").alias("rank"))


@register("hash_split", """WITH h AS (SELECT c_custkey, sha256('split' || c_custkey) AS h FROM customer)
SELECT c_custkey, list_reduce([('0x' || substr(h, 1 + 8 * i, 8))::BIGINT FOR i IN range(8)], lambda r, x: (r % 100 * 96 + x) % 100) % 100 < 15 AS validation FROM h""")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return Q.split(_t(spark, sf, "customer").select("c_custkey"), "c_custkey", "split")


@register("round_robin_sample", """SELECT c_custkey, c_nationkey, turn FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('s' || c_custkey), c_custkey) AS turn FROM customer) ORDER BY turn, sha256('s' || c_custkey), c_custkey LIMIT 60""")
def round_robin_sample(spark: SparkSession, sf: str) -> DataFrame:
    return Q.stratified_round_robin(_t(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", "s", 60).withColumn("turn", F.col("turn").cast("long"))


@register("adjudication", """WITH j AS (SELECT l_orderkey, l_linenumber, l_partkey % 4 AS g1, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 4 END AS g2, CASE WHEN l_orderkey % 2 = 0 THEN (l_partkey + l_suppkey) % 4 END AS g3 FROM lineitem),
o AS (SELECT *, CASE WHEN g2 IS NULL THEN 'single' WHEN g1 = g2 THEN 'agreed' WHEN g3 IS NULL THEN 'open' ELSE 'decided' END AS outcome FROM j)
SELECT outcome, CASE WHEN outcome IN ('single', 'agreed') THEN g1 ELSE g3 END AS grade, count(*) AS n FROM o GROUP BY ALL""")
def adjudication(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_quantity"))
    first = rows.select("id", (F.col("l_partkey") % 4).alias("grade"))
    second = rows.filter("l_suppkey % 3 > 0").select("id", (F.col("l_suppkey") % 4).alias("grade"))
    third = rows.filter("l_orderkey % 2 = 0").select("id", ((F.col("l_partkey") + F.col("l_suppkey")) % 4).alias("grade"))
    return Q.adjudicated(first, second, third, ["id"]).groupBy("outcome", "grade").agg(F.count("*").alias("n"))


@register("dataset_rules", """SELECT 'duplicate text' AS rule, md5(coalesce(text, '')) AS key, count(*) AS n FROM documents GROUP BY coalesce(text, '') HAVING count(*) > 1
UNION ALL SELECT 'label without document', doc_id::VARCHAR, count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0) GROUP BY doc_id""")
def dataset_rules(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    copies = Q.duplicate_keys(d.select(F.md5(F.coalesce("text", F.lit(""))).alias("k")), ["k"], "duplicate text")
    return copies.unionByName(Q.orphans(_t(spark, sf, "labels"), "doc_id", d.filter("doc_id % 5 <> 0"), "doc_id", "label without document"))


@register("event_fold", "SELECT user_id, arg_max(event_type, event_id) AS state, count(*) AS events FROM events GROUP BY user_id")
def event_fold(spark: SparkSession, sf: str) -> DataFrame:
    return Q.folded(_t(spark, sf, "events"), "user_id", "event_id", "event_type")


@register("event_chain", """WITH RECURSIVE o AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
c AS (SELECT user_id, k, event_id, '' AS previous, sha256(chr(9) || event_id || chr(9) || event_type) AS own FROM o WHERE k = 1
 UNION ALL SELECT o.user_id, o.k, o.event_id, c.own, sha256(c.own || chr(9) || o.event_id || chr(9) || o.event_type) FROM c JOIN o ON o.user_id = c.user_id AND o.k = c.k + 1)
SELECT event_id, own, previous FROM c""")
def event_chain(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return Q.chain(_t(spark, sf, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", ["event_id", "event_type"]).select("event_id", "own", "previous")


@register("divergent_keys", "SELECT user_id, count(DISTINCT event_type) AS payloads FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def divergent_keys(spark: SparkSession, sf: str) -> DataFrame:
    return Q.divergent(_t(spark, sf, "events"), "user_id", "event_type")


@register("rate_limit", """WITH r AS (SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS t, user_id FROM events),
w AS (SELECT event_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS since, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent FROM r)
SELECT sum((since < 600)::INT)::BIGINT AS soon, sum((recent > 3)::INT)::BIGINT AS crowded, count(*) AS n FROM w WHERE since < 600 OR recent > 3""")
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return Q.waits(_t(spark, sf, "events"), "user_id", "ts", 600, 3, 86400).agg(F.sum((F.col("since") < 600).cast("int")).alias("soon"), F.sum((F.col("recent") > 3).cast("int")).alias("crowded"), F.count("*").alias("n"))


@register("backoff_episodes", """WITH r AS (SELECT user_id, event_id, ts, epoch(date_trunc('second', ts))::BIGINT AS t FROM events), n AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER w, 43201) > 43200 THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS episode FROM n)
SELECT user_id, episode::BIGINT AS episode, count(*) AS n, least(30 * pow(2.0, count(*) - 1), 900.0) AS wait_s FROM e GROUP BY ALL""")
def backoff_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return Q.episodes(_t(spark, sf, "events"), "user_id", "ts", 43200, 30, 900)


@register("clean_html", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages""")
def clean_html(spark: SparkSession, sf: str) -> DataFrame:
    """The plain cleaning path: tags out, spaces collapsed."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return _t(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace(body, r"[ \t\n\r]+", " ")).alias("text"))

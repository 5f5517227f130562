"""Queries over text as a statute reader sees it: stems, normal form, references, clauses, defined terms, copied runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratiform.catalog import register
from stratiform.functions import legal as L
from stratiform.functions import stem
from stratiform.functions import text as T
from stratiform.operators import evidence as E
from stratiform.operators import hierarchy as H
from stratiform.plans import porter_sql
from stratiform.shipping import ship


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


@register("stemmed_terms", rf"""WITH w AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '([\p{{L}}\p{{N}}]+)', 1)) AS term FROM documents UNION ALL SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '([\p{{L}}\p{{N}}]+)', 1)) FROM benchmark),
{porter_sql.stems("w")} SELECT term AS word, stem, count(*) AS n FROM w JOIN stems USING (term) GROUP BY ALL""")
def stemmed_terms(spark: SparkSession, sf: str) -> DataFrame:
    words = lambda t: _t(spark, sf, t).select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("word"))
    counted = words("documents").unionByName(words("benchmark")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.select("word", F.get(stem.porter_stems(F.array("word")), F.lit(0)).alias("stem"), "n")


@register("italian_stems")
def italian_stems(spark: SparkSession, sf: str) -> DataFrame:
    words = _t(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-zàèéìòù]+)"), 1)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).select("word", F.get(stem.italian_stems(F.array("word")), F.lit(0)).alias("stem"), "n")


@register("normal_text")
def normal_text(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", L.normalized("text").alias("text"))


_SAID = "o AS (SELECT o_orderkey AS k, o_orderkey % 6 AS f, (o_custkey % 40 + 1)::VARCHAR AS a, (o_orderkey % 9 + 1)::VARCHAR AS p FROM orders)"


@register("act_references", f"""WITH {_SAID}, r AS (
SELECT k, 12 AS start, 'points (d), (f) and (k) of Article ' || a || '(' || p || ')' AS phrase, 'points_of_article' AS form, 'A' AS act, a || '.' || p || '.' || x AS path, NULL AS skipped, 'condition' AS cue FROM o, (SELECT unnest(['d', 'f', 'k']) AS x) WHERE f = 0
UNION ALL SELECT k, 7, 'paragraphs ' || p || ' and 12 of Article ' || a || ' of that Regulation', 'paragraphs_of_article', NULL, NULL, 'anaphora', 'exception' FROM o WHERE f = 1
UNION ALL SELECT k, 0, 'Articles ' || a || ' to 43', 'articles', 'A', x::VARCHAR, NULL, NULL FROM o, range(1, 44) t(x) WHERE f = 2 AND x >= a::INT
UNION ALL SELECT k, 4, 'Article ' || a || '(' || p || ') and (10) of Directive 2015/2366', 'article', 'B', a || '.' || x, NULL, NULL FROM (SELECT *, unnest([p, '10']) AS x FROM o WHERE f = 3)
UNION ALL SELECT k, 0, 'point (b) of paragraph ' || p, 'points_of_paragraph', 'A', a || '.' || p || '.b', NULL, NULL FROM o WHERE f = 4
UNION ALL SELECT k, 11, 'paragraph ' || p, 'paragraphs', 'A', a || '.' || p, NULL, 'condition' FROM o WHERE f = 5
UNION ALL SELECT k, 11 + length('paragraph ' || p || ' and '), 'Article ' || a || ' of Regulation (EU) No 1093/2010', 'article', NULL, NULL, 'outside_the_corpus', 'condition' FROM o WHERE f = 5) SELECT * FROM r""")
def act_references(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-references of sentences made from order keys, in every form, each resolved to a path or skipped."""
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 40 + 1).cast("string").alias("a"), (F.col("o_orderkey") % 9 + 1).cast("string").alias("p"))
    form = F.element_at(
        F.array(
            F.concat(F.lit("pursuant to points (d), (f) and (k) of Article "), "a", F.lit("("), "p", F.lit(")")),
            F.concat(F.lit("except paragraphs "), "p", F.lit(" and 12 of Article "), "a", F.lit(" of that Regulation")),
            F.concat(F.lit("Articles "), "a", F.lit(" to 43 apply")),
            F.concat(F.lit("see Article "), "a", F.lit("("), "p", F.lit(") and (10) of Directive 2015/2366")),
            F.concat(F.lit("point (b) of paragraph "), "p"),
            F.concat(F.lit("subject to paragraph "), "p", F.lit(" and Article "), "a", F.lit(" of Regulation (EU) No 1093/2010")),
        ),
        (F.col("k") % 6 + 1).cast("int"),
    )
    nodes = o.select("k", F.lit("A").alias("act"), F.concat("a", F.lit("."), "p").alias("path"), form.alias("text"))
    found = nodes.select("k", "text", F.explode(L.references({"Directive 2015/2366": "B"})("act", "path", "text")).alias("r"))
    return found.select("k", "r.*", L.cue(F.col("text"), F.col("r.start"), F.lit(0)).alias("cue"))


@register("clause_texts", r"""WITH p AS (SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '(?s).*?[.;:]\s+|.+$') AS x FROM documents WHERE regexp_matches(text, '(?i)licen[cs]e|token'))),
l AS (SELECT doc_id, piece, (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(piece))::INT AS low FROM p),
m AS (SELECT doc_id, low, piece, unnest(range(1, length(piece) + 1)) AS i FROM l WHERE regexp_matches(piece, '(?i)licen[cs]e|token'))
SELECT doc_id, (low + i - 1)::INT AS "at", low, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS clause FROM m WHERE substr(lower(piece), i, 7) IN ('license', 'licence') OR substr(lower(piece), i, 5) = 'token'""")
def clause_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The whole clause around every mention of two words in every text."""
    d = _t(spark, sf, "documents").filter(F.col("text").rlike("(?i)licen[cs]e|token"))
    return d.select("doc_id", F.explode(L.clauses("licen[cs]e|token", 1 << 30)("text")).alias("c")).select("doc_id", "c.*")


@register("defined_terms", r"""WITH n AS (SELECT n_nationkey AS k, n_name AS a, n_regionkey AS r FROM nation),
t AS (SELECT k, unnest([lower(a), 'region ' || r]) AS term FROM n WHERE k % 3 > 0) SELECT k, term FROM t""")
def defined_terms(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("a"), F.col("n_regionkey").cast("string").alias("r"))
    text = F.concat(F.lit("'"), "a", F.lit("' or 'region "), "r", F.when(F.col("k") % 3 > 0, "' means any 'other' place").otherwise("' is a place"))
    return n.select("k", F.explode(L.defined_terms(text)).alias("term"))


_TERMS = r"""t AS (SELECT DISTINCT item_id % 3 AS act, unnest(regexp_extract_all(lower(text), '([a-z]{9,})', 1)) AS term FROM benchmark),
f AS (SELECT act, term, unnest(CASE WHEN regexp_matches(term, '[^aeou]y$') THEN [term, term[:-2] || 'ies'] ELSE [term, term || 's', term || 'es'] END) AS form FROM t),
w AS (SELECT DISTINCT doc_id, doc_id % 3 AS act, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}_-]+)', 1)) AS form FROM documents)"""


@register("term_uses", f"""WITH {_TERMS} SELECT DISTINCT doc_id, term FROM w JOIN f USING (act, form)""")
def term_uses(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of a glossary (the long words of every item) in the whole texts of the same act."""
    terms = _t(spark, sf, "benchmark").select((F.col("item_id") % 3).alias("act"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{9,})"), 1)).alias("term")).distinct()
    nodes = _t(spark, sf, "documents").select((F.col("doc_id") % 3).alias("act"), "doc_id", "text")
    return E.word_uses(nodes, terms, "act", "doc_id", "text").select("doc_id", "term")


_TURNS = "SELECT conv_id, turn, coalesce(text, '') AS q, coalesce(lead(text) OVER w, '') AS body, coalesce(lag(text) OVER w, '') AS ctx FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"
_LIST = "regexp_extract_all(lower({}), '([a-z0-9]+)', 1)"


@register("question_rejections", rf"""WITH t AS ({_TURNS}), w AS (SELECT *, {_LIST.format("q")} AS qw, {_LIST.format("ctx || ' ' || body")} AS tw, {_LIST.format("body")} AS bw, {_LIST.format("ctx")} AS cw FROM t),
g AS (SELECT *, [array_to_string(qw[i:i + 7], ' ') FOR i IN range(1, len(qw) - 6)] AS qg, [array_to_string(tw[i:i + 7], ' ') FOR i IN range(1, len(tw) - 6)] AS tg,
 list_filter(list_distinct(qw), lambda x: length(x) >= 4 AND x NOT IN ('that', 'this', 'with', 'from')) AS content FROM w)
SELECT conv_id, turn, CASE WHEN regexp_matches(q, '(?i)\bArt(?:icles?|\.)\s*\d|\bparagraphs?\s+\d|\bpoints?\s+\(|\(\d+[a-z]?\)|\b[A-Z]{{3,5}}:\d') THEN 'a reference'
 WHEN list_has_any(qg, tg) THEN 'a copied run' WHEN len(list_intersect(content, list_filter(cw, lambda x: NOT list_contains(bw, x)))) > len(list_intersect(content, bw)) THEN 'leans on the inherited context' END AS reason FROM g""")
def question_rejections(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn, as a question, against the turns around it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    e = lambda c: F.coalesce(c, F.lit(""))
    t = _t(spark, sf, "conversations").select("conv_id", "turn", e(F.col("text")).alias("q"), e(F.lead("text").over(w)).alias("body"), e(F.lag("text").over(w)).alias("ctx"))
    return t.select("conv_id", "turn", L.rejection(F.concat("q", F.lit("?")), F.col("ctx"), F.col("body"), ["that", "this", "with", "from"]).alias("reason"))


@register("longest_runs", """WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
a AS (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1) AS w FROM t)),
b AS (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(nxt, '')), '([a-z0-9]+)', 1) AS w FROM t)),
d AS (SELECT conv_id, turn, i - j AS diagonal, i - row_number() OVER (PARTITION BY conv_id, turn, i - j ORDER BY i) AS island FROM a JOIN b USING (conv_id, turn, word)),
r AS (SELECT conv_id, turn, max(n) AS run FROM (SELECT conv_id, turn, count(*) AS n FROM d GROUP BY conv_id, turn, diagonal, island) GROUP BY ALL)
SELECT conv_id, turn, coalesce(run, 0)::INT AS run FROM t LEFT JOIN r USING (conv_id, turn)""")
def longest_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Longest run of words that every turn shares with the next one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _t(spark, sf, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("next"))
    return t.select("conv_id", "turn", L.longest_run("text", "next").alias("run"))


@register("turn_containment", """WITH t AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS x FROM conversations),
c AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY conv_id ORDER BY turn), '') || ' ' || x AS y FROM t)
SELECT a.conv_id, a.turn, b.turn AS other FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND contains(b.y, a.x) WHERE a.x <> ''""")
def turn_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Turns whose whole text stands in what another turn of the conversation has before it or says; a conversation bounds the join."""
    t = _t(spark, sf, "conversations").select("conv_id", "turn", T.collapsed(F.coalesce("text", F.lit(""))).alias("x"))
    before = F.coalesce(F.lag("x").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    o = t.select("conv_id", F.col("turn").alias("other"), F.concat(before, F.lit(" "), "x").alias("y"))
    return t.filter("x <> ''").join(o, "conv_id").filter((F.col("turn") != F.col("other")) & F.col("y").contains(F.col("x"))).select("conv_id", "turn", "other")


_WORDSETS = "s AS (SELECT item_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1))) AS s FROM benchmark), c AS (SELECT DISTINCT s FROM s WHERE len(s) > 0)"


@register("similar_items", f"""WITH {_WORDSETS}, p AS (SELECT array_to_string(a.s, chr(31)) AS x, array_to_string(b.s, chr(31)) AS y, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS u FROM c a, c b)
SELECT md5(x) AS a, md5(y) AS b, round(i / u, 6) AS jaccard FROM p WHERE md5(x) < md5(y) AND 100 * i >= 12 * u""")
def similar_items(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of benchmark items by class of their word sets, at 0.12 or more."""
    d = _t(spark, sf, "benchmark").select("item_id", T.ascii_words(F.col("text")).alias("w"))
    return E.similar_pairs(d, "item_id", "w", 12)


@register("json_replies", """SELECT event_id, json_extract_string('{"a": ' || props || '}', '$.a.k')::BIGINT AS k FROM events""")
def json_replies(spark: SparkSession, sf: str) -> DataFrame:
    """The object inside a noisy reply, then a field of it."""
    e = _t(spark, sf, "events").withColumn("reply", F.concat(F.lit("Sure. "), "props", F.lit(" Anything else?")))
    return e.select("event_id", F.get_json_object(L.json_in(F.col("reply")), "$.k").cast("long").alias("k"))


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows over all tasks, before pages are made of them: a file of a few megabytes is one task, however many pages it stands for."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@register("statute_nodes", """WITH c AS (SELECT c_custkey AS k, c_name AS n, c_nationkey::VARCHAR AS p, c_mktsegment AS s FROM customer)
SELECT k, k::VARCHAR AS path, 1 AS level, 'articulo' AS kind, '' AS own_text FROM c
UNION ALL SELECT k, k || '.1', 2, 'apartado', n || ' shall pay:' FROM c UNION ALL SELECT k, k || '.1.a', 3, 'punto', p FROM c
UNION ALL SELECT k, k || '.1.sub_2', 3, 'subparagraph', 'By ' || s || '.' FROM c""")
def statute_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A small article in the journal's layout for every customer."""
    c = _dealt(_t(spark, sf, "customer")).select("c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("p"), "c_mktsegment")
    page = F.format_string(
        '<html xmlns="http://www.w3.org/1999/xhtml"><body><div class="eli-subdivision" id="art_%s"><p class="oj-ti-art">Article</p><div id="001.001"><p class="oj-normal">1.   %s shall pay:</p>'
        '<table><tr><td>(a)</td><td><p class="oj-normal">%s</p></td></tr></table><p class="oj-normal">By %s <sup>1</sup>.</p></div></div></body></html>',
        F.col("c_custkey").cast("string"), "c_name", "p", "c_mktsegment",
    )
    return H.nodes(c.select(F.col("c_custkey").alias("k"), page.alias("x")), "k", "x", "journal").select("k", "path", "level", "kind", "own_text")


_NORM = "c AS (SELECT c_custkey AS k, c_name AS n, c_nationkey::VARCHAR AS p, c_mktsegment AS s FROM customer)"


@register("consolidated_nodes", f"""WITH {_NORM}
SELECT k, 'On ' || n AS title, k::VARCHAR AS path, 1 AS level, 'articulo' AS kind, '' AS own_text FROM c
UNION ALL SELECT k, 'On ' || n, k || '.1', 2, 'apartado', n || ' shall pay:' FROM c UNION ALL SELECT k, 'On ' || n, k || '.1.a', 3, 'punto', p FROM c
UNION ALL SELECT k, 'On ' || n, k || '.1.sub_2', 3, 'subparagraph', 'By ' || s || '.' FROM c""")
def consolidated_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A small article in the consolidated layout, with its title, for every customer."""
    c = _dealt(_t(spark, sf, "customer")).select("c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("p"), "c_mktsegment")
    page = F.format_string(
        '<html xmlns="http://www.w3.org/1999/xhtml"><body><div class="eli-subdivision" id="art_%s"><p class="title-article-norm">Article</p><div class="eli-title"><p>On %s</p></div><div class="norm"><span class="no-parag">1.  </span><div class="norm inline-element">%s shall pay:</div></div>'
        '<div class="grid-container grid-list"><div class="grid-list-column-1">(a)</div><div class="grid-list-column-2"><p class="norm">%s</p></div></div><p class="modref">M1</p><p class="norm">By %s.</p></div></body></html>',
        F.col("c_custkey").cast("string"), "c_name", "c_name", "p", "c_mktsegment",
    )
    return H.nodes(c.select(F.col("c_custkey").alias("k"), page.alias("x")), "k", "x", "consolidated").select("k", "title", "path", "level", "kind", "own_text")


@register("amending_acts", f"""WITH {_NORM} SELECT k, '2' AS article, 'M' || p AS act FROM c WHERE k % 3 > 0 UNION ALL SELECT k, '4', 'R' || k FROM c""")
def amending_acts(spark: SparkSession, sf: str) -> DataFrame:
    """Acts that amended the articles of a small consolidated text for every customer: by the block an article starts in, by its own mark, or none."""
    c = _dealt(_t(spark, sf, "customer")).select("c_custkey", F.col("c_nationkey").cast("string").alias("p"))
    div = '<div class="eli-subdivision" id="art_%s">%s<p>text</p></div>'
    page = F.concat(
        F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><body>' + div % ("1", "")),
        F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit('<a title="M'), "p", F.lit(': INSERTED">▼M1</a>'))).otherwise(""),
        F.lit(div % ("2", "") + div % ("3", '<a title="x: y">▼B</a>')),
        F.concat(F.lit('<div class="eli-subdivision" id="art_4"><a title="R'), F.col("c_custkey").cast("string"), F.lit(': REPLACED">►M2</a><p>t</p></div><a title="x: y">▼B</a></body></html>')),
    )
    return H.amendments(c.select(F.col("c_custkey").alias("k"), page.alias("x")), "k", "x")

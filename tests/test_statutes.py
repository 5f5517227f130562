"""Statute text, stemmers, hierarchy, dealing and sealed folders on hand-written cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiform.functions import legal as L
from stratiform.functions import stem
from stratiform.operators import design, evidence, hierarchy


def test_stemmers_on_published_examples():
    words = "caresses ponies cats feed agreed plastered motoring conflated hopping falling filing happy sky relational digitizer vietnamization sensibiliti electriciti goodness allowance adoption replacement probate cease controll roll is"
    stems = "caress poni cat feed agre plaster motor conflat hop fall file happi sky relat digit vietnam sensibl electr good allow adopt replac probat ceas control roll is"
    assert list(map(stem.porter, words.split())) == stems.split()
    words = "abbandonata abbandonerà abbandono abbassamento abbassandola abbassarono abbassarsi pronuncia propensione propizie proprietà proprietari prorogato"
    stems = "abbandon abbandon abband abbass abbass abbass abbass pronunc propension propiz propriet proprietar prorog"
    assert list(map(stem.italian, words.split())) == stems.split()


def test_normal_text():
    assert L.normal("►M1 “Any”  ﬁrm ; see (  ) – ok") == '"Any" firm; see <FN> - ok'
    assert L.normal("Text ( *1 ) Note one ( *2 ) Note two") == "Text" and L.normal("") == "" and L.normal(None) is None


def test_references():
    def read(text):
        return [(r[2], r[3], r[4], r[5]) for r in L.read_references("A", "7.2", text, {"Directive 2015/2366": "B"})]

    assert read("point (ii) or (iv) of Article 31a(2)") == [("points_of_article", "A", "31a.2.ii", None), ("points_of_article", "A", "31a.2.iv", None)]
    assert read("points (f) to (h) of Article 8") == [("points_of_article", "A", "8.f", None), ("points_of_article", "A", "8.g", None), ("points_of_article", "A", "8.h", None)]
    assert read("Articles 3(2)(b) and 17 to 19 apply; Articles 9 to 5") == [("articles", "A", x, None) for x in ("3.2.b", "17", "18", "19", "9")]
    assert read("Articles 4 and the rest, point of order, paragraph of text") == []
    assert read("Article 4(1) and (3) of Directive 2015/2366") == [("article", "B", "4.1", None), ("article", "B", "4.3", None)]
    assert read("Article 5, point (b), of this Regulation") == [("article", "A", "5.b", None)]
    assert read("paragraphs 1 and 2 of Article 9 of that Directive") == [("paragraphs_of_article", None, None, "anaphora")]
    assert read("Article 3 of Regulation (EU) No 1093/2010") == [("article", None, None, "outside_the_corpus")]
    assert read("point (b) of paragraph 3; paragraph 4") == [("points_of_paragraph", "A", "7.3.b", None), ("paragraphs", "A", "7.4", None)]
    assert read(None) == []


def test_clause_and_longest_run_against_brute_force():
    text = "One clause. " + "word " * 100 + "mention " + "word " * 100 + "; last"
    assert L.clause("A b. C d; e", 5, 6) == (5, "C d;")
    at = text.index("mention")
    low, got = L.clause(text, at, at + 7)
    assert low == 12 and got.startswith("...word") and got.endswith("word...") and "mention" in got and len(got) <= 306
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        runs = [j - i for i, j in itertools.combinations(range(len(a) + 1), 2) if any(a[i:j] == b[k : k + j - i] for k in range(len(b)))]
        assert L.longest_shared_run(a, b) == max(runs, default=0)


def test_columns_over_statutes(spark):
    df = spark.createDataFrame([("'Payer', 'fee' and 'spy' means any 'x'", "subject to Article 4", 11, 'noise {"k": {"a": 1}} end'), (None, None, 0, "} {"), ("", "", 0, None)], "d string, t string, at int, j string")
    got = df.select(L.defined_terms(F.col("d")).alias("d"), L.cue(F.col("t"), F.col("at"), F.lit(0)).alias("c"), L.json_in(F.col("j")).alias("j")).collect()
    assert [tuple(r) for r in got] == [(["Payer", "fee", "spy"], "condition", '{"k": {"a": 1}}'), ([], None, None), ([], None, None)]
    terms = spark.createDataFrame([(1, "spy"), (1, "c++ fee"), (2, "spy")], "act int, term string")
    nodes = spark.createDataFrame([(1, 1, "Spies, not spying"), (2, 1, "a C++ fees list"), (3, 1, "co-spy"), (4, 2, "the SPY"), (5, 1, None)], "id int, act int, text string")
    assert sorted((r.id, r.term, r.at) for r in evidence.uses(nodes, terms, "act", "text", L.term_regex(F.col("term"))).collect()) == [(1, "spy", 1), (2, "c++ fee", 3), (4, "spy", 5)]


JOURNAL = """<html xmlns="http://www.w3.org/1999/xhtml"><body><div class="eli-subdivision" id="art_9"><p class="oj-ti-art">Article 9</p><div class="eli-title"><p>Own funds</p></div>
<div id="009.001"><p class="oj-normal">1.   First block:<a id="ntc1" href="#ntr1">(<sup>1</sup>)</a></p><table><tbody><tr><td><p>(a)</p></td><td><p class="oj-normal">point a</p><table><tr><td>(i)</td><td>inner</td></tr></table></td></tr></tbody></table>
<p class="oj-normal">Second block</p><table><tr><td>(a)</td><td>other a</td></tr></table><table><tr><td>-</td><td><p class="oj-normal">dash</p></td></tr></table></div></div></body></html>"""
CONSOLIDATED = """<html xmlns="http://www.w3.org/1999/xhtml"><body><div class="eli-subdivision" id="art_9"><p class="title-article-norm">Article 9</p><div class="norm"><span class="no-parag">1.  </span><div class="norm inline-element">First block:</div></div>
<div class="grid-container grid-list"><div class="grid-list-column-1">(a)</div><div class="grid-list-column-2"><p class="norm">point a</p></div></div><p class="modref">M1</p><p class="norm">Second block</p>
<div class="grid-container grid-list"><div class="grid-list-column-1">(a)</div><div class="grid-list-column-2">other a</div></div></div></body></html>"""


def test_hierarchy(spark):
    docs = spark.createDataFrame([(1, JOURNAL), (2, None), (3, ""), (4, "<broken"), (5, JOURNAL)], "id int, x string")
    rows = hierarchy.nodes(docs, "id", "x", "journal").orderBy("id", "ordinal").collect()
    assert {r.id for r in rows} == {1, 5} and {r.title for r in rows} == {"Own funds"}
    assert [(r.path, r.kind, r.own_text) for r in rows if r.id == 1] == [
        ("9", "articulo", ""),
        ("9.1", "apartado", "First block: <FN>"),
        ("9.1.a", "punto", "point a"),
        ("9.1.a.i", "punto", "inner"),
        ("9.1.sub_2", "subparagraph", "Second block - dash"),
        ("9.1.sub_2.a", "punto", "other a"),
    ]
    got = [(r[3], r[6], r[7]) for r in hierarchy.read_document(CONSOLIDATED, "consolidated")]
    assert got == [("9", "articulo", ""), ("9.1", "apartado", "First block:"), ("9.1.a", "punto", "point a"), ("9.1.sub_2", "subparagraph", "Second block"), ("9.1.sub_2.a", "punto", "other a")]
    with pytest.raises(Exception, match="mismatch|syntax|token|unclosed|element"):
        list(hierarchy.read_document("<broken", "journal", strict=True))


def test_dealing_is_balanced(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abc"), rng.choice(["x", None])) for i in range(30)]
    got = {r.id: r.batch for r in design.deal(spark.createDataFrame(rows, "id int, p string, q string"), "id", ["p", "q"]).collect()}
    values = np.array([[p == v for v in "abc"] + [q == "x", q is None] for _, p, q in rows], dtype=float)
    batch = np.array([got[i] for i, _, _ in rows])
    assert sorted(np.bincount(batch)) == [10, 10, 10]
    best = design.imbalance(values, batch, 3)
    for i, j in itertools.combinations(range(30), 2):
        swapped = batch.copy()
        swapped[[i, j]] = swapped[[j, i]]
        assert design.imbalance(values, swapped, 3) >= best - 1e-9
    assert design.deal(spark.createDataFrame([], "id int, p string"), "id", ["p"]).count() == 0


def test_sinks_can_be_run_again(spark, tmp_path):
    from stratiform.sources import artifacts

    at = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "n"), (1, "a")], "k int, v string")
    for _ in range(2):
        artifacts.append_new(rows, at, ["k"])
    artifacts.append_new(spark.createDataFrame([(3, "c")], "k int, v string"), at, ["k"])
    assert sorted(map(str, (tuple(r) for r in spark.read.parquet(at).collect()))) == ["(1, 'a')", "(2, None)", "(3, 'c')", "(None, 'n')"]
    with pytest.raises(ValueError, match="other values"):
        artifacts.append_new(spark.createDataFrame([(2, "b")], "k int, v string"), at, ["k"])
    sealed = str(tmp_path / "sealed")
    with pytest.raises(ValueError, match="not sealed"):
        artifacts.seal(rows, sealed, [rows])
    artifacts.seal(rows, sealed, [rows.filter("k > 5")])
    assert artifacts.read_sealed(spark, sealed).count() == 4
    rows.write.mode("append").parquet(f"{sealed}/data")
    with pytest.raises(ValueError, match="as sealed"):
        artifacts.read_sealed(spark, sealed)


def test_amendments(spark):
    article = '<div class="eli-subdivision" id="art_%s">%s<p>text</p></div>'
    body = article % ("1", "") + '<a title="32019R1: INSERTED">▼M1</a>' + article % ("2", "") + article % ("3", '<a title="x: y">▼B</a>') + article % ("4", '<a title="32020R2: REPLACED">►M2</a>')
    docs = spark.createDataFrame([(1, f'<html xmlns="http://www.w3.org/1999/xhtml"><body>{body}</body></html>'), (2, None), (3, "<x")], "id int, x string")
    assert sorted(tuple(r) for r in hierarchy.amendments(docs, "id", "x").collect()) == [(1, "2", "32019R1"), (1, "4", "32020R2")]


def test_pages_are_read_by_all_tasks(spark, sf):
    """Pages made of a table's rows are dealt first: the table is one file and would be one task."""
    from stratiform.catalog import queries

    for name in ("statute_nodes", "consolidated_nodes", "amending_acts"):
        df = queries()[name](spark, sf)
        assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")), name


def test_words_are_taken_once_for_all_runs(spark):
    """A text of n words has n runs; words taken anew for each would make it quadratic."""
    from pyspark.sql import functions as F

    from stratiform.functions import text as T

    df = spark.createDataFrame([("a b c d e",), ("a",), ("",)], "t string").select(L.runs(T.ascii_words(F.col("t")), 4).alias("r"))
    assert [r.r for r in df.collect()] == [["a b c d", "b c d e"], [], []]
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1

"""Operators on hand-written rows."""

import pytest

from stratiform.functions import text as T
from stratiform.operators import curation, retrieval, stats, structure
from stratiform.sources import files
from stratiform.streaming import log


def run(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank int")


def test_text_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("The court's 1.234,5 and 12,5 figures; courts",), (None,)], "t string")
    got = df.select(T.analyzed(F.col("t")).alias("a"), T.figures(F.col("t")).alias("f"), T.shingles(F.col("t")).alias("s")).collect()
    assert got[0].a[0] == "court" and "the" not in got[0].a
    assert got[0].f == ["1.234", "12.5", "5"]
    assert got[1].a == [] and got[1].f == [] and got[1].s == []
    sample = spark.createDataFrame([("é ﬁ",)], "t string").select(T.nfc("t").alias("c"), T.nfkc("t").alias("k"), T.hmac_sha256(b"key", F.lit("The quick brown fox jumps over the lazy dog")).alias("h")).first()
    assert sample.c == "é ﬁ" and sample.k == "é fi"
    assert sample.h == "f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8"


def test_fusion_and_merges(spark):
    a, b = run(spark, [(1, 10, 3.0, 1), (1, 11, 2.0, 2), (1, 12, 1.0, 3)]), run(spark, [(1, 12, 9.0, 1), (1, 13, 8.0, 2)])
    fused = [(r.doc_id, r.rank) for r in retrieval.rrf([(a, 1.0), (b, 1.0)], 60, 50).orderBy("rank").collect()]
    assert fused == [(12, 1), (10, 2), (11, 3), (13, 4)]
    base = run(spark, [(1, d, 1.0, k) for k, d in enumerate((10, 11, 12, 20, 21), 1)])
    hits = spark.createDataFrame([(1, 0, 1, 10), (1, 0, 2, 20), (1, 1, 1, 20), (1, 1, 2, 21)], "query_id long, list int, pos int, doc_id long")
    merged = [(r.doc_id, r.place) for r in retrieval.decomposition(base, hits, keep=1, total=3).orderBy("rank").collect()]
    assert merged == [(10, "kept"), (20, "added"), (21, "added"), (11, "rest"), (12, "rest")]


def test_pagerank_keeps_its_mass(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0)], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 0.0)], "node long, s double")
    p = {r.node: r.score for r in retrieval.pagerank(edges, seeds, rounds=30).collect()}
    assert sum(p.values()) == pytest.approx(1) and p[1] > p[3] > p[2]


def test_pagerank_is_the_fixed_point_or_an_error(spark):
    import numpy as np

    n, rnd = 9, np.random.default_rng(1)
    w = np.triu(rnd.integers(0, 3, (n, n)), 1).astype(float)
    w[range(n - 1), range(1, n)] = 1
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "src long, dst long, weight double")
    s = np.eye(n)[0]
    seeds = spark.createDataFrame(list(enumerate(s.tolist())), "node long, s double")
    out = w.sum(axis=1, keepdims=True)
    step = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
    dangling = (out[:, 0] == 0).astype(float)
    for follow in (0.3, 0.5):
        want = np.linalg.solve(np.eye(n) - follow * (step.T + np.outer(s, dangling)), (1 - follow) * s)
        got = dict(retrieval.pagerank(edges, seeds, follow).collect())
        assert np.abs(want - [got[i] for i in range(n)]).max() < 1e-11
    with pytest.raises(ValueError, match="converge"):
        retrieval.pagerank(edges, seeds, rounds=4)


def test_pagerank_reaches_every_node_above_a_seed(spark):
    from stratiform.plans import evaluation

    sf, f = "/root/testdata/sf0.01", 0.3
    got = dict(evaluation.reference_scores(spark, sf).collect())
    seeds = [n for n in got if n % 100 == 0]
    p = s = {n: (n in seeds) / len(seeds) for n in got}
    for _ in range(60):
        dangling = sum(x for n, x in p.items() if n // 2 not in got)
        nxt = {n: (1 - f + f * dangling) * s[n] for n in got}
        for n, x in p.items():
            if n // 2 in got:
                nxt[n // 2] += f * x
        p = nxt
    assert max(abs(p[n] - got[n]) for n in got) < 1e-11
    assert sum(x > 0 for x in got.values()) == sum(x > 0 for x in p.values()) and got[1] > 0


def test_envelope_against_enumeration(spark):
    import itertools

    w, base, cand, relevant = [1, 1, -1, 0, -1], 2, 1, 3
    every = [(cand - base + sum(x for x, y in zip(w, on, strict=True) if y)) / (relevant + sum(on)) for on in itertools.product([0, 1], repeat=5)]
    unjudged = spark.createDataFrame([(1, i, x) for i, x in enumerate(w)], "query_id long, doc_id long, w int")
    known = spark.createDataFrame([(1, base, cand, relevant)], "query_id long, base_found int, cand_found int, relevant int")
    got = stats.recall_envelope(unjudged, known).first()
    assert (got.least, got.greatest) == (round(min(every), 6), round(max(every), 6))


def test_paired_refuses_missing_queries(spark):
    a, b = spark.createDataFrame([(1, 0.5)], "q long, v double"), spark.createDataFrame([(2, 0.5)], "q long, v double")
    with pytest.raises(Exception, match="not in both runs"):
        stats.paired(a, b, "q", "v").collect()


def test_chain_shows_a_changed_row(spark):
    e = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "log long, seq long, x string")
    chained = curation.chain(e, "log", "seq", ["seq", "x"])
    assert curation.broken_links(chained, "log", "seq", ["seq", "x"]).count() == 0
    from pyspark.sql import functions as F

    forged = chained.withColumn("own", F.when(F.col("seq") == 2, "0").otherwise(F.col("own")))
    assert [r.seq for r in curation.broken_links(forged, "log", "seq", ["seq", "x"]).collect()] == [2]


def test_chunks_are_highest_fitting_subtrees(spark):
    nodes = spark.createDataFrame([("1", 5), ("1.1", 40), ("1.1.1", 40), ("1.2", 30), ("1.2.1", 20)], "path string, tokens int")
    got = {r.path: (r.chunk, r.own_only) for r in structure.budget_chunks(nodes, 60).collect()}
    assert got == {"1": ("1", True), "1.1": ("1.1", True), "1.1.1": ("1.1.1", False), "1.2": ("1.2", False), "1.2.1": ("1.2", False)}


def test_run_file_round_trip(spark, tmp_path):
    a = run(spark, [(1, 10, 3.0, 1), (1, 11, 2.0, 2), (2, 12, 1.0, 1)])
    files.write_run(a, str(tmp_path / "run"))
    assert sorted(map(tuple, files.read_run(spark, str(tmp_path / "run")).select(*a.columns).collect())) == sorted(map(tuple, a.collect()))


def test_rules_stop_the_read(spark):
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="rule broken: positive"):
        files.checked(spark.range(3), positive=F.col("id") > 0).collect()


def test_stream_folds_like_the_batch(spark, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    log.run_once(log.folded(spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf), "user_id", "event_id", "event_type"), "folded_log")
    assert sorted(map(tuple, spark.table("folded_log").collect())) == sorted(map(tuple, curation.folded(batch, "user_id", "event_id", "event_type").collect()))


def test_greedy_dedup_in_priority_order(spark):
    import random

    rnd = random.Random(2)
    order = {i: p for i, p in enumerate(rnd.sample(range(60), 60))}
    pairs = {tuple(rnd.sample(range(60), 2)) for _ in range(90)}
    kept = set()
    for i in sorted(order, key=order.get):
        if not any((i, j) in pairs or (j, i) in pairs for j in kept):
            kept.add(i)
    items, similar = spark.createDataFrame(list(order.items()), "id long, p int"), spark.createDataFrame(sorted(pairs), "a long, b long")
    assert {r.id for r in curation.greedy_kept(items, similar, "id", "p").collect() if r.kept} == kept


def test_ndcg_envelope_against_enumeration(spark):
    import itertools
    import math

    grade, base, cand = [3, None, 1, None, None], [1, 2, None, 3, None], [2, None, 1, 4, 3]
    gain = lambda r: 1 / math.log2(r + 1) if r else 0.0
    every = []
    for free in itertools.product(range(4), repeat=3):
        it = iter(free)
        g = [next(it) if x is None else x for x in grade]
        ideal = sum(x * gain(i + 1) for i, x in enumerate(sorted(g, reverse=True)))
        every.append(sum(x * (gain(c) - gain(b)) for x, b, c in zip(g, base, cand, strict=True)) / ideal)
    rows = spark.createDataFrame([(1, i, g, b, c) for i, (g, b, c) in enumerate(zip(grade, base, cand, strict=True))], "query_id long, doc_id long, grade int, base_rank int, cand_rank int")
    got = stats.ndcg_envelope(rows).first()
    assert (got.least, got.greatest) == (round(min(every), 6), round(max(every), 6))


def test_contamination_reads_the_words_of_a_long_text_once(spark):
    import time

    from stratiform.operators import curation

    long = " ".join(f"w{i}" for i in range(40_000))
    docs = spark.createDataFrame([(1, long), (2, "a b c d e f g h i"), (2, "a b c d e f g h"), (3, None), (4, "x y")], "doc_id long, text string")
    bench = spark.createDataFrame([("w7 w8 w9 w10 w11 w12 w13 w14 and B c d e f g h i",), (None,)], "text string")
    began = time.monotonic()
    assert sorted(map(tuple, curation.contamination(docs, bench, "doc_id", "text").collect())) == [(1, 39_993, 1), (2, 3, 1)]
    assert time.monotonic() - began < 30


def test_dense_search_in_tiles(spark, monkeypatch):
    import numpy as np

    from stratiform.operators import retrieval as R

    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (300, 4)).astype(float)
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(R, "TILE", 700)
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in R.dense_topk(docs.filter("vec_id % 20 = 0"), docs, 5).collect())
    s = v @ v.T
    assert got == [(q, p + 1, d, s[q, d]) for q in range(0, 300, 20) for p, d in enumerate(sorted(range(300), key=lambda d: (-s[q, d], d))[:5])]


def test_bm25_scores_where_the_documents_lie(spark, monkeypatch):
    from stratiform.operators import retrieval as R

    docs = spark.createDataFrame([(i, " ".join(w for p, w in enumerate(("river", "stone", "cloud", "tree", "stone")) if i % (p + 2)) if i % 9 else None) for i in range(200)], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "stones stone clouds"), (2, "trees"), (3, "nothing"), (4, "rivers by a tree")], "item_id long, text string")
    calls, scored = [], R._scored
    monkeypatch.setattr(R, "_scored", lambda *a: calls.append(1) or scored(*a))
    monkeypatch.setattr(R, "TILE", 80)
    run = lambda d: sorted((r.query_id, int(r.doc_id), r.score) for r in R.bm25(queries, d, 300, query_id="item_id", query_text="text", doc_id="doc_id", doc_text="text").collect())
    here, shuffled = run(docs), run(docs.withColumn("doc_id", docs.doc_id.cast("string")))
    assert here == shuffled and len(here) > 300 and calls == [1]
    assert not run(docs.filter("false"))


def test_bm25_reads_texts_in_small_batches(spark):
    """A worker holds the words of a batch; Spark's default would be those of ten thousand texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    words = [f"w{i}x" for i in range(40)]
    q = spark.createDataFrame([(1, " ".join(words))], "i long, t string")
    d = spark.range(3000).selectExpr("id as d", "concat('w', id % 50, 'x other') as t").repartition(1)
    got = retrieval.bm25(q, d, 3, query_id="i", query_text="t", doc_id="d", doc_text="t").orderBy("rank").collect()
    assert [r.doc_id for r in got] == [0, 1, 2] and int(spark.conf.get(name)) <= 1000


def test_documents_of_one_row_group_are_read_by_all_tasks(spark, monkeypatch, tmp_path):
    """Parquet of one row group is one task's; bm25 and overlap deal its texts first."""
    path = str(tmp_path / "d")
    spark.range(400).selectExpr("id as d", "concat('stones of rivers ', id % 7) as t").coalesce(1).write.parquet(path)
    docs, q = spark.read.parquet(path), spark.createDataFrame([(1, "rivers stones")], "i long, t string")
    tasks, kept = [], retrieval._kept_terms
    monkeypatch.setattr(retrieval, "_kept_terms", lambda words, *a: tasks.append(words.rdd.getNumPartitions()) or kept(words, *a))
    run = lambda f: sorted((r["rank"], r.doc_id) for r in f(q, docs, 3, query_id="i", query_text="t", doc_id="d", doc_text="t").collect())
    assert run(retrieval.bm25) == run(retrieval.overlap) == [(1, 0), (2, 1), (3, 2)]
    assert len(tasks) == 2 and min(tasks) >= 4


def test_words_cut_from_bytes_are_those_of_the_analyzer(spark):
    from stratiform.functions.stem import porter_analyzed

    odd = ["it's the boy’s²s x's²", "Straße İstanbul K'S o'sullivan's", "a_b-c naïve wörld’s—end", "", None, "½cup ١٢ 東京 \U0001d54f🙂relations", "dogs'stones relational's\nrunning éa", "the of", " ly "]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd * 3)], "d long, t string").repartition(2)
    q = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i long, t string")
    run = lambda f, **a: sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in f(q, docs, 30, query_id="i", query_text="t", doc_id="d", doc_text="t", **a).collect())
    got = run(retrieval.bm25)
    assert got == run(retrieval.bm25, analyzer=lambda c: porter_analyzed(c)) and len({r[0] for r in got}) == 6
    plain = {(i, d): len(set(a) & set(b)) for i, a in enumerate(map(_long_words, odd)) for d, b in enumerate(map(_long_words, odd * 3)) if set(a) & set(b)}
    assert {(r[0], r[1]): r[2] for r in run(retrieval.overlap)} == plain and plain


def _long_words(text):
    import re

    return re.findall("[a-z]{6,}", (text or "").lower())

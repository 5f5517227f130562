"""Readers and sinks of layers, runs, vectors and texts: what is stale or changed is refused. The event log as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from stratiform.operators import curation, draws, retrieval, structure
from stratiform.sources import layers, sinks
from stratiform.streaming import log

H = "a" * 64


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def entry(document, act, role="original", sha=H, size=9):
    return {"document": document, "act": act, "role": role, "source_sha256": sha, "size": size, "fetched_at": "2026-01-01T00:00:00Z"}


def test_manifest_and_source_selection(spark, tmp_path):
    m = layers.read_manifest(spark, lines(tmp_path / "m.jsonl", [entry("a1", "A"), entry("a2", "A", "consolidated"), entry("b1", "B")]))
    assert sorted(r.document for r in layers.preferred(m).collect()) == ["a2", "b1"]
    for bad in (entry("", "A"), entry("x", "A", "draft"), entry("x", "A", sha="00"), entry("x", "A", size=0)):
        with pytest.raises(Exception, match="rule broken"):
            layers.read_manifest(spark, lines(tmp_path / "bad.jsonl", [bad])).collect()
    (tmp_path / "land").mkdir()
    (tmp_path / "land" / "f.html").write_bytes(b"text")
    assert [(r.document, r.size) for r in layers.landed(spark, str(tmp_path / "land")).collect()] == [("f.html", 4)]


def test_layers_are_refused_where_stale(spark, tmp_path):
    schema = "act string, source_sha256 string, version string, articles array<struct<path: string, nodes: array<struct<path: string, own_text: string>>>>"
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(schema)
    doc = {"act": "A", "source_sha256": H, "version": "1.4", "articles": [{"path": "1", "nodes": [{"path": "1", "own_text": "x"}, {"path": "1.1", "own_text": ""}]}]}
    at = tmp_path / "layer.json"
    at.write_text(json.dumps(doc))
    m = spark.createDataFrame([("A", H)], "act string, source_sha256 string")
    layer = layers.read_layer(spark, str(at), schema, m, "1.4")
    assert [tuple(r) for r in layers.node_map(layer).collect()] == [("A", "1", "x"), ("A", "1.1", "")]
    for manifest, version in ((m, "1.5"), (m.withColumn("source_sha256", F.lit("b" * 64)), "1.4"), (m.unionByName(spark.createDataFrame([("B", H)], "act string, source_sha256 string")), "1.4")):
        with pytest.raises(layers.Stale):
            layers.read_layer(spark, str(at), schema, manifest, version)


def test_runs_by_digest(spark, tmp_path):
    run = spark.createDataFrame([(1, 1, 7, 0.5), (1, 2, 9, 0.25), (2, 1, 9, 1.0)], "query_id long, rank int, doc_id long, score double")
    digest = sinks.write_pinned_run(run.repartition(3), str(tmp_path / "run"))
    assert layers.run_digest(run) == digest and layers.read_pinned_run(spark, str(tmp_path / "run"), digest).count() == 3
    assert layers.run_digest(run.withColumn("score", F.col("score") * 2)) != digest
    with pytest.raises(layers.Stale):
        layers.read_pinned_run(spark, str(tmp_path / "run"), H)


def test_frozen_inputs(spark, tmp_path):
    from hashlib import sha256

    from pyspark.sql.types import _parse_datatype_string

    root = tmp_path / "bench"
    root.mkdir()
    lines(root / "needs.jsonl", [{"need_id": 1}])
    sealed = {"needs": sha256((root / "needs.jsonl").read_bytes()).hexdigest()}
    schemas = {"needs": _parse_datatype_string("need_id long")}
    m = spark.createDataFrame([], "act string, source_sha256 string")
    assert layers.read_frozen(spark, str(root), schemas, sealed, m, "", "")["needs"].count() == 1
    lines(root / "needs.jsonl", [{"need_id": 2}])
    with pytest.raises(layers.Stale, match="as sealed"):
        layers.read_frozen(spark, str(root), schemas, sealed, m, "", "")


def test_vectors_texts_and_reports(spark, tmp_path):
    v = spark.createDataFrame([(1, [0.6, 0.8]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    at, who = str(tmp_path / "v"), {"model": "m", "layer": 500}
    sinks.write_vectors(v, at, who, 2)
    assert sinks.read_vectors(spark, at, who).count() == 2
    with pytest.raises(layers.Stale, match="layer: 500 for 400"):
        sinks.read_vectors(spark, at, {"model": "m", "layer": 400})
    with pytest.raises(ValueError, match="unit vector"):
        sinks.write_vectors(v.withColumn("embedding", F.array(F.lit(2.0).cast("float"), F.lit(0.0).cast("float"))), str(tmp_path / "w"), who, 2)
    t = spark.createDataFrame([("a",), ("a",), ("é",), (None,)], "text string")
    store = str(tmp_path / "texts")
    for _ in range(2):
        assert sinks.put(t, store).count() == 2
    assert spark.read.parquet(store).count() == 2 and sinks.get(spark, store, sinks.put(t, store)).count() == 2
    with pytest.raises(layers.Stale):
        sinks.get(spark, store, spark.createDataFrame([(H,)], "sha256 string"))
    assert "| 1 | [0.6" in sinks.report(v.limit(1), "V") and sinks.report(v, "V").startswith("## V")
    with pytest.raises(ValueError, match="no report"):
        sinks.report(v, "V", 1)


def test_small_readers(spark, tmp_path):
    table = "text\n| a | b |\n|---|---|\n| 1 | x y |\n| 2 |  |\n\nend"
    got = spark.createDataFrame([(table,), (None,)], "t string").select(layers.table_rows(F.col("t")).alias("r")).collect()
    assert [r.r for r in got] == [[["1", "x y"], ["2", ""]], []]
    (tmp_path / "x.json").write_text(json.dumps([{"act": "A", "articles": ["1", "2"]}]))
    assert layers.read_exclusions(spark, str(tmp_path / "x.json")).count() == 2
    assert layers.config_digest({"b": 1, "a": "é"}, {"a", "b"}) == layers.config_digest({"a": "é", "b": 1}, {"a", "b"})
    with pytest.raises(ValueError, match="contract"):
        layers.config_digest({"a": 1}, {"a", "b"})
    spark.createDataFrame([(1, ["x", "y"])], "q long, docs array<string>").write.parquet(str(tmp_path / "e"))
    assert layers.external(spark, str(tmp_path / "e"), {"query_id": "q", "doc_id": "docs"}, "doc_id").count() == 2


def test_pages_join_to_their_text():
    for limit in (1, 3, 7, 40):
        for text in ("", "ab\ncd\n", "a" * 50 + "\nb", "x\n" * 30, "long line without end " * 5):
            got = structure.page_texts(text, limit)
            assert "".join(got) == text and all(len(p) <= limit for p in got) and (len(got) == 1 or all(got))


def test_a_forged_event_breaks_all_that_follow(spark):
    events = spark.createDataFrame([(u, i, f"e{i}") for u in "ab" for i in range(6)], "user string, id int, what string")
    chained = curation.chain(events, "user", "id", ["id", "what"])
    assert curation.broken_links(chained, "user", "id", ["id", "what"]).count() == 0
    forged = spark.createDataFrame([tuple(r) for r in chained.collect()], chained.schema).withColumn("what", F.when((F.col("user") == "a") & (F.col("id") == 2), "forged").otherwise(F.col("what")))
    assert sorted((r.user, r.id) for r in curation.broken_links(forged, "user", "id", ["id", "what"]).collect()) == [("a", i) for i in range(2, 6)]


def assembled(base, hits, scores=None):
    """The rule of a merge in words: six stay, corroborated ones next, then turns or scores, then the base."""
    top, support = base[:10], {d for h in hits for d in h[:5]}
    places = 4
    chosen = [d for d in top[6:] if d in support]
    fresh, added = [[d for d in h[:5] if d not in top] for h in hits], []
    while any(fresh):
        for f in fresh:
            while f and f[0] in added:
                f.pop(0)
            if f:
                added.append(f.pop(0))
    if scores:
        placed = added[: max(0, places - len(chosen))]
        added = sorted(added, key=lambda d: (-max(s[d] for h, s in zip(hits, scores, strict=True) if d in h[:5]), placed.index(d) if d in placed else 99, base.index(d)))
    fill = (chosen + added + [d for d in top[6:] if d not in support])[:places]
    first = sorted(top[:6] + fill, key=base.index)
    return first + [d for d in base if d not in first]


def test_merges_of_lists_that_share_documents(spark):
    import random

    rnd = random.Random(4)
    base_rows, hit_rows, want = [], [], {}
    for q in range(12):
        base = rnd.sample(range(30), 30)
        hits = [rnd.sample(range(30), 7) for _ in range(rnd.randint(1, 4))]
        scores = [{d: rnd.randint(0, 3) / 2 for d in h} for h in hits]
        base_rows += [(q, d, r) for r, d in enumerate(base, 1)]
        hit_rows += [(q, k, p, d, scores[k][d]) for k, h in enumerate(hits) for p, d in enumerate(h, 1)]
        want[q] = (assembled(base, hits), assembled(base, hits, scores))
    base = spark.createDataFrame(base_rows, "query_id long, doc_id long, rank int")
    hits = spark.createDataFrame(hit_rows, "query_id long, list int, pos int, doc_id long, score double")
    for k, scored in enumerate((False, True)):
        got = {}
        for r in retrieval.decomposition(base, hits, scored=scored).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.doc_id)
        assert got == {q: w[k] for q, w in want.items()}


def test_streams(spark, tmp_path):
    at = str(tmp_path / "events")
    rows = [(1, "a", "2026-01-01 00:05:00", 1), (1, "b", "2026-01-01 00:50:00", 2), (2, "a", "2026-01-01 01:10:00", 3)]
    spark.createDataFrame(rows, "user int, kind string, ts string, id int").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(at)
    schema = spark.read.parquet(at).schema
    log.run_once(log.folded(log.read(spark, at, schema), "user", "id", "kind"), "folded_events")
    assert sorted(tuple(r) for r in spark.table("folded_events").collect()) == [(1, "b", 2), (2, "a", 1)]
    log.run_once(log.windowed(log.read(spark, at, schema), "ts", "kind"), "windowed_events")
    assert sorted((r.kind, r.n) for r in spark.table("windowed_events").collect()) == [("a", 1), ("a", 1), ("b", 1)]


def test_fusion_of_whole_rankings_refuses_gaps(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 10, 2)], "query_id long, doc_id long, rank int")
    assert [r.doc_id for r in retrieval.rrf([(a, 2.0), (b, 1.0)]).orderBy("rank").collect()] == [10, 11]
    with pytest.raises(Exception, match="not in every ranking"):
        retrieval.rrf([(a, 1.0), (b.filter("rank = 1"), 1.0)]).collect()


def test_analyzers(spark):
    from stratiform.functions import stem

    df = spark.createDataFrame([("The payer's payments, as REGULATED by states", "L'impresa della società paga gli interessi")], "en string, it string")
    row = df.select(stem.porter_analyzed(F.col("en")).alias("en"), stem.italian_analyzed(F.col("it")).alias("it")).first()
    assert row.en == ["payer", "payment", "regul", "state"] and row.it == ["impres", "societ", "pag", "interess"]


def test_browsing_a_corpus(spark):
    from stratiform.operators.browse import Corpus

    rows = [("A", "2", "On fees", "", 0), ("A", "2.1", "", "The payer pays a fee. Fees are due.", 1), ("A", "10", "Scope", "no fee here", 2), ("A", "9a", "Old", "fee", 3), ("B", "1", "Fees", "fee", 0)]
    nodes = spark.createDataFrame(rows, "act string, path string, title string, own_text string, ordinal int")
    corpus = Corpus(nodes, spark.createDataFrame([("A", "9a")], "act string, article string"))
    assert [(r.act, r.path, r.pos) for r in corpus.search(r"\bfees?\b", ["A"]).collect()] == [("A", "2.1", 18), ("A", "2.1", 23), ("A", "10", 4)]
    assert [r.path for r in corpus.search("fees", in_titles=True).collect()] == ["2", "1"]
    assert [r.path for r in corpus.titles("A").collect()] == ["2", "10"] and [r.path for r in corpus.article("A", "2").collect()] == ["2", "2.1"]
    assert [(r.path, r.known) for r in corpus.lookup([("B", "1"), ("A", "9a"), ("A", "10")]).collect()] == [("1", True), ("9a", False), ("10", True)]


def test_paths_and_quantiles():
    from stratiform.operators import verdicts as V

    actions = {"R": V.DISPLACE, "N": V.DISPLACE, "D": V.DISCARD, "M": V.FRONTIER, "E": V.FRONTIER}
    got = V.assign_paths(actions, {("R", "M"): True, ("R", "E"): True, ("N", "R"): False}, "B", "E", ["R", "N"], "N")
    assert got == {"fast": "N", "quality": "E", "discarded": {"D": "inferior", "M": "dominated by R"}, "frontier": ["B", "R"]}
    assert V.assign_paths({}, {}, "B", "E", ["R"])["fast"] == "B" and V.assign_paths({"R": V.DISPLACE}, {("B", "R"): True}, "B", "E", ["R"])["fast"] == "B"
    published = {1: 12.70620474, 2: 4.30265273, 5: 2.57058184, 10: 2.22813885, 30: 2.04227246, 199: 1.97195654}
    assert all(abs(V.t_quantile(0.975, df) - t) < 1e-7 for df, t in published.items())


def test_seeded_draws_like_python(spark):
    import random

    from stratiform.operators import verdicts as V

    deltas = [(i, ((i * 7) % 11 - 4) / 10) for i in range(30)]
    rng = random.Random(20261013)
    means = sorted(sum(deltas[i][1] for i in rng.choices(range(30), k=30)) / 30 for _ in range(200))
    got = V.limits(spark.createDataFrame(deltas, "need int, delta double"), "need", ["delta"], 200, draws=draws.replicates(spark, 30, 200, 20261013)).first()
    assert [got.low2, got.high2, got.low1, got.high1] == [round(means[i], 6) for i in (5, 194, 10, 189)]


def test_question_terms(spark):
    from stratiform.operators import dependencies

    questions = spark.createDataFrame([(1, "What fees does the payer owe; and when? No spies."), (2, "Nothing")], "query_id int, text string")
    definitions = spark.createDataFrame([("A", "4.1", "fee"), ("A", "4.2", "spy"), ("B", "2", "payer")], "act string, path string, term string")
    owners = spark.createDataFrame([("c1", "A", "4.1"), ("c2", "B", "2")], "chunk_id string, act string, path string")
    got = dependencies.question_terms(questions, definitions, owners).collect()
    assert sorted(tuple(r) for r in got) == [(1, "A", "fee", "c1", "What fees does the payer owe;"), (1, "B", "payer", "c2", "What fees does the payer owe;")]


def test_a_system_is_the_run_its_summary_hashed(spark, tmp_path):
    run = spark.createDataFrame([(1, 1, 5, 0.5), (1, 2, 7, 0.25), (2, 1, 5, 0.5)], "query_id long, rank int, doc_id long, score double")
    path, summary = f"file://{tmp_path}/run", tmp_path / "summary.json"
    sinks.write_run(run, path)
    digest = layers.run_digest(run)
    summary.write_text(json.dumps({"identity": {"run_sha256": digest}, "nDCG": 0.5}, indent=1))
    found, said = layers.read_system(spark, path, f"file://{summary}")
    assert found.count() == 3 and said["nDCG"] == 0.5
    for bad in ({"identity": {"run_sha256": "0" * 64}}, {"identity": {}}, {}):
        summary.write_text(json.dumps(bad))
        with pytest.raises(layers.Stale):
            layers.read_system(spark, path, f"file://{summary}")


def test_pools_of_needs(spark):
    runs = spark.createDataFrame([("a", 1, 10, 1), ("a", 1, 11, 3), ("b", 2, 10, 2), ("c", 1, 12, 1)], "contributor string, query_id int, doc_id int, rank int")
    queries = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "query_id int, need_id int")
    anchors = spark.createDataFrame([(7, 10), (8, 13)], "need_id int, doc_id int")
    got = {(r.need_id, r.doc_id): [tuple(x) for x in r.sources] for r in curation.pool_of_needs(runs, queries, {"a": 2, "b": 2}, anchors).collect()}
    assert got == {(7, 10): [("a", 1, 1), ("anchor", None, 0), ("b", 2, 2)], (8, 13): [("anchor", None, 0)]}


def test_changes_are_explained_both_ways(spark):
    base = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", None)], "k string, t string")
    other = spark.createDataFrame([("1", "a"), ("2", "x"), ("5", "n"), ("4", None), ("6", "y")], "k string, t string")
    marks = spark.createDataFrame([("2", "M2"), ("2", "M1"), ("5", "M1"), ("4", "M1")], "k string, act string")
    changes, problems = structure.explained(base, other, marks, "k", "t")
    assert sorted((r.k, r.change, r.acts) for r in changes.collect()) == [("2", "amended", ["M1", "M2"]), ("5", "added", ["M1"])]
    assert sorted((r.k, r.problem) for r in problems.collect()) == [("3", "removed"), ("4", "silent"), ("6", "unexplained")]

"""Every operator on nulls, empty and long texts, repeated rows, ties, clashing columns and empty tables."""

import hashlib

import public_tokenizers
import pytest

from stratiform.llm import bpe_replay, decontaminate, html_crf, ngram_join, ogg, pii_bootstrap, quotes, suffix_dedup, toxicity_pu, warc

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, "x"), (4, LONG), (5, LONG), (6, " \t\n "), (7, "é" * 300)]
DOCS = "doc_id long, text string, TEXT string, n_bytes int, key string, component int, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "other", 1, "k", 2, 0.5) for i, t in ROWS], DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one two three"), (None, "four five"), (2, None), (3, "one two three")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (7, None)], "doc_id long, toxic int")


def operators(bench, labels):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return {
        "ogg": ogg.media_features,
        "toxicity": lambda d: toxicity_pu.toxicity(d, labels),
        "pii": lambda d: pii_bootstrap.digests(pii_bootstrap.find(d)),
        "bpe": lambda d: bpe_replay.token_digests(d, path, public_tokenizers.PATTERN),
        "suffix": suffix_dedup.dedup,
        "decontaminate": lambda d: decontaminate.contamination(d, bench),
        "ngram": ngram_join.classes,
    }


@pytest.mark.parametrize("name", ["ogg", "toxicity", "pii", "bpe", "suffix", "decontaminate", "ngram"])
def test_rows_are_kept(docs, bench, labels, name):
    op = operators(bench, labels)[name]
    assert sorted(str(r[0]) for r in op(docs).collect()) == sorted(str(i) for i, _ in ROWS)
    assert op(docs.limit(0)).collect() == []


def test_defined_results(docs, bench):
    n = {(r.doc_id, r.n_removed == r.n_bytes) for r in suffix_dedup.dedup(docs).collect() if r.doc_id in (4, 5, 7)}
    assert n == {(4, True), (5, True), (7, True)}
    c = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(docs).collect()}
    assert c[5][1] == 4 and c[2] == (0, 2) and c[6] == (0, 6) and c[None] == (1, None)
    d = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert (d[1].n_hit, d[1].n_items, d[1].contaminated) == (5, 2, True) and d[2].n_words == 0
    assert d[1].items_sha256 == hashlib.sha256(b"1,3").hexdigest()


def test_pages(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None), (None, "v", ""), (3, "w", "<p>a</p>"), (4, "x", "<div" * 5000)]
    pages = spark.createDataFrame([(*r, "z", 9) for r in rows], "page_id long, url string, html string, HTML string, digest_ int")
    back = {(r.page_id, r.record_type, r.refers_to) for r in warc.roundtrip(pages).collect()}
    assert back == {(1, "revisit", 3), (2, "response", None), (None, "revisit", 2), (3, "response", None), (4, "response", None)}
    assert html_crf.main_text(pages).count() == 6 and html_crf.main_text(pages.limit(0)).collect() == [] and warc.roundtrip(pages.limit(0)).collect() == []


def test_quotations(spark):
    rows = [(1, 0, "u", "Hello  World\n\nsecond par"), (1, 1, "a", "> hello world\nyes"), (1, 2, "u", "> > hello world\n> yes\nthanks\n> nothing"), (1, 3, "a", None), (None, 1, "x", "> a"), (2, 0, "u", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    got = {(r.conv_id, r.turn): (r.own_text, r.n_quotes, r.n_linked, r.reply_to, r.depth) for r in quotes.link(df).collect()}
    assert got[1, 2] == ("thanks", 3, 2, 1, 2) and got[1, 1] == ("yes", 1, 1, 0, 1) and got[1, 3] == ("", 0, 0, 2, 3) and got[None, 1] == ("", 0, 0, None, 0)
    assert quotes.link(df.limit(0)).collect() == []

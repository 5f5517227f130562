"""Operators that SQL can't express against plain implementations."""

import base64
import collections
import gzip
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from stratiform.llm import bpe_replay, common, decontaminate, hashing, html_crf, ngram_join, ogg, pii_bootstrap, quotes, suffix_dedup, toxicity_pu, warc
from stratiform.llm.common import table


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def words_of(rnd, n, size=40):
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


def mutated(rnd, text, share):
    return " ".join(w if rnd.random() > share else f"m{rnd.randrange(10**6)}" for w in text.split(" "))


def test_ogg_checksum_and_damage():
    def slow(data):
        c = 0
        for x in data:
            c ^= x << 24
            for _ in range(8):
                c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
        return c

    rnd = random.Random(1)
    for n in (0, 1, 300):
        data = rnd.randbytes(n)
        assert ogg.checksum(data) == slow(data)
    for n in (64, 4096, 61440, 61504, 400_000):
        data = rnd.randbytes(n)
        assert ogg.read_samples(ogg.mux(data, n))[:2] == (data, n)
    bad = bytearray(ogg.mux(data, n))
    bad[100_000] ^= 1
    assert "bad_pages=1;lost=1" in ogg.read_samples(bytes(bad))[2]


def test_bpe_like_the_library(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    v = bpe_replay.Vocabulary(path, public_tokenizers.PATTERN)
    texts = [r.text or "" for r in table(spark, sf, "documents", "text").collect()] + ["a" * 5000, "漢字 🙂 's't  \n x", " " * 700]
    for t in texts:
        ids = lib.encode_ordinary(t)
        assert v.encode(t) == ids and v.decode(ids) == t.encode()
    for t, (n, a, b) in zip(texts, v.digests(texts), strict=True):
        assert (n, a, b) == (len(i := lib.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_base_spans_like_the_patterns():
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def slow(t):
        for k, p in enumerate(patterns):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m.group())
                if [True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 16 <= len(d) <= 19 and pii_bootstrap.luhn(d), 8 <= len(d) <= 15][k]:
                    yield k, m.start(), m.end()

    rnd = random.Random(3)
    parts = ["a", "b", "@", ".", "1", "2", "25", "9", "+", "-", " ", "(", "_", "é", "4111111111111111", "a@b.c", "1.2.3.4"]
    for _ in range(20_000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert pii_bootstrap.base_spans(t) == list(slow(t)), t


def test_patterns_discover_identifiers(spark):
    numbers = [f"+1 (988) 555-24{i}5" for i in range(5)] + ["998-0042-x7"]
    found = pii_bootstrap.find(frame(spark, [f"please call me under number {n} thanks" for n in numbers]))
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in found.collect()}[5] == [(3, 28, 39)]


def test_suffixes(spark):
    rnd = random.Random(5)
    base = [words_of(rnd, 300, 10**6) for _ in range(4)]
    texts = [*base, base[0], base[1][50:700] + base[2][:400], mutated(rnd, base[3], 0.02), "ab" * 400, "x" * 199, base[0][:200] + "é" + base[0][:250], None]
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[p : p + 200] for b in raw for p in range(len(b) - 199))

    def slow(b):
        m = bytearray(len(b))
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                m[p : p + 200] = b"\1" * 200
        runs = sum(1 for i, x in enumerate(m) if x and (not i or not m[i - 1]))
        return len(b), sum(m), runs, hashlib.sha256(bytes(x for x, y in zip(b, m, strict=True) if not y)).hexdigest()

    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.dedup(frame(spark, texts)).collect()}
    assert got == {i: slow(b) for i, b in enumerate(raw)}


def test_suffix_anchors_do_not_depend_on_the_pieces(monkeypatch):
    rnd = random.Random(11)
    for data in (rnd.randbytes(3000), b"ab" * 900, rnd.randbytes(500) * 4, rnd.randbytes(200), rnd.randbytes(337)):

        def anchors(piece):
            monkeypatch.setattr(suffix_dedup, "PIECE", piece)
            out = []
            for a in suffix_dedup._pieces(data):
                every = np.arange(len(a.place))
                strings = [[x.tolist() for x in a.strings(k)] for k in every]
                out += zip((a.place + a.base).tolist(), (a.lo + a.base).tolist(), (a.hi + a.base).tolist(), a.gram.tolist(), a.contexts(every).tolist(), strings, strict=True)
            return out

        whole = anchors(1 << 18)
        assert len({r[0] for r in whole}) == len(whole) and sum(r[2] - r[1] + 1 for r in whole) == len(data) - 199
        for piece in (1, 7, 136, 137, 138, 500, 1100):
            assert anchors(piece) == whole


def test_suffixes_of_texts_in_pieces(spark):
    rnd = random.Random(12)
    n = suffix_dedup.PIECE
    letters = lambda k: "".join(rnd.choices("abcdefghij", k=k))
    alone, twice, base = letters(2 * n + 900), letters(n + 700), letters(n + 5000)
    texts = [alone, twice, twice, base, letters(300) + base[n - 400 : n + 450] + letters(300)]
    count = collections.Counter(hash(t[p : p + 200]) for t in texts for p in range(len(t) - 199))

    def slow(t):
        runs = []
        for p in range(len(t) - 199):
            if count[hash(t[p : p + 200])] > 1:
                if runs and p <= runs[-1][1]:
                    runs[-1][1] = p + 200
                else:
                    runs.append([p, p + 200])
        return [x for run in runs for x in run]

    want = {i: slow(t) for i, t in enumerate(texts)}
    assert want[0] == [] and want[2] == [0, len(twice)] and want[3] and want[4]
    assert {r.doc_id: r.spans for r in suffix_dedup.removed_spans(frame(spark, texts)).collect()} == want


def test_ngram_join(spark, monkeypatch):
    rnd = random.Random(6)
    hot = words_of(rnd, 30, 10**6)
    texts = [hot + " " + words_of(rnd, rnd.randint(0, 9), 10**6) for _ in range(40)]
    for n in (6, 12, 40, 90, 200):
        base = words_of(rnd, n, 10**6)
        texts += [mutated(rnd, base, rnd.choice([0.005, 0.01, 0.02, 0.03, 0.05])) for _ in range(45)]
        texts += [base, base, " ".join(base.split()[: int(n * 0.8)])]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i: (len(s), find(i)) for i, s in enumerate(sets)}
    for rare in (32, 2):
        monkeypatch.setattr(ngram_join, "RARE", rare)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(frame(spark, texts)).collect()} == want


def test_decontamination_in_blocks(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    whole = sorted(map(tuple, decontaminate.contamination(docs, bench).collect()))
    assert whole == sorted(map(tuple, decontaminate.contamination(docs, bench, limit=1000).collect()))
    assert any(r[5] for r in whole)


def test_wu_manber_finds_all():
    rnd = random.Random(8)
    for _ in range(200):
        text = bytes(rnd.choice(b"ab c") for _ in range(200))
        patterns = list({text[i : i + rnd.randint(4, 9)] for i in (rnd.randrange(180) for _ in range(6))} | {b"abab", b"ccca"})
        got = sorted(decontaminate.WuManber(patterns, 2).search(text))
        assert got == sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels", "doc_id", "toxic")
    rows = toxicity_pu.toxicity(table(spark, sf, "documents", "doc_id", "text"), labels).join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.predicted for r in rows) > 0.9 and hit / sum(r.toxic for r in rows) > 0.9


@pytest.mark.parametrize("n_p", [100, 1000, 2000, 5000])
def test_toxicity_for_any_number_of_labels(n_p):
    """|P| / |U| from 0.01 to 0.5: nothing is lost as labels grow."""
    rnd = random.Random(n_p)

    def text(toxic):
        words = {f"w{rnd.randrange(3000)}" for _ in range(40)}
        return " ".join(sorted(words | ({f"insult{rnd.randrange(6)}", f"slur{rnd.randrange(6)}"} if toxic else set())))

    model = toxicity_pu.learn([text(True) for _ in range(n_p)], [text(rnd.random() < 0.1) for _ in range(10_000)], 0.1)
    scores = {y: [model.score(text(y)) >= toxicity_pu.THRESHOLD for _ in range(300)] for y in (True, False)}
    assert sum(scores[True]) > 280 and sum(scores[False]) < 10


@pytest.mark.parametrize("prior", [0.02, 0.3, 0.95])
def test_risk_gradient(prior):
    """Against finite differences, in both branches: where the negative part is below 0, its own turned round."""
    rnd = np.random.default_rng(4)
    p, u = (toxicity_pu.Rows([np.flatnonzero(rnd.random(6) < share).tolist() for _ in range(30)]) for share in (0.6, 0.3))
    w, l2, gamma = np.r_[np.abs(rnd.normal(size=6)) * 2, -1.5], 0.01, 0.7

    def parts(w):
        loss = lambda rows, sign: (1 / (1 + np.exp(sign * (rows.dot(w[:-1]) + w[-1])))).mean()
        return prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)

    value, g = toxicity_pu.risk(w, p, u, prior, l2, 0.0, gamma)
    plus, negative = parts(w)
    assert abs(value - (plus + max(0.0, negative))) < 1e-12
    assert (negative < 0) == (prior == 0.95)
    objective = (lambda w: sum(parts(w))) if negative >= 0 else (lambda w: -gamma * parts(w)[1])
    for k in range(7):
        d = np.zeros(7)
        d[k] = 1e-6
        slope = (objective(w + d) - objective(w - d)) / 2e-6 + (l2 * w[k] if k < 6 else 0)
        assert abs(slope - g[k]) < 1e-7


def test_toxicity_scores_are_sums_of_features():
    rnd = random.Random(2)
    weights = {f: rnd.random() for f in ("ab", "abcd*", "abcd*64", "abcde**", "abcde**128", "xyzu*128", "xy*")}
    model = toxicity_pu.Model(weights, -1.0)
    for _ in range(200):
        text = " ".join("".join(rnd.choice("abcdexyzu") if rnd.random() < 0.3 else "abcdexyz"[i] for i in range(rnd.randint(1, 7))) for _ in range(rnd.choice([3, 80, 200])))
        z = sum(weights.get(f, 0.0) for f in toxicity_pu.features_of(toxicity_pu.words_of(text))) - 1.0
        assert abs(model.score(text) - 1 / (1 + np.exp(-z))) < 1e-12
    assert toxicity_pu.features_of({"abcde", "abcdf", *(f"q{i}" for i in range(198))}) >= {"abcd*", "abcd*128", "abcde**"}
    assert "abcd*64" not in toxicity_pu.features_of({"abcde", "abcdf", *(f"q{i}" for i in range(198))})


def test_ngram_join_of_mixed_templates(spark, monkeypatch):
    """Texts put together from common templates, linked with nobody: once their pivots are tried, only sketches meet."""
    rnd = random.Random(31)
    templates = [" ".join(f"t{k}w{rnd.randrange(10**6)}" for _ in range(25)) for k in range(40)]
    texts = [" ".join(rnd.sample(templates, 12)) for _ in range(150)]
    copy = texts[7].split(" ")
    texts.append(" ".join(copy[:40] + ["other"] + copy[41:]))
    met, overlaps = [], ngram_join.overlaps
    monkeypatch.setattr(ngram_join, "overlaps", lambda pairs, *rest: (met.append(pairs.count()), overlaps(pairs, *rest))[1])
    got = {r.doc_id: r.component_id for r in ngram_join.classes(frame(spark, texts)).collect()}
    assert got == {i: i for i in range(150)} | {150: 7}
    assert len(met) == 3 and met[0] <= 151 and met[2] < 20


def test_sketches_bound_intersections():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 900))
        every = np.unique(rng.integers(0, 2**63, 3 * n).astype(np.uint64))
        a, b = (np.sort(rng.choice(every, int(k), False)) for k in (n, rng.integers(max(1, n * 3 // 4), min(len(every), n * 4 // 3 + 1) + 1)))
        most = ngram_join.most_shared(len(a), ngram_join.sketch(a), len(b), ngram_join.sketch(b))
        assert len(np.intersect1d(a, b)) <= most and ngram_join.most_shared(n, ngram_join.sketch(a), n, ngram_join.sketch(a)) == n


def test_toxicity_of_odd_rows(spark):
    """Null and empty texts have the score of the bias; null ids and repeated rows change nothing."""
    rnd = random.Random(9)
    texts = [" ".join(f"w{rnd.randrange(500)}" for _ in range(20)) + (" slur" if i % 8 == 0 else "") for i in range(800)]
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(800)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    rows = list(enumerate(texts))
    rows += [(9000, None), (9001, "")]
    plain = {r.doc_id: r.score for r in toxicity_pu.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    odd = toxicity_pu.toxicity(spark.createDataFrame(rows + rows[:50] + [(None, "a slur")] * 300, "doc_id long, text string"), labels).collect()
    assert {r.doc_id: r.score for r in odd if r.doc_id is not None} == plain
    assert len({r.score for r in odd if r.doc_id in (9000, 9001)}) == 1 and all(r.predicted == 0 for r in odd if r.doc_id in (9000, 9001))
    assert all(r.predicted == 1 for r in odd if r.doc_id is None) and len(odd) == 1152


def test_repeated_rows_above_the_sampling_bound(spark):
    """Where U is a sample, copies of rows move neither its rate nor the fit."""
    rnd = random.Random(10)
    rows = [(i, " ".join(f"w{rnd.randrange(300)}" for _ in range(12)) + (" slur" if i % 10 == 0 else "")) for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(0, 3000, 3)], "doc_id long, toxic int")
    train = lambda r: toxicity_pu.train(spark.createDataFrame(r, "doc_id long, text string"), labels, max_positive=40, max_unlabelled=500)
    a, b = train(rows), train(rows + rows[:1500] * 2)
    assert a.weights and a.weights == b.weights and a.bias == b.bias


def test_held_out_pages():
    model, wrong, total = html_crf.default_model(), 0, 0
    for page, labels in html_crf.labelled_pages(150, seed=99):
        own = html_crf.blocks(page)
        wrong += sum(labels.get(b.text, 0) != y for b, y in zip(own, model.viterbi(own), strict=True))
        total += len(own)
    assert wrong < 0.01 * total


def test_warc_reader_takes_pieces_and_shows_damage():
    pages = [warc.page_record(i, f"http://a/{i}", f"<p>{i}</p>" * 50, None, False) for i in range(5)]
    data = b"".join(pages)
    reader = warc.Reader()
    assert [r.payload for i in range(0, len(data), 7) for r in reader.feed(data[i : i + 7])] == [f"<p>{i}</p>".encode() * 50 for i in range(5)]
    forged = warc.record("response", [("WARC-Payload-Digest", "sha1:AAAA")], b"HTTP/1.1 200 OK\r\n\r\nx")
    assert not next(warc.Reader().feed(forged)).valid
    assert len(list(warc.Reader().feed(data[:-10]))) == 4


def test_warc_reader_survives_any_length():
    """No length crashes or stalls the reader; records before and behind a damaged header are read."""
    good = [warc.page_record(i, f"http://a/{i}", "<p>x</p>", None, False) for i in range(2)]
    plain = gzip.decompress(good[0])
    said = re.search(rb"Content-Length: (\d+)", plain)
    for bad in (b"abc", b"", b"-54", b"-1", b"1e3", b"9" * 30, b"+3", b"0x10", "²".encode(), b"99999", b"3\r\nContent-Length: 4"):
        broken = gzip.compress(plain[: said.start(1)] + bad + plain[said.end(1) :])
        reader = warc.Reader()
        assert len([r for piece in (good[0], broken, good[1]) for r in reader.feed(piece)]) == 2, bad
        assert reader.damaged >= 1
        joined = gzip.compress(plain + plain[: said.start(1)] + bad + plain[said.end(1) :] + plain)
        assert len(list(warc.Reader().feed(joined))) >= 2


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_warc_reader_on_random_damage(data):
    records = [warc.page_record(i, f"http://a/{i}", f"<p>{i}</p>", None, False) for i in range(3)]
    raw = bytearray(gzip.decompress(records[1]))
    for _ in range(data.draw(st.integers(1, 6))):
        at = data.draw(st.integers(0, len(raw) - 1))
        raw[at : at + data.draw(st.integers(0, 9))] = data.draw(st.binary(max_size=9))
    reader = warc.Reader()
    found = [r for piece in (records[0], gzip.compress(bytes(raw)), records[2]) for r in reader.feed(piece)] + list(reader.finish())
    assert [r.payload for r in found if r.valid][:1] == [b"<p>0</p>"] and found[-1].payload == b"<p>2</p>"
    assert len(found) < 3 + len(raw)


def test_pipeline_takes_effect(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    assert not any(pii_bootstrap.base_spans(r.text) for r in docs.collect())
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id for r in docs.collect()}


def test_contexts_by_a_plain_rule():
    def plain(text, start, end):
        flat = lambda w: pii_bootstrap._short(re.sub("[0-9]", "0", "".join(c.lower()[:1] for c in w)))
        before, after = text[:start].split(), text[end:].split()
        turned = lambda w: flat(w) if len(w) <= pii_bootstrap.LONG_WORD else pii_bootstrap._short(pii_bootstrap._plain(w)[::-1])
        out = [f"L {flat(before[-2])} {flat(before[-1])}"] if len(before) > 1 else []
        return out + ([f"B {flat(before[-1])} _ {turned(after[0])}"] if before and after else [])

    rnd = random.Random(12)
    for _ in range(400):
        text = "".join(rnd.choice(["1", "a", ",", " ", "x9", "@", "\n", "Σ", "İ", "long" * 20]) for _ in range(rnd.randrange(1, 60)))
        spans = [(s, e) for s, e in pii_bootstrap.tokens(text, [])]
        assert pii_bootstrap._around(text, spans) == [plain(text, s, e) for s, e in spans]


def test_contexts_inside_one_long_word_take_linear_time():
    text = "word " + "1," * 500_000
    began = time.time()
    spans = pii_bootstrap.tokens(text, pii_bootstrap.base_spans(text))
    assert len(pii_bootstrap._around(text, spans)) == 500_000 and time.time() - began < 30


def thue_morse(n, letters):
    word = letters[0]
    while len(word) < n:
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word


def test_sets_of_words_made_to_collide(spark):
    """Thue-Morse words are equal to any polynomial modulo a power of two."""
    a, b = thue_morse(512, "58"), thue_morse(512, "85")
    texts = [a, b, f"{a} x y z w", f"{b} x y z w", a]
    assert {r.doc_id: r.component_id for r in ngram_join.classes(frame(spark, texts)).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
    long = [thue_morse(4096, "58"), thue_morse(4096, "85")]
    windows = {(x[i : i + n], int(r)) for x in long for n in (64, 200, 336) for i, r in enumerate(hashing.Windows(x.encode()).of(np.arange(4096 - n + 1), n))}
    assert len({t for t, _ in windows}) == len({r for _, r in windows}) == len(windows)


def test_keys_that_clash_are_told_apart(spark):
    df = spark.createDataFrame([(i, i % 2, i // 2) for i in range(8)] + [(8, 5, 1), (9, 0, 0)], "id long, key long, check long")
    keys = {r.id: r.key for r in common.apart(df, "key", "check", common.Scratch(spark, "t")).collect()}
    assert keys[9] == keys[0] and keys[8] == 5 and len(set(keys.values())) == 9


def test_ranks_with_very_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", 2)
    monkeypatch.setattr(suffix_dedup, "PARTS", 2)
    test_suffixes(spark)
    rnd = random.Random(14)
    hot = words_of(rnd, 20, 10**6)[:140]
    texts = [f"{rnd.random()}{rnd.random()}{'left' if i % 2 else 'wide'} {hot} {'right' if i % 3 else 'wrong'} side of it all, so {rnd.random()}{rnd.random()}" for i in range(60)]
    count = collections.Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    want = {i: any(count[t[p : p + 200]] > 1 for p in range(len(t) - 199)) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_removed > 0 for r in suffix_dedup.dedup(frame(spark, texts)).collect()} == want


def test_warc_reader_finds_what_follows_damage(spark, tmp_path):
    rnd = random.Random(15)
    html = ["".join(rnd.choices("abcdefgh <>", k=3000)) for _ in range(4)]
    r = [warc.page_record(i, f"http://a/{i}", h, None, False) for i, h in enumerate(html)]
    ids = lambda records: [int(x.headers["x-page-id"]) for x in records]

    def read(data, piece):
        reader = warc.Reader()
        return ids([x for i in range(0, len(data), piece) for x in reader.feed(data[i : i + piece])] + list(reader.finish()))

    segments = [r[0] + r[1][:200], r[2] + r[3]]
    reader = warc.Reader()
    assert ids([x for s in segments for x in reader.feed(s)]) == [0, 2, 3]
    for cut in (1, 2, 3, 12, 700, len(r[1]) - 1):
        for piece in (1, 2, 3, 7, 500, 1 << 16):
            assert read(r[0] + r[1][:cut] + r[2] + r[3], piece) == [0, 2, 3], (cut, piece)
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    swallowing = stored.compress(b"x" * 60_000) + stored.flush()
    assert read(r[0] + swallowing[:30] + r[2] + r[3], 100) == [0, 2, 3]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(r))
    (tmp_path / "b.warc.gz").write_bytes(r[0] + r[1][:200] + r[2])
    rows = warc.read_files(spark, f"file://{tmp_path}").collect()
    assert sorted((x.page_id, bytes(x.payload)) for x in rows) == sorted((i, html[i].encode()) for i in (0, 1, 2, 3, 0, 2)) and all(x.valid for x in rows)


def test_ogg_pages_without_segments_and_packets():
    a, b = b"a" * 255 * 3, b"b" * 100
    page = lambda n, granule, flags, lacing, body: ogg.write_page(7, n, granule, flags, bytes(lacing), body)
    media = page(0, -1, ogg.FIRST, [255, 255], a[:510]) + page(1, -1, ogg.CONTINUED, [], b"") + page(2, 3, ogg.CONTINUED, [255, 0, 100], a[510:] + b)
    s = ogg.demux(media)[0][7]
    assert (s.packets, s.granules, s.lost) == ([a, b], [-1, 3], 0)
    media = page(0, 3, ogg.FIRST, [100], b) + page(1, 9, 0, [255, 255], a[:510]) + page(2, 12, ogg.CONTINUED, [255, 0], a[510:])
    s = ogg.demux(media)[0][7]
    assert (s.packets, s.granules, s.lost) == ([b, a], [3, 12], 0)


def test_ogg_columns_of_odd_rows(spark):
    """Every column of the contract, worked out again from its words."""
    texts = ["", None, "é" * 64, "x" * 64, "y" * 65, "word " * 30_000, "word " * 30_000]
    rows = {r.doc_id: r for r in ogg.media_features(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        media = ogg.mux(payload, len(raw))
        assert tuple(rows[i])[1:7] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert f"seconds={len(payload) / ogg.RATE:.6f}" in rows[i].feature and "bad_pages=0;lost=0" in rows[i].feature
    assert rows[5][1:] == rows[6][1:] and rows[0][1:] == rows[1][1:]


def test_decontamination_of_text_ids(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    bench = table(spark, sf, "benchmark", "item_id", "text")
    named = bench.selectExpr("concat('item', item_id) as item_id", "text")
    for limit in (decontaminate.MAX_PATTERN_BYTES, 3000):
        a = {r.doc_id: r["items"] for r in decontaminate.contaminated_ranges(docs, bench, limit=limit).collect()}
        b = {r.doc_id: r["items"] for r in decontaminate.contaminated_ranges(docs, named, limit=limit).collect()}
        assert b == {i: sorted(f"item{x}" for x in v) for i, v in a.items()} and any(a.values())


def test_viterbi_like_enumeration():
    rnd, rng = random.Random(16), np.random.default_rng(16)
    pages = [html_crf.blocks(p) for p, _ in html_crf.labelled_pages(12, seed=5)]
    names = sorted({f for b in pages for k in range(len(b)) for f in html_crf.features(b, k)})
    for b in pages:
        b = b[: rnd.randint(1, 9)]
        model = html_crf.Crf({f: i for i, f in enumerate(names)}, rng.normal(size=(len(names), 2)), rng.normal(size=(2, 2)))
        s = model.scores([html_crf.features(b, k) for k in range(len(b))])

        def total(y, s=s, model=model):
            return sum(s[k, v] for k, v in enumerate(y)) + sum(model.move[a, c] for a, c in itertools.pairwise(y))

        assert abs(total(model.viterbi(b)) - max(map(total, itertools.product((0, 1), repeat=len(b))))) < 1e-9


def test_likelihood_and_gradient_by_enumeration():
    pages = [(b[:5], [int(i % 3 == 1) for i in range(len(b[:5]))]) for b in (html_crf.blocks(p) for p, _ in html_crf.labelled_pages(4, seed=6))]
    pages[1] = (pages[1][0][:2], pages[1][1][:2])
    sample, rng = html_crf.Sample(pages), np.random.default_rng(17)
    w, l2 = rng.normal(size=2 * sample.d + 4) * 0.3, 0.01

    def slow(w):
        model, total = html_crf.Crf(sample.at, w[:-4].reshape(-1, 2), w[-4:].reshape(2, 2)), 0.0
        for b, gold in pages:
            s = model.scores([html_crf.features(b, k) for k in range(len(b))])
            score = lambda y, s=s: sum(s[k, v] for k, v in enumerate(y)) + sum(model.move[a, c] for a, c in itertools.pairwise(y))
            total += np.logaddexp.reduce([score(y) for y in itertools.product((0, 1), repeat=len(b))]) - score(gold)
        return total / len(pages) + l2 / 2 * (w @ w)

    value, g = sample.loss(w, l2)
    assert abs(value - slow(w)) < 1e-9
    for k in [*rng.integers(0, len(w), 12).tolist(), *range(len(w) - 4, len(w))]:
        d = np.zeros(len(w))
        d[k] = 1e-5
        assert abs((slow(w + d) - slow(w - d)) / 2e-5 - g[k]) < 1e-6


def test_blocks_of_deep_pages():
    """No depth hides an end tag: hidden text stays hidden, boilerplate stays where it is."""
    for n in (10, 600, 30_000):
        page = "<div>" * n + "<noscript><div>hidden</div></noscript><nav class='menu'><div>menu</div></nav><p>seen</p>" + "</div>" * n + "<p>after</p>"
        got = html_crf.blocks(page)
        assert [b.text for b in got] == ["menu", "seen", "after"] and "nav" in got[0].tags and "nav" not in got[1].tags and got[2].tags == ("p",)
    names = "".join(f"<div class='c{chr(97 + i % 26)}x{i}'>" for i in range(20_000))
    assert html_crf.extract(names + "<article><p>A text of some length, and with an end.</p></article>", html_crf.default_model())
    assert len(html_crf.blocks("<b>" * 20_000 + "</section>" * 20_000 + "<p>x</p>")) == 1
    assert html_crf.blocks(f"<div class='{'a' * 300} sidebar'>x</div>")[0].names[-1] == "sidebar"
    long = html_crf.blocks("<p>" + "word " * 200 + "cookies privacy newsletter</p>")
    assert "cues=2" in html_crf.features(long, 0)


def slow_bootstrap(mentions):
    """Rounds over sets, as the words of the module say."""
    pairs = {}
    for p, i, k in mentions:
        pairs[p, i] = max(pairs.get((p, i), -1), k)
    seeds = {}
    for (_, i), k in pairs.items():
        if k >= 0:
            seeds[i] = max(seeds.get(i, -1), k)
    size, trusted, rounds = collections.Counter(p for p, _ in pairs), dict(seeds), 0
    while True:
        rounds += 1
        support = collections.Counter((p, trusted[i]) for p, i in pairs if i in trusted)
        good = {(p, k): n / size[p] for (p, k), n in support.items() if n >= pii_bootstrap.MIN_SUPPORT and n / size[p] >= pii_bootstrap.MIN_PRECISION}
        best = {}
        for _, i in sorted(pairs):
            for k in range(4):
                own = [v for (p, kk), v in good.items() if kk == k and (p, i) in pairs]
                score = 1 - np.prod([max(1 - v, 0.02) for v in own]) if own else 0
                if score >= pii_bootstrap.MIN_INSTANCE and score > best.get(i, (0, 0))[0] + 1e-12:
                    best[i] = (score, k)
        new = {i: k for i, (_, k) in best.items() if i not in trusted}
        if not new:
            return {i: k for i, k in trusted.items() if i not in seeds}, rounds
        trusted |= new


def test_bootstrap_like_brute_force(spark):
    rnd = random.Random(18)
    chain = [(f"p{k}", f"n{j}", -1) for k in range(1, 7) for j in range(5 * k - 5, 5 * k + 5)]
    mentions = [("p0", f"s{j}", 3) for j in range(30)] + [("p0", f"n{j}", -1) for j in range(5)] + [(f"q{k}", f"n{j}", -1) for k in range(6) for j in range(5 * k, 5 * k + 5)]
    mentions += [(f"q{k}", f"s{j}", 3) for k in range(6) for j in range(30)] + chain
    mentions += [(f"r{rnd.randrange(12)}", f"i{rnd.randrange(40)}", rnd.choice([-1, 0, 1, 3])) for _ in range(400)]
    want, rounds = slow_bootstrap(mentions)
    got = pii_bootstrap.bootstrap(spark.createDataFrame(mentions, "pattern string, instance string, kind int"))
    assert {r.instance: r.kind for r in got.collect()} == want and want


def test_identifiers_of_later_rounds(spark):
    """Each round's finds carry the next pattern; the last lies beyond three rounds."""
    mentions = [(f"p0{c}", f"s{j}", 3) for j in range(40) for c in "ab"]
    for k in range(6):
        for c in "ab":
            mentions += [(f"p{k}{c}", f"n{k}_{j}", -1) for j in range(5)] + [(f"p{k + 1}{c}", f"n{k}_{j}", -1) for j in range(5)]
    mentions += [(f"p{k}{c}", f"s{j}", 3) for k in range(1, 7) for j in range(3 * k) for c in "ab"]
    want, rounds = slow_bootstrap(mentions)
    got = {r.instance: r.kind for r in pii_bootstrap.bootstrap(spark.createDataFrame(mentions, "pattern string, instance string, kind int")).collect()}
    assert got == want and want


def test_grouped_short_and_long_identifiers(spark):
    numbers = [f"+1 (988) 555-2{i}5" for i in range(10, 50)]
    long = "z" * 200
    texts = [f"please call me under number {n} thanks {long} a" for n in numbers] + [f"please call me under number {x} thanks {long} a" for x in ("DE89 3704 0044 0532", "x7", "k" * 80 + "1")]
    found = {r.doc_id: [tuple(s)[1:] for s in r.spans] for r in pii_bootstrap.find(frame(spark, texts)).collect()}
    at = len("please call me under number ")
    assert found[40] == [(at, at + 19)] and found[41] == [(at, at + 2)] and found[42] == [(at, at + 81)]
    assert pii_bootstrap._around("a " + "b" * 100 + "1 x@", 104, 106) == ["L a " + pii_bootstrap._short("b" * 100 + "0")]
    assert pii_bootstrap.tokens("in 7 of 12 13 cases", []) == [(3, 4), (8, 10), (11, 13), (8, 13)]


def test_personal_data_of_odd_rows(spark):
    texts = [None, "", "a@b.cd" * 3, "1 " * 50_000 + "x@y.zz", "x@y.zz", "x@y.zz"]
    rows = {r.doc_id: r for r in pii_bootstrap.digests(pii_bootstrap.find(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        spans = ",".join(f"{pii_bootstrap.KINDS[k]}:{s}:{e}" for k, s, e in pii_bootstrap.base_spans(t))
        assert rows[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest() and rows[i].spans == spans
    assert rows[0].n_email == 0 and rows[3].n_email == 1 and rows[4][1:] == rows[5][1:]


def test_real_pages_by_another_rule(sf):
    """The given pages mark their article; block F1 against that mark, of a model that never saw them."""
    import pyarrow.parquet as pq

    model, hit, said, true = html_crf.default_model(), 0, 0, 0
    for page in pq.read_table(f"{sf}/pages.parquet", columns=["html"]).column(0).to_pylist():
        inside = re.findall(r"<article.*?</article>", page or "", re.S)
        want = collections.Counter(b.text for part in inside for b in html_crf.blocks(part))
        b = html_crf.blocks(page)
        got = collections.Counter(x.text for x, y in zip(b, model.viterbi(b), strict=True) if y)
        hit, said, true = hit + sum((want & got).values()), said + sum(got.values()), true + sum(want.values())
    assert true > 100 and 2 * hit / (said + true) > 0.99


PROSE = ["Prose that goes on for a while, with commas, and ends here.", "Another paragraph of some length follows the first one; it says more.", "The third paragraph isn't long.", "A fourth one, of words and of marks, stands here too.", "The last paragraph ends the page."]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in PROSE)


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><article>{PARAGRAPHS}</article>",
        f"<title>t</title><meta charset=x><link href=y>{PARAGRAPHS}",
        f"<head><style>p {{}}</style><script>var a</script>{PARAGRAPHS}",
        f"<body><!--><article>{PARAGRAPHS}</article>",
        f"<body><!---><article>{PARAGRAPHS}</article>",
        f"<body><!-- <p>no</p> --!><article>{PARAGRAPHS}</article>",
        f"<body><article><svg><path><title>icon</title>{PARAGRAPHS}</article>",
        f"<body><article><math><mi>{PARAGRAPHS}</article>",
        f"<body><article><svg><foreignObject><p>drawn</p></foreignObject></svg>{PARAGRAPHS}</article>",
        f"<body>{PARAGRAPHS}</body>",
        f"<body><div>{PARAGRAPHS}</div></body>",
        f"<body><div class='zorblax'>{PARAGRAPHS}</div></body>",
        "<body>" + "".join(f"<div>{x}</div>" for x in PROSE),
        f"<body><ul class=menu><li><a href=x>Home</a><li><a href=y>News</a></ul>{PARAGRAPHS}",
        f"<article><p style='color:red; display: none'>Secret text is here.</p><p hidden>Also</p><div aria-hidden=true><p>x</p></div>{PARAGRAPHS}</article>",
    ],
)
def test_pages_that_leave_tags_out(page):
    assert html_crf.extract(page, html_crf.default_model()) == "\n".join(PROSE)


def test_given_articles_by_another_parser(sf):
    """The texts of the given pages' <article> elements as Python's own parser reads them."""
    from html.parser import HTMLParser

    import pyarrow.parquet as pq

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.off, self.lines, self.now = 0, 0, [], []

        def _end(self):
            self.lines.append(" ".join("".join(self.now).split()))
            self.now = []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.off += tag in ("script", "style")
            if tag not in ("a", "b", "i", "em", "strong", "span", "code"):
                self._end()

        def handle_endtag(self, tag):
            if tag not in ("a", "b", "i", "em", "strong", "span", "code"):
                self._end()
            self.depth -= tag == "article"
            self.off -= tag in ("script", "style")

        def handle_data(self, data):
            if self.depth and not self.off:
                self.now.append(data)

    model, same, n = html_crf.default_model(), 0, 0
    for page in pq.read_table(f"{sf}/pages.parquet", columns=["html"]).column(0).to_pylist():
        if page and "<article" in page and "</article" in page:
            parser = Article()
            parser.feed(page)
            parser.close()
            n += 1
            same += html_crf.extract(page, model) == "\n".join(x for x in parser.lines if x)
    assert n > 20 and same > 0.97 * n


def test_held_out_plain_pages():
    model, hit, said, true = html_crf.default_model(), 0, 0, 0
    for page, labels in html_crf.labelled_pages(100, seed=98, plain=1.0):
        b = html_crf.blocks(page, model.knows)
        found, want = ({k for k, x in enumerate(b) if y(k, x)} for y in (lambda k, x, got=model.viterbi(b): got[k], lambda k, x, labels=labels: labels.get(x.text)))
        hit, said, true = hit + len(found & want), said + len(found), true + len(want)
    assert 2 * hit / (said + true) > 0.98


def test_quotations_like_the_sql(spark):
    """Random conversations that quote whole messages, paragraphs, lines and runs of lines, against DuckDB."""
    import duckdb
    import pyarrow as pa

    from stratiform.llm.oracles import OP7

    rnd = random.Random(20)
    rows = []
    for conv in range(25):
        said = []
        for turn in range(rnd.randint(2, 9)):
            lines = [rnd.choice(["yes", "No  way", "", "a longer line here", f"line {rnd.randrange(30)}"]) for _ in range(rnd.randint(1, 6))]
            for _ in range(rnd.randint(0, 2) if said else 0):
                old = rnd.choice(said)
                i, j = sorted((rnd.randrange(len(old)), rnd.randrange(len(old))))
                lines = ["> " * rnd.choice([1, 1, 2]) + (x.upper() if rnd.random() < 0.2 else x) for x in old[i : j + 1]] + lines
            said.append([x for x in lines if not x.startswith(">")] or [""])
            rows.append((conv, turn, "u", "\n".join(lines)))
    rows += [(3, 0, "u", "line 1"), (3, None, "u", "> yes"), (None, 1, "u", "> yes"), (4, 50, "u", None)]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    con = duckdb.connect()
    con.register("conversations", pa.Table.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows], schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])))
    want = con.execute(OP7).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and sum(r.n_linked for r in got) > 20


def test_quotations_of_runs_of_lines(spark):
    rows = [(1, 0, "u", "one\ntwo\n\nthree\nfour"), (1, 1, "u", "else"), (1, 2, "u", "> TWO\n> three\nwhat?"), (1, 3, "u", "> two\n> four\nno")]
    got = {r.turn: (r.n_quotes, r.n_linked, r.reply_to) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (0, 0, None), 1: (0, 0, 0), 2: (1, 1, 0), 3: (1, 0, 2)}


def test_words_that_come_again_are_remembered(monkeypatch):
    """Making room keeps the words met again, which are not replayed anew."""
    v = bpe_replay.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    v.cache, v.met = {}, set()
    monkeypatch.setattr(bpe_replay, "CACHE_WORDS", 60)
    seen, plain = [], v._entries
    monkeypatch.setattr(v, "_entries", lambda words: seen.extend(words) or plain(words))
    often = " ".join(f"oftzqx{chr(97 + i)}k" for i in range(20))
    texts = [often + " " + " ".join(f"onczqx{chr(97 + k)}{chr(97 + i)}w" for i in range(20)) for k in range(12)]
    got = [v.digests([t])[0] for t in texts]
    assert sum(w.strip().startswith("oftzqx") for w in seen) == 20 and len(v.cache) <= 60
    v.cache, v.met = {}, set()
    assert got == v.digests(texts)


def test_contexts_and_strings_of_many_anchors_at_once():
    """Contexts are put together from 64-byte ranks at the anchors only; strings of all anchors come in one go."""
    rnd = random.Random(21)
    text = rnd.randbytes(5000)
    other = rnd.randbytes(700) + text[1000:3000] + rnd.randbytes(90)
    a, b = (next(suffix_dedup._pieces(x)) for x in (text, other))
    every = [np.arange(len(x.place)) for x in (a, b)]
    contexts = [x.contexts(k) for x, k in zip((a, b), every, strict=True)]
    assert len(a.windows._ranks) == 4
    held = lambda x, data, k: data[max(0, x.place[k] - 136) : x.place[k] + 200]
    equal = [(i, j) for i in every[0] for j in every[1] if contexts[0][i] == contexts[1][j]]
    assert equal == [(i, j) for i in every[0] for j in every[1] if held(a, text, i) == held(b, other, j)] and len(equal) > 10
    owner, off, rank = a.strings_of(every[0][3:9])
    for n, k in enumerate(range(3, 9)):
        p = np.arange(a.lo[k], a.hi[k] + 1)
        assert off[owner == n].tolist() == (a.place[k] - p).tolist() and rank[owner == n].tolist() == a.windows.of(p, 200).tolist()

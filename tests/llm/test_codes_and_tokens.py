"""Vector codes, token alignment and token counts against plain versions and the libraries."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratiform.llm import token_alignment, token_counts, vector_codes

WORDS, A, B = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "  two  spaces ", "\ttab\r\n", "<|endoftext|>", "a<|startoftext|><|endoftext|>b <|endoftext", "Don't DON'T we'LL", "ÉÀ é ﬁ İ Σς ΑΣ", "日本語 한글 नमस्ते", "😀👩‍👩", "▁x", "\x00\x1c\x85\xa0 x", "1234567890 ½ ٣", "a" * 700, "ab" * 900, "!!!!!" * 300, "<s>x</s><unk>"]


def random_texts(n, seed=3):
    rnd = random.Random(seed)
    pool = "abcAB'  éßΣж日한😀́\t\n0٣.,<|>"
    return ["".join(rnd.choice(pool) for _ in range(rnd.randrange(80))) for _ in range(n)] + ["".join(rnd.choice("abc") for _ in range(3000))]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_counts_are_the_librarys(library):
    texts = ODD + random_texts(3000) + ["".join(map(chr, range(a, a + 64))) for a in range(0, 0xD800, 64)]
    assert token_counts.Counter(WORDS).counts(texts) == library(texts)


def test_counts_of_a_text_read_in_pieces(library, monkeypatch):
    texts = [" ".join(random_texts(300, s)) for s in range(3)]
    monkeypatch.setattr(token_counts, "PIECE", 50)
    monkeypatch.setattr(token_counts, "SYMBOLS", 64)
    monkeypatch.setattr(token_counts, "LONG", 9)
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 100)
    c = token_counts.Counter(WORDS)
    assert [c.counts([t])[0] for t in texts] == library(texts)


def test_rounds_are_single_merges():
    """Ragged rounds and linked rounds against one merge at a time, on a made vocabulary full of repeats."""
    rnd = random.Random(5)
    parts, merges = list("abc"), []
    while len(merges) < 60:
        a, b = rnd.choice(parts), rnd.choice(parts)
        if a + b not in parts and len(a + b) < 9:
            merges.append((a, b))
            parts.append(a + b)
    m = token_counts.Merges({p: i for i, p in enumerate(parts)}, merges, "")
    ranks = {p: i for i, p in enumerate(merges)}

    def plain(word):
        s = list(word)
        while True:
            best = min(((ranks[p], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in ranks), default=None)
            if best is None:
                return len(s)
            s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]

    words = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 40))) for pool in ("a", "ab", "abc") for _ in range(300)]
    assert m.counts(words).tolist() == [plain(w) for w in words]
    assert [m._linked(m._symbols([w], np.array([len(w)]))) for w in words] == [plain(w) for w in words]


def test_disordered_merges_are_refused():
    with pytest.raises(ValueError):
        token_counts.Merges({"a": 0, "b": 1, "ab": 2, "aba": 3}, [("ab", "a"), ("a", "b")], "")


def test_count_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x y"), (3, None), (4, "tab"), (4, "tab"), (99, "word " * 2048), (100, "word " * 2049)]
    got = token_counts.token_counts(spark.createDataFrame([(i, t, "o") for i, t in rows], "doc_id long, text string, TEXT string"), WORDS)
    want = [(i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, library([t or "" for _, t in rows]), strict=True)]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert [r.over_limit for r in got.collect() if r.doc_id in (99, 100)] == [False, True]
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), WORDS).collect() == []


def plain_alignment(rows):
    al = token_alignment.aligner(A, B)
    docs, counts = [], Counter()
    for i, t in rows:
        t = t or ""
        a, b = al.a.encode(" " + t, add_special_tokens=False).ids, al.b.encode(t)
        raw = b" " + t.encode()
        if not t or b"".join(al.bytes_a[x] for x in a) != raw or b"".join(al.bytes_b[x] for x in b) != raw:
            docs.append((i, [], [], [], []))
            continue
        at, ends = 0, []
        for own, table in ((a, al.bytes_a), (b, al.bytes_b)):
            at, e = 0, []
            for x in own:
                at += len(table[x])
                e.append(at)
            ends.append(e)
        links = [(a[p], b[q]) for p, e in enumerate(ends[0]) for q, f in enumerate(ends[1]) if e == f] if len(a) < 400 else [(a[ends[0].index(e)], b[ends[1].index(e)]) for e in sorted(set(ends[0]) & set(ends[1]))]
        counts.update(links)
        groups, last = [], 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            groups.append((",".join(str(x) for x, f in zip(a, ends[0], strict=True) if last < f <= e), ",".join(str(x) for x, f in zip(b, ends[1], strict=True) if last < f <= e)))
            last = e
        docs.append((i, a, b, groups, links))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return [
        (i, len(a), len(b), len(g), len(k), sum(counts[p] == top[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join("|".join(x) for x in g).encode()).hexdigest() if a else "")
        for i, a, b, g, k in docs
    ]


@pytest.mark.parametrize("heavy", [4, 1 << 20])
def test_alignment(spark, sf, heavy):
    rows = [(i, t) for i, t in enumerate(ODD + random_texts(60))] + [(None, "one two"), (None, None), (7, "one two"), (7, "one two")]
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 1500").limit(60).collect()]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_links int").repartition(3)
    got = token_alignment.align(df, A, B, heavy=heavy)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain_alignment(rows)))


def test_alignment_of_nothing(spark):
    for rows in ([], [(1, None), (2, "")]):
        got = token_alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
        assert sorted(tuple(r) for r in got) == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]


def test_links_of_a_long_text():
    """Documents laid end to end give what each gives alone."""
    al = token_alignment.aligner(A, B)
    own = al.encode([" ".join(random_texts(400, 8)).replace("  ", " "), "x", "one two three"])
    x, y, bounds, n, digests = al.align(*own[1:])
    cut = lambda ids, sizes: np.split(ids, np.cumsum(sizes)[:-1])
    alone = [al.align(p, np.array([len(p)]), q, np.array([len(q)])) for p, q in zip(cut(own[1], own[2]), cut(own[3], own[4]), strict=True)]
    assert digests == [d[4][0] for d in alone] and n.tolist() == [int(d[3][0]) for d in alone]
    assert x.tolist() == [v for d in alone for v in d[0].tolist()] and y.tolist() == [v for d in alone for v in d[1].tolist()]


def test_remembered_chunks_change_no_ids(sf):
    """Texts encoded together, again, and after everything was forgotten, against both libraries on the whole texts."""
    import pyarrow.parquet as pq

    al = token_alignment.Aligner(A, B)
    texts = [t or "" for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column(0).to_pylist()][:60] + ODD + random_texts(200, 5) + [" ".join(ODD), "long" * 50 + " tail", "x  ", "x "]
    full = [t for t in texts if t]
    want = []
    for t in full:
        a, b = al.a.encode(" " + t, add_special_tokens=False).ids, al.b.encode(t)
        raw = (" " + t).encode()
        if b"".join(al.bytes_a[i] for i in a) == raw == b"".join(al.bytes_b[i] for i in b):
            want.append((t, a, b))
    for known in (400_000, 400_000, 50):
        token_alignment.REMEMBERED, before = known, token_alignment.REMEMBERED
        kept, a, n_a, b, n_b = al.encode(texts)
        token_alignment.REMEMBERED = before
        cut = lambda ids, sizes: [v.tolist() for v in np.split(ids, np.cumsum(sizes)[:-1])]
        assert [(texts[i], x, y) for i, x, y in zip(kept, cut(a, n_a), cut(b, n_b), strict=True)] == want


def plain_codes(rows):
    """The contract in Python integers: rows (id, vector, label) of one length, a multiple of eight."""
    kept = [(i, [math.floor(4096 * x) if abs(x) < 2**60 else int(x) * 4096 for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // 8
    part = lambda v, p: v[p * w : (p + 1) * w]
    first = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    books = [[part(v, p) for v in list(first.values())[:16]] for p in range(8)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            held = {}
            for _, v, _ in kept:
                held.setdefault(best(part(v, p), books[p])[1], []).append(part(v, p))
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])]
    out, sums = [], Counter()
    for i, v, c in kept:
        found = [best(part(v, p), books[p]) for p in range(8)]
        e = sum(d for d, _ in found)
        sums[c] += e
        out.append((i, "".join(f"{k:02x}" for _, k in found), e, c))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, e, sums[c], sha) for i, code, e, c in out]


SCHEMA = "vec_id long, embedding array<double>, label int, code int, EMBEDDING string"


def codes(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(map(str, (tuple(r) for r in vector_codes.vector_codes(df, **more).collect())))


def vector_rows(n, dim=16, seed=4):
    rnd = random.Random(seed)
    return [(i, [rnd.gauss(0, 0.5) for _ in range(dim)], rnd.choice([None, 1, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("heavy", [1, 4096])
def test_codes(spark, heavy):
    rows = vector_rows(200)
    odd = [(500, None, 1), (501, [float("nan")] * 16, 1), (502, [float("inf")] + [0.0] * 15, 2), (503, [None] + [0.0] * 15, 2), (None, rows[3][1], 1), (None, rows[4][1], 1), (5, rows[5][1], 3), (5, rows[5][1], 3)]
    assert codes(spark, rows + odd, heavy=heavy) == sorted(map(str, plain_codes(rows + odd)))


def test_codes_of_few_and_of_equal_vectors(spark):
    for rows in (vector_rows(5), [(i, [0.25] * 8, 1) for i in range(40)], [(None, [0.5] * 8, None)], [(1, [], 1), (2, [], None)]):
        assert codes(spark, rows) == sorted(map(str, plain_codes(rows)))
    assert vector_codes.vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert codes(spark, [(1, None, 1)]) == []


def test_codes_beyond_64_bits(spark):
    rows = vector_rows(30) + [(100, [1e30] + [0.0] * 15, 7), (101, [3e5] * 16, 8), (102, [-(2.0**55)] * 16, 9)]
    want = [(i, c, e if e < 1 << 63 else None, s, h) for i, c, e, s, h in plain_codes(rows)]
    got = codes(spark, rows)
    assert len(got) == 33 and [g.split(",")[:3] for g in got] == [str(w).split(",")[:3] for w in sorted(want, key=str)]


def test_codes_of_other_lengths(spark):
    """A vector of another length has no code; one of a length that isn't a multiple of eight is padded."""
    rows = vector_rows(40, 11)
    padded = [(i, v + [0.0] * 5, c) for i, v, c in rows]
    assert codes(spark, rows) == codes(spark, padded)
    other = codes(spark, rows + [(5000, [1.0] * 16, None)])
    assert [o for o in other if not o.startswith("(5000")] == codes(spark, rows) and any(o.startswith("(5000, None, None") for o in other)


def test_codes_use_floats_as_they_are(spark):
    rows = [(i, [np.float32(x).item() for x in v], c) for i, v, c in vector_rows(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(str, (tuple(r) for r in vector_codes.vector_codes(df).collect()))) == sorted(map(str, plain_codes(rows)))

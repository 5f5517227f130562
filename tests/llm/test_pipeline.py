"""The pipeline's stages against plain Python, on rows with nulls, shared ids, copies and clashing columns."""

import random

import corpus_pipeline as P
import pytest

from stratiform.llm import pii_bootstrap, toxicity_pu
from stratiform.llm.common import pick, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, key string"


def prose(rnd, n):
    return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows(sf, spark):
    rnd = random.Random(3)
    base, other = prose(rnd, 80), prose(rnd, 60)
    near = base.rsplit(" ", 2)[0]
    passage = table(spark, sf, "benchmark", "text").first()[0]
    texts = [
        (-5, near), (1, base), (1, base), (1, other), (2, base), (None, base), (None, base), (9223372036854775807, near), (-9223372036854775808, prose(rnd, 50)),
        (3, passage), (None, passage), (4, prose(rnd, 3) + " " + passage), (4, prose(rnd, 30)), (5, None), (5, None), (6, ""), (None, None),
        (7, "write to a.b@example.org or +1 (988) 555-2425 now"), (None, "write to a.b@example.org"), (8, prose(rnd, 40_000)),
    ]
    return [(i, t, "en", f"s{k}", None if t is None else len(t), "other", "k") for k, (i, t) in enumerate(texts)]


def plain(rows):
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def near_copies(rows):
    """Rows equal in id and text once; of each group the smallest (id, text digest)."""
    import hashlib

    known = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[2], r[3], r[4] or -1)):
        known.setdefault((r[0], hashlib.md5((r[1] or "").encode()).hexdigest()), r)
    keys = sorted(known)
    sets = {k: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (known[k][1] or "").split()) else None for k in keys}
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [known[k] for k in keys if find(k) == k] + [r for r in rows if r[0] is None]


def test_near_copies_like_brute_force(spark, sf, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert plain(P.drop_near_copies(spark, docs, sf).collect()) == plain(near_copies(rows))


def test_contaminated_rows_go_whatever_their_id(spark, sf, rows):
    got = P.drop_contaminated(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()
    assert plain(got) == plain([r for r in rows if r[3] not in ("s9", "s10", "s11")])


def test_toxic_rows_go(spark, sf, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    real = table(spark, sf, "documents")
    both = real.selectExpr("doc_id + 100 as doc_id", "text", "lang", "source", "n_chars").unionByName(pick(docs, *P.COLUMNS))
    labels = table(spark, sf, "labels", "doc_id", "toxic").selectExpr("doc_id + 100 as doc_id", "toxic")
    model = toxicity_pu.train(both, labels)
    got = toxicity_pu.keep_clean(both, model).collect()
    assert plain(got) == plain([r for r in both.collect() if model.score(r.text) < toxicity_pu.THRESHOLD])


def test_personal_data_is_masked(spark, sf, rows):
    got = {r.source: r for r in P.mask_personal_data(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()}
    assert got["s17"].text == "write to [email] or [phone] now" and got["s17"].n_chars == len(got["s17"].text) and got["s18"].text == "write to [email]"
    for r in rows:
        if not pii_bootstrap.base_spans(r[1]):
            assert tuple(got[r[3]]) == tuple(r[:5])


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_on_empty_tables(spark, sf, rows, name):
    stage = dict(P.STAGES)[name]
    out = stage(spark, spark.createDataFrame(rows, SCHEMA).limit(0), sf)
    assert out.collect() == [] and (name == "tokens" or out.columns == list(P.COLUMNS))


def test_run_leaves_only_its_result(spark, sf):
    import os

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:").replace("//", "/")
    out = P.run(spark, sf)
    assert out.count() > 0
    left = [os.listdir(f"{root}/{d}") for d in os.listdir(root) if d.startswith("pipeline-")]
    assert max(map(len, left)) == 1

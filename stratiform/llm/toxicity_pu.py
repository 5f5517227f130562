"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over words, word prefixes and the share of a text's words that begin with a prefix
is trained in numpy from confirmed toxic texts (P) and unlabelled texts (U). U is drawn from all texts
by a hash of its own, whatever their labels, so the share of toxic texts in it is that of the corpus
however large P is; a text may be in both. The risk is ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``
with the sigmoid loss: where the second part falls below 0, the step goes the other way, so the
classifier can't win by calling every unlabelled text clean. The class prior is the share of toxic
rows among the labels of the training folds.

The fit takes about ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` texts at most, drawn by a hash of the id at a rate
made of the number of distinct ids; their distinct features go to the driver. Labels are drawn first
(a table of about ``MAX_POSITIVE`` ids, the only thing that is broadcast), so documents are neither shuffled
nor sorted. Every whole text is scored.

Defined cases: a null or empty text has no feature, its score is that of the bias; a null id is in no
held-out fold, has no label and is not learnt from; null labels are ignored; an id with both labels
counts as toxic. Without any positive label the score is 0 everywhere. Repeated rows count once in the
fit, in its sampling rate, too, and pass through the scoring. Empty texts with an id are unlabelled texts like
others and belong to U; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.llm import common as C
from stratiform.llm.ogg import _arrow_type

MAX_POSITIVE = 3_000
MAX_UNLABELLED = 12_000
#: Features that fewer positive texts hold are left out, and those that aren't clearly more frequent
#: in P than in U: so many texts, such a share of P, so many standard errors, so many times. Clean features are as frequent in both.
MIN_DF, MIN_SHARE, MIN_Z, MIN_RATIO = 3, 0.005, 5.0, 2.0
STEPS = 300
#: Lower, and texts with one telling word would lie where the loss is flat.
MIN_BIAS = -2.0
RATE = 0.1
L2 = 1e-4
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2

#: Lengths of the prefixes and the marks that tell them from words.
PREFIXES = ((4, "*"), (5, "**"))
#: A prefix that begins one in so many of the distinct words of a text is a feature of its own: inflected
#: words share prefixes with clean ones, and only their frequency tells them apart.
SHARES = (64, 128)

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased words."""
    return set(_WORD.findall((text or "").lower()))


def features_of(words: set[str]) -> set[str]:
    """The words, their prefixes marked by stars, and those prefixes that reach a share of the words."""
    out = set(words)
    for size, mark in PREFIXES:
        out.update(_marked(Counter(w[:size] for w in words), mark, len(words)))
    return out


def _marked(prefixes: Counter[str], mark: str, n: int) -> Iterator[str]:
    for p, k in prefixes.items():
        yield p + mark
        for share in SHARES:
            if share * k >= n:
                yield f"{p}{mark}{share}"


def held_out(id_col: str) -> F.Column:
    """The fold whose labels are never learnt from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


class Rows:
    """Binary sparse rows: the features of all rows in one array."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.n = len(rows)
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.at = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(self.sizes.sum()))
        self.row = np.repeat(np.arange(self.n), self.sizes)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, weights=g[self.row], minlength=size)


def _loss(z: np.ndarray) -> np.ndarray:
    """Sigmoid loss: bounded, and loss(z) + loss(-z) = 1."""
    return 1 / (1 + np.exp(np.clip(z, -50, 50)))


def _slope(z: np.ndarray) -> np.ndarray:
    x = _loss(z)
    return -x * (1 - x)


def risk(w: np.ndarray, positive: Rows, unlabelled: Rows, prior: float, l2: float = L2, beta: float = 0.0, gamma: float = 1.0) -> tuple[float, np.ndarray]:
    """The corrected risk of weights and bias (the last of ``w``), and the direction to step against: its gradient, or where the negative part fell below ``-beta`` that of its negative part, turned round."""
    size = len(w) - 1
    sp, su = positive.dot(w[:-1]) + w[-1], unlabelled.dot(w[:-1]) + w[-1]
    negative = _loss(-su).mean() - prior * _loss(-sp).mean()
    down_u, down_p = -_slope(-su) / unlabelled.n, prior * _slope(-sp) / positive.n
    if negative >= -beta:
        down_p = down_p + prior * _slope(sp) / positive.n
    else:
        down_u, down_p = -gamma * down_u, -gamma * down_p
    g = np.append(positive.back(down_p, size) + unlabelled.back(down_u, size) + l2 * w[:-1], down_p.sum() + down_u.sum())
    return prior * _loss(sp).mean() + max(0.0, negative), g


def fit(positive: Rows, unlabelled: Rows, size: int, prior: float, steps: int = STEPS, rate: float = RATE, l2: float = L2, beta: float = 0.0, gamma: float = 1.0) -> tuple[np.ndarray, float, list[float]]:
    """Weights, bias and the risk at every step, by Adam over the whole sample."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = MIN_BIAS / 2
    risks = []
    for step in range(1, steps + 1):
        now, g = risk(w, positive, unlabelled, prior, l2, beta, gamma)
        risks.append(now)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        # every feature was chosen because it is more frequent in P, so none speaks for a clean text
        w[:-1], w[-1] = np.maximum(w[:-1], 0), max(w[-1], MIN_BIAS)
    return w[:-1], float(w[-1]), risks


class Model:
    """Weights of features, and the bias."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.known = [(size, mark, {f.partition("*")[0] for f in weights if f.rstrip("0123456789").endswith(mark)}) for size, mark in PREFIXES]

    def score(self, text: str | None) -> float:
        words, weights = words_of(text), self.weights
        found = words & weights.keys()
        for size, mark, known in self.known:
            found.update(_marked(Counter(p for w in words if (p := w[:size]) in known), mark, len(words)))
        # fsum: the same for any order of the set
        z = math.fsum(weights.get(f, 0.0) for f in found) + self.bias
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _sampled(size: int, total: int, key: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, size / max(1, total)))


def _word_rows(df: DataFrame) -> DataFrame:
    """(id, positive, unlabelled, words): the distinct words of a text, as one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [" ".join(sorted(words_of(t.as_py()))) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rows, pa.string())], ["id", "positive", "unlabelled", "words"])

    return C.map_arrow(df, run, [C.field("id", "string"), C.field("positive", "boolean"), C.field("unlabelled", "boolean"), C.field("words", "string")])


def telling(positive: Counter[str], unlabelled: Counter[str], n_p: int, n_u: int) -> list[str]:
    """Features that stand out in P against U (texts that hold each, and the sizes), in natural order."""
    strength = {}
    for f, k in positive.items():
        p, u, both = k / n_p, unlabelled[f] / n_u, (k + unlabelled[f]) / (n_p + n_u)
        z = (p - u) / math.sqrt(max(1e-12, both * (1 - both)) * (1 / n_p + 1 / n_u))
        if z >= MIN_Z and p >= MIN_RATIO * u:
            strength[f] = z
    return sorted(strength)


def learn(positive: list[str], unlabelled: list[str], prior: float) -> Model:
    """Fit on texts given by their distinct words, joined by spaces; both lists hold at least one."""
    often = Counter(f for words in positive for f in features_of(set(words.split())))
    often = Counter({f: k for f, k in often.items() if k >= max(MIN_DF, MIN_SHARE * len(positive))})
    of_u = Counter(f for words in unlabelled for f in features_of(set(words.split())) & often.keys())
    chosen = telling(often, of_u, len(positive), len(unlabelled))
    at = {f: i for i, f in enumerate(chosen)}
    rows = lambda texts: Rows([sorted(at[f] for f in features_of(set(words.split())) & at.keys()) for words in texts])
    w, bias, _ = fit(rows(positive), rows(unlabelled), len(at), prior)
    return Model({f: float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-3}, bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    """Fit on the labels outside the held-out fold; None without positives."""
    known = C.pick(labels, id_col, label_col).filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("y_"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("y_") > 0).cast("long")), F.lit(0))).first()
    if not toxic:
        return None
    src = C.pick(docs, id_col, text_col).filter(F.col(id_col).isNotNull())
    chosen = known.filter((F.col("y_") > 0) & _sampled(max_positive, toxic, F.col(id_col))).select(id_col, F.lit(True).alias("p_"))
    total = src.agg(F.approx_count_distinct(id_col, 0.01)).first()[0]  # copies of a row change neither this nor the hashes
    marked = src.join(F.broadcast(chosen), id_col, "left").select(F.col(id_col).cast("string").alias("id"), F.coalesce("p_", F.lit(False)).alias("p_"), _sampled(max_unlabelled, total, F.concat_ws("|", F.lit("u"), id_col)).alias("u_"), text_col)
    held = sorted((r.positive, r.unlabelled, r.words) for r in _word_rows(marked.filter("p_ or u_")).distinct().toLocalIterator())
    positive, unlabelled = [words for p, _, words in held if p], [words for _, u, words in held if u]
    return learn(positive, unlabelled, toxic / n if prior is None else prior) if positive and unlabelled else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every whole text."""
    src = C.pick(docs, id_col, text_col)
    kind = _arrow_type(src, id_col)
    sent = src.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            s = [m.score(t.as_py()) if m else 0.0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(s, pa.float64())], [id_col, "score"])

    scored = C.map_arrow(src, run, [C.id_field(src, id_col), C.field("score", "double")])
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(df: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns; no shuffle."""
    at = df.columns.index(text_col)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            yield batch.filter(pa.array([m is None or m.score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return C.map_arrow(df, run, df.schema.fields)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train, then score."""
    return score(docs, train(docs, labels, id_col, text_col), id_col, text_col)

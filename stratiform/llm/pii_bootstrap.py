"""Personal data: base recognisers, and bootstrapped contextual extraction beyond them.

The base recognisers find e-mail and IP addresses, card and telephone numbers. Their finds are the
seeds. Candidates are all other tokens with a digit or @, of any length, and groups of such tokens with
single spaces between them ("DE89 3704 0044"). Around every seed and candidate stand lexical patterns (the two
words before, the word before and after, whole words). Spark scores the graph of patterns and instances
in rounds until one finds nothing new: a pattern is trusted for a kind if most of its distinct instances
are trusted ones of that kind, an instance if the patterns it fills leave little doubt, and it stays so;
trusted patterns then discover identifiers no recogniser knows, and these are the next round's instances.
Of candidates inside one another the longest trusted one counts.

Texts are read once. What is shuffled are the mentions (identifier-like tokens), pre-aggregated to
distinct (pattern, instance) pairs, so a hot pattern is a sum of partial counts; the found spans go
back to the documents by the hash of the text. Lineage is cut by tables in the shared folder.

Defined cases: null counts as empty text, without spans; null ids and repeated rows pass through;
equal texts get equal spans; an empty table gives an empty table; other columns are ignored. Very long
digit or word runs are read in linear time, also with a candidate at every second character.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratiform.llm import common as C
from stratiform.llm.ogg import _arrow_type

KINDS = ("email", "ip", "card", "phone")
#: Rounds end when nothing new is found; so many without an end are an error.
ROUNDS = 1000
#: Words of patterns and instances beyond this many characters stand for themselves by a digest.
LONG_WORD = 64
#: A pattern needs so many distinct trusted instances of a kind, being such a share of all its instances.
MIN_SUPPORT, MIN_PRECISION = 3, 0.8
#: 1 - product of (1 - precision) over the trusted patterns of an instance.
MIN_INSTANCE = 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive, and only from the start of a run of digits: the same matches without going back.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+@-")
_END = re.compile(r"[A-Za-z0-9._%+@-]*")
_DIGITS = re.compile("[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the whole run before an @ is the local part, less what the last match took."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        nxt = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = nxt = m.end()
        else:
            done = max(done, start)
        at = text.find("@", nxt)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base recognisers, by kind, then start; code points, end exclusive."""
    text = text or ""
    out = [(0, s, e) for s, e in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 16 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Candidates outside the base spans: runs of letters, digits and ._%+@- with a digit or @, and then groups of those with one space between, too."""
    taken, k, done, out = sorted((s, e) for _, s, e in base), 0, 0, []
    for m in _SIGN.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and text[start - 1] in _TOKEN:
            start -= 1
        end = done = _END.match(text, m.start()).end()
        while end > start and text[end - 1] in ".-_%+":
            end -= 1
        while start < end and text[start] in ".-_%":
            start += 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if start < end and not any(s < end and start < e for s, e in taken[k : k + 4]):
            out.append((start, end))
    groups, first = [], 0
    for k in range(1, len(out) + 1):
        if k == len(out) or out[k][0] != out[k - 1][1] + 1 or text[out[k - 1][1]] != " ":
            if k - first > 1:
                groups.append((out[first][0], out[k - 1][1]))
            first = k
    return out + groups


def _short(word: str) -> str:
    """A word, or the digest of a very long one."""
    return word if len(word) <= LONG_WORD else "#" + hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


_WORD = re.compile(r"\S+")


def _plain(word: str) -> str:
    """Lower case, character by character, digits as 0."""
    return _DIGITS.sub("0", word.lower() if word.isascii() else "".join([c.lower()[:1] for c in word]))


def _running(word: str, cuts: set[int]) -> dict[int, str]:
    """Digests of the beginnings of a word, all in one pass over it."""
    h, at, out = hashlib.blake2b(digest_size=16), 0, {}
    for cut in sorted(cuts):
        h.update(word[at:cut].encode("utf-8", "surrogatepass"))
        at, out[cut] = cut, "#" + h.copy().hexdigest()
    return out


def _around(text: str, spans: list[tuple[int, int]] | int, end: int | None = None) -> list[list[str]] | list[str]:
    """Patterns of each span: the two words before; the word before and the word after, all whole. Digits become 0.

    A start and an end instead of spans are one span, of which the patterns come alone. Of the word a span stands in, what is before the span and what is behind it are words. The long ones
    are told by digests: of all beginnings (or, for the word after, ends) of one word in a single pass.
    """
    if end is not None:
        return _around(text, [(spans, end)])[0]
    if not spans:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [s for s, _ in words]
    asked: list[list[tuple[int, int] | None]] = []  # far, near, after: a word's number and where it is cut
    ahead: dict[int, set[int]] = {}
    behind: dict[int, set[int]] = {}

    def note(held: dict[int, set[int]], k: int, cut: int, size: int) -> tuple[int, int]:
        if size > LONG_WORD:
            held.setdefault(k, set()).add(cut)
        return k, cut

    for start, end in spans:
        i, j = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
        own = starts[i] < start
        near = (i, start) if own else (i - 1, words[i - 1][1]) if i else None
        far = near and near[0] and (near[0] - 1, words[near[0] - 1][1]) or None
        after = (j, end) if end < words[j][1] else (j + 1, words[j + 1][0]) if j + 1 < len(words) else None
        asked.append([x and note(ahead, *x, x[1] - words[x[0]][0]) for x in (far, near)] + [after and note(behind, *after, words[after[0]][1] - after[1])])
    before = {(k, words[k][0] + c): d for k, cuts in ahead.items() for c, d in _running(_plain(text[slice(*words[k])]), {c - words[k][0] for c in cuts}).items()}
    later = {(k, words[k][1] - c): d for k, cuts in behind.items() for c, d in _running(_plain(text[slice(*words[k])])[::-1], {words[k][1] - c for c in cuts}).items()}
    out = []
    for far, near, after in asked:
        own = []
        if near:
            told = before.get(near) or _plain(text[words[near[0]][0] : near[1]])
            if far:
                own.append(f"L {before.get(far) or _plain(text[words[far[0]][0] : far[1]])} {told}")
            if after:
                own.append(f"B {told} _ {later.get(after) or _plain(text[after[1] : words[after[0]][1]])}")
        out.append(own)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


_MENTION = "array<struct<start:int,end:int,instance:string,patterns:array<string>,kind:int>>"


def with_key(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``key``, a hash of the text."""
    return df.withColumn("key", F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, base, mentions): base spans, and every seed and identifier-like token with its patterns (kind -1: unknown)."""
    src = with_key(C.pick(df, id_col, text_col), text_col)
    kind = _arrow_type(src, id_col)
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    mention = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string())), ("kind", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, mentions = [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                found = base + [(-1, s, e) for s, e in tokens(text, base)]
                around = _around(text, [(s, e) for _, s, e in found])
                mentions.append([{"start": s, "end": e, "instance": _short(text[s:e].lower()), "patterns": p, "kind": k} for (k, s, e), p in zip(found, around, strict=True) if p])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), batch.column(2), pa.array(bases, span), pa.array(mentions, mention)], [id_col, "key", "base", "mentions"])

    return C.map_arrow(src, run, [C.id_field(src, id_col), C.field("key", "string"), C.field("base", "array<struct<kind:int,start:int,end:int>>"), C.field("mentions", _MENTION)])


def bootstrap(mentions: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_precision: float = MIN_PRECISION, min_instance: float = MIN_INSTANCE, scratch: C.Scratch | None = None) -> DataFrame:
    """Trusted new instances (instance, kind, score) from mentions (pattern, instance, kind; -1: unknown)."""
    scratch = scratch or C.Scratch(mentions.sparkSession, "pii")
    pairs = scratch.keep(mentions.groupBy("pattern", "instance").agg(F.max("kind").alias("seed")))
    counts = pairs.groupBy("pattern").agg(F.count("*").alias("n"))
    trusted = pairs.filter("seed >= 0").groupBy("instance").agg(F.max("seed").alias("kind")).withColumn("score", F.lit(1.0))
    seeds, found = trusted, None
    for _ in range(rounds):
        support = pairs.join(trusted, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("k"))
        good = support.filter(F.col("k") >= min_support).join(counts, "pattern").withColumn("precision", F.col("k") / F.col("n")).filter(F.col("precision") >= min_precision)
        doubt = F.sum(F.log(F.greatest(1 - F.col("precision"), F.lit(0.02))))
        scores = pairs.join(good.select("pattern", "kind", "precision"), "pattern").groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("score"))
        best = scores.filter(F.col("score") >= min_instance).groupBy("instance").agg(F.max_by(F.struct("kind", "score"), F.struct("score", -F.col("kind"))).alias("x"))
        # what is trusted stays so, with its kind: support only grows, so the rounds come to an end
        new = scratch.keep(best.select("instance", "x.kind", "x.score").join(trusted.select("instance"), "instance", "left_anti"))
        none = new.isEmpty()
        found = new if found is None else found if none else scratch.keep(found.unionByName(new))
        if none:
            return found
        trusted = seeds.unionByName(found)
    raise RuntimeError(f"new identifiers still appear after {rounds} rounds")


def _joined(spans: F.Column) -> F.Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, key, base, spans): arrays of (kind, start, end), base ones and all, by kind, then start.

    ``key`` is a hash of the text.
    """
    scratch = C.Scratch(df.sparkSession, "pii")
    scanned = scratch.keep(scan(df, id_col, text_col))
    each = scanned.select("key", F.explode("mentions").alias("m"))
    found = bootstrap(each.select(F.explode("m.patterns").alias("pattern"), "m.instance", "m.kind"), rounds, scratch=scratch)
    inside = Window.partitionBy("key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    extra = (
        each.filter("m.kind < 0")
        .select("key", "m.start", "m.end", "m.instance")
        .join(found, "instance")
        .select("key", "kind", "start", "end")
        .distinct()
        .withColumn("reached", F.max("end").over(inside))
        .filter("reached is null or end > reached")
        .groupBy("key")
        .agg(F.collect_set(F.struct("kind", "start", "end")).alias("extra"))
    )
    both = F.array_sort(F.concat("base", F.coalesce("extra", F.expr("array()"))))
    return scanned.select(id_col, "key", "base").join(extra, "key", "left").select(id_col, "key", "base", both.alias("spans"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(id_col, *(count(k) for k in range(4)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(text_col: str = "text", spans_col: str = "spans") -> F.Column:
    """Column of the text with every span replaced by its kind in brackets; overlapping spans give one bracket, of the first."""
    ordered = F.array_sort(F.transform(spans_col, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("k"))))
    names = F.array(*map(F.lit, KINDS))
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: F.Column, x: F.Column) -> F.Column:
        kept = F.substring(text, acc["at"] + 1, x["s"] - acc["at"])
        mark = F.concat(acc["out"], kept, F.lit("["), F.get(names, x["k"]), F.lit("]"))
        return F.when(x["s"] >= acc["at"], F.struct(mark.alias("out"), x["e"].alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["e"]).alias("at")))

    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans_col) > 0, F.aggregate(ordered, start, step, end)).otherwise(F.col(text_col))

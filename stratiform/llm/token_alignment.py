"""Alignment of two tokenizers over a corpus by the byte offsets at which their tokens end together.

Every text is encoded by A (a byte-level ``tokenizers`` file, over a space and the text) and by B (a
``sentencepiece`` file, which adds the space). The tokens of a slice of an Arrow batch are laid end to end with
the documents' byte offsets; one bincount each marks where A and B tokens end, and where both do a group is cut
and its last A and B tokens are linked. Prefix sums over the cuts, cut at the documents, give each one's results.

The texts are encoded once. Each document's distinct links with their counts are written to the shared folder;
links are counted over the corpus with a partial count a task. A pair of at least one in ``HEAVY`` links is
heavy: there are at most ``HEAVY`` of them, so their counts are broadcast, and looked up where the links lie. The
links of all other pairs meet their counts in a join, where no pair has more than its share of one in ``HEAVY``.

Defined cases: null and empty texts, and texts whose joined A or B bytes differ from a space and the text (runs
that a model normalises, U+2581), have no tokens: zeros and an empty digest. Null ids and repeated rows are rows
of their own; other columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.llm import common as C
from stratiform.llm.ogg import _arrow_type
from stratiform.llm.token_counts import slices

#: A pair with one link in this many, or more, is heavy; so many pairs are broadcast at most, 17 bytes each.
HEAVY = 1 << 20
#: Distinct pairs that a task counts before it sends them on.
COUNTED = 1 << 20
#: Chunks whose ids a worker remembers, and the longest of them.
REMEMBERED, CHUNK = 400_000, 64
_SHIFT = 32
#: Chunks that are encoded together.
RUN = 500
_VISIBLE = "[!-~\u00c0-\u024f\u0370-\u03ff\u0400-\u04ff]"
_CUT, _SEEN = re.compile(f"(?<={_VISIBLE})(?= )"), re.compile(_VISIBLE + r"\Z")


def _byte_characters() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Two tokenizers, and the bytes that each token stands for."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = _byte_characters()
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        bytes_a = {i: bytes(of[c] for c in t) for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec.get("added_tokens") or []}
        self.bytes_a = [bytes_a.get(i, b"") for i in range(max(bytes_a) + 1)]
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        # a piece with a space behind another character could join chunks (A splits there before it merges)
        self.parted = not any("▁" in p.lstrip("▁") for _, p in pieces)
        # chunks by number, and of all of them end to end A's ids, how many each has (-1: not given back), B's, how many
        self.number: dict[str, int] = {}
        self.store = [np.empty(0, np.int64)] * 4
        self.length_a, self.length_b = (np.array([len(t) for t in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        # every id as text, with what follows it: inside its side of a group (,), at the end of A's (|) or of the group (;)
        self.text_a, self.text_b = (np.array([b"%d%s" % (i, s) for s in (b",", end) for i in range(len(own))], object) for own, end in ((self.bytes_a, b"|"), (self.bytes_b, b";")))

    def _both(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a space, by A, and by B, which adds its space to every text but an empty one."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return ids_a, [y or [self.b.piece_to_id("▁")] for y in self.b.encode([t[1:] for t in texts], num_threads=1)]

    def _learn(self, chunks: list[str], alone: set[str]) -> None:
        """Remember the ids of chunks. Chunks are encoded in runs laid end to end, those in ``alone`` and of runs that a tokenizer doesn't give back one by one."""
        joined = [c for c in chunks if c not in alone]
        runs = [joined[i : i + RUN] for i in range(0, len(joined), RUN)]
        held: list[tuple[list[str], list[np.ndarray]]] = []
        single = [c for c in chunks if c in alone]
        for own, x, y in zip(runs, *self._both(["".join(r) for r in runs]), strict=True):
            raw = "".join(own).encode("utf-8", "surrogatepass")
            ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in own])
            sides = [(np.array(ids, np.int64), table) for ids, table in ((x, self.length_a), (y, self.length_b))]
            places = [np.cumsum(table[ids]) for ids, table in sides]
            cuts = [np.searchsorted(at, ends) + 1 for at in places]
            same = all(b"".join(map(names.__getitem__, ids)) == raw and np.array_equal(at[cut - 1], ends) for ids, names, at, cut in zip((x, y), (self.bytes_a, self.bytes_b), places, cuts, strict=True))
            if same:
                held.append((own, [v for (ids, _), cut in zip(sides, cuts, strict=True) for v in (ids, np.diff(np.r_[0, cut]))]))
            else:
                single += own
        if single:
            ids_a, ids_b = self._both(single)
            good = [b"".join(map(self.bytes_a.__getitem__, x)) == b"".join(map(self.bytes_b.__getitem__, y)) == c.encode("utf-8", "surrogatepass") for c, x, y in zip(single, ids_a, ids_b, strict=True)]
            sizes = [np.array([len(v) if ok else -1 for v, ok in zip(ids, good, strict=True)], np.int64) for ids in (ids_a, ids_b)]
            flat = [np.array([t for v, ok in zip(ids, good, strict=True) if ok for t in v], np.int64) for ids in (ids_a, ids_b)]
            held.append((single, [flat[0], sizes[0], flat[1], sizes[1]]))
        at = len(self.store[1])
        for own, _ in held:
            self.number.update(zip(own, range(at, at + len(own)), strict=True))
            at += len(own)
        self.store = [np.concatenate([old, *(parts[k] for _, parts in held)]) for k, old in enumerate(self.store)]

    def encode(self, texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of those texts that both give back, then all their ids by A, how many each has, and the same of B.

        Neither's tokens reach over a space behind a visible character, so the chunks between such spaces are
        encoded one by one, and those met lately are remembered.
        """
        full = [i for i, t in enumerate(texts) if t]
        chunks = [_CUT.split(" " + texts[i]) if self.parted else [" " + texts[i]] for i in full]
        distinct = set().union(*chunks)
        if len(self.store[1]) + len(distinct) > REMEMBERED or len(self.store[0]) > REMEMBERED * 16:
            self.number, self.store = {}, [np.empty(0, np.int64)] * 4
        new = [c for c in distinct if c not in self.number]
        if new:
            # what ends a text may end in spaces, which what follows would join
            last = {c[-1] for c in chunks}
            self._learn(new, {c for c in new if c in last and not _SEEN.search(c)} if self.parted else set(new))
        code = np.fromiter(map(self.number.__getitem__, chain.from_iterable(chunks)), np.int64, sum(map(len, chunks)))
        sizes = np.array([len(c) for c in chunks], np.int64)
        ends = np.cumsum(sizes)
        lost = np.r_[0, np.cumsum(self.store[1][code] < 0)]
        good = lost[ends] == lost[ends - sizes]
        code, doc = code[np.repeat(good, sizes)], np.repeat(np.arange(int(good.sum())), sizes[good])
        sides = []
        for flat, counts in (self.store[:2], self.store[2:]):
            counts = np.maximum(counts, 0)
            begin = np.cumsum(counts) - counts
            n = counts[code]
            place = np.arange(int(n.sum())) + np.repeat(begin[code] - (np.cumsum(n) - n), n)
            sides += [flat[place], np.bincount(doc, n, int(good.sum())).astype(np.int64)]
        for c in new:
            if len(c) > CHUNK:
                del self.number[c]
        return [i for i, ok in zip(full, good.tolist(), strict=True) if ok], *sides

    def align(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """For documents laid end to end (ids and how many each document has, by A and by B): linked A ids, B ids, where each document's links begin and, last, end, its numbers of links, and digests of its groups."""
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        total = int(end_a[-1]) if len(end_a) else 0
        both = (np.bincount(end_a, minlength=total + 1) > 0) & (np.bincount(end_b, minlength=total + 1) > 0)
        cuts = np.cumsum(both)
        cut_a, cut_b = both[end_a], both[end_b]
        doc_end = end_a[np.cumsum(n_a) - 1] if len(n_a) else np.empty(0, np.int64)
        bounds = np.r_[0, cuts[doc_end]].astype(np.int64)
        # A's tokens of a group, then B's: a token stands behind its own side's and the other's of earlier groups (for B: of this group, too)
        group_a, group_b = cuts[end_a] - cut_a, cuts[end_b] - cut_b
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        pieces = np.empty(len(a) + len(b), object)
        pieces[place_a] = self.text_a[a + cut_a * len(self.bytes_a)]
        pieces[place_b] = self.text_b[b + cut_b * len(self.bytes_b)]
        at = np.r_[0, np.cumsum(n_a + n_b)].tolist()
        digests = [hashlib.sha256(b"".join(pieces[s:e].tolist())[:-1]).hexdigest() for s, e in zip(at, at[1:], strict=False)]
        return a[cut_a], b[cut_b], bounds, np.diff(bounds), digests


@lru_cache(2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def distinct_links(a: np.ndarray, b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (code) of each document, their counts, and where each document's begin and, last, end."""
    code, doc = a << _SHIFT | b, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]) if len(code) else np.empty(0, np.int64)
    return code[first], np.diff(np.r_[first, len(code)]), np.searchsorted(doc[first], np.arange(len(bounds)))


def link_table(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, n_a, n_b, n_groups, n_links, groups_sha256, a, b, times): every document's distinct links and how often each occurs in it.

    ``row`` tells the rows of one run of the job; the table must be written before it is used twice.
    """
    src = C.pick(df, id_col, text_col)
    kind = _arrow_type(src, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for batch in batches:
            for ids, texts in slices(batch):
                n = len(ids)
                kept, ids_a, n_a, ids_b, n_b = align.encode(texts)
                a, b, bounds, links, digests = align.align(ids_a, n_a, ids_b, n_b)
                code, times, at = distinct_links(a, b, bounds)
                columns = np.zeros((3, n), np.int64)
                columns[:, kept] = n_a, n_b, links
                sha = np.full(n, "", object)
                sha[kept] = digests
                sizes = np.zeros(n, np.int64)
                sizes[kept] = np.diff(at)
                offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (code >> _SHIFT, code & ((1 << _SHIFT) - 1), times)]
                rows = pa.array(np.arange(number, number + n), pa.int64())
                number += n
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), rows, *(pa.array(columns[k], pa.int64()) for k in (0, 1, 2, 2)), pa.array(sha.tolist(), pa.string()), *lists], [f.name for f in fields])

    fields = [C.id_field(src, id_col), *(C.field(c, "long") for c in ("row", "n_a", "n_b", "n_groups", "n_links")), C.field("groups_sha256", "string"), *(C.field(c, "array<int>") for c in ("a", "b", "times"))]
    return C.map_arrow(src, run, fields)


def _codes(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, counts and number of links of each row, from columns a, b, times beginning at ``at``."""
    a, b, times = (batch.column(at + k).flatten().to_numpy().astype(np.int64) for k in range(3))
    return a << _SHIFT | b, times, np.asarray(batch.column(at).value_lengths(), np.int64)


def pair_counts(links: DataFrame) -> DataFrame:
    """(code, n) of every linked pair of ids, code being a << 32 | b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, n = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(code, kind="stable")
            code = code[order]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
            return (code[first], np.add.reduceat(n[order], first)) if len(code) else (code, n)

        for batch in batches:
            code, n, _ = _codes(batch, 0)
            held.append((code, n))
            size += len(code)
            if size > 2 * COUNTED:
                held = [merged()]
                size = len(held[0][0])
                if size > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held[0]], ["code", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in merged()], ["code", "n"])

    parts = C.map_arrow(links.select("a", "b", "times"), run, [C.field("code", "long"), C.field("n", "long")])
    return parts.groupBy("code").agg(F.sum("n").alias("n"))


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    n_best: links whose pair is its B id's most frequent one, ties included; count_sum: the pairs' corpus-wide
    counts, summed over the links. ``heavy``: most pairs that are broadcast.
    """
    spark = df.sparkSession
    scratch = C.Scratch(spark, "alignment")
    links = scratch.keep(link_table(df, path_a, path_b, id_col, text_col))
    counted = scratch.keep(pair_counts(links))
    # B's ids are those of a vocabulary, so their highest counts may be broadcast
    highest = counted.groupBy(F.col("code").bitwiseAND(F.lit((1 << _SHIFT) - 1)).alias("b")).agg(F.max("n").alias("top"))
    pairs = counted.withColumn("b", F.col("code").bitwiseAND(F.lit((1 << _SHIFT) - 1))).join(F.broadcast(highest), "b").select("code", "n", (F.col("n") == F.col("top")).alias("best"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = -(-total // heavy)
    known = pairs.filter(F.col("n") >= least).toArrow()
    order = np.argsort(known.column("code").to_numpy())
    table = [known.column(c).to_numpy()[order] for c in ("code", "n", "best")]
    sent = spark.sparkContext.broadcast(table)

    def find(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each code in the table, and whether it stands there."""
        keys = sent.value[0]
        at = np.minimum(np.searchsorted(keys, code), max(0, len(keys) - 1))
        return at, (keys[at] == code if len(keys) else np.zeros(len(code), bool))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with the sums over their heavy links in place of the links."""
        for batch in batches:
            code, times, sizes = _codes(batch, len(plain))
            at, hit = find(code)
            out = []
            for column in (sent.value[2].astype(np.int64), sent.value[1]):
                own = np.zeros(len(code), np.int64)
                own[hit] = times[hit] * column[at[hit]]
                prefix = np.r_[0, np.cumsum(own)]
                ends = np.cumsum(sizes)
                out.append(prefix[ends] - prefix[ends - sizes])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(plain)], *(pa.array(c, pa.int64()) for c in out)], [*plain, "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, times, sizes = _codes(batch, 1)
            rare = ~find(code)[1]
            rows = np.repeat(batch.column(0).to_numpy(), sizes)[rare]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (rows, code[rare], times[rare])], ["row", "code", "times"])

    plain = [id_col, "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    result = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    answers = C.map_arrow(links.select(*plain, "a", "b", "times"), sums, [links.schema[c] for c in plain] + [C.field("n_best", "long"), C.field("count_sum", "long")])
    light = pairs.filter(F.col("n") < least)
    if light.isEmpty():
        return answers.select(*result)
    open_ = C.map_arrow(links.select("row", "a", "b", "times"), others, [C.field(c, "long") for c in ("row", "code", "times")])
    met = open_.join(light, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_"), F.sum(F.col("times") * F.col("n")).alias("sum_"))
    full = answers.join(met, "row", "left")
    for name, more in (("n_best", "best_"), ("count_sum", "sum_")):
        full = full.withColumn(name, F.col(name) + F.coalesce(more, F.lit(0)))
    return full.select(*result)

"""Removal of byte strings of 200 bytes that occur more than once, by prefix doubling over sampled suffixes.

Every suffix of every text stands for the string it begins with. Ranking all of them at growing
lengths would sort every byte of the corpus again and again, so the suffixes are first sampled by
content: of each 200-byte string the leftmost smallest hash among its 64-byte strings is its anchor.
Equal strings have equal anchors at equal places, and one anchor stands for the whole run of
strings (its own run) that chose it. Spark then ranks (position, rank) rows of the anchors at growing
lengths and drops those that are unique:

1. at 64 bytes: an anchor whose 64 bytes occur once stands for no repeated string;
2. at 336 bytes, the anchor with all that its strings can hold on both sides: if these occur again, so
   do all its strings, and the anchor is done (past the threshold);
3. what is left lies at the ends of repeats: there the 200-byte strings of the anchors are compared
   at every offset, among the anchors of one rank. A copied context is represented once. A rank with very
   many contexts is dealt out by the strings' own hashes, which keeps equal strings together.

Fixed-size bitmaps of the surviving ranks filter the scans, so only survivors are shuffled, with texts
only of the documents that lose bytes. Ranks are 64-bit hashes: of the 64 bytes and, separately, of
what is compared within that rank, so two different strings would have to agree in both.

Defined cases: null counts as empty text; texts under 200 bytes lose nothing; overlapping occurrences
in one text count; repeated rows and null ids are documents of their own, with equal texts losing
equally; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.llm import bitmap
from stratiform.llm import common as C
from stratiform.llm.hashing import Windows, joined, mix
from stratiform.llm.ogg import _arrow_type

LENGTH, GRAM = 200, 64
_SPAN = LENGTH - GRAM
#: Window starts that are anchored at a time; a longer text goes in pieces that overlap.
PIECE = 1 << 18
#: Starts, from an anchor, of strings of 64 bytes that cover the anchor's context.
_COVER = np.array([[-136], [-72], [-8], [56], [120], [136]])
_POSITION = np.uint64((1 << 20) - 1)
#: Contexts of one rank that are compared together; a rank of more is dealt into ``PARTS`` parts, one of
#: ``PARTS`` times as many into the square of that, and so on.
MANY, PARTS = 256, 16


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values: minima of doubled widths, two of which overlap in the last."""
    n, w = len(x) - width + 1, 1
    while 2 * w <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[:n], x[width - w : width - w + n])


class Anchors:
    """Anchors of a piece of a text: places, the first and last string start of their own runs, ranks at 64 bytes."""

    def __init__(self, data: bytes, start: int, end: int) -> None:
        """String starts from ``start`` up to ``end`` (exclusive)."""
        self.base = max(0, start - LENGTH)
        self.data = data[self.base : end + 2 * LENGTH]
        self.windows = Windows(self.data)
        first = start - self.base
        rank = mix(self.windows.ranks(GRAM.bit_length() - 1)[first : first + (end - start) + _SPAN])
        order = (rank & ~_POSITION) | np.arange(len(rank), dtype=np.uint64)
        chosen = (_sliding_min(order, _SPAN + 1) & _POSITION).astype(np.int64)
        cuts = np.flatnonzero(np.diff(chosen)) + 1
        lo = np.r_[0, cuts]
        self.at = chosen[lo]
        self.gram = rank[self.at]
        self.place = self.at + first
        self.lo, self.hi = lo + first, np.r_[cuts - 1, len(chosen) - 1] + first

    def drop_last(self) -> None:
        self.gram, self.place, self.lo, self.hi = self.gram[:-1], self.place[:-1], self.lo[:-1], self.hi[:-1]

    def contexts(self, pick: np.ndarray) -> np.ndarray:
        """Rank of all that the strings of an anchor can hold, and of how much of it there is: of six strings of 64 bytes that cover it."""
        p = self.place[pick]
        a, b = np.maximum(p - _SPAN, 0), np.minimum(p + LENGTH, len(self.data))
        held = self.windows.ranks(GRAM.bit_length() - 1)[np.clip(p + _COVER, a, b - GRAM)]
        pairs = joined(held[:3], held[3:])
        return mix(joined(joined(pairs[0], pairs[1]), pairs[2]) + mix(((p - a) << 10 | (b - p)).astype(np.uint64)))

    def strings(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets before the anchor, and ranks, of the strings of one anchor."""
        return self.strings_of(np.array([k]))[1:]

    def strings_of(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The strings of some anchors: the number of the anchor among them, the offset before it, the rank."""
        n = self.hi[pick] - self.lo[pick] + 1
        owner = np.repeat(np.arange(len(pick)), n)
        p = (self.lo[pick] - np.cumsum(n) + n)[owner] + np.arange(len(owner))
        return owner, (self.place[pick][owner] - p).astype(np.uint8), self.windows.of(p, LENGTH)


def _pieces(data: bytes) -> Iterator[Anchors]:
    """Anchors of a text, piece by piece; one that windows of two pieces chose is left to the later piece, with its whole run."""
    before = None
    for start in range(0, len(data) - LENGTH + 1, PIECE):
        a = Anchors(data, start, min(start + PIECE, len(data) - LENGTH + 1))
        if before is not None:
            if before.place[-1] + before.base == a.place[0] + a.base:
                a.lo[0] = before.lo[-1] + before.base - a.base
                before.drop_last()
            yield before
        before = a
    if before is not None:
        yield before


def _bytes(x) -> bytes:
    return (x.as_py() or "").encode("utf-8", "surrogatepass")


def _grams(docs: DataFrame) -> DataFrame:
    """(gram): ranks at 64 bytes of all anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for x in batch.column(1):
                for a in _pieces(_bytes(x)):
                    held.append(a.gram)
                    size += len(a.gram)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["gram"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["gram"])

    return C.map_arrow(docs, run, [C.field("gram", "long")])


def _survivors(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(gram, context, doc, place, lo, hi) of the anchors whose rank is in the bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[np.ndarray]] = []
            size = 0
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for a in _pieces(_bytes(x)):
                    own = np.flatnonzero(bitmap.has(sent.value, a.gram))
                    if len(own):
                        held.append([a.gram[own].view(np.int64), a.contexts(own).view(np.int64), np.full(len(own), doc), a.place[own] + a.base, a.lo[own] + a.base, a.hi[own] + a.base])
                        size += len(own)
                if size > 100_000:
                    yield _columns(held)
                    held, size = [], 0
            if held:
                yield _columns(held)

    return C.map_arrow(docs, run, [C.field(n, "long") for n in _SURVIVOR])


_SURVIVOR = ("gram", "context", "doc", "place", "lo", "hi")


def _columns(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*held, strict=True)], list(_SURVIVOR))


def _spot(doc: np.ndarray | int, place: np.ndarray) -> np.ndarray:
    """Key of an anchor."""
    return mix(np.asarray(doc, np.int64).view(np.uint64) + mix(place.astype(np.uint64)))


def _spots(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_spot(doc, place).view(np.int64))], ["key"])

    return C.map_arrow(rows.select("doc", "place"), run, [C.field("key", "long")])


def _strings(docs: DataFrame, grams: np.ndarray, spots: np.ndarray, many: list[np.ndarray]) -> DataFrame:
    """(gram, part, doc, place, strings): the 200-byte strings of chosen anchors, as an offset (1 byte) and a rank (8 bytes) each; ``many``: bitmaps of the ranks to be dealt, for each power of ``PARTS``."""
    sent = docs.sparkSession.sparkContext.broadcast((grams, spots, many))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g_bits, s_bits, m_bits = sent.value
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            g, p, d, m, n, packed = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            ends = np.r_[0, np.cumsum(n * 9)].astype(np.int32)
            strings = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (g, p, d, m)] + [strings], ["gram", "part", "doc", "place", "strings"])

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for a in _pieces(_bytes(x)):
                    own = np.flatnonzero(bitmap.has(g_bits, a.gram))
                    own = own[bitmap.has(s_bits, _spot(doc, a.place[own] + a.base))]
                    if not len(own):
                        continue
                    owner, off, rank = a.strings_of(own)
                    part = np.full(len(owner), -1)
                    if m_bits:
                        power = sum((bitmap.has(m, a.gram[own]).astype(np.int64) for m in m_bits), np.zeros(len(own), np.int64))[owner]
                        part = np.where(power > 0, (rank % np.uint64(PARTS) ** power.astype(np.uint64)).astype(np.int64), -1)
                        order = np.lexsort((part, owner))
                        owner, off, rank, part = owner[order], off[order], rank[order], part[order]
                    starts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])])
                    packed = np.empty((len(owner), 9), np.uint8)
                    packed[:, 0], packed[:, 1:] = off, rank.view(np.uint8).reshape(-1, 8)
                    k = own[owner[starts]]
                    held.append((a.gram[k].view(np.int64), part[starts], np.full(len(k), doc), a.place[k] + a.base, np.diff(np.r_[starts, len(owner)]), packed.ravel()))
                    size += len(owner)
                if size > 200_000:
                    yield out()
                    size = 0
        if held:
            yield out()

    return C.map_arrow(docs, run, [C.field("gram", "long"), C.field("part", "long"), C.field("doc", "long"), C.field("place", "long"), C.field("strings", "binary")])


def _equal_strings(rows: DataFrame) -> DataFrame:
    """(doc, start, end): the strings that another anchor of the same rank has, too; rows sorted by rank and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> list[tuple[int, int, int]]:
            if len(held) < 2:
                held.clear()
                return []
            sizes = np.array([len(raw) // 9 for _, _, raw in held])
            packed = np.frombuffer(b"".join(raw for _, _, raw in held), np.uint8).reshape(-1, 9)
            off, rank = packed[:, 0].astype(np.int64), np.ascontiguousarray(packed[:, 1:]).view(np.uint64).ravel()
            _, back, count = np.unique(rank, return_inverse=True, return_counts=True)
            hit = count[back] > 1
            owner = np.repeat(np.arange(len(held)), sizes)
            cuts, out = np.r_[0, np.cumsum(sizes)], []
            for k in np.unique(owner[hit]).tolist():
                doc, place, _ = held[k]
                own = slice(cuts[k], cuts[k + 1])
                starts = np.sort(place - off[own][hit[own]])
                ends = np.flatnonzero(np.diff(starts) > LENGTH)
                out += [(doc, int(s), int(e) + LENGTH) for s, e in zip(starts[np.r_[0, ends + 1]], starts[np.r_[ends, len(starts) - 1]], strict=True)]
            held.clear()
            return out

        done: list[tuple[int, int, int]] = []
        for batch in batches:
            for g, p, d, m, s in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (g, p) != at:
                    done += close()
                    at = (g, p)
                held.append((d, m, s))
                if len(done) > 10_000:
                    yield _intervals(done)
                    done = []
        done += close()
        if done:
            yield _intervals(done)

    return C.map_arrow(rows, run, [C.field("doc", "long"), C.field("start", "long"), C.field("end", "long")])


def _intervals(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc", "start", "end"])


def repeats(docs: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(doc, start, end): byte ranges of docs (doc, text) covered by repeated strings; ranges may overlap."""
    repeated = _grams(docs).groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram")
    found = _survivors(docs, bitmap.build(repeated, "gram"))
    anchors = scratch.keep(found.groupBy(*_SURVIVOR).agg(F.count("*").alias("copies")))
    contexts = scratch.keep(anchors.groupBy("gram", "context").agg(F.sum("copies").alias("n"), F.min(F.struct("doc", "place")).alias("first")))
    whole = anchors.join(contexts.filter("n > 1").select("gram", "context"), ["gram", "context"]).select("doc", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end"))
    ranks = contexts.groupBy("gram").agg(F.count("*").alias("n"), F.min("n").alias("least")).filter("n > 1 and least = 1")
    ranks = scratch.keep(ranks.select("gram", "n"))
    chosen = contexts.join(ranks.select("gram"), "gram").select("first.doc", "first.place")
    most = ranks.agg(F.max("n")).first()[0] or 0
    bounds = [MANY * PARTS**k for k in range(10) if MANY * PARTS**k < most]
    rows = _strings(docs, bitmap.build(ranks, "gram"), bitmap.build(_spots(chosen)), [bitmap.build(ranks.filter(F.col("n") > x), "gram") for x in bounds])
    ends = _equal_strings(rows.repartition("gram", "part").sortWithinPartitions("gram", "part"))
    return scratch.keep(whole.unionByName(ends).distinct())


def _cut(docs: DataFrame, id_col: str, with_ranges: bool) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) from (id, text[, ranges])."""
    kind = _arrow_type(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, x in enumerate(batch.column(1)):
                data, spans = _bytes(x), []
                for s, e in sorted((r["start"], r["end"]) for r in batch.column(2)[k].as_py() or ()) if with_ranges else ():
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                kept, at = [], 0
                for s, e in spans:
                    kept.append(data[at:s])
                    at = e
                kept.append(data[at:])
                rows.append((len(data), sum(e - s for s, e in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), [v for span in spans for v in span]))
            n, r, s, h, v = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(h, pa.string()), pa.array(v, pa.list_(pa.int64()))], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return C.map_arrow(docs, run, [C.id_field(docs, id_col), C.field("n_bytes", "long"), C.field("n_removed", "long"), C.field("n_spans", "long"), C.field("kept_sha256", "string"), C.field("spans", "array<long>")])


def removed_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans): spans is a flat list of starts and ends of the removed runs."""
    scratch = C.Scratch(df.sparkSession, "suffix")
    src = C.with_identity(C.pick(df, id_col, text_col).toDF("id", "text"), "text", "doc", scratch)
    ranges = repeats(src.select("doc", "text"), scratch)
    losing = scratch.keep(ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("ranges")))
    bits = df.sparkSession.sparkContext.broadcast(bitmap.build(losing, "doc"))

    def split(lose: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = bitmap.has(bits.value, batch.column(2).to_numpy().view(np.uint64))
                yield batch.filter(pa.array(own if lose else ~own))

        return src.mapInArrow(run, src.schema)

    rest = _cut(split(False).select("id", "text"), "id", False)
    cut = _cut(split(True).join(losing, "doc", "left").select("id", "text", "ranges"), "id", True)
    return rest.unionByName(cut).withColumnRenamed("id", id_col)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest columns of ``removed_spans``."""
    return removed_spans(df, id_col, text_col).drop("spans")

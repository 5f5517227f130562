"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are runs of ``size`` consecutive words of the benchmark items, written as bytes with one
space before, between and after the words, so that they only match at word boundaries. Documents are
brought to the same form and scanned with block shift tables: the last block of the current position
says how far to jump; where it says 0, the bucket of that block's hash names the patterns to compare.
Patterns of different length classes have tables of their own, because the shortest pattern bounds
every jump. The tables go out to the executors; if they would pass ``MAX_PATTERN_BYTES``, the
benchmark is searched block by block: the driver holds one block at a time, the hits of each go to a
table in the shared folder and are merged. No document is shuffled unless there is more than one block.

Defined cases: null texts have no words; items without words have no pattern, items of fewer than
``size`` words are one pattern; items of equal text are all reported; a null item id marks words as
hit but isn't among the reported items, ids may be of any type. Empty tables: no patterns (nothing is hit), no documents (no
rows). Repeated rows and null ids pass through; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stratiform.llm import common as C
from stratiform.llm.ogg import _arrow_type

#: Of one block of the benchmark; the tables take a few times as much.
MAX_PATTERN_BYTES = 16 << 20
#: What an id in the list of a pattern's items counts for.
ID_BYTES = 16
#: (shortest pattern, block size) of the length classes.
CLASSES = ((3, 2), (12, 4), (40, 8))

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words: digits, letters and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def windows(text: str | None, size: int) -> set[bytes]:
    words = words_of(text)
    return {b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))} if words else set()


class WuManber:
    """Tables for patterns of at least ``m`` bytes, with blocks of ``block`` bytes."""

    def __init__(self, patterns: list[bytes], block: int) -> None:
        self.block, self.m = block, min(map(len, patterns))
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[bytes]]] = {}
        for p in patterns:
            for end in range(block, self.m + 1):
                key = p[end - block : end]
                jump = self.m - end
                if self.shift.get(key, self.m) > jump:
                    self.shift[key] = jump
            bucket = self.buckets.setdefault(p[self.m - block : self.m], {})
            bucket.setdefault(p[: self.m], []).append(p)

    def search(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(start, pattern) of every occurrence."""
        m, block, shift, far = self.m, self.block, self.shift, self.m - self.block + 1
        end, n = m, len(text)
        while end <= n:
            key = text[end - block : end]
            jump = shift.get(key, far)
            if jump:
                end += jump
                continue
            start = end - m
            for p in self.buckets[key].get(text[start:end], ()):
                if text.startswith(p, start):
                    yield start, p
            end += 1


class Matcher:
    """All patterns of a block of the benchmark, by length class."""

    def __init__(self, items: dict[bytes, list[int]]) -> None:
        self.items, self.tables = items, []
        for k, (low, block) in enumerate(CLASSES):
            high = CLASSES[k + 1][0] if k + 1 < len(CLASSES) else 1 << 62
            if own := sorted(p for p in items if low <= len(p) < high):
                self.tables.append(WuManber(own, block))

    def find(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, merged ranges of hit words, ids of the items."""
        words = words_of(text)
        line = b" " + b" ".join(words) + b" " if words else b""
        found = [x for t in self.tables for x in t.search(line)]
        if not found:
            return len(words), [], set()
        spaces, at = [], -1
        while (at := line.find(b" ", at + 1)) >= 0:
            spaces.append(at)
        ranges = sorted((first := bisect_right(spaces, s) - 1, first + p.count(b" ") - 1) for s, p in found)
        merged: list[tuple[int, int]] = []
        for a, b in ranges:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return len(words), merged, {i for _, p in found for i in self.items[p]}


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, limit: int) -> Iterator[dict[bytes, list[int]]]:
    """Patterns with their items, in blocks of at most ``limit`` bytes; the driver holds one at a time."""
    items: dict[bytes, list[int]] = {}
    held = 0
    for row in C.pick(benchmark, id_col, text_col).toLocalIterator():
        for p in windows(row[1], size):
            held += ID_BYTES + (len(p) if p not in items else 0)
            items.setdefault(p, []).extend([] if row[0] is None else [row[0]])
        if held > limit:
            yield items
            items, held = {}, 0
    yield items


def _search(docs: DataFrame, items: dict[bytes, list], id_col: str, item: T.DataType) -> DataFrame:
    """(id, n_words, ranges, items); ``item``: the type of the items' ids."""
    kind, item_kind = _arrow_type(docs, id_col), to_arrow_type(item)
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for batch in batches:
            rows = [matcher.find(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(kind),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[x for ab in r[1] for x in ab] for r in rows], pa.list_(pa.int64())),
                    pa.array([sorted(r[2]) for r in rows], pa.list_(item_kind)),
                ],
                [id_col, "n_words", "ranges", "items"],
            )

    return C.map_arrow(docs, run, [C.id_field(docs, id_col), C.field("n_words", "long"), C.field("ranges", "array<long>"), T.StructField("items", T.ArrayType(item), True)])


def contaminated_ranges(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 13, limit: int = MAX_PATTERN_BYTES) -> DataFrame:
    """(id, n_words, ranges, items): ranges is a flat list of first and one-past-last hit words, items the sorted ids of the items found."""
    src = C.pick(docs, id_col, text_col)
    item = benchmark.schema[item_col].dataType
    blocks = _blocks(benchmark, item_col, item_text, size, limit)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _search(src, first, id_col, item)
    # More than one block: equal texts have equal hits, so the blocks are merged by the text's hash.
    keyed = src.withColumn("key_", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    scratch = C.Scratch(docs.sparkSession, "decontaminate")
    texts = scratch.keep(keyed.select("key_", text_col).dropDuplicates(["key_"]))
    every = None
    for items in itertools.chain([first, second], blocks):
        part = scratch.keep(_search(texts, items, "key_", item))
        every = part if every is None else every.unionByName(part)
    scratch.drop(texts)
    merged = every.groupBy("key_").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("ranges")).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return keyed.join(merged, "key_", "left").select(id_col, "n_words", _merge_ranges(F.col("ranges")).alias("ranges"), "items")


def _merge_ranges(flat: F.Column) -> F.Column:
    """Overlapping ranges of a flat list, made one."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(flat) / 2).cast("int") - 1), lambda k: F.struct(F.get(flat, 2 * k).alias("a"), F.get(flat, 2 * k + 1).alias("b"))))

    def add(out: F.Column, x: F.Column) -> F.Column:
        n = F.size(out)
        last = F.get(out, n - 1)
        joined = F.concat(F.slice(out, 1, F.greatest(n - 1, F.lit(0))), F.array(F.greatest(last, x["b"])))
        return F.when((n > 0) & (x["a"] <= last), joined).otherwise(F.concat(out, F.array(x["a"], x["b"])))

    return F.when(F.size(flat) > 0, F.aggregate(pairs, F.expr("array() :: array<bigint>"), add)).otherwise(flat)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 13, share: int = 20, limit: int = MAX_PATTERN_BYTES) -> DataFrame:
    """Per document n_words, n_hit, n_items, items_sha256 and ``contaminated``: at least 1/``share`` of the words hit."""
    found = contaminated_ranges(docs, benchmark, id_col, text_col, item_col, item_text, size, limit)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, x: x - s)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (F.lit(share) * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 13, share: int = 20, limit: int = MAX_PATTERN_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text isn't contaminated, with all their columns; told by the text, so rows without an id and rows that share one are judged each on its own."""
    blocks = _blocks(benchmark, item_col, item_text, size, limit)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        # one block: every row is judged where it lies, nothing is shuffled
        sent, at = docs.sparkSession.sparkContext.broadcast(first), docs.columns.index(text_col)

        def clean(matcher: Matcher, text: str | None) -> bool:
            n, ranges, _ = matcher.find(text)
            hit = sum(b - a for a, b in ranges)
            return not hit or share * hit < n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for batch in batches:
                yield batch.filter(pa.array([clean(matcher, t.as_py()) for t in batch.column(at)], pa.bool_()))

        return C.map_arrow(docs, run, docs.schema.fields)
    keyed = docs.withColumn("key_", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    found = contamination(keyed.select("key_", text_col), benchmark, "key_", text_col, item_col, item_text, size, share, limit)
    return keyed.join(found.filter("contaminated").select("key_").distinct(), "key_", "left_anti").select(*docs.columns)


def digest_of(items: list[int]) -> str:
    """As items_sha256, in Python."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()

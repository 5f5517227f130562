"""Vector codes: eight part codebooks of sixteen entries, fitted by integer k-means as tree aggregations.

Vectors become integers (floor of 4096 times a component) and are cut into eight equal parts. They are kept
as blocks of columns in the shared folder. A round is one ``treeAggregate`` over the blocks: distances to a
part's entries accumulate dimension by dimension, the nearest entry takes the part, and 64-bit tensors of sums and
counts, filled by ``np.add.at``, are merged through a reduction tree. They have one size whatever the rows, as
have the codebooks that go out. All arithmetic is on integers, so neither order nor partitions change a result.

Sums of errors over equal labels: labels that hold at least one row in ``HEAVY`` are broadcast (there are no
more than ``HEAVY``), the rows of the others meet theirs in a join in which no label has many.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped. The codebooks
begin as the rows of the smallest distinct ids (null comes last; of rows that share an id, the smallest
vector), fewer where there are fewer. Vectors are padded with zeros to a multiple of eight. A vector of another
length than that of the smallest id has a null code and a null error. Components too large for 64-bit sums of
squares are taken as Python integers; an error or a sum beyond 64 bits is null. Repeated rows count as often as they
stand there; null labels are one label; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.llm import common as C
from stratiform.llm.ogg import _arrow_type

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block.
BLOCK = 4096
#: Labels whose sums are broadcast at most.
HEAVY = 4096

Tensors = tuple[np.ndarray, np.ndarray]


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Components end to end, where each row's begin, their numbers, and which rows are kept."""
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
    keep = np.asarray(column.is_valid()) & (bad[ends] == bad[ends - sizes])
    return flat, ends - sizes, sizes, keep


def columns(flat: np.ndarray, starts: np.ndarray, dim: int) -> np.ndarray:
    """Components of rows of one length as columns, padded with zeros to a multiple of ``PARTS``."""
    x = flat[starts + np.arange(dim)[:, None]] if len(starts) and dim else np.zeros((dim, len(starts)))
    return np.vstack([x, np.zeros((-dim % PARTS, len(starts)))])


def whole(x: np.ndarray, exact: bool) -> np.ndarray:
    """floor(4096 x) as 64-bit or, where ``exact``, as Python integers."""
    if not exact:
        return np.floor(x * SCALE).astype(np.int64)
    big = np.frompyfunc(lambda v: int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE), 1, 1)
    return big(x).reshape(x.shape)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each column's nearest entry and its squared distance. ``x``: (width, n), ``book``: (entries, width)."""
    distance = np.zeros((book.shape[0], x.shape[1]), x.dtype)
    for j in range(x.shape[0]):
        gap = x[j] - book[:, j, None]
        distance += gap * gap
    index = np.argmin(distance, axis=0)
    return index, distance[index, np.arange(x.shape[1])]


def tensors(x: np.ndarray, books: np.ndarray) -> Tensors:
    """Sums (part, component, entry) and counts (part, entry) of one block assigned to the codebooks (part, entry, component)."""
    parts, entries, width = books.shape
    sums, counts = np.zeros((parts, width, entries), books.dtype), np.zeros((parts, entries), np.int64)
    for p in range(parts):
        own = x[p * width : (p + 1) * width]
        index, _ = nearest(own, books[p])
        np.add.at(counts[p], index, 1)
        for j in range(width):
            np.add.at(sums[p, j], index, own[j])
    return sums, counts


def merged(a: Tensors | None, b: Tensors | None) -> Tensors | None:
    return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])


def moved(books: np.ndarray, total: Tensors | None) -> np.ndarray:
    """Every used entry becomes the floor of its parts' mean."""
    if total is None:
        return books
    sums, counts = total
    used = counts > 0
    means = sums.transpose(0, 2, 1) // np.maximum(counts, 1)[:, :, None]
    return np.where(used[:, :, None], means, books)


def _lowest(src: DataFrame, id_col: str, vec_col: str, dim: int | None) -> list[tuple[object, list[float]]]:
    """The kept rows of the ``ENTRIES`` smallest distinct ids: every task sends that many, Spark takes the least of them."""
    kind, number = _arrow_type(src, id_col), pa.float64()

    def order(row: tuple) -> tuple:
        return (row[0] is None, row[0] if row[0] is not None else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list[float]] = {}
        for batch in batches:
            flat, starts, sizes, keep = vectors(batch.column(1))
            if dim is not None:
                keep = keep & (sizes == dim)
            ids = batch.column(0).to_pylist()
            worst = max(map(order, held.items())) if len(held) >= ENTRIES else None
            for i in np.flatnonzero(keep).tolist():
                k = ids[i]
                if worst is not None and order((k, None)) > worst:
                    continue
                own = flat[starts[i] : starts[i] + sizes[i]].tolist()
                held[k] = min(held.get(k, own), own)
                if len(held) > ENTRIES:
                    held = dict(sorted(held.items(), key=order)[:ENTRIES])
                worst = max(map(order, held.items())) if len(held) >= ENTRIES else None
        yield pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array(list(held.values()), pa.list_(number))], ["id", "v"])

    fields = [T.StructField("id", src.schema[id_col].dataType, True), C.field("v", "array<double>")]
    rows = C.map_arrow(src, run, fields).groupBy("id").agg(F.min("v").alias("v")).orderBy(F.col("id").asc_nulls_last()).limit(ENTRIES).collect()
    return [(r.id, r.v) for r in rows]


def _blocks(src: DataFrame, vec_col: str, dim: int) -> DataFrame:
    """(n, top, raw): blocks of vectors, component by component as doubles of the columns' precision, with their largest size."""
    narrow = isinstance(src.schema[vec_col].dataType.elementType, T.FloatType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                flat, starts, sizes, keep = vectors(batch.column(0)[at : at + BLOCK])
                x = columns(flat, starts[keep & (sizes == dim)], dim)
                if x.shape[1]:
                    raw = x.astype(np.float32 if narrow else np.float64).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int64()), pa.array([float(np.abs(x).max(initial=0))]), pa.array([raw], pa.binary())], ["n", "top", "raw"])

    return C.map_arrow(C.pick(src, vec_col), run, [C.field("n", "long"), C.field("top", "double"), C.field("raw", "binary")])


def fit(src: DataFrame, id_col: str, vec_col: str, scratch: C.Scratch, rounds: int = ROUNDS) -> tuple[np.ndarray, int, bool] | None:
    """Codebooks (part, entry, component), the vectors' length, and whether they need integers beyond 64 bits; None without vectors."""
    first = _lowest(src, id_col, vec_col, None)
    if not first:
        return None
    dim = len(first[0][1])
    if any(len(v) != dim for _, v in first):
        first = _lowest(src, id_col, vec_col, dim)
    blocks = scratch.keep(_blocks(src, vec_col, dim))
    n, top = blocks.agg(F.sum("n"), F.max("top")).first()
    size = max(1, dim + -dim % PARTS)
    # whole components are at most top * 4096 + 1; their sums, and the squares of differences over a vector, must stay in 64 bits
    bound = int(top) * SCALE + SCALE + 1
    exact = n * bound >= 1 << 62 or size * (2 * bound) ** 2 >= 1 << 62
    seeds = whole(columns(np.array([v for _, v in first], np.float64).ravel(), np.arange(len(first)) * dim, dim), exact)
    width = seeds.shape[0] // PARTS
    books = np.ascontiguousarray(seeds.reshape(PARTS, width, len(first)).transpose(0, 2, 1))
    kind = np.float32 if isinstance(src.schema[vec_col].dataType.elementType, T.FloatType) else np.float64
    rows = blocks.select("n", "raw").rdd
    depth = 2 if rows.getNumPartitions() <= 256 else 3
    for _ in range(rounds):
        sent = src.sparkSession.sparkContext.broadcast(books)

        def add(total: Tensors | None, block: T.Row, sent=sent) -> Tensors:
            x = np.frombuffer(block.raw, kind).astype(np.float64).reshape(-1, block.n)
            return merged(total, tensors(whole(x, exact), sent.value))

        books = moved(books, rows.treeAggregate(None, add, merged, depth))
        sent.unpersist()
    scratch.drop(blocks)
    return books, dim, exact


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components, in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(df: DataFrame, books: np.ndarray, dim: int, exact: bool, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error) of every kept row. ``books``, ``dim``, ``exact``: from ``fit``."""
    src = C.pick(df, id_col, vec_col, label_col)
    sent = df.sparkSession.sparkContext.broadcast(books)
    kinds = [_arrow_type(src, c) for c in (id_col, label_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = sent.value.shape
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                flat, starts, sizes, keep = vectors(part.column(1))
                right = sizes[keep] == dim
                x = whole(columns(flat, starts[keep][right], dim), exact)
                found = [nearest(x[p * width : (p + 1) * width], sent.value[p]) for p in range(parts)]
                code, error = np.full(len(right), None, object), np.full(len(right), None, object)
                code[right] = ["".join(f"{k:02x}" for k in own) for own in np.stack([f[0] for f in found], 1).tolist()] if right.any() else []
                error[right] = [e if e < 1 << 63 else None for e in sum(f[1] for f in found).tolist()]
                own = part.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([own.column(0).cast(kinds[0]), own.column(2).cast(kinds[1]), pa.array(code.tolist(), pa.string()), pa.array(error.tolist(), pa.int64())], [id_col, label_col, "code", "error"])

    return C.map_arrow(src, run, [C.id_field(src, id_col), C.id_field(src, label_col), C.field("code", "string"), C.field("error", "long")])


def vector_codes(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", heavy: int = HEAVY) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every kept row."""
    scratch = C.Scratch(df.sparkSession, "codes")
    src = C.pick(df, id_col, vec_col, label_col)
    fitted = fit(src, id_col, vec_col, scratch)
    if fitted is None:
        fields = [C.id_field(src, id_col), *(C.field(c, k) for c, k in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string")))]
        return df.sparkSession.createDataFrame([], T.StructType(fields))
    books, dim, exact = fitted
    coded = scratch.keep(encode(src, books, dim, exact, id_col, vec_col, label_col))
    sums = scratch.keep(coded.groupBy(F.col(label_col).alias("label_")).agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n_")))
    most = coded.count() / heavy
    large, small = sums.filter(F.col("n_") >= most).drop("n_"), sums.filter(F.col("n_") < most).drop("n_")
    same = F.col(label_col).eqNullSafe(F.col("label_"))
    out = coded.join(F.broadcast(large.withColumn("known_", F.lit(True))), same, "left").drop("label_")
    if not small.isEmpty():
        rest = out.filter("known_ is null").drop("label_error", "known_").join(small, same, "left").drop("label_")
        out = out.filter("known_").drop("known_").unionByName(rest)
    return out.select(id_col, "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))

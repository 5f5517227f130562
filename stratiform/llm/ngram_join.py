"""N-gram Jaccard self-join by token-combination prefixes.

A document's set holds its distinct word shingles (tokens). Equal sets are one class. Two classes link
if ``100 * intersection >= percent * union``; then at most ``tau = n - ceil(percent * n / 100)`` tokens
of either are missing from the other.

1. *Census.* Tokens of the lower half of the hash space are counted over all documents, in compact
   blobs by hash range. A set with more than tau tokens nobody else has can't link; the rest are
   candidates. A fixed-size bitmap of their keys filters the following scan. Among the candidates whole
   sets are counted again, so those that only resemble a group too little are out, and each one's
   number of shared tokens bounds its intersection with any other.
2. *Prefixes.* All sets order tokens by hash. Tokens that at most ``RARE`` candidates hold are rare
   and indexed singly; the others are frequent, dealt into ``groups`` by hash, and indexed as pairs of one
   group. The prefix is extended until rare tokens, plus one less than its frequent tokens in each group,
   exceed tau: without a common rare token and with at most one common frequent token a group, more than
   tau tokens would be missing. So linked sets share a signature.
3. *Verification* on whole sets: every signature has a pivot, a holder that shares most of its tokens.
   First each set meets one of its pivots; components of these links settle the groups of thousands of
   near copies with one comparison a set. Where a signature still has holders in different components,
   all of them meet its pivot, then the pairs of holders in different components meet, as far as their
   intersections with the pivot and their sketches, bitmaps of at least two bits a token, leave it possible.

Nothing is dropped: signatures have no cap. Shuffles carry hashes and sets of candidates, never
texts.

Defined cases: null, empty and blank texts have an empty set, link with nothing and are their own
component; fewer words than a shingle: the whole sequence is the one token; a null id is never the
smallest of a component, one of its own if it has an empty set; repeated rows are one class; tables
may be empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.llm import bitmap
from stratiform.llm import common as C
from stratiform.llm.components import components
from stratiform.llm.hashing import mix, pairs_mixed, word_shingles
from stratiform.llm.ogg import _arrow_type

SHINGLE, PERCENT = 5, 75
#: Candidates that may hold a rare token.
RARE = 32
#: Groups of frequent tokens for sets of at least ``LARGE`` tokens; smaller sets have one group.
LARGE, GROUPS = 64, 16
#: Parts in which the sets of a component are labelled.
PARTS = 16
#: Times that whole sets are counted among the candidates left.
COUNTS = 2
#: Smallest signatures of a set by which repeated meetings of a pair are told.
FIRST = 12
#: Owner of a token that a block has counted itself.
NOBODY = (1 << 16) - 1
#: Tokens that a block of the census holds, and a range of hashes.
BLOCK_TOKENS, RANGE_TOKENS = 500_000, 1_000_000


def tau(n, percent: int):
    """Tokens that a set of n may miss."""
    return n - (percent * n + 99) // 100


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit keys of a set, digests of its sorted tokens."""
    raw = hashlib.blake2b(tokens.tobytes(), digest_size=16, key=b"stratiform sets").digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _sets(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple[tuple[int, int], np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            own = [word_shingles(t.as_py(), SHINGLE) for t in batch.column(column)[at : at + 500]]
            yield [(set_key(x), x) for x in own]


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, byte by byte, so that equal high bytes stand together and compress."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _stored(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple[tuple[int, int], np.ndarray]]]:
    for batch in batches:
        yield [((k, 0), np.frombuffer(x.as_buffer(), np.uint64)) for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]


def census(df: DataFrame, total: int, percent: int) -> DataFrame:
    """(key, shared): sets of which at most tau of the counted tokens are in no other set, and how many
    are; a superset of those that link. ``df`` holds texts, of which the lower half of the hash space is
    counted, or (key, tokens), which are counted whole.

    A token that several sets of a block hold is counted there and sent once, without an owner, so the
    rows of a hot token grow with the blocks, not with the sets.
    """
    whole = len(df.columns) > 1
    read, top = (_stored, 64) if whole else (_sets, 63)
    bits = max(10, int(total // RANGE_TOKENS).bit_length())

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        keys: dict[tuple[int, int], int] = {}
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            block = part << 24 | number
            number += 1
            sizes = np.array([len(x) for x in held])
            tokens, owner = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            first = np.r_[True, tokens[1:] != tokens[:-1]] if len(tokens) else np.empty(0, bool)
            size = np.diff(np.r_[np.flatnonzero(first), len(tokens)])
            counted = np.bincount(owner[np.repeat(size > 1, size)], minlength=len(held))
            tokens, owner = tokens[first], np.where(size > 1, NOBODY, owner[first])
            at = (tokens >> np.uint64(top - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(at)) + 1
            ranges = at[np.r_[0, cuts]] if len(at) else np.empty(0, np.int64)
            rest = (tokens & np.uint64((1 << (top - bits)) - 1)) >> np.uint64(max(0, top - bits - 40))
            a = [_planes(x, 5) for x in np.split(rest, cuts)] if len(at) else []
            b = [_planes(x, 2) for x in np.split(owner.astype(np.uint64), cuts)] if len(at) else []
            own = [np.array([k for k, _ in keys], np.int64).tobytes()], [np.stack([sizes, np.array(list(keys.values())), counted]).astype("<i8").tobytes()]
            out = pa.RecordBatch.from_arrays([pa.array(np.r_[ranges, -1 - block], pa.int64()), pa.array([block] * (len(a) + 1), pa.int64()), pa.array(a + own[0], pa.binary()), pa.array(b + own[1], pa.binary())], ["range", "block", "tokens", "owners"])
            keys.clear()
            held.clear()
            return out

        count = 0
        for own in read(batches, 0):
            for key, x in own:
                if len(x) and key not in keys:
                    keys[key] = len(x)
                    held.append(x if whole else x[: np.searchsorted(x, np.uint64(1 << 63))])
                    count += len(held[-1])
                    if count > BLOCK_TOKENS or len(held) > 60_000:
                        yield flush()
                        count = 0
        if held:
            yield flush()

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by range: for every block the owners of tokens that stand more than once in the range."""
        held: list[tuple[int, np.ndarray, bytes]] = []
        at = None

        def close() -> Iterator[pa.RecordBatch]:
            tokens = np.concatenate([t for _, t, _ in held])
            order = np.argsort(tokens, kind="stable")
            same = np.diff(tokens[order]) == 0
            hit = np.zeros(len(tokens), bool)
            hit[order[1:]] |= same
            hit[order[:-1]] |= same
            start, blocks, owners = 0, [], []
            for block, t, raw in held:
                mine = hit[start : start + len(t)]
                start += len(t)
                if mine.any():
                    blocks.append(block)
                    owners.append(_numbers(raw, 2)[mine].astype("<u2").tobytes())
            held.clear()
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(owners, pa.binary()), pa.array([None] * len(blocks), pa.binary())], ["block", "owners", "keys"])

        for batch in batches:
            for r, block, tokens, owners in zip(*(batch.column(k) for k in range(4)), strict=True):
                r = r.as_py()
                if r < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([owners.as_py()], pa.binary()), pa.array([tokens.as_py()], pa.binary())], ["block", "owners", "keys"])
                    continue
                if r != at and held:
                    yield from close()
                at = r
                held.append((block.as_py(), _numbers(tokens.as_py(), 5), owners.as_py()))
        if held:
            yield from close()

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, the one with the keys first."""
        keys, sizes, n, count, at = np.empty(0, np.int64), None, None, None, None

        def close() -> Iterator[pa.RecordBatch]:
            if at is not None:
                good = sizes - count <= tau(n, percent)
                yield pa.RecordBatch.from_arrays([pa.array(keys[good], pa.int64()), pa.array(count[good], pa.int64())], ["key", "shared"])

        for batch in batches:
            for block, owners, own in zip(*(batch.column(k) for k in range(3)), strict=True):
                if own.is_valid:
                    yield from close()
                    at, keys = block.as_py(), np.frombuffer(own.as_py(), np.int64)
                    sizes, n, count = np.frombuffer(owners.as_py(), "<i8").reshape(3, -1)
                    count = count.copy()
                else:
                    assert block.as_py() == at
                    own_of = np.frombuffer(owners.as_py(), "<u2")
                    count += np.bincount(own_of[own_of != NOBODY], minlength=len(keys))
        yield from close()

    parts = C.map_arrow(df, blobs, [C.field("range", "long"), C.field("block", "long"), C.field("tokens", "binary"), C.field("owners", "binary")])
    by_range = parts.repartition("range").sortWithinPartitions("range")
    found = C.map_arrow(by_range, repeated, [C.field("block", "long"), C.field("owners", "binary"), C.field("keys", "binary")])
    by_block = found.withColumn("late", F.col("keys").isNull()).repartition("block").sortWithinPartitions("block", "late").drop("late")
    return C.map_arrow(by_block, chosen, [C.field("key", "long"), C.field("shared", "long")])


def _with_sets(df: DataFrame, id_col: str, text_col: str, bits: np.ndarray) -> DataFrame:
    """(id, key, check, n, tokens) of every row; tokens, a binary of the sorted hashes, only of sets in the bitmap, once a task."""
    src = C.pick(df, id_col, text_col)
    kind = _arrow_type(src, id_col)
    sent = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own = next(_sets(iter([part]), 1))
                ok = bitmap.has(sent.value, np.array([k for (k, _), _ in own], np.int64).view(np.uint64))
                raw = [x.tobytes() if good and len(x) and k not in seen else None for (k, x), good in zip(own, ok, strict=True)]
                if len(seen) < 100_000:  # copies inside a task; others meet later
                    seen.update(k for (k, _), r in zip(own, raw, strict=True) if r)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(kind), pa.array([k for (k, _), _ in own], pa.int64()), pa.array([c for (_, c), _ in own], pa.int64()), pa.array([len(x) for _, x in own], pa.int64()), pa.array(raw, pa.binary())], [id_col, "key", "check", "n", "tokens"])

    return C.map_arrow(src, run, [C.id_field(src, id_col), C.field("key", "long"), C.field("check", "long"), C.field("n", "long"), C.field("tokens", "binary")])


def _head(raw: bytes, percent: int) -> np.ndarray:
    """The tokens a prefix may need: tau + 1, and one for every group."""
    x = np.frombuffer(raw, np.uint64)
    return x[: tau(len(x), percent) + 1 + GROUPS]


def _tokens(sets: DataFrame, percent: int) -> DataFrame:
    """(token, key) rows of the heads of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = [_head(x.as_buffer(), percent).view(np.int64) for x in batch.column(1)[at : at + 256]]
                keys = np.repeat(batch.column(0)[at : at + 256].to_numpy(), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own), pa.int64()), pa.array(keys, pa.int64())], ["token", "key"])

    return C.map_arrow(sets.select("key", "tokens"), run, [C.field("token", "long"), C.field("key", "long")])


def signatures_of(tokens: np.ndarray, kinds: np.ndarray, n: int, groups: int, percent: int) -> np.ndarray:
    """Signatures of one set. ``tokens``: its first tokens in hash order; ``kinds``: 0 alone, 1 rare, 2 frequent."""
    frequent = kinds == 2
    group = (mix(tokens ^ np.uint64(groups)) % np.uint64(groups)).astype(np.int64)
    worth = np.ones(len(tokens), np.int64)
    seen: set[int] = set()
    for i in np.flatnonzero(frequent):
        if group[i] not in seen:
            seen.add(int(group[i]))
            worth[i] = 0
    end = int(np.searchsorted(np.cumsum(worth), tau(n, percent) + 1)) + 1
    out = [tokens[:end][kinds[:end] == 1]]
    for g in seen:
        own = np.sort(tokens[:end][frequent[:end] & (group[:end] == g)])
        a, b = np.triu_indices(len(own), 1)
        out.append(pairs_mixed(own[a], own[b]) ^ np.uint64(groups))
    return np.concatenate(out)


def signatures(sets: DataFrame, shared: DataFrame, kinds: DataFrame, percent: int) -> DataFrame:
    """(sig, key, n, r) from sets, their (key, shared) (r: shared) and the kinds of their tokens (key, marks: array of (token, kind)) of those that aren't alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, keys, sizes, common = [], [], [], []
            for key, n, raw, marks, shared in zip(*(batch.column(k) for k in range(5)), strict=True):
                key, n, tokens = key.as_py(), n.as_py(), _head(raw.as_buffer(), percent)
                kind = np.zeros(len(tokens), np.int8)
                own = marks.values
                if own is not None and len(own):
                    t, k = own.field(0).to_numpy().view(np.uint64), own.field(1).to_numpy()
                    kind[np.searchsorted(tokens, t)] = k
                regimes = {GROUPS if n >= LARGE else 1}
                regimes |= {1} if percent * n < 100 * LARGE <= 100 * n else set()  # smaller partners have one group
                regimes |= {GROUPS} if n < LARGE and 100 * n >= percent * LARGE else set()
                mine = [signatures_of(tokens, kind, n, g, percent) for g in regimes] if n > 2 else []
                mine = np.unique(np.concatenate(mine)) if mine else np.empty(0, np.uint64)
                sigs.append(mine)
                keys.append(np.full(len(mine), key))
                sizes.append(np.full(len(mine), n))
                common.append(np.full(len(mine), shared.as_py()))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64), pa.int64()), pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(common), pa.int64())], ["sig", "key", "n", "r"])

    rows = sets.join(shared, "key").join(kinds, "key").select("key", "n", "tokens", "marks", "shared")
    return C.map_arrow(rows, run, [C.field(c, "long") for c in ("sig", "key", "n", "r")])


def _among(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """The sets (key, n, tokens) whose key may be in ``keys`` (key): a filter of fixed size, nothing is shuffled but the keys."""
    sent = sets.sparkSession.sparkContext.broadcast(bitmap.build(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitmap.has(sent.value, batch.column(0).to_numpy().view(np.uint64))))

    rows = sets.select("key", "n", "tokens")
    return C.map_arrow(rows, run, rows.schema.fields)


def overlaps(pairs: DataFrame, sets: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(a, b, n, m, both): sizes and intersection of the whole sets of distinct pairs (a, b)."""
    pairs = scratch.keep(pairs)
    sets = _among(sets, pairs.select(F.explode(F.array("a", "b")).alias("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in ([len(x) for x, _ in rows], [len(y) for _, y in rows], both))], ["a", "b", "n", "m", "both"])

    left = sets.select(F.col("key").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
    return C.map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, [C.field(c, "long") for c in ("a", "b", "n", "m", "both")])


def sketch(tokens: np.ndarray) -> bytes:
    """A bitmap of at least two bits a token: each bit is the parity of the number of tokens with its number as their low bits."""
    bits = max(256, 1 << (2 * len(tokens)).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def most_shared(n: int, x: bytes, m: int, y: bytes) -> int:
    """The largest intersection that sets of n and m tokens with these sketches can have.

    Where the sketches differ, so do the sets, in another token at each place; a longer sketch is folded to the other's length.
    """
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return (n + m - int(np.bitwise_count(a ^ b).sum())) // 2


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int, scratch: C.Scratch) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule a link out; sketches are a thirtieth of the sets."""
    pairs = scratch.keep(pairs)
    sent = sets.sparkSession.sparkContext.broadcast(bitmap.build(pairs.select(F.explode(F.array("a", "b")).alias("key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bitmap.has(sent.value, batch.column(0).to_numpy().view(np.uint64))))
            drawn = [sketch(np.frombuffer(x.as_buffer(), np.uint64)) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(drawn, pa.binary())], ["key", "n", "sketch"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            keep = [(100 + percent) * most_shared(n, x, m, y) >= percent * (n + m) for n, x, m, y in rows]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    fields = [C.field("key", "long"), C.field("n", "long"), C.field("sketch", "binary")]
    drawn = scratch.keep(C.map_arrow(sets.select("key", "n", "tokens"), run, fields))
    both = pairs.join(drawn.toDF("a", "n", "x"), "a").join(drawn.toDF("b", "m", "y"), "b").select("a", "b", "n", "x", "m", "y")
    out = scratch.keep(C.map_arrow(both, check, [C.field("a", "long"), C.field("b", "long")]))
    scratch.drop(pairs, drawn)
    return out


def _linked(scored: DataFrame, percent: int) -> DataFrame:
    return scored.filter(100 * F.col("both") >= percent * (F.col("n") + F.col("m") - F.col("both"))).select("a", "b")


def _close(percent: int) -> F.Column:
    """Pairs (a, b) of n and m tokens, of which r and s are in any other set, that may link: the smaller
    of r and s must reach the intersection that the sizes ask for."""
    sizes = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    return sizes & ((100 + percent) * F.least("r", "s") >= percent * (F.col("n") + F.col("m"))) & (F.col("a") != F.col("b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _open(signed: DataFrame, known: DataFrame | None, scratch: C.Scratch) -> DataFrame:
    """(sig, key, n, r, component) of signatures whose holders are in different components."""
    labelled = signed.select("sig", "key", "n", "r")
    if known is None:
        labelled = labelled.withColumn("component", F.col("key"))
    else:
        labelled = labelled.join(known.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    mixed = labelled.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("sig")
    return scratch.keep(labelled.join(mixed, "sig"))


def links(sets: DataFrame, shared: DataFrame, percent: int, scratch: C.Scratch) -> DataFrame:
    """(node, component) of the keys of sets (key, n, tokens) that link with another one; shared: (key, shared)."""
    tokens = _tokens(sets, percent)
    kinds = tokens.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token", F.when(F.col("c") > RARE, 2).otherwise(1).cast("byte").alias("kind"))
    marks = tokens.join(kinds, "token").groupBy("key").agg(F.collect_list(F.struct("token", "kind")).alias("marks"))
    signed = scratch.keep(signatures(sets, shared, marks, percent))
    open_ = _open(signed, None, scratch)
    scratch.drop(signed)
    # a holder that shares most of its tokens, the same one for all signatures where it can be
    order = F.struct(-F.col("r") / F.col("n"), F.xxhash64("key"), "key", "n", "r")
    pivots = scratch.keep(open_.groupBy("sig").agg(F.min(order).alias("p")).select("sig", F.col("p.key").alias("b"), F.col("p.n").alias("m"), F.col("p.r").alias("s")))
    star = lambda rows: rows.withColumnRenamed("key", "a").join(pivots, "sig").filter(_close(percent))
    # one pivot a set, in one order for all, then the others where that leaves a question
    choice = star(open_).groupBy("a").agg(F.min(F.struct(-F.col("s") / F.col("m"), F.xxhash64("b"), "b")).alias("p")).select("a", "p.b")
    one = scratch.keep(overlaps(_ordered(choice), sets, scratch))
    early = components(_linked(one, percent), scratch)
    again = _open(open_, early, scratch)
    scratch.drop(open_)
    two = scratch.keep(overlaps(_ordered(star(again)).join(one.select("a", "b"), ["a", "b"], "left_anti"), sets, scratch))
    tried = one.unionByName(two)
    known = components(early.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_linked(two, percent)), scratch)
    rest = _open(again, known, scratch)
    scratch.drop(again)
    held = tried.select("a", "b", "both").unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b"), "both")).withColumnRenamed("a", "key")
    brief = F.shiftright("sig", 32).cast("int")
    first = rest.groupBy("key").agg(F.slice(F.array_sort(F.collect_set(brief)), 1, FIRST).alias("first"))
    near = rest.join(first, "key").join(pivots.select("sig", "b"), "sig").join(held, ["key", "b"], "left").withColumn("o", F.when(F.col("key") == F.col("b"), F.col("n")).otherwise(F.col("both"))).select("sig", F.col("key").alias("a"), "n", "r", "o", "component", "first")
    other = near.select("sig", F.col("a").alias("b"), F.col("n").alias("m"), F.col("r").alias("s"), F.col("o").alias("q"), F.col("component").alias("other"), F.col("first").alias("second"))
    # a pair meets once, not in all its common signatures, if their first ones have any in common
    once = F.coalesce(brief <= F.array_min(F.array_intersect("first", "second")), F.lit(True))
    # of an intersection, one part is in the pivot, too, the other among the shared tokens that are not
    most = F.coalesce(F.least("o", "q") + F.least(F.col("r") - F.col("o"), F.col("s") - F.col("q")), F.least("r", "s"))
    enough = (100 + percent) * most >= percent * (F.col("n") + F.col("m"))
    pairs = near.join(other, "sig").filter((F.col("component") < F.col("other")) & _close(percent) & enough & once)
    left = _plausible(_ordered(pairs).join(tried.select("a", "b"), ["a", "b"], "left_anti"), sets, percent, scratch)
    scratch.drop(rest)
    last = scratch.keep(_linked(overlaps(left, sets, scratch), percent))
    return components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(last), scratch)


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id): the smallest id reachable by links."""
    C.small_batches(df.sparkSession)
    scratch = C.Scratch(df.sparkSession, "ngram")
    df = C.pick(df, id_col, text_col)
    size = df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    chosen = scratch.keep(census(C.pick(df, text_col), size // 7, percent).select("key"))
    read = scratch.keep(_with_sets(df, id_col, text_col, bitmap.build(chosen)))
    told = C.apart(read, "key", "check", scratch)
    sets = scratch.keep(told.filter("tokens is not null").select("key", "n", "tokens").dropDuplicates(["key"]))
    docs = scratch.keep(told.select(id_col, "key", "n"))
    scratch.drop(read)
    for _ in range(COUNTS):
        shared = scratch.keep(census(sets.select("key", "tokens"), size // 7, percent))
        fewer = scratch.keep(_among(sets, shared.select("key")))
        scratch.drop(sets)
        sets = fewer
    known = links(sets, shared, percent, scratch)
    least = docs.filter("n > 0").groupBy("key").agg(F.min(id_col).alias("low"))
    # the sets of a component meet in parts, so that a huge one is not a single task's
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS))
    linked = scratch.keep(known.withColumnRenamed("node", "key").join(least, "key").withColumn("part", part))
    smallest = linked.groupBy("component").agg(F.min("low").alias("least")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>")))
    lowest = linked.join(smallest, ["component", "part"]).select("key", "least")
    of_key = least.join(lowest, "key", "left").select("key", F.coalesce("least", "low").alias("least"))
    return docs.select(id_col, "key", "n").join(of_key, "key", "left").select(id_col, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col(id_col)).alias("component_id"))

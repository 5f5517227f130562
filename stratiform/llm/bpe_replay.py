"""Byte-level BPE by merge replay over a corpus slice.

The distinct words of a slice of the corpus (a batch of documents, less the words seen lately) are
laid out in one sequence of tokens. An inverted index from merge rank to the places of its pair is
built once; the ranks are then applied in order over all words together, and each merge touches only
the two neighbours of the place. Documents are put together from the words' ids. No shuffle; what a
task holds is bounded by ``CACHE_WORDS`` and a batch.

Each match of the pattern is encoded separately and without special tokens; a match that is itself in
the vocabulary is that one id. Defined cases: null counts as empty text, which has no tokens; null ids
and repeated rows pass through; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stratiform.llm import common as C
from stratiform.llm.ogg import _arrow_type

#: Words whose ids a worker remembers between batches; about 250 bytes each.
CACHE_WORDS = 150_000
#: New words that are replayed together; more would not fit the processor's cache.
SLICE_WORDS = 3_000
#: Longest match that goes into the common sequence; longer ones are replayed alone, not remembered.
LONG = 4096


class Vocabulary:
    """Ranks of a ``.tiktoken`` file and the replay over them."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(pattern)
        self.pairs = self._pairs()
        self.cache: dict[str, tuple[int, bytes, bytes]] = {}
        self.met: set[str] = set()

    def _pairs(self) -> dict[int, int]:
        """Rank of the merge of two tokens, by ``left << 20 | right``: every split of every token."""
        get = self.ranks.get
        return {left << 20 | right: r for t, r in self.ranks.items() for k in range(1, len(t)) if (left := get(t[:k])) is not None and (right := get(t[k:])) is not None}

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of every word. Words are laid out one after another; -1 stands between them."""
        tokens, starts, single = [-1], [], self.single
        for w in words:
            starts.append(len(tokens))
            tokens += [single[b] for b in w]
            tokens.append(-1)
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}
        merge = self.pairs.get
        a = -1
        for i, b in enumerate(tokens):
            if a >= 0 and b >= 0 and (r := merge(a << 20 | b)) is not None:
                if r in places:
                    places[r].append(i - 1)
                else:
                    places[r] = [i - 1]
            a = b
        order = list(places)
        heapq.heapify(order)
        while order:
            rank = heapq.heappop(order)
            for i in sorted(places.pop(rank)):
                a, j = tokens[i], after[i]
                if a < 0 or (b := tokens[j]) < 0 or merge(a << 20 | b) != rank:  # one is part of another token by now
                    continue
                k, h = after[j], before[i]
                tokens[i], tokens[j] = rank, -2
                after[i], before[k] = k, i
                if (x := tokens[h]) >= 0 and (r := merge(x << 20 | rank)) is not None:
                    if r not in places:
                        places[r] = []
                        heapq.heappush(order, r)
                    places[r].append(h)
                if (x := tokens[k]) >= 0 and (r := merge(rank << 20 | x)) is not None:
                    if r not in places:
                        places[r] = []
                        heapq.heappush(order, r)
                    places[r].append(i)
        out = []
        for s in starts:
            ids = []
            while (t := tokens[s]) >= 0:
                ids.append(t)
                s = after[s]
            out.append(ids)
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])

    def _entries(self, words: list[str]) -> list[tuple[int, bytes, bytes]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = [self.ranks.get(b) for b in raw]
        ids = iter(self.replay([b for b, r in zip(raw, whole, strict=True) if r is None]))
        out = []
        for r in whole:
            own = next(ids) if r is None else [r]
            out.append((len(own), b" ".join([b"%d" % i for i in own]), self.decode(own)))
        return out

    def _make_room(self, words: set[str]) -> list[str]:
        """Words that aren't remembered. Where they don't fit, what was met again since room was last made is kept: most words come once."""
        new = [w for w in words if w not in self.cache and len(w) <= LONG]
        self.met.update(w for w in words if w in self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {w: self.cache[w] for w in self.met}
            self.met = set()
            if len(self.cache) + len(new) > CACHE_WORDS:
                self.cache = {}
                new = [w for w in words if len(w) <= LONG]
        return new

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of tokens, the SHA-256 of its ids and that of the decoded bytes."""
        found = [self.pattern.findall(t) for t in texts]
        words = set().union(*found)
        new = self._make_room(words)
        cache = self.cache
        for i in range(0, len(new), SLICE_WORDS):
            cache.update(zip(new[i : i + SLICE_WORDS], self._entries(new[i : i + SLICE_WORDS]), strict=True))
        out = []
        for words in found:
            try:
                own = [cache[w] for w in words]
            except KeyError:  # a long word
                own = [cache.get(w) or self._entries([w])[0] for w in words]
            n, ids, raw = zip(*own, strict=True) if own else ((), (), ())
            out.append((sum(n), hashlib.sha256(b" ".join(ids)).hexdigest(), hashlib.sha256(b"".join(raw)).hexdigest()))
        return out

    def encode(self, text: str) -> list[int]:
        words = [w.encode("utf-8", "surrogatepass") for w in self.pattern.findall(text)]
        rest = iter(self.replay([w for w in words if w not in self.ranks]))
        return [i for w in words for i in ([self.ranks[w]] if w in self.ranks else next(rest))]


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """A batch in runs of at most 2 MB of text, or one text."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        ids.append(i)
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size > 2_000_000:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def token_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256). ``path``: a rank file that every executor has."""
    src = C.pick(df, id_col, text_col)
    kind = _arrow_type(src, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for ids, texts in _slices(batch):
                n, a, b = zip(*v.digests(texts), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return C.map_arrow(src, run, [C.id_field(src, id_col), C.field("n_tokens", "long"), C.field("ids_sha256", "string"), C.field("decoded_sha256", "string")])


def encode_column(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids themselves."""
    src = C.pick(df, id_col, text_col)
    kind = _arrow_type(src, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for ids, texts in _slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([v.encode(t) for t in texts], pa.list_(pa.int32()))], [id_col, "ids"])

    return C.map_arrow(src, run, [C.id_field(src, id_col), C.field("ids", "array<int>")])


def decode_column(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes): ids decoded; null ids give null."""
    src = C.pick(df, id_col, ids_col)
    kind = _arrow_type(src, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            raw = [None if x is None else v.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(raw, pa.binary())], [id_col, "bytes"])

    return C.map_arrow(src, run, [C.id_field(src, id_col), C.field("bytes", "binary")])

"""Token counts of a byte-pair vocabulary with word ends, by rank-synchronous merging of arrays.

The file's own normaliser and splitter give the pre-tokens. Those that a task hasn't counted lately are
laid out in one ragged numpy array of symbols; in every round each sequence applies its pair of lowest
rank, at all its places and in all sequences at once, until no sequence has a pair left. Its count is
the number of symbols that survive. Long sequences keep their symbols in linked arrays, so that a
round touches only the places of its rank. No shuffle; a task holds ``CACHE_WORDS`` counts and a slice of
its batch.

Rounds give what merging one place after another gives if no merge can make a pair of lower rank; files
where one could are refused.

Defined cases: null counts as empty, which has no tokens; special strings inside a text are one token
each; null ids and repeated rows pass through; other columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from stratiform.llm import common as C
from stratiform.llm.ogg import _arrow_type

#: More tokens than this are over the limit.
LIMIT = 2048
#: Words (runs without a space) whose counts a worker remembers, and the longest of them.
CACHE_WORDS, CACHED_CHARS = 400_000, 256
#: Longest sequence of the common array, symbols laid out together, characters of a text read at a time.
LONG, SYMBOLS, PIECE = 512, 1 << 20, 1 << 20
_NONE = np.int64(1 << 40)


class Merges:
    """Symbols and ranked pairs of a vocabulary file."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        width = 1 << max(vocab.values()).bit_length()
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born = np.full(width, -1, np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1]
        if (np.maximum(born[left], born[right]) >= np.arange(len(made))).any() or len(np.unique(made)) < len(made):
            raise ValueError("merges must be ranked by the order in which their parts arise, and make each symbol once")
        order = np.argsort(left * width + right)
        self.width, self.made = width, made
        self.keys, self.ranks = (left * width + right)[order], order.astype(np.int64)
        # symbols of the characters that bytes stand for, inside a word and at its end; all are below 1024
        self.inner, self.final = (np.array([vocab.get(chr(c) + s, -1) for c in range(1024)], np.int64) for s in ("", suffix))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def counts(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of every word (non-empty, of characters that stand for bytes)."""
        out = np.zeros(len(words), np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = self._linked(self._symbols([words[i]], sizes[i : i + 1]))
        short = np.flatnonzero(sizes <= LONG)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes[short]) // SYMBOLS)) + 1
        for own in np.split(short, cuts):
            if len(own):
                out[own] = self._ragged(self._symbols([words[i] for i in own.tolist()], sizes[own]), sizes[own])
        return out

    def _symbols(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        out, last = self.inner[chars], np.cumsum(sizes) - 1
        out[last] = self.final[chars[last]]
        if (out < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        return out

    def _ragged(self, sym: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """All sequences side by side; ``rank[i]`` is that of symbols i and i + 1."""
        out = np.zeros(len(sizes), np.int64)
        who = np.arange(len(sizes))
        rank = np.append(self.rank(sym[:-1], sym[1:]), _NONE)
        rank[np.cumsum(sizes) - 1] = _NONE
        while len(sizes):
            starts = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(rank, starts)
            done = low == _NONE
            if done.any():
                out[who[done]] = sizes[done]
                stay = np.repeat(~done, sizes)
                sym, rank, sizes, who, low = sym[stay], rank[stay], sizes[~done], who[~done], low[~done]
                if not len(sizes):
                    break
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = _apart(np.flatnonzero(rank == low[owner]))
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sizes = sizes - np.bincount(owner[at], minlength=len(sizes))
            ends = rank[at + 1] == _NONE  # the pair behind a merge is looked up anew, the border behind a sequence stays
            sym, rank, owner, at = sym[keep], rank[keep], owner[keep], at - np.arange(len(at))
            rank[at] = _NONE
            last = np.cumsum(sizes) - 1
            new = at[~ends | (at != last[owner[at]])]
            new = new[new != last[owner[new]]]
            before = at[at > 0] - 1
            new = np.union1d(new, before[owner[before] == owner[before + 1]])
            rank[new] = self.rank(sym[new], sym[new + 1])
        return out

    def _linked(self, sym: np.ndarray) -> int:
        """One long sequence: symbols linked to their neighbours, places by rank."""
        n = len(sym)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank = np.append(np.append(self.rank(sym[:-1], sym[1:]), _NONE), _NONE)
        sym = np.append(sym, 0)
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] != _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            r = rank[at]
            for own in np.split(at, np.flatnonzero(np.diff(r)) + 1) if len(at) else ():
                k = int(rank[own[0]])
                if k not in places:
                    places[k] = []
                    heapq.heappush(waiting, k)
                places[k].append(own)

        put(np.arange(n))
        count = n
        while waiting:
            r = heapq.heappop(waiting)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            at = at[_even(np.r_[True, after[at[:-1]] != at[1:]])]
            gone = after[at]
            sym[at] = self.made[r]
            rank[gone] = _NONE
            behind = after[gone]
            after[at], before[behind] = behind, at
            count -= len(at)
            ahead = before[at]
            changed = np.unique(np.r_[at, ahead[ahead >= 0]])
            following = after[changed]
            rank[changed] = np.where(following < n, self.rank(sym[changed], sym[following]), _NONE)
            put(changed)
        return count


def _even(first: np.ndarray) -> np.ndarray:
    """Which members of runs stand at an even place of their run; ``first`` marks where one begins."""
    place = np.arange(len(first))
    return (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0


def _apart(at: np.ndarray) -> np.ndarray:
    """Of neighbouring places of one pair (a symbol twice), every second one from the left."""
    return at[_even(np.r_[True, np.diff(at) != 1])] if len(at) else at


class Counter:
    """Token counts of texts by a ``tokenizers`` file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-pair files are read")
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that depend on their surroundings are not read")
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer, library.pre_tokenizer
        names = sorted((re.escape(t["content"]) for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(names)) if names else None
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.cache: dict[str, int] = {}

    def _words(self, text: str) -> tuple[int, list[str]]:
        """Special strings, and the normalised rest, split at spaces (which no pre-token holds)."""
        special, parts = 0, [text]
        if self.special is not None:
            parts = self.special.split(text)
            special = len(parts) - 1
        words: list[str] = []
        for part in parts:
            at = 0
            while at < len(part):
                end = len(part) if len(part) - at <= PIECE else part.find(" ", at + PIECE)
                end = len(part) if end < 0 else end
                words += self.normal.normalize_str(part[at:end]).split(" ")
                at = end
        return special, words

    def _count(self, words: list[str]) -> list[int]:
        """Tokens of distinct words. They are split together; a pre-token belongs to the word that it starts in."""
        starts = np.cumsum([0] + [len(w) + 1 for w in words])[:-1]
        found = self.split.pre_tokenize_str(" ".join(words))
        if not found:
            return [0] * len(words)
        own = np.searchsorted(starts, np.array([s for _, (s, _) in found]), "right") - 1
        number: dict[str, int] = {}
        index = np.array([number.setdefault(t, len(number)) for t, _ in found])
        return np.bincount(own, self.merges.counts(list(number))[index], len(words)).astype(np.int64).tolist()

    def counts(self, texts: list[str]) -> list[int]:
        found, cache = [self._words(t) for t in texts], self.cache
        distinct = set().union(*(w for _, w in found))
        if len(cache) + len(distinct) > CACHE_WORDS:
            cache.clear()
        new = [w for w in distinct if w not in cache]
        cache.update(zip(new, self._count(new), strict=True))
        out = [special + sum(map(cache.__getitem__, words)) for special, words in found]
        for w in new:
            if len(w) > CACHED_CHARS:
                del cache[w]
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def slices(batch: pa.RecordBatch, size: int = 1 << 21) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch (null: empty) in runs of about ``size`` characters, or one text."""
    ids, texts, held = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        ids.append(i)
        texts.append(t.as_py() or "")
        held += len(texts[-1])
        if held > size:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def token_counts(df: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit). ``path``: a ``tokenizers`` file that every executor has."""
    src = C.pick(df, id_col, text_col)
    kind = _arrow_type(src, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for ids, texts in slices(batch):
                n = c.counts(texts)
                size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return C.map_arrow(src, run, [C.id_field(src, id_col), C.field("n_bytes", "long"), C.field("n_tokens", "long"), C.field("over_limit", "boolean")])

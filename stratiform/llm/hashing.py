"""64-bit hashes of all word or byte windows of a text at once, in numpy.

Words stand for a keyed digest; a window's hash is put together from those of its parts by a mixer that
is linear in nothing, not by a polynomial: no family of strings (Thue-Morse words, say) is known to
collide. Equal windows have equal hashes everywhere.
"""

from __future__ import annotations

import hashlib

import numpy as np

_KEY = b"stratiform words"


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pairs_mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of hashes, of half the cost of ``pairs_mixed``."""
    x = a * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    return x


class Windows:
    """Ranks of the strings of a text by prefix doubling: eight bytes are their own rank, the rank of 2k
    bytes is made of that of the first k and that of the k bytes behind them. Lengths between are two ranks
    that overlap."""

    def __init__(self, data: bytes) -> None:
        first = np.empty(max(0, len(data) - 7), np.uint64)
        for k in range(min(8, len(first))):
            first[k::8] = np.frombuffer(data, "<u8", (len(data) - k) // 8, k)
        self._ranks = [first]

    def ranks(self, level: int) -> np.ndarray:
        """Ranks of all strings of 2^level bytes, of eight at least."""
        while len(self._ranks) <= level - 3:
            half, last = 8 << len(self._ranks) - 1, self._ranks[-1]
            self._ranks.append(joined(last[:-half], last[half:]))
        return self._ranks[level - 3]

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Ranks of strings of one length, of eight bytes at least."""
        k = length.bit_length() - 1
        ranks = self.ranks(k)
        return mix(joined(ranks[starts], ranks[starts + (length - (1 << k))]) + np.uint64(length))

    def of_lengths(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ranks of strings of a length each."""
        out = np.empty(len(starts), np.uint64)
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            out[own] = self.of(starts[own], n)
        return out


class _Words(dict):
    """Hashes of words by a keyed digest."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=_KEY).digest(), "little")
        return h


#: Words whose hashes are remembered, and words hashed at a time.
KNOWN, PIECE = 1 << 16, 1 << 16
_known = _Words()


def word_shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words (lower case A-Z, split at ASCII white space); of the whole text if it has fewer words, of nothing if none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    own = np.empty(len(words), np.uint64)
    for at in range(0, len(words), PIECE):
        if len(_known) > KNOWN:
            _known.clear()
        part = words[at : at + PIECE]
        own[at : at + len(part)] = np.fromiter(map(_known.__getitem__, part), np.uint64, len(part))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = own[:n] + np.uint64(size)
    for k in range(1, size):
        out = joined(out, own[k : n + k])
    out = np.sort(mix(out))
    return out[np.r_[True, out[1:] != out[:-1]]]

"""Text functions as column expressions; Unicode normalisation as Arrow UDFs, for which Spark has no built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The stop words of the lexical analyzer.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def analyzed(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Lower-cased words of letters and digits, possessives stripped, stop words removed; in order, with repeats."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "['’]s\\b", "")
    return F.filter(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: ~w.isin(stop))


def spaced(text: Column) -> Column:
    """A text whose runs of ASCII letters, ASCII digits and whatever isn't ASCII are the words of ``analyzed``, stop words included."""
    raw = F.coalesce(text, F.lit(""))
    # most texts hold nothing that the expressions could find
    low = F.when(raw.contains("'") | raw.contains("’"), F.regexp_replace(F.lower(raw), "['’]s\\b", "")).otherwise(F.lower(raw))
    return F.when(F.octet_length(raw) > F.char_length(raw), F.regexp_replace(low, r"[^\x00-\x7F\p{L}\p{N}]", " ")).otherwise(low)


def content_words(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Distinct ASCII words of more than two letters that aren't stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(stop)))


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct runs of ``size`` words; a shorter text is one shingle, one without words none."""
    w = ascii_words(text)
    n = F.greatest(F.size(w) - size + 1, F.lit(1))
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(w, i, size), " "))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def figures(text: Column) -> Column:
    """Numbers in canonical form: digit groups joined, decimal comma as point; distinct and sorted."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9]{1,3}(?:[\u00a0\u202f ][0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?)"), 1)
    return F.array_sort(F.array_distinct(F.transform(raw, lambda x: F.translate(x, ",\u00a0\u202f ", "."))))


def ancestors(path: Column) -> Column:
    """All prefixes of a dotted path, the shortest first, the path itself last."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def parent(path: Column) -> Column:
    return F.when(path.contains("."), F.regexp_replace(path, r"\.[^.]+$", ""))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hash_mod(key: Column, salt: str, n: int) -> Column:
    """Deterministic bucket: the whole salted SHA-256 as a number, modulo n (below 2^31), folded over its eight 32-bit limbs."""
    digest = F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)
    limbs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.aggregate(limbs, F.lit(0).cast("long"), lambda r, x: (r * (2**32 % n) + x) % n)


def hmac_sha256(secret: bytes, text: Column) -> Column:
    """HMAC-SHA256 as hex, by its definition over two hashes."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in key)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def _normal(form: str):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return run


nfc, nfkc = _normal("NFC"), _normal("NFKC")

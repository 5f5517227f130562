"""Porter and Italian Snowball stemming, after the published descriptions; as Arrow functions over arrays of words."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from stratiform.functions.text import STOP_WORDS, analyzed, spaced

# The suffixes of Porter's steps 2, 3 and 4.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """v or c for every letter; y is a vowel after a consonant."""
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and k and out[-1] == "c") else "c"
    return out


_VOWELS_CONSONANT = re.compile("[aeiou]+[^aeiou]")


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem))) if "y" in stem else len(_VOWELS_CONSONANT.findall(stem))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _by_last(suffixes) -> dict[str, list[str]]:
    """Suffixes by their last two letters, the longest first."""
    out: dict[str, list[str]] = {}
    for s in sorted(suffixes, key=len, reverse=True):
        out.setdefault(s[-2:], []).append(s)
    return out


_LAST2, _LAST3, _LAST4 = _by_last(_STEP2), _by_last(_STEP3), _by_last(_STEP4)
#: Last letters of words that some step may change.
_CHANGING = frozenset("sdgyel") | {s[-1] for s in (*_STEP2, *_STEP3, *_STEP4)}


def _ending(word: str, by_last: dict[str, list[str]]) -> str | None:
    """The longest of the suffixes that the word ends with."""
    for s in by_last.get(word[-2:], ()):
        if word.endswith(s):
            return s
    return None


def _replaced(word: str, table: dict[str, str], by_last: dict[str, list[str]]) -> str:
    end = _ending(word, by_last)
    if end is None or _measure(word[: -len(end)]) == 0:
        return word
    return word[: -len(end)] + table[end]


@lru_cache(200_000)
def porter(word: str) -> str:
    """Stem of a lower-cased word; words of one or two letters stay."""
    if len(word) < 3 or word[-1] not in _CHANGING:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]):
            word = word[:-1]
    elif (end := "ed" if word.endswith("ed") else "ing" if word.endswith("ing") else None) and "v" in _shape(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _cvc(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP2, _LAST2), _STEP3, _LAST3)
    end = _ending(word, _LAST4)
    if end and _measure(stem := word[: -len(end)]) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
        word = stem
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    if _measure(word) > 1 and _double(word) and word[-1] == "l":
        word = word[:-1]
    return word


# The suffix lists of the Italian Snowball algorithm.
_PRONOUNS = "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split()
_VERBS = "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir".split()
_STANDARD = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split()
_AZIONE = "azione azioni atore atori".split()
_LOGIA = {"logia": "log", "logie": "log", "uzione": "u", "uzioni": "u", "usione": "u", "usioni": "u", "enza": "ente", "enze": "ente"}
_ITALIAN_VOWELS = "aeiouàèìòù"


def _region(word: str, start: int = 0) -> int:
    """First position after a consonant that follows a vowel."""
    for k in range(start + 1, len(word)):
        if word[k] not in _ITALIAN_VOWELS and word[k - 1] in _ITALIAN_VOWELS:
            return k + 1
    return len(word)


def _rv(word: str) -> int:
    """The third letter on where the word starts consonant vowel; after the next vowel where the second letter is a consonant;
    after the next consonant where two vowels start it."""
    if len(word) < 3:
        return len(word)
    vowel = [c in _ITALIAN_VOWELS for c in word]
    if vowel[0] != vowel[1] and vowel[1]:
        return 3
    wanted = not vowel[1]
    return next((k + 1 for k in range(2, len(word)) if vowel[k] == wanted), len(word))


@lru_cache(200_000)
def italian(word: str) -> str:
    """Stem of a lower-cased word."""
    for a, b in zip("áéíóú", "àèìòù", strict=True):
        word = word.replace(a, b)
    word = word.replace("qu", "qU")
    letters = list(word)
    for k in range(1, len(letters) - 1):
        if letters[k] in "ui" and letters[k - 1] in _ITALIAN_VOWELS and letters[k + 1] in _ITALIAN_VOWELS:
            letters[k] = letters[k].upper()
    word = "".join(letters)
    rv, r1 = _rv(word), _region(word)
    r2 = _region(word, r1)

    def within(end: str, start: int) -> bool:
        return word.endswith(end) and len(word) - len(end) >= start

    pronoun = _longest(word, _PRONOUNS)
    if pronoun:
        before = word[: -len(pronoun)]
        gerund = before.endswith(("ando", "endo")) and len(before) - 4 >= rv
        infinitive = before.endswith(("ar", "er", "ir")) and len(before) - 2 >= rv
        if gerund or infinitive:
            word = before + ("e" if infinitive else "")

    def cut(end: str) -> None:
        nonlocal word
        word = word[: -len(end)]

    changed = True
    end = _longest(word, [*_STANDARD, *_AZIONE, *_LOGIA, "amento", "amenti", "imento", "imenti", "amente", "ità", "ivo", "ivi", "iva", "ive"])
    if end in ("amento", "amenti", "imento", "imenti") and within(end, rv):
        cut(end)
    elif end == "amente" and within(end, r1):
        cut(end)
        if within("iv", r2):
            cut("iv")
            if within("at", r2):
                cut("at")
        elif tail := next((t for t in ("abil", "os", "ic") if within(t, r2)), None):
            cut(tail)
    elif end in _LOGIA and within(end, r2):
        word = word[: -len(end)] + _LOGIA[end]
    elif end in _AZIONE and within(end, r2):
        cut(end)
        if within("ic", r2):
            cut("ic")
    elif end == "ità" and within(end, r2):
        cut(end)
        if tail := next((t for t in ("abil", "ic", "iv") if within(t, r2)), None):
            cut(tail)
    elif end in ("ivo", "ivi", "iva", "ive") and within(end, r2):
        cut(end)
        if within("at", r2):
            cut("at")
            if within("ic", r2):
                cut("ic")
    elif end in _STANDARD and within(end, r2):
        cut(end)
    else:
        changed = False
    if not changed:
        # the longest ending that lies in RV
        verb = max((v for v in _VERBS if within(v, rv)), key=len, default=None)
        if verb:
            cut(verb)
    if word and word[-1] in "aeioàèìò" and len(word) - 1 >= rv:
        word = word[:-1]
        if word.endswith("i") and len(word) - 1 >= rv:
            word = word[:-1]
    if word.endswith(("ch", "gh")) and len(word) - 2 >= rv:
        word = word[:-1]
    return word.replace("U", "u").replace("I", "i")


def _over(stem: Callable[[str], str]):
    @F.pandas_udf(ArrayType(StringType()))
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return run


#: Stems of an array of lower-cased words; null stays null.
porter_stems, italian_stems = _over(porter), _over(italian)


def porter_analyzed(text: Column) -> Column:
    """Words of the lexical analyzer: lower case, possessives off, stop words out, stems of what has three letters or more."""
    return porter_stems(analyzed(text))


#: What a corpus scan may do in two steps: the words, and the stem of each distinct one.
porter_analyzed.words, porter_analyzed.stem = analyzed, porter
#: The same words as runs of bytes of one text, and what is left out of them: they needn't be cut into arrays first.
porter_analyzed.spaced, porter_analyzed.stop = spaced, frozenset(STOP_WORDS)


#: Articles, their contractions with prepositions, and the commonest particles; pass another list where a contract names one.
ITALIAN_STOP_WORDS = [p + a for p in ("", "al", "del", "dal", "nel", "sul") for a in ("l", "lo", "la", "gli", "le")] + "il i un uno una a di da in con su per tra fra e ed o ma se che chi cui non si è sono ai dei dai nei sui al del dal nel sul c ad come più questo questa quello quella".split()


def italian_analyzed(text: Column, stop: list[str] = ITALIAN_STOP_WORDS) -> Column:
    """The same with Italian stop words and stems, possessives left alone."""
    low = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return italian_stems(F.filter(low, lambda w: ~w.isin(stop)))

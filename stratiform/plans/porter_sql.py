"""Porter's algorithm as DuckDB SQL, one step a common table: the stem table of the BM25 queries' SQL."""

from __future__ import annotations

from stratiform.functions import stem


def _shape(w: str) -> str:
    """V or C for every letter: a y begins the word or follows a vowel as a consonant."""
    marked = rf"regexp_replace(regexp_replace({w}, '^y', 'Y'), '([aeiouy])y', '\1Y', 'g')"
    return f"regexp_replace(regexp_replace({marked}, '[^aeiouy]', 'C', 'g'), '[aeiouy]', 'V', 'g')"


def _m(shape: str) -> str:
    return f"len(regexp_extract_all({shape}, 'V+C'))"


def _cvc(w: str, shape: str) -> str:
    return f"(suffix({shape}, 'CVC') AND right({w}, 1) NOT IN ('w', 'x', 'y'))"


def _double(w: str, shape: str) -> str:
    return f"(length({w}) > 1 AND right({w}, 1) = left(right({w}, 2), 1) AND suffix({shape}, 'C'))"


def _table(suffixes: dict[str, str]) -> str:
    """The longest suffix decides, and it goes if a syllable stands before it."""
    cases = " ".join(f"WHEN suffix(w, '{x}') THEN CASE WHEN {_m(f'left(s, -{len(x)})')} > 0 THEN left(w, -{len(x)}) || '{y}' ELSE w END" for x, y in sorted(suffixes.items(), key=lambda i: -len(i[0])))
    return f"CASE {cases} ELSE w END"


def stems(source: str) -> str:
    """Common tables that end in ``stems`` (term, stem), of the distinct ``term`` of a table."""
    steps = [
        "CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN left(w, -2) WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN left(w, -1) ELSE w END",
        f"CASE WHEN suffix(w, 'eed') THEN CASE WHEN {_m('left(s, -3)')} > 0 THEN left(w, -1) ELSE w END WHEN suffix(w, 'ing') AND contains(left(s, -3), 'V') THEN left(w, -3) || '!' WHEN suffix(w, 'ed') AND NOT suffix(w, 'ing') AND contains(left(s, -2), 'V') THEN left(w, -2) || '!' ELSE w END",
    ]
    out, name = [f"p0 AS (SELECT term, term AS w, {_shape('term')} AS s FROM (SELECT DISTINCT term FROM {source}) WHERE length(term) > 2)"], "p0"

    def step(expr: str) -> None:
        nonlocal name
        new = f"p{len(out)}"
        out.append(f"{new} AS (SELECT term, w, {_shape('w')} AS s FROM (SELECT term, {expr} AS w FROM {name}))")
        name = new

    step(steps[0])
    step(steps[1])
    # a mark shows that an ending went: what is left of the word is mended
    bare, shape = "left(w, -1)", "left(s, -1)"
    mended = f"CASE WHEN regexp_matches({bare}, '(at|bl|iz)$') THEN {bare} || 'e' WHEN {_double(bare, shape)} AND right({bare}, 1) NOT IN ('l', 's', 'z') THEN left({bare}, -1) WHEN {_m(shape)} = 1 AND {_cvc(bare, shape)} THEN {bare} || 'e' ELSE {bare} END"
    step(f"CASE WHEN suffix(w, '!') THEN {mended} ELSE w END")
    step("CASE WHEN suffix(w, 'y') AND contains(left(s, -1), 'V') THEN left(w, -1) || 'i' ELSE w END")
    step(_table(stem._STEP2))
    step(_table(stem._STEP3))
    longest = " ".join(f"WHEN suffix(w, '{x}') THEN CASE WHEN {_m(f'left(s, -{len(x)})')} > 1 {'AND right(left(w, -3), 1) IN (' + chr(39) + 's' + chr(39) + ', ' + chr(39) + 't' + chr(39) + ')' if x == 'ion' else ''} THEN left(w, -{len(x)}) ELSE w END" for x in sorted(stem._STEP4, key=lambda x: -len(x)))
    step(f"CASE {longest} ELSE w END")
    step(f"CASE WHEN suffix(w, 'e') AND ({_m('left(s, -1)')} > 1 OR {_m('left(s, -1)')} = 1 AND NOT {_cvc('left(w, -1)', 'left(s, -1)')}) THEN left(w, -1) ELSE w END")
    step(f"CASE WHEN {_m('s')} > 1 AND {_double('w', 's')} AND suffix(w, 'l') THEN left(w, -1) ELSE w END")
    return ", ".join(out) + f", stems AS (SELECT term, w AS stem FROM {name} UNION ALL SELECT DISTINCT term, term FROM {source} WHERE length(term) < 3)"

"""Reading replies that hold more than what was asked for: JSON in noisy text, lists below a heading, judged lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

_MARK = re.compile(r'\\.|["{}\[\]]', re.S)


def bracketed(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the outermost closed brackets of a text, in order.

    A stack of open brackets, in which quotes begin and end strings and a backslash hides the next character; outside
    of brackets quotes mean nothing. A closing bracket that doesn't fit gives up what is open. Where the text ends inside a
    string, its quotes were read the wrong way round: reading starts again at the first bracket behind a quote that
    stands in the bracket never closed, so that a stray brace doesn't hide what follows it.
    """
    text = text or ""
    out: list[tuple[int, int]] = []
    begin = 0
    while begin is not None:
        out = [x for x in out if x[0] < begin]
        stack: list[tuple[str, int]] = []
        string, again = False, None
        for m in _MARK.finditer(text, begin):
            c = m[0]
            if len(c) == 2:
                continue
            if c == '"':
                string = bool(stack) and not string
                if stack and again is None:
                    again = m.end()
            elif string:
                continue
            elif c in "{[":
                stack.append((c, m.start()))
            elif stack and stack[-1][0] + c in ("{}", "[]"):
                start = stack.pop()[1]
                while out and out[-1][0] > start:
                    out.pop()
                out.append((start, m.end()))
                if not stack:
                    again = None
            else:
                stack, again = [], None
        begin = again if string else None
    return out


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def _brackets(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": s, "end": e} for s, e in bracketed(t)])


def json_values(text: Column) -> Column:
    """The JSON objects and lists in a reply, none inside another: array of (start, end, json), ``start`` from 0."""
    held = F.transform(_brackets(text), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("json")))
    return F.filter(held, lambda x: F.try_parse_json(x["json"]).isNotNull())


def first_object(text: Column, values: Column) -> Column:
    """(json, error, extra) of a reply that is to be one object; ``values``: its ``json_values``.

    The value must begin at the first brace. ``extra``: more stands around it than a code fence.
    """
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    brace = F.locate("{", text) - 1
    hit = F.get(F.filter(values, lambda x: x["start"] == brace), F.lit(0))
    around = F.concat(F.substring(text, 1, hit["start"]), F.substring(text, hit["end"] + 1, F.length(text)))
    error = F.when(trimmed == "", "empty_output").when(brace < 0, "no_json_object").when(hit.isNull(), "invalid_json")
    extra = F.when(trimmed == "", False).when(brace < 0, True).when(hit.isNull(), F.locate("{", trimmed) > 1).otherwise(F.regexp_replace(F.replace(F.replace(around, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")), r"(?U)\s", "") != "")
    return F.struct(hit["json"].alias("json"), error.alias("error"), extra.alias("extra"))


def section(text: Column, heading: str, stop: str | None = None) -> Column:
    """What stands behind ``heading:`` (in any case), up to a line that begins with ``stop:``; null without the heading."""
    end = rf"(?:\n\s*{re.escape(stop)}:|\z)" if stop else r"\z"
    pattern = rf"(?isU){re.escape(heading)}:\s*(.*?){end}"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


_ITEM = r"(?Umd)^\s*(?:[-*•]|\d+[.)])\s*(.+?)\s*$"


def listed(text: Column, heading: str, most: int, stop: str | None = None, tags: str | None = "question") -> Column:
    """(items, dropped): the lines that open with a dash, star, bullet or number below a heading (anywhere without one), distinct in any case, the first ``most``.

    Spaces collapse; the form's placeholder tag is no text, and what is left empty no item. ``dropped`` counts those left out.
    """
    found = F.regexp_extract_all(F.coalesce(section(text, heading, stop), text, F.lit("")), F.lit(_ITEM), 1)
    bare = F.transform(found, lambda x: F.regexp_replace(x, rf"(?i)</?{tags}>", " ")) if tags else found
    clean = F.transform(bare, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    full = F.filter(clean, lambda x: x != "")
    low = F.transform(full, lambda x: F.lower(x))
    once = F.filter(full, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    kept = F.slice(once, 1, most)
    return F.struct(kept.alias("items"), (F.size(found) - F.size(kept)).alias("dropped"))


def judged_lines(text: Column, n: Column | int, names: list[str]) -> Column:
    """(place, name, yes) of the lines ``[place] name | yes or no`` of candidates 1 to ``n``, the first line of each; a name that isn't one of ``names`` is ``unparsed``."""
    line = r"(?Umid)^\s*(\[\d+\]\s*.+?\s*\|\s*(?:necessary\s*:\s*)?(?:yes|no)\b)"
    part = r"(?Usid)^\[(\d+)\]\s*(.+?)\s*\|\s*(?:necessary\s*:\s*)?(yes|no)$"
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(line), 1)

    def one(x: Column) -> Column:
        name = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_extract(x, part, 2))), r"^\*+|\*+$", ""), r"(?U)\s+", " "))
        return F.struct(F.regexp_extract(x, part, 1).try_cast("int").alias("place"), F.when(name.isin(names), name).otherwise("unparsed").alias("name"), (F.lower(F.regexp_extract(x, part, 3)) == "yes").alias("yes"))

    rows = F.filter(F.transform(found, one), lambda r: r["place"].between(1, n))
    places = F.transform(rows, lambda r: r["place"])
    first = F.filter(rows, lambda r, i: F.array_position(places, r["place"]) == i + 1)
    return F.transform(first, lambda r: F.struct(r["place"].alias("place"), r["name"].alias("name"), r["yes"].alias("yes")))

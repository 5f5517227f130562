"""Admission of judges' and authors' replies: every rule a reply breaks, with the place where it breaks it.

A reply is one JSON text, read once as a variant, so that a field of any type, or none, is a value to be judged and not
an error. Every function gives a column: the array of (path, rule) that its kind of reply breaks, empty for one that is
admitted. ``violations`` makes them one table. Where a rule needs other tables (is there such a node, may it be named)
``search_nodes`` joins them. Labels are judged as the record of an adjudication would hold them: a grade 0 needs
the provisions read, an ambiguous one still its best grade.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabularies of the roles' contracts.
ANSWERABILITIES = ["complete", "partial", "none"]
GATE_VERDICTS = ["independent", "paraphrase", "same_legal_question", "same_rule_superficial_change", "uncertain"]
UNRELATED = ["independent", "uncertain"]
TYPES = ["direct", "multi_provision", "exception_confusion", "partial_out_of_scope"]
DIFFICULTIES = ["easy", "medium", "hard"]
DRIVERS = ["negation", "exception", "numeric", "date", "lexical_twin", "cross_reference", "level2_gap"]
GAP_DRIVERS = ["numeric", "date", "level2_gap"]
ANSWERABILITY = "answerability"

NODE = r"^[A-Za-z0-9]+:[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*$"


def _nothing() -> Column:
    return F.array().cast("array<struct<path:string,rule:string>>")


def read(text: str | Column) -> Column:
    """A reply as a variant; null where it isn't JSON."""
    return F.try_parse_json(text)


def at(v: Column, name: str) -> Column:
    """A field of an object, as a variant; null where there is none."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def elements(v: Column | Seen) -> Column:
    return F.coalesce(F.try_variant_get(_value(v), "$", "array<variant>"), F.array().cast("array<variant>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row: Spark computes an expression anew wherever it stands inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Seen(NamedTuple):
    """A value whose kind is known; the rules take it as they take a plain one."""

    value: Column
    kind: Column


def seen(x: Column, names: list[str], body: Callable[[dict[str, Seen]], Column]) -> Column:
    """``body`` of fields of an entry, all read at once; they aren't there where it is no object."""
    fields = F.try_variant_get(x, "$", f"struct<{','.join(f'{n}:variant' for n in names)}>")
    known = lambda f: F.struct(*[F.struct(f[n].alias("v"), kind(f[n]).alias("k")).alias(n) for n in names])
    return let(fields, lambda f: let(known(f), lambda e: body({n: Seen(e[n]["v"], e[n]["k"]) for n in names})))


def _value(v: Column | Seen) -> Column:
    return v.value if isinstance(v, Seen) else v


def kind(v: Column | Seen) -> Column:
    """``object``, ``list``, ``text``, ``whole``, ``truth``, ``null``, ``number``; null for a field that isn't there."""
    if isinstance(v, Seen):
        return v.kind

    def name(k: Column) -> Column:
        return F.when(k.isNull(), None).when(k == "STRING", "text").when(k == "BIGINT", "whole").when(k == "BOOLEAN", "truth").when(k == "VOID", "null").when(k.startswith("OBJECT"), "object").when(k.startswith("ARRAY"), "list").otherwise("number")

    return let(F.schema_of_variant(v), name)


def word(v: Column | Seen) -> Column:
    """The value of a text; null for what isn't one."""
    return F.when(kind(v) == "text", F.try_variant_get(_value(v), "$", "string"))


def _is(v: Column | Seen, *kinds: str) -> Column:
    # the kind of a whole object or list is its schema, with those of all that is in it
    whole = {"object": "struct<x_:variant>", "list": "array<variant>"}
    if kinds[0] in whole and len(kinds) == 1 and not isinstance(v, Seen):
        return F.try_variant_get(v, "$", whole[kinds[0]]).isNotNull()
    return F.coalesce(kind(v).isin(*kinds), F.lit(False))


def _absent(v: Column | Seen) -> Column:
    return _value(v).isNull() | _is(v, "null")


def _text(v: Column | Seen) -> Column:
    """A text that isn't blank."""
    return F.coalesce(word(v).rlike(r"(?U)\S"), F.lit(False))


def _among(v: Column | Seen, values: list[str]) -> Column:
    return F.coalesce(word(v).isin(values), F.lit(False))


def _grade(v: Column | Seen, nullable: bool) -> Column:
    good = F.coalesce(_is(v, "whole") & F.try_variant_get(_value(v), "$", "bigint").between(0, 3), F.lit(False))
    return good | _absent(v) if nullable else good


def _refs(v: Column | Seen) -> Column:
    return _is(v, "list") & F.forall(elements(v), lambda x: F.coalesce(word(x).rlike(NODE), F.lit(False)))


def _broken(*rules: tuple[Column, str | Column, str]) -> Column:
    """(path, rule) of those whose condition holds."""
    named = [F.when(bad, F.struct((F.lit(p) if isinstance(p, str) else p).alias("path"), F.lit(rule).alias("rule"))) for bad, p, rule in rules]
    return F.array_compact(F.array(*named))


def _then(first: Column, more: Column) -> Column:
    """``more`` only where ``first`` finds nothing."""
    return let(first, lambda x: F.when(F.size(x) > 0, x).otherwise(more))


def _object(v: Column, inner: Column) -> Column:
    return _then(_broken((~_is(v, "object"), "$", "not an object")), inner)


def _each(entries: Column, path: str, rule: Callable[[Column, Column], Column]) -> Column:
    """The rule over every entry of a list, which it gets with its path."""
    return F.flatten(F.transform(entries, lambda x, i: rule(x, F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]")))))


def concept(v: Column) -> Column:
    """A concept author's reply: the concept, its facts, the fit."""
    facts = at(v, "facts")
    return _object(v, F.concat(
        _broken((~_text(at(v, "concept")), "$.concept", "no text"), (~_is(facts, "list"), "$.facts", "not a list")),
        _each(elements(facts), "$.facts", lambda x, p: _broken((~_text(x), p, "no text"))),
        _broken((~_text(at(v, "fit")), "$.fit", "no text")),
    ))


def statement(v: Column) -> Column:
    return _object(v, _broken((~_text(at(v, "primary")), "$.primary", "no text")))


def gate(v: Column, shown: Column) -> Column:
    """A gatekeeper's verdict, naming only a need of ``shown`` (array of text)."""
    verdict, closest = at(v, "verdict"), at(v, "closest")
    related = ~_among(verdict, UNRELATED)
    return _object(v, _then(_broken((~_among(verdict, GATE_VERDICTS), "$.verdict", "not in the vocabulary")), _then(
        _broken((~(_absent(closest) | _is(closest, "text")), "$.closest", "neither text nor null")),
        _broken((related & ~F.coalesce(F.array_contains(shown, word(closest)), F.lit(False)), "$.closest", "not shown")),
    )))


def evidence_gate(v: Column) -> Column:
    return _object(v, _broken((~_among(at(v, "verdict"), GATE_VERDICTS), "$.verdict", "not in the vocabulary")))


def declared(v: Column) -> Column:
    """The problem that a search declares instead of an answer, or null."""
    p = at(v, "problem")
    return F.when(~_absent(p) & ~_among(p, ["", "null"]), F.coalesce(word(p), F.try_variant_get(p, "$", "string"), F.lit("")))


def _judgment(grade: Column | Seen, ambiguous: Column | Seen, basis: Column | Seen, path: str | Column) -> Column:
    """What the record of an adjudication refuses of a label whose fields are of the right types."""
    none = _absent(grade)
    zero = F.coalesce(F.try_variant_get(_value(grade), "$", "bigint") == 0, F.lit(False))
    return _broken((F.coalesce(F.try_variant_get(_value(ambiguous), "$", "boolean"), F.lit(False)) & none, path, "ambiguous without a grade"), (zero & (F.size(elements(basis)) == 0), path, "no scope basis for grade 0"))


def label(x: Column, path: Column, nullable: bool, reason: str = "reason") -> Column:
    """Grade, ambiguity, scope basis and reason of an entry."""
    def rules(e: dict[str, Seen]) -> Column:
        grade, ambiguous, basis = e["grade"], e["ambiguous"], e["scope_basis"]
        types = _broken(
            (~_grade(grade, nullable), F.concat(path, F.lit(".grade")), "not 0 to 3" + (" or null" if nullable else "")),
            (~(ambiguous.value.isNull() | _is(ambiguous, "truth")), F.concat(path, F.lit(".ambiguous")), "not true or false"),
            (~(_absent(basis) | _refs(basis)), F.concat(path, F.lit(".scope_basis")), "not a list of nodes"),
            (~_text(e[reason]), F.concat(path, F.lit(f".{reason}")), "no text"),
        )
        return _then(types, _judgment(grade, ambiguous, basis, path))

    return seen(x, ["grade", "ambiguous", "scope_basis", reason], rules)


def identity(x: Column, path: Column, target: Column) -> Column:
    """What an entry says of its target beside its id, where that is another one; null says nothing."""
    other = lambda v: ~_absent(v) & ~F.coalesce(word(v) == target, F.lit(False))
    return seen(x, ["target", "node"], lambda e: _broken(*[(other(v), F.concat(path, F.lit(f".{n}")), "not its id's") for n, v in e.items()]))


def exactly(named: Column, expected: Column, path: str) -> Column:
    """Ids named twice, that weren't given, and that are missing: one violation an id."""
    rule = lambda ids, text: F.transform(ids, lambda x: F.struct(F.lit(path).alias("path"), F.concat(F.lit(text), x).alias("rule")))

    def of(ids: Column) -> Column:
        # the ids in order: equal ones follow one another
        twice = F.array_distinct(F.filter(ids, lambda x, i: (i > 0) & (x == F.get(ids, i - 1))))
        return F.concat(rule(twice, "named twice: "), rule(F.array_except(ids, expected), "unknown: "), rule(F.array_except(F.array_sort(F.array_distinct(expected)), ids), "missing: "))

    return let(F.array_sort(named), of)


def _entries(v: Column, field: str, ids: Column, rule: Callable[[Column, Column, Column], Column], unknown: bool = True) -> Column:
    """A list of entries that name ids of ``ids`` (id -> target): the rule over those with an id (``unknown``: also of ids that weren't given), and their coverage."""
    rows = F.transform(elements(at(v, field)), lambda x: F.struct(x.alias("x"), let(at(x, "item_id"), word).alias("id")))

    def one(e: Column, p: Column) -> Column:
        def judged(target: Column) -> Column:
            every = F.concat(identity(e["x"], p, target), rule(e["x"], p, target))
            return every if unknown else F.when(target.isNull(), _nothing()).otherwise(every)

        return F.when(e["id"].isNull(), _broken((F.lit(True), p, "names no id"))).otherwise(let(F.try_element_at(ids, e["id"]), judged))

    named = lambda entries: F.array_compact(F.transform(entries, lambda e: e["id"]))
    return let(rows, lambda entries: F.concat(_each(entries, f"$.{field}", one), exactly(named(entries), F.map_keys(ids), f"$.{field}")))


def answerability(v: Column, reason: str = "answerability_reason") -> Column:
    return _then(_broken((~_among(at(v, "answerability"), ANSWERABILITIES), "$.answerability", "not in the vocabulary")), _broken((~_text(at(v, reason)), f"$.{reason}", "no text")))


def graded(v: Column, ids: Column) -> Column:
    """A judge's reply: every candidate shown, by its id, and the answerability with what is missing."""
    short = _among(at(v, "answerability"), ["partial", "none"]) & ~_text(at(v, "missing"))
    inner = F.concat(_entries(v, "grades", ids, lambda x, p, t: label(x, p, True)), answerability(v), _broken((short, "$.missing", "no text")))
    return _object(v, _then(_broken((~_is(at(v, "grades"), "list"), "$.grades", "not a list")), inner))


def pooled(v: Column, ids: Column) -> Column:
    """The pool variant: an explicit grade and an explicit ambiguity for every candidate, no answerability."""
    def rule(x: Column, p: Column, target: Column) -> Column:
        missing = _broken((~_is(at(x, "ambiguous"), "truth"), F.concat(p, F.lit(".ambiguous")), "not given"))
        return let(missing, lambda flag: F.concat(flag, F.filter(label(x, p, False), lambda r: ~((F.size(flag) > 0) & r["path"].endswith(".ambiguous")))))

    return _object(v, _then(_broken((~_is(at(v, "grades"), "list"), "$.grades", "not a list")), _entries(v, "grades", ids, rule)))


def item(x: Column, p: Column, target: Column) -> Column:
    """An entry of a deciding judge: a label of a node, or an answerability."""
    on_need = _broken(
        (~_among(at(x, "answerability"), ANSWERABILITIES), F.concat(p, F.lit(".answerability")), "not in the vocabulary"),
        (~_absent(at(x, "grade")), F.concat(p, F.lit(".grade")), "a grade on the answerability"),
        (~(at(x, "ambiguous").isNull() | _is(at(x, "ambiguous"), "truth")), F.concat(p, F.lit(".ambiguous")), "not true or false"),
        (~_text(at(x, "reason")), F.concat(p, F.lit(".reason")), "no text"),
    )
    on_node = _then(_broken((~_absent(at(x, "answerability")), F.concat(p, F.lit(".answerability")), "an answerability on a node")), label(x, p, True))
    return F.when(target == ANSWERABILITY, on_need).otherwise(on_node)


def decided(v: Column, ids: Column) -> Column:
    """A deciding judge's reply: every item it was asked, by its id, and no other."""
    return _object(v, _then(_broken((~_is(at(v, "items"), "list"), "$.items", "not a list")), _entries(v, "items", ids, item, unknown=False)))


def candidate(x: Column, p: Column) -> Column:
    """A candidate that a search names, but for what only the corpus can tell."""
    under = lambda n: F.concat(p, F.lit(f".{n}"))
    node = at(x, "node")
    lists = [(~at(x, n).isNull() & ~_refs(at(x, n)), under(n), "not a list of nodes") for n in ("scope", "scope_basis")]
    rules = _broken(
        (~_grade(at(x, "grade"), False), under("grade"), "not 0 to 3"),
        (~(at(x, "ambiguous").isNull() | _is(at(x, "ambiguous"), "truth")), under("ambiguous"), "not true or false"),
        *lists,
        (~_text(at(x, "rationale")), under("rationale"), "no text"),
    )
    inner = _then(rules, _judgment(at(x, "grade"), at(x, "ambiguous"), at(x, "scope_basis"), p))
    return _then(_broken((~_is(x, "object"), p, "not an object")), _then(_broken((~F.coalesce(word(node).rlike(NODE), F.lit(False)), under("node"), "no node")), inner))


def searched(v: Column) -> Column:
    """A search's final reply: a declared problem, or all candidates and the answerability, and then what ties it to the search's own grades."""
    problem, candidates, gap = at(v, "problem"), at(v, "candidates"), at(v, "gap_note")
    entries = elements(candidates)
    nodes = F.array_compact(F.transform(entries, lambda x: F.when(_is(x, "object"), word(at(x, "node")))))
    known = _among(at(v, "answerability"), ANSWERABILITIES)
    told = F.when(~known, _broken((F.lit(True), "$.answerability", "not in the vocabulary"))).otherwise(_broken(
        (~_text(at(v, "answerability_reason")), "$.answerability_reason", "no text"),
        (~_among(at(v, "answerability"), ["complete"]) & ~_text(gap), "$.gap_note", "no text"),
        (_among(at(v, "answerability"), ["complete"]) & ~(_absent(gap) | _is(gap, "text")), "$.gap_note", "neither text nor null"),
    ))
    contract = F.concat(_each(entries, "$.candidates", candidate), _broken((F.size(F.array_distinct(nodes)) < F.size(nodes), "$.candidates", "a node named twice")), told)
    sure = lambda x: ~F.coalesce(F.try_variant_get(x, "$.ambiguous", "boolean"), F.lit(False))
    from_grade = lambda least: F.exists(entries, lambda x: F.coalesce(F.try_variant_get(x, "$.grade", "bigint") >= least, F.lit(False)) & sure(x))
    says = lambda a: _among(at(v, "answerability"), [a])
    invariants = _broken((says("complete") & ~from_grade(3), "$.answerability", "complete without grade 3"), (says("none") & from_grade(2), "$.answerability", "none with relevant evidence"), (says("partial") & ~from_grade(2), "$.answerability", "partial without relevant evidence"))
    answered = _then(_broken((~_is(candidates, "list"), "$.candidates", "not a list")), _then(contract, invariants))
    plain = _absent(problem) | _among(problem, ["", "null"])
    return _object(v, F.when(plain, answered).otherwise(_broken((~_text(problem), "$.problem", "neither text nor null"))))


def metadata(v: Column, graded: Column, answers: Column) -> Column:
    """An adjudicator's type, difficulty and drivers against the final grades (node -> struct of grade, ambiguous) and answerability."""
    drivers = F.try_variant_get(v, "$.drivers", "map<string,variant>")
    named = F.coalesce(F.map_entries(drivers), F.array().cast("array<struct<key:string,value:variant>>"))
    lists = F.forall(named, lambda d: _is(d["value"], "list") & F.forall(elements(d["value"]), lambda x: _is(x, "text")))
    shape = _broken((~_is(at(v, "type"), "text"), "$.type", "no text"), (~_is(at(v, "difficulty"), "text"), "$.difficulty", "no text"), (~_is(at(v, "drivers"), "object"), "$.drivers", "not an object"), (_is(at(v, "drivers"), "object") & ~lists, "$.drivers", "not lists of nodes"))
    whole = answers == "complete"

    def node(driver: Column, x: Column, p: Column) -> tuple[Column, Column]:
        n = word(x)
        row = F.try_element_at(graded, n)
        gap = n == "gap_note"
        sure = ~row["ambiguous"]
        contract = _broken((gap & ~driver.isin(GAP_DRIVERS), p, "a gap for a driver no gap can hold"), (~gap & row.isNull(), p, "not among the final grades"))
        off = ~gap & row.isNotNull()
        meaning = _broken((gap & driver.isin(GAP_DRIVERS) & whole, p, "a gap on a complete need"), (off & (driver == "negation") & ~((row["grade"] == 3) & sure), p, "negation without grade 3"), (off & ~driver.isin("negation", "lexical_twin") & ~((row["grade"] >= 2) & sure), p, "driver without relevant support"))
        return contract, meaning

    def every(which: int) -> Column:
        def one(d: Column) -> Column:
            path = F.concat(F.lit("$.drivers."), d["key"])
            usable = d["key"].isin(DRIVERS) & (F.size(elements(d["value"])) > 0)
            inner = F.flatten(F.transform(elements(d["value"]), lambda x, i: node(d["key"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))[which]))
            wrong = _broken((~d["key"].isin(DRIVERS), path, "not a driver"), (d["key"].isin(DRIVERS) & (F.size(elements(d["value"])) == 0), path, "no node named"))
            return F.when(usable, inner).otherwise(wrong if which == 0 else _nothing())

        return F.flatten(F.transform(F.array_sort(F.map_keys(drivers)), lambda k: one(F.struct(k.alias("key"), F.try_element_at(drivers, k).alias("value")))))

    contract = F.concat(_broken((~_among(at(v, "type"), TYPES), "$.type", "not in the vocabulary"), (~_among(at(v, "difficulty"), DIFFICULTIES), "$.difficulty", "not in the vocabulary")), every(0))
    meaning = F.concat(_broken((whole == _among(at(v, "type"), ["partial_out_of_scope"]), "$.type", "against the answerability")), every(1))
    return _object(v, _then(shape, _then(contract, meaning)))


def violations(replies: DataFrame, keys: list[str], broken: Column) -> DataFrame:
    """(keys, path, rule): one row for everything that keeps a reply from admission."""
    return replies.select(*keys, F.explode(broken).alias("x_")).select(*keys, "x_.path", "x_.rule")


def search_nodes(replies: DataFrame, keys: list[str], reply: str, nodes: DataFrame, excluded: DataFrame) -> DataFrame:
    """(keys, path, rule) of the nodes that a search's candidates and their scopes name: not among ``nodes`` (node), or under an article of ``excluded`` (article: act and article as ``act:article``)."""
    each = replies.select(*keys, F.posexplode(elements(at(F.col(reply), "candidates"))).alias("i_", "x_")).filter(_is(F.col("x_"), "object"))
    own = each.select(*keys, F.concat(F.lit("$.candidates["), F.col("i_").cast("string"), F.lit("].node")).alias("path"), word(at(F.col("x_"), "node")).alias("node"), F.lit(True).alias("own_"))
    for name in ("scope", "scope_basis"):
        held = each.select(*keys, "i_", F.posexplode(elements(at(F.col("x_"), name))).alias("j_", "y_"))
        own = own.unionByName(held.select(*keys, F.format_string(f"$.candidates[%d].{name}[%d]", "i_", "j_").alias("path"), word(F.col("y_")).alias("node"), F.lit(False).alias("own_")))
    named = own.filter(F.col("node").rlike(NODE)).withColumn("article_", F.regexp_extract("node", r"^([^.]+)", 1))
    lost = named.join(nodes.select("node").distinct(), "node", "left_anti").select(*keys, "path", F.lit("no such node").alias("rule"))
    barred = named.filter("own_").join(excluded.select(F.col("article").alias("article_")).distinct(), "article_", "left_semi").select(*keys, "path", F.lit("an excluded article").alias("rule"))
    return lost.unionByName(barred)

"""Admission rules over replies of any shape against plain Python, and readers of noisy replies."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from stratiform.operators import admission as A
from stratiform.operators import replies as R

IDS = {"i1": "X:1.a", "i2": "X:2", "i3": "Y:3"}
ITEMS = {"i1": "X:1.a", "i2": "answerability", "i3": "Y:3"}
GRADED = {"X:1": (3, False), "X:2": (2, False), "Y:1": (1, False), "Y:2": (3, True)}
NODE = re.compile(A.NODE)
MISSING = object()


def text(x):
    return isinstance(x, str) and bool(x.strip())


def grade(x, nullable):
    return nullable if x is None or x is MISSING else isinstance(x, int) and not isinstance(x, bool) and 0 <= x <= 3


def refs(x):
    return isinstance(x, list) and all(isinstance(r, str) and NODE.match(r) for r in x)


def judgment(e, p):
    g = e.get("grade")
    return [(p, "ambiguous without a grade")] * (e.get("ambiguous") is True and g is None) + [(p, "no scope basis for grade 0")] * (g == 0 and not isinstance(g, bool) and not e.get("scope_basis"))


def label(e, p, nullable, reason="reason"):
    out = [(f"{p}.grade", "not 0 to 3" + (" or null" if nullable else ""))] * (not grade(e.get("grade", MISSING), nullable))
    out += [(f"{p}.ambiguous", "not true or false")] * (not isinstance(e.get("ambiguous", False), bool))
    out += [(f"{p}.scope_basis", "not a list of nodes")] * (e.get("scope_basis") is not None and not refs(e["scope_basis"]))
    out += [(f"{p}.{reason}", "no text")] * (not text(e.get(reason)))
    return out or judgment(e, p)


def exactly(named, given, p):
    twice = sorted(n for n in set(named) if named.count(n) > 1)
    return [(p, f"named twice: {x}") for x in twice] + [(p, f"unknown: {x}") for x in sorted(set(named) - set(given))] + [(p, f"missing: {x}") for x in sorted(set(given) - set(named))]


def entries(v, field, ids, rule, unknown=True):
    out, named = [], []
    for i, e in enumerate(v[field]):
        p = f"$.{field}[{i}]"
        if not isinstance(e, dict) or not isinstance(e.get("item_id"), str):
            out.append((p, "names no id"))
            continue
        named.append(e["item_id"])
        t = ids.get(e["item_id"])
        if t is None and not unknown:
            continue
        out += [(f"{p}.{n}", "not its id's") for n in ("target", "node") if e.get(n) is not None and e[n] != t]
        out += rule(e, p, t)
    return out + exactly(named, ids, f"$.{field}")


def told(v):
    if v.get("answerability") not in A.ANSWERABILITIES:
        return [("$.answerability", "not in the vocabulary")]
    return [] if text(v.get("answerability_reason")) else [("$.answerability_reason", "no text")]


def graded(v):
    if not isinstance(v.get("grades"), list):
        return [("$.grades", "not a list")]
    out = entries(v, "grades", IDS, lambda e, p, t: label(e, p, True)) + told(v)
    return out + [("$.missing", "no text")] * (v.get("answerability") in ("partial", "none") and not text(v.get("missing")))


def pooled(v):
    if not isinstance(v.get("grades"), list):
        return [("$.grades", "not a list")]

    def rule(e, p, t):
        flag = [(f"{p}.ambiguous", "not given")] * (not isinstance(e.get("ambiguous"), bool))
        return flag + [x for x in label(e, p, False) if not (flag and x[0].endswith(".ambiguous"))]

    return entries(v, "grades", IDS, rule)


def decided(v):
    if not isinstance(v.get("items"), list):
        return [("$.items", "not a list")]

    def rule(e, p, t):
        if t != "answerability":
            return [(f"{p}.answerability", "an answerability on a node")] if e.get("answerability") is not None else label(e, p, True)
        out = [(f"{p}.answerability", "not in the vocabulary")] * (e.get("answerability") not in A.ANSWERABILITIES)
        out += [(f"{p}.grade", "a grade on the answerability")] * (e.get("grade") is not None)
        out += [(f"{p}.ambiguous", "not true or false")] * ("ambiguous" in e and not isinstance(e["ambiguous"], bool))
        return out + [(f"{p}.reason", "no text")] * (not text(e.get("reason")))

    return entries(v, "items", ITEMS, rule, unknown=False)


def searched(v):
    if v.get("problem") not in (None, "", "null"):
        return [] if text(v["problem"]) else [("$.problem", "neither text nor null")]
    if not isinstance(v.get("candidates"), list):
        return [("$.candidates", "not a list")]
    out, nodes = [], []
    for i, c in enumerate(v["candidates"]):
        p = f"$.candidates[{i}]"
        if not isinstance(c, dict):
            out.append((p, "not an object"))
            continue
        if isinstance(c.get("node"), str):
            nodes.append(c["node"])
        if not isinstance(c.get("node"), str) or not NODE.match(c["node"]):
            out.append((f"{p}.node", "no node"))
            continue
        own = [(f"{p}.grade", "not 0 to 3")] * (not grade(c.get("grade"), False)) + [(f"{p}.ambiguous", "not true or false")] * ("ambiguous" in c and not isinstance(c["ambiguous"], bool))
        own += [(f"{p}.{n}", "not a list of nodes") for n in ("scope", "scope_basis") if n in c and not refs(c[n])]
        own += [(f"{p}.rationale", "no text")] * (not text(c.get("rationale")))
        out += own or judgment(c, p)
    out += [("$.candidates", "a node named twice")] * (len(set(nodes)) < len(nodes))
    a, gap = v.get("answerability"), v.get("gap_note")
    if a not in A.ANSWERABILITIES:
        out.append(("$.answerability", "not in the vocabulary"))
    else:
        out += [("$.answerability_reason", "no text")] * (not text(v.get("answerability_reason")))
        out += [("$.gap_note", "no text")] * (a != "complete" and not text(gap)) + [("$.gap_note", "neither text nor null")] * (a == "complete" and gap is not None and not isinstance(gap, str))
    if out:
        return out
    sure = [c["grade"] for c in v["candidates"] if not c.get("ambiguous")]
    return [("$.answerability", "complete without grade 3")] * (a == "complete" and 3 not in sure) + [("$.answerability", "none with relevant evidence")] * (a == "none" and max(sure, default=0) >= 2) + [("$.answerability", "partial without relevant evidence")] * (a == "partial" and max(sure, default=0) < 2)


def metadata(v):
    d = v.get("drivers")
    out = [(f"$.{f}", "no text") for f in ("type", "difficulty") if not isinstance(v.get(f), str)] + [("$.drivers", "not an object")] * (not isinstance(d, dict))
    out += [("$.drivers", "not lists of nodes")] * (isinstance(d, dict) and not all(isinstance(x, list) and all(isinstance(n, str) for n in x) for x in d.values()))
    if out:
        return out
    contract = [(f"$.{f}", "not in the vocabulary") for f, known in (("type", A.TYPES), ("difficulty", A.DIFFICULTIES)) if v[f] not in known]
    meaning = [("$.type", "against the answerability")] * (v["type"] == "partial_out_of_scope")
    for k in sorted(d):
        if k not in A.DRIVERS or not d[k]:
            contract.append((f"$.drivers.{k}", "not a driver" if k not in A.DRIVERS else "no node named"))
            continue
        for i, n in enumerate(d[k]):
            p, row = f"$.drivers.{k}[{i}]", GRADED.get(n)
            if n == "gap_note":
                contract += [(p, "a gap for a driver no gap can hold")] * (k not in A.GAP_DRIVERS)
                meaning += [(p, "a gap on a complete need")] * (k in A.GAP_DRIVERS)
            elif row is None:
                contract.append((p, "not among the final grades"))
            elif k == "negation" and not (row[0] == 3 and not row[1]):
                meaning.append((p, "negation without grade 3"))
            elif k not in ("negation", "lexical_twin") and not (row[0] >= 2 and not row[1]):
                meaning.append((p, "driver without relevant support"))
    return contract or meaning


def gate(v):
    c = v.get("closest")
    if v.get("verdict") not in A.GATE_VERDICTS:
        return [("$.verdict", "not in the vocabulary")]
    if c is not None and not isinstance(c, str):
        return [("$.closest", "neither text nor null")]
    return [("$.closest", "not shown")] * (v["verdict"] not in A.UNRELATED and c not in ("n1", "n2"))


def concept(v):
    f = v.get("facts")
    out = [("$.concept", "no text")] * (not text(v.get("concept"))) + [("$.facts", "not a list")] * (not isinstance(f, list))
    out += [(f"$.facts[{i}]", "no text") for i, x in enumerate(f if isinstance(f, list) else []) if not text(x)]
    return out + [("$.fit", "no text")] * (not text(v.get("fit")))


MAPPING = lambda: F.create_map(*[F.lit(x) for kv in IDS.items() for x in kv])
ITEMS_MAP = lambda: F.create_map(*[F.lit(x) for kv in ITEMS.items() for x in kv])
GRADED_MAP = lambda: F.create_map(*[x for k, (g, a) in GRADED.items() for x in (F.lit(k), F.struct(F.lit(g).alias("grade"), F.lit(a).alias("ambiguous")))])
ENTRY = {"item_id": "i1", "grade": 2, "ambiguous": False, "reason": "r", "scope_basis": ["X:1"]}
CASES = {
    "graded": (graded, lambda v: A.graded(v, MAPPING()), {"grades": [ENTRY, ENTRY | {"item_id": "i2", "grade": 0}, {"item_id": "i3", "grade": None, "reason": "x"}], "answerability": "partial", "answerability_reason": "r", "missing": "m"}),
    "pooled": (pooled, lambda v: A.pooled(v, MAPPING()), {"grades": [ENTRY, ENTRY | {"item_id": "i2", "grade": 0, "node": "X:2"}, ENTRY | {"item_id": "i3"}]}),
    "decided": (decided, lambda v: A.decided(v, ITEMS_MAP()), {"items": [ENTRY, {"item_id": "i2", "answerability": "none", "reason": "r"}, ENTRY | {"item_id": "i3", "target": "Y:3"}]}),
    "searched": (searched, A.searched, {"problem": None, "candidates": [{"node": "X:1.a", "grade": 3, "rationale": "r"}, {"node": "Y:2", "grade": 0, "scope_basis": ["Y:1"], "ambiguous": False, "rationale": "r"}], "answerability": "complete", "answerability_reason": "r", "gap_note": None}),
    "metadata": (metadata, lambda v: A.metadata(v, GRADED_MAP(), F.lit("complete")), {"type": "direct", "difficulty": "easy", "drivers": {"negation": ["X:1"], "exception": ["X:2", "X:1"], "lexical_twin": ["Y:1"]}}),
    "gate": (gate, lambda v: A.gate(v, F.array(F.lit("n1"), F.lit("n2"))), {"verdict": "paraphrase", "closest": "n1"}),
    "concept": (concept, A.concept, {"concept": "c", "facts": ["a", "b"], "fit": "f"}),
    "statement": (lambda v: [("$.primary", "no text")] * (not text(v.get("primary"))), A.statement, {"primary": "p"}),
    "evidence_gate": (lambda v: [("$.verdict", "not in the vocabulary")] * (v.get("verdict") not in A.GATE_VERDICTS), A.evidence_gate, {"verdict": "uncertain"}),
}
VALUES = [None, "", " ", "x", "none", "complete", "partial", "X:1", "X:2", "Y:2", "gap_note", "i1", "i9", "n3", "partial_out_of_scope", 0, 1, 3, 4, -1, 2.0, True, False, [], ["X:1"], ["X:1", 5], ["no node"], {}, {"a": 1}, "1" * 30]


def mutated(rnd, v):
    """A copy of a reply in which some value, at any depth, is another one, gone or doubled."""
    v = json.loads(json.dumps(v))
    for _ in range(rnd.choice([0, 1, 1, 2, 3])):
        at = v
        while True:
            keys = list(at) if isinstance(at, dict) else list(range(len(at)))
            if not keys:
                break
            k = rnd.choice(keys)
            if isinstance(at[k], (dict, list)) and at[k] and rnd.random() < 0.75:
                at = at[k]
                continue
            how = rnd.random()
            if how < 0.2:
                del at[k]
            elif how < 0.3 and isinstance(at, list):
                at.append(json.loads(json.dumps(at[k])))
            elif how < 0.4 and isinstance(at, dict):
                at[rnd.choice(["numeric", "node", "target", "extra", "ambiguous", "date"])] = json.loads(json.dumps(rnd.choice(VALUES)))
            else:
                at[k] = json.loads(json.dumps(rnd.choice(VALUES)))
            break
    return v


@pytest.mark.parametrize("name", sorted(CASES))
def test_rules(spark, name):
    plain, column, good = CASES[name]
    rnd = random.Random(name)
    cases = [good, [], 5, "x", None] + [mutated(rnd, good) for _ in range(250)]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "id int, reply string").withColumn("v", A.read("reply"))
    got = {}
    for r in A.violations(df, ["id"], column(F.col("v"))).collect():
        got.setdefault(r.id, []).append((r.path, r.rule))
    for i, c in enumerate(cases):
        want = plain(c) if isinstance(c, dict) else [("$", "not an object")]
        assert sorted(got.get(i, [])) == sorted(want), c
    assert 0 not in got and len({tuple(v) for v in got.values()}) > 1


def test_no_json_is_not_admitted(spark):
    df = spark.createDataFrame([(1, "no json"), (2, None)], "id int, reply string").withColumn("v", A.read("reply"))
    assert sorted((r.id, r.rule) for r in A.violations(df, ["id"], A.concept(F.col("v"))).collect()) == [(1, "not an object"), (2, "not an object")]


def test_nodes_of_a_search(spark):
    v = {"candidates": [{"node": "X:1.a", "scope": ["X:1", "Z:9"]}, {"node": "P:7.b"}, {"node": "Q:1", "scope_basis": ["P:7.b"]}, 5]}
    df = spark.createDataFrame([(1, json.dumps(v))], "id int, reply string").withColumn("v", A.read("reply"))
    nodes = spark.createDataFrame([("X:1.a",), ("X:1",), ("P:7.b",)], "node string")
    got = A.search_nodes(df, ["id"], "v", nodes, spark.createDataFrame([("P:7",)], "article string"))
    assert sorted((r.path, r.rule) for r in got.collect()) == [("$.candidates[0].scope[1]", "no such node"), ("$.candidates[1].node", "an excluded article"), ("$.candidates[2].node", "no such node")]


def test_brackets_know_strings_and_escapes():
    found = lambda t: [t[s:e] for s, e in R.bracketed(t)]
    assert found('Sure: {"a": "}{", "b": ["]"]} done') == ['{"a": "}{", "b": ["]"]}']
    assert found(r'{"a": "\"}"} and [1, {"x": 2}]') == [r'{"a": "\"}"}', '[1, {"x": 2}]']
    assert found('{"a": {"b": 1}, "c": "cut') == ['{"b": 1}']
    assert found('a stray { he said "no" and then {"a": 1}') == ['{"a": 1}']
    assert found('a stray { he said " and then {"a": 1} end') == ['{"a": 1}']
    assert found("} ] {} [ ( ]") == ["{}", "[ ( ]"] and found("") == [] == found(None)
    assert found("[{]} {}") == ["{}"]
    deep = "[" * 20_000 + "]" * 20_000
    assert found(deep) == [deep]


def test_first_objects(spark):
    replies = ['```json\n{"a": 1}\n```', 'Here: {"a": "}"}', "", None, " \n", "no braces", "x {broken", '{"a": 1} {"b": 2}', "{bad} {}"]
    df = spark.createDataFrame(list(enumerate(replies)), "id int, t string").withColumn("v", R.json_values(F.col("t")))
    got = [tuple(r.x) for r in df.select("id", R.first_object(F.col("t"), F.col("v")).alias("x")).orderBy("id").collect()]
    assert got == [('{"a": 1}', None, False), ('{"a": "}"}', None, True), (None, "empty_output", False), (None, "empty_output", False), (None, "empty_output", False), (None, "no_json_object", True), (None, "invalid_json", True), ('{"a": 1}', None, True), (None, "invalid_json", False)]


def test_lists_below_a_heading(spark):
    replies = ["Intro\n- not this\nREQUIREMENTS:\n- One  thing\n2) two\n* ONE thing\n• <question>three</question>\n- <question>\n3. four", "- a\n- b\n- c\n- d", "none", None, "facts:\n- f\nCONCEPTS:\n- g"]
    df = spark.createDataFrame(list(enumerate(replies)), "id int, t string")
    got = [(r.x["items"], r.x.dropped) for r in df.select("id", R.listed(F.col("t"), "REQUIREMENTS", 3).alias("x")).orderBy("id").collect()]
    assert got == [(["One thing", "two", "three"], 3), (["a", "b", "c"], 1), ([], 0), ([], 0), (["f", "g"], 0)]
    facts = [r.x["items"] for r in df.select("id", R.listed(F.col("t"), "FACTS", 9, "CONCEPTS").alias("x")).orderBy("id").collect()]
    assert facts[4] == ["f"]


def test_judged_lines(spark):
    t = "[1] Condition | yes\n [2] **Exception** | necessary: NO\n[1] exception | no\n[9] condition | yes\n[3] odd one | yes please\n[4] condition | maybe"
    df = spark.createDataFrame([(t,), (None,)], "t string")
    got = [[tuple(x) for x in r.x] for r in df.select(R.judged_lines(F.col("t"), 5, ["condition", "exception"]).alias("x")).collect()]
    assert got == [[(1, "condition", True), (2, "exception", False), (3, "unparsed", True)], []]


def test_fields_of_an_entry_are_read_once(spark):
    """Inside a lambda Spark shares no expressions: what a rule writes twice is computed twice, for every entry."""
    df = spark.createDataFrame([("{}", {"i1": "X:1"})], "t string, ids map<string,string>").withColumn("v", A.read("t"))
    plan = df.select(A.pooled(F.col("v"), F.col("ids")))._jdf.queryExecution().optimizedPlan().toString()
    # before: 482 readings and 222 kinds
    assert plan.count("try_variant_get") <= 48 and plan.lower().count("schemaofvariant.") <= 12


def test_items_given_and_returned_are_dealt_once(spark):
    """A null names nothing; the items of a job are counted in many small parts, not in as few as their bytes suggest."""
    from stratiform.operators import evidence

    given = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (3, None), (None, 4)], "job long, item long")
    back = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 9), (3, None), (None, 4)], "job long, item long")
    out = evidence.admission(given, back, "job", "item")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, 1, 0, 1), (2, 0, 1, 0), (3, 1, 1, 0), (None, 1, 1, 0)], key=repr)
    assert out.rdd.getNumPartitions() >= evidence.PARTS

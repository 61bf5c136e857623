"""Schemas, folds and completions against plain Python models on random inputs."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gymlake.functions import state as S
from gymlake.functions.json_schema import schema_problems, with_schema_problems
from gymlake.operators import folds
from gymlake.plans.evidence import WORKSPACE

# ------------------------------------------------------------------ schemas


def kind_ok(v, kind):
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    return {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None, "number": number, "integer": number and v == int(v)}[kind]


def same(a, b):
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True) if isinstance(a, (dict, list)) or isinstance(b, (dict, list)) else isinstance(a, bool) == isinstance(b, bool) and a == b


def model(s, v, path="$"):
    """An independent reading of the keywords, as a list of problems."""
    if s is True or s is False:
        return [] if s else [f"{path}: false"]
    out = []
    if s.get("$ref") == "#/$defs/l":
        out += model({"maxItems": 1, "type": "array"}, v, path)
    say = lambda bad, what: out.append(f"{path}: {what}") if bad else None
    number, text = kind_ok(v, "number"), isinstance(v, str)
    if "type" in s:
        say(not any(kind_ok(v, k) for k in ([s["type"]] if isinstance(s["type"], str) else s["type"])), "type")
    if "enum" in s:
        say(not any(same(v, e) for e in s["enum"]), "enum")
    if "const" in s:
        say(not same(v, s["const"]), "const")
    for word, bad in (("minimum", lambda b: v < b), ("maximum", lambda b: v > b), ("exclusiveMinimum", lambda b: v <= b), ("exclusiveMaximum", lambda b: v >= b), ("multipleOf", lambda b: v % b != 0)):
        if word in s and number:
            say(bad(s[word]), word)
    for word, bad in (("minLength", lambda b: len(v) < b), ("maxLength", lambda b: len(v) > b), ("pattern", lambda b: not re.search(b, v))):
        if word in s and text:
            say(bad(s[word]), word)
    if isinstance(v, dict):
        for k in s.get("required", []):
            say(k not in v, f"required:{k}")
        for k, need in s.get("dependentRequired", {}).items():
            for other in need:
                say(k in v and other not in v, f"dependentRequired:{other}")
        say(len(v) < s.get("minProperties", 0), "minProperties")
        say(len(v) > s.get("maxProperties", 99), "maxProperties")
        for k, sub in s.get("properties", {}).items():
            out += model(sub, v[k], f"{path}.{k}") if k in v else []
        for p, sub in s.get("patternProperties", {}).items():
            for k in v:
                out += model(sub, v[k], f"{path}.{k}") if re.search(p, k) else []
        rest = [k for k in v if k not in s.get("properties", {}) and not any(re.search(p, k) for p in s.get("patternProperties", {}))]
        if s.get("additionalProperties") is False:
            say(bool(rest), "additionalProperties")
        elif "additionalProperties" in s:
            for k in rest:
                out += model(s["additionalProperties"], v[k], f"{path}.{k}")
        if "propertyNames" in s:
            say(any(model(s["propertyNames"], k) for k in v), "propertyNames")
    if isinstance(v, list):
        say(len(v) < s.get("minItems", 0), "minItems")
        say(len(v) > s.get("maxItems", 99), "maxItems")
        say(bool(s.get("uniqueItems")) and any(same(a, b) for i, a in enumerate(v) for b in v[:i]), "uniqueItems")
        first = s.get("prefixItems", [])
        for i, sub in enumerate(first[: len(v)]):
            out += model(sub, v[i], f"{path}[{i}]")
        for i in range(len(first), len(v)):
            out += model(s.get("items", True), v[i], f"{path}[{i}]")
        if "contains" in s:
            n = sum(not model(s["contains"], x) for x in v)
            say(n < s.get("minContains", 1), "contains")
            say(n > s.get("maxContains", 99), "maxContains")
    for sub in s.get("allOf", []):
        out += model(sub, v, path)
    say("anyOf" in s and all(model(x, v) for x in s.get("anyOf", [])), "anyOf")
    say("oneOf" in s and sum(not model(x, v) for x in s.get("oneOf", [])) != 1, "oneOf")
    say("not" in s and not model(s["not"], v), "not")
    if "if" in s:
        out += model(s.get("else" if model(s["if"], v) else "then", True), v, path)
    return out


SCHEMAS = [
    {"type": ["object", "array"], "properties": {"a": {"type": "integer", "minimum": 1, "exclusiveMaximum": 4}, "b": {"type": "string", "minLength": 1, "maxLength": 2, "pattern": "x|é"}}, "required": ["a"], "additionalProperties": {"type": "null"}},
    {"properties": {"a": {"items": {"type": "object", "properties": {"b": {"items": {"enum": [1, "x", None, [1], {"a": 1}, True]}}}, "required": ["b"]}, "minItems": 1, "maxItems": 2}}, "minProperties": 1, "maxProperties": 2, "dependentRequired": {"b": ["a", "c"]}},
    {"items": {"anyOf": [{"type": "number", "multipleOf": 2}, {"type": "string"}]}, "prefixItems": [{"const": 1}, False], "uniqueItems": True, "contains": {"type": "number"}, "minContains": 1, "maxContains": 2},
    {"allOf": [{"not": {"type": "boolean"}}, {"oneOf": [{"type": "object"}, {"required": ["a"]}, {"maximum": 2}]}], "if": {"type": "string"}, "then": {"maxLength": 1}, "else": {"propertyNames": {"maxLength": 1, "pattern": "^[ab]"}}},
    {"allOf": [{"properties": {"a": {"type": "number"}}}, {"properties": {"a": {"minItems": 2}}}, {"properties": {"a": {"required": ["b"]}, "b": {"$ref": "#/$defs/l"}}}], "$defs": {"l": {"maxItems": 1, "type": "array"}}},
    {"patternProperties": {"^a": {"exclusiveMinimum": 1, "maximum": 2.5}, "b": {"type": "boolean"}}, "additionalProperties": False},
    True,
    False,
]


def random_json(rnd, depth=0):
    leaf = [1, 2, 0, 1.0, 2.5, -3, 4, True, False, None, "", "x", "é", "yy", "xyz"]
    roll = rnd.random()
    if depth > 3 or roll < 0.45:
        return rnd.choice(leaf)
    if roll < 0.7:
        return [random_json(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return {k: random_json(rnd, depth + 1) for k in rnd.sample(["a", "b", "c", "ab"], rnd.randrange(4))}


@pytest.mark.parametrize("number", range(len(SCHEMAS)))
def test_schema_equals_its_model(spark, number):
    rnd = random.Random(number)
    values = [v for v in (random_json(rnd) for _ in range(250)) if v is not None]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i long, raw string")
    got = {r[0]: sorted(r[1]) for r in df.select("i", schema_problems(F.col("raw"), SCHEMAS[number])).collect()}
    assert got == {i: sorted(model(SCHEMAS[number], v)) for i, v in enumerate(values)}
    by_columns = with_schema_problems(df, "raw", SCHEMAS[number])
    assert by_columns.columns == ["i", "raw", "problems"] and {r["i"]: sorted(r["problems"]) for r in by_columns.collect()} == got


def test_references_parsing_and_refusals(spark):
    one = lambda raw, s: spark.createDataFrame([(raw,)], "raw string").select(schema_problems(F.col("raw"), s)).first()[0]
    tree = {"$ref": "#/$defs/n~1a", "$defs": {"n/a": {"properties": {"x": {"$ref": "#/$defs/int"}}}, "int": {"type": "integer"}}}
    assert one('{"x": "1"}', tree) == ["$.x: type"] and one('{"x": 7.0}', tree) == []
    for raw in ("{broken", "", None, "null", '{"a": 1'):
        assert one(raw, None) == one(raw, {"type": "null"}) == ["$: not JSON"]
    assert one("[1, 2]", None) == one('"text"', None) == []
    assert one("9" * 30, {"type": "integer", "maximum": 5}) == ["$: maximum"]
    assert one('{"a": "' + "y" * 300_000 + '"}', {"properties": {"a": {"maxLength": 299_999}}}) == ["$.a: maxLength"]
    with pytest.raises(ValueError, match="back to itself"):
        schema_problems(F.col("raw"), {"$ref": "#"})
    with pytest.raises(ValueError, match="unevaluatedItems"):
        schema_problems(F.col("raw"), {"unevaluatedItems": False})


# -------------------------------------------------------------- completions


def filled(t, v):
    """Neutral values for whatever is missing."""
    if isinstance(t, T.StructType):
        return {f.name: filled(f.dataType, (v or {}).get(f.name)) for f in t.fields}
    if isinstance(t, T.ArrayType):
        return [filled(t.elementType, x) if isinstance(t.elementType, T.StructType) else x for x in v or []]
    return v if v is not None else {"string": "", "bigint": 0, "boolean": False}.get(t.simpleString(), {})


def completed(t, old, new, name=""):
    if isinstance(t, T.StructType):
        return {f.name: completed(f.dataType, (old or {}).get(f.name), (new or {}).get(f.name), f.name) for f in t.fields}
    if isinstance(t, T.MapType):
        return {**(old or {}), **(new or {})}
    if new is None:
        return filled(t, old)
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
        own = S.DECLARED_IDENTITY.get(name)
        key = own if own in t.elementType.names else next((k for k in S.IDENTITY if k in t.elementType.names), None)
        earlier = {x[key]: x for x in old or [] if key and x.get(key) is not None}
        merged = [{k: x[k] if x.get(k) is not None else earlier.get(x.get(key), {}).get(k) for k in t.elementType.names} for x in new]
        return [filled(t.elementType, x) for x in merged]
    return new


def random_state(rnd, t, gaps):
    if rnd.random() < gaps:
        return None
    if isinstance(t, T.StructType):
        return {f.name: random_state(rnd, f.dataType, gaps) for f in t.fields}
    if isinstance(t, T.MapType):
        return {k: rnd.choice("uvw") for k in rnd.sample("klm", rnd.randrange(3))}
    if isinstance(t, T.ArrayType):
        inner = t.elementType
        return [random_state(rnd, inner, gaps) or ({} if isinstance(inner, T.StructType) else "z") for _ in range(rnd.randrange(4))]
    return {"string": rnd.choice(["a", "b", "c"]), "bigint": rnd.randrange(5), "boolean": rnd.random() < 0.5}[t.simpleString()]


@pytest.mark.parametrize("family", ["workspace", "mcp_notes", "mcp_api", "web_research", "terminal_ops"])
def test_completion_equals_its_model_at_every_depth(spark, family):
    t = WORKSPACE if family == "workspace" else S.FAMILIES[family]
    rnd = random.Random(len(family))
    pairs = [(random_state(rnd, t, 0.1) or {}, random_state(rnd, t, 0.35) or {}) for _ in range(120)]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    full = df.select("i", F.to_json(S.complete(F.from_json("a", t), F.from_json("b", t), t), {"ignoreNullFields": "false"})).collect()
    got = {r[0]: json.loads(r[1]) for r in full}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == completed(t, a, b), (a, b)


# -------------------------------------------------------------------- folds

NOTES = S.FAMILIES["mcp_notes"]


def test_fold_equals_a_loop_and_finds_the_first_failure(spark):
    rnd, rows, want = random.Random(9), [], {}
    initial = {"notes": [{"title": "a", "content": "start", "tags": ["x"]}]}
    for k in range(40):
        states = [initial]
        for turn in range(rnd.randrange(1, 9)):
            p = random_state(rnd, NOTES, 0.25) or {}
            rows.append((k, turn, json.dumps(p)))
            states.append(completed(NOTES, states[-1], p))
        want[k] = states
    rnd.shuffle(rows)
    steps = spark.createDataFrame(rows, "k long, turn long, p string").select("k", "turn", F.from_json("p", NOTES).alias("predicted"), F.lit("clash").alias("state"))
    out = folds.fold_states(steps, ["k"], "turn", "predicted", F.from_json(F.lit(json.dumps(initial)), NOTES), NOTES)
    got = {r["k"]: [json.loads(x) for x in r["s"]] for r in out.select("k", F.transform("states", lambda s: F.to_json(s["state"], {"ignoreNullFields": "false"})).alias("s")).collect()}
    assert got == want
    verdicts = {r["k"]: r for r in folds.step_verdicts(out, ["k"], {"any": "len(state['notes']) > 0", "first": "state['notes'][0]['title'] == 'a'"}, NOTES).collect()}
    for k, states in want.items():
        r, held = verdicts[k], [len(s["notes"]) > 0 for s in states]
        first = [h and s["notes"][0]["title"] == "a" for h, s in zip(held, states, strict=True)]
        assert (r["n_states"], r["any_ever"], r["any_always"], r["any_at_end"], r["any_first_failure"]) == (len(states), any(held), all(held), held[-1], held.index(False) if False in held else None)
        assert (r["first_ever"], r["first_at_end"], r["first_first_failure"]) == (any(first), first[-1], first.index(False) if False in first else None)
        assert r["first_error"] == (None if all(held) else "checker_raised:IndexError")
    assert any(r["any_ever"] != r["any_at_end"] for r in verdicts.values())


def test_fold_of_equal_null_and_too_many_steps(spark):
    p = json.dumps({"notes": []})
    rows = [(1, 3, p), (1, 3, p), (1, None, None), (None, 1, p)]
    steps = spark.createDataFrame(rows, "k long, turn long, p string").select("k", "turn", F.from_json("p", NOTES).alias("predicted"))
    initial = F.from_json(F.lit('{"notes":[{"title":"a"}]}'), NOTES)
    got = {r["k"]: [(s["place"], s["at"], len(s["state"]["notes"])) for s in r["states"]] for r in folds.fold_states(steps, ["k"], "turn", "predicted", initial, NOTES).collect()}
    assert got == {1: [(0, None, 1), (1, None, 1), (2, 3, 0), (3, 3, 0)], None: [(0, None, 1), (1, 1, 0)]}
    assert folds.fold_states(steps.limit(0), ["k"], "turn", "predicted", initial, NOTES).count() == 0
    with pytest.raises(Exception, match="more than 2 steps"):
        folds.fold_states(steps, ["k"], "turn", "predicted", initial, NOTES, max_steps=2).collect()

"""Malformed texts, predicates, states and playbook edits on literal inputs."""

import pytest
from pyspark.sql import functions as F

from gymlake.functions import predicates as P
from gymlake.functions import state as S
from gymlake.functions import text as X
from gymlake.operators import playbook as B
from gymlake.operators.enrich import enrich
from gymlake.operators.judge_parse import coerce_score, parse_judgements, verdict


def run(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


@pytest.mark.parametrize("text,want", [
    ("<think>a</think>X", "X"), ("<think>a</think>X<think>b</think>Y", "XY"), ("<think>a<THINK>b</think>c</think>X", "X"), ("lost</think> X", "X"),
    ("X <think>rest", "X"), ("X <think>rest <obs>kept", "X <obs>kept"), ("plain", "plain"), ("", ""),
])
def test_thinking(text, want):
    assert X.thinking_removed(text, "obs") == want


def test_tag_blocks(spark):
    texts = ["<o>a</o><O> b </O>c", "<o>open", "none", "", None]
    assert run(spark, lambda x: X.last_tag_block(x, "o"), texts) == ["b", "open", None, None, None]
    assert run(spark, lambda x: X.observation(x, "o"), texts) == ["b", "open", "none", "No output", "No output"]


def test_objects_in_text():
    assert X.outer_braces('x {"a": "}", "b": {"c": 1}} y {2}') == '{"a": "}", "b": {"c": 1}}'
    assert X.outer_braces('{"a": "q\\"}"} {"b": 1}', backward=True) == '{"b": 1}'
    assert X.outer_braces('{"open": 1') is None


def test_choices(spark):
    assert run(spark, X.boxed_choice, ["\\boxed{A}", "\\boxed{ b }", "\\boxed{A} \\boxed{B}", "answer is **B**", "none", None]) == ["A", "B", "B", "B", None, None]


def test_tags(spark):
    assert run(spark, X.normalise_tag, ["Stale Identifier Reuse", "--A__b--", "", None, "Été 2"]) == ["stale-identifier-reuse", "a-b", "general", "general", "été-2"]


def test_scores(spark):
    raws = ["7", "0", "-1", "3.5", "2.5", '"4/5"', '"n/a"', None, "true", '" 3 "', '"2.5"', '"true"', "[4]", "null", "false"]
    assert run(spark, lambda x: coerce_score(F.parse_json(x)), raws) == [5, 0, 0, 4, 2, 4, 0, 0, 1, 3, 0, 0, 0, 0, 0]


def test_judgements_that_are_hard_to_read(spark):
    raws = [
        '{"scores": {"format": 3}, "strengths": ["a"], "weaknesses": "b"} and {"note": 1}',  # the object with scores counts
        '<think>never closed {"x": 1} <final_evaluation>{"scores": {"format": 3}, "strengths": ["a"]}',  # thinking ends where the tag opens
        '{"scores": {"format": 0, "quality": 0}}',  # no valid score is no failure to read
        "{'scores': {format: 3,}, 'strengths': ['a, ]', 'b',],}", 'a stray { brace, then {"scores": {"format": 3}}',
    ]
    got = [r.asDict() for r in parse_judgements(spark.createDataFrame(list(enumerate(raws)), "i int, raw string")).orderBy("i").collect()]
    assert [r["format"] for r in got] == [3, 3, 0, 3, 3] and all(r["success"] and r["error_message"] is None for r in got)
    assert [r["total_score"] for r in got] == [3.0, 3.0, 0.0, 3.0, 3.0]
    assert got[0]["strengths"] == ["a"] and got[0]["weaknesses"] == ["b"] and got[1]["strengths"] == ["a"] and got[3]["strengths"] == ["a, ]", "b"]


def test_judgements(spark):
    s = '"scores": {"format": 4, "factuality": 2, "consistency": 0, "realism": 3, "quality": 3}'
    raws = [f"<think>hm</think><final_evaluation>```json\n{{{s}, \"strengths\": [\"a\"]}}\n```</final_evaluation>", f"said: {{{s},}} done", f"{{{s}, \"strengths\": [\"cut", "", "no json", f"```json\n{{\"x\": 1}}\n``` ```json\n{{{s}}}\n```"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = {r["i"]: r for r in parse_judgements(df).collect()}
    assert all(got[i]["total_score"] == 3.0 and got[i]["success"] for i in (0, 1, 2, 5))
    assert got[0]["strengths"] == ["a"] and not got[3]["success"] and got[3]["error_message"] == "Empty output" and got[4]["error_message"] == "No JSON object found"


def test_verdict_modes(spark):
    df = spark.createDataFrame([(True, 0.1), (False, 0.9)], "c boolean, s double")
    got = df.select(*[verdict(m, F.col("c"), F.col("s"), 0.5).alias(m) for m in ("checker", "llm", "both")]).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (False, True, False)]


NOTES = S.FAMILIES["mcp_notes"]


@pytest.mark.parametrize("predicate,reason", [
    ("state['notes'] == []", None), ("len(state.get('notes', [])) > 0 and True is True", None), ("any(t == 'x' for n in state['notes'] for t in n['tags'])", None), ("state['notes'][0:2] != []", None),
    ("import os", "syntax"), ("state.__class__", "attribute:__class__"), ("eval('state')", "name:eval"), ("other == state", "name:other"), ("1 == 1", "no_state"), ("state['a'] + 1 == 2", "node:BinOp"), ("(lambda: state)()", "node:Lambda"),
])
def test_vetting(predicate, reason):
    got = P.vet(predicate)
    assert got == reason or (reason and got in ("call", reason))


def test_tautologies():
    assert P.is_tautology("state['a'] == 1 or state['a'] != 1") and P.is_tautology("state['a'] >= 1 or state['a'] < 1")
    assert not P.is_tautology("state['a'] == 1 or state['b'] != 1") and not P.is_tautology("state['a'] == 1")


def test_clauses_keys_and_literals():
    p = "(state['a'] == 1 and state.get('b') == 2) and not state['c']"
    assert len(P.conjuncts(p)) == 3 and P.keys_read(p) == {"a", "b", "c"}
    assert P.long_literals("state['a'] == 'one two three four five six seven'") == ["one two three four five six seven"]


def test_predicates_over_states(spark):
    rows = [([("a", "c", ["x"]), ("b", "d", [])],), ([],), (None,)]
    df = spark.createDataFrame(rows, NOTES).select(F.struct("notes").alias("state"))
    tests = {
        "len(state['notes']) == 2": [True, False, False],
        "all(n['title'] != 'b' for n in state['notes'])": [False, True, True],
        "any('x' in n['tags'] for n in state['notes'] if n['title'] == 'a')": [True, False, False],
        "state['notes'][-1]['title'] == 'b'": [True, False, False],
        "sorted([n['title'] for n in state['notes']]) == ['a', 'b']": [True, False, False],
        "not state['notes']": [False, True, True],
        "state['zzz'] == 1": [False, False, False],
        "state['notes'] < 3": [False, False, False],
    }
    for p, want in tests.items():
        c = P.compile_predicate(p, NOTES, state=F.col("state"))
        assert [r[0] for r in df.select(c.column).collect()] == want, p
    assert P.compile_predicate("state['zzz'] == 1", NOTES, state=F.col("state")).reason == "checker_raised:KeyError"
    steps = df.select(F.array("state").alias("states"))
    j = P.judge("len(state['notes']) == 9", "any(len(s['notes']) > 0 for s in states)", True, NOTES, F.col("states")[0], F.col("states"))
    assert [r[0] for r in steps.select(j.column).collect()] == [True, False, False]


def test_predicates_that_raise_or_have_no_native_form(spark):
    df = spark.createDataFrame([([("a", "c", ["x"])],), ([],)], NOTES).select(F.struct("notes").alias("state"))
    out_of_range = [("t", None), ("f", "checker_raised:IndexError")]
    tests = {
        "state['notes'][0]['title'] != 'b'": out_of_range,
        "not state['notes'][0]['title'] == 'b'": out_of_range,
        "len(state['notes']) == 0 or state['notes'][0]['title'] == 'a'": [("t", None), ("t", None)],
        "len(state['notes']) > 0 and state['missing'] == 1": [("f", "checker_raised:KeyError"), ("f", None)],
        "{n['title'] for n in state['notes']} == {n['title'] for n in state['notes'][-1:]}": [("t", None), ("t", None)],
        "state['notes'][0]['content'].split('c').count('') == 2": out_of_range,
        "len([t for n in state['notes'] for t in n['tags']]) == 1": [("t", None), ("f", None)],
        "state['notes'] < 3": [("f", "checker_raised:TypeError")] * 2,
    }
    for p, want in tests.items():
        assert P.vet(p) is None
        c = P.compile_predicate(p, NOTES, state=F.col("state"))
        got = df.select(c.column.alias("c"), c.error.alias("e")).collect()
        assert [("ft"[r["c"]], r["e"]) for r in got] == want, p
    assert P.vet("state['a'].__class__") == "attribute:__class__" and P.vet("open('x') == state") == "call"


@pytest.mark.parametrize("raw,want", [
    ('{"notes":[]}', []), ('{"notes":[{"title":"a","content":"b"}]}', ["missing:notes[0].tags"]), ('{"notes":{"a":1}}', ["kind:notes:object"]), ("{}", ["missing:notes"]),
    ('{"notes":[{"id":1,"title":"a","content":"b","tags":"client"}]}', ["extra:notes[0].id", "kind:notes[0].tags"]), (None, ["kind:state"]), ("[1]", ["kind:state"]),
])
def test_state_violations(spark, raw, want):
    assert run(spark, lambda x: S.violations(x, NOTES), [raw]) == [want]


@pytest.mark.parametrize("family", sorted(S.FAMILIES))
def test_empty_state_conforms_to_neutral(spark, family):
    schema = S.FAMILIES[family]
    full = run(spark, lambda x: F.to_json(S.conform(F.from_json(x, schema), schema)), ["{}"])[0]
    assert run(spark, lambda x: S.violations(x, schema), [full]) == [[]]


def test_kinds(spark):
    assert run(spark, S.kind_of, ["1", "1.5", '"a"', "true", "[]", "{}", "null", "oops", None]) == ["integer", "number", "string", "boolean", "list", "object", "null", "null", "null"]


def test_edits():
    old = [{"entry_id": str(i), "tag": "t", "content": c, "helpful": i, "harmful": 1, "version": 1} for i, c in enumerate(["check the path first", "never delete records", "list files before reading"])]
    ops = [
        {"op": "add", "content": "Check the path FIRST!", "tag": "t"}, {"op": "update", "entry_ids": ["9"], "content": "x"}, {"op": "merge", "entry_ids": ["2", "1"], "content": "merged rule text"},
        {"op": "remove", "entry_ids": ["0"]}, {"op": "add", "content": "something new entirely"}, {"op": "dance", "entry_ids": []},
    ]
    book, outcomes = B.edit_playbook(old, ops)
    assert outcomes == ["suppressed", "rejected", "merged", "removed", "added", "rejected"]
    assert [e["content"] for e in book] == ["merged rule text", "something new entirely"]
    assert (book[0]["helpful"], book[0]["harmful"], book[0]["version"]) == (3, 2, 2) and book[1]["tag"] == "general"
    assert B.edit_playbook(old, []) == (old, [])


def test_edits_that_are_malformed_or_partly_known():
    old = [{"entry_id": str(i), "tag": "t", "content": c, "helpful": i, "harmful": 1, "version": 1} for i, c in enumerate(["check the path first", "never delete records", "list files before reading"])]
    ops = [
        {"op": "merge", "entry_ids": ["0"], "content": "x"}, {"op": "remove", "entry_ids": ["0", "1"]}, {"op": "add", "content": "  "}, {"op": "update", "entry_ids": ["0", "1"], "content": "x"},
        {"op": "update", "entry_ids": ["0"], "content": " sharper words ", "tag": "A B"}, {"op": "merge", "entry_ids": ["2", "nine", "1"], "content": "both", "tag": None}, {"op": "update", "entry_ids": ["0"], "content": ""},
    ]
    book, outcomes = B.edit_playbook(old, ops)
    assert outcomes == ["rejected", "rejected", "rejected", "rejected", "updated", "merged", "rejected"]
    assert [(e["entry_id"], e["tag"], e["content"], e["version"], e.get("provenance")) for e in book] == [("0", "a-b", "sharper words", 2, None), ("new-5", "t", "both", 2, ["2", "1"])]


def test_frontier_keeps_ties(spark):
    df = spark.createDataFrame([("a", 0.9, 0.1, 0.5), ("b", 0.1, 0.9, 0.5), ("c", 0.1, 0.1, 0.1), ("d", 0.9, 0.1, 0.5)], "k string, x double, y double, z double")
    assert sorted(r["k"] for r in B.pareto_frontier(df, "k", "x", "y", "z").collect()) == ["a", "b", "d"]


def test_compactness_budget():
    with pytest.raises(ValueError):
        B.compactness(F.lit(1), 0)


class _Flaky:
    def __init__(self):
        self.n = 0

    def __call__(self, prompts):
        self.n += 1
        if self.n % 2:
            raise TimeoutError
        return [p.upper() for p in prompts]


def test_enrichment_retries_and_reports(spark):
    df = spark.createDataFrame([("a",), (None,)], "p string").coalesce(1)
    got = enrich(df, "p", "r", _Flaky, attempts=2, pause=0.0).collect()
    assert [(r["r"], r["error"]) for r in got] == [("A", None), ("", None)]
    failed = enrich(df, "p", "r", _Flaky, attempts=1, pause=0.0).collect()
    assert [r["error"] for r in failed] == ["TimeoutError", None]

"""Static audits of checkers, prompts of judged turns and guards on literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from gymlake.functions import predicates as P
from gymlake.functions import text as X
from gymlake.operators import prompts as J
from gymlake.plans.bank import at_least
from gymlake.plans.reports import assert_isolated

LONG = "one two three four five six seven"


@pytest.mark.parametrize("predicate,shown,want", [
    ("state['notes'] == []", [], []),
    (f"state['title'] == '{LONG}'", [], ["leak"]),
    (f"state['title'] == '{LONG}'", [LONG], []),
    (f"state['title'] == '{LONG}'", [LONG + " eight"], ["leak"]),
    (f"state['title'] == '{'x' * 81}'", [], ["leak"]),
    ("state['gone'] == 1 and state.get('lost') == 2", [], ["key:gone", "key:lost"]),
    ("any(c['tool'] in ['fly'] or c['tool'] == 'fly' for c in state['_action_log'])", [], ["tool:fly"]),
    ("any(c['tool'] == 'search' and c['arguments']['title'] == 'a' for c in state['_action_log'])", [], []),
    ("state['notes'] == [] or state['notes'] != []", [], ["tautology"]),
    ("state['notes'", [], ["unsafe:syntax"]),
])
def test_static_problems(predicate, shown, want):
    assert P.static_problems(predicate, ["notes", "title"], ["search"], shown) == want


def test_audits_of_null_predicates_and_texts(spark):
    df = spark.createDataFrame([(1, None, ["a"]), (2, "state['notes'] == []", None)], "i int, p string, s array<string>")
    assert {r["i"]: r["x"] for r in df.select("i", P.audited(["notes"], [])(F.col("p"), F.col("s")).alias("x")).collect()} == {1: None, 2: []}


@pytest.mark.parametrize("value,want", [
    ({"a": {"b": [{"c": "d"}, ["e", {"f": 1}]]}}, {"a", "b", "c", "d", "e", "f"}),
    ("alone", {"alone"}), ([], set()), ({"": None}, {""}),
    ({"k": 'a "quoted" text\\', "l\\": "\\\\\"", "m": "line\nbreak\tand \u0001 ä \U0001f600"}, {"k", 'a "quoted" text\\', "l\\", "\\\\\"", "m", "line\nbreak\tand \u0001 ä \U0001f600"}),
    ({"long": '\n"' * 50_000}, {"long", '\n"' * 50_000}),
])
def test_all_strings(spark, value, want):
    for ascii in (True, False):
        got = spark.createDataFrame([(json.dumps(value, ensure_ascii=ascii),)], "x string").select(X.all_strings(F.col("x"))).first()[0]
        assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("p,r,turn,given,want", [
    (["a", "b", "c"], ["x", "y"], 1, "", ("a", "x", "")),
    (["a", "b", "c"], ["x", "y"], 3, None, ("c", "", J.HISTORY + "a\nx\n\nb\ny\n\n")),
    (["a", "b", "c"], ["x"], 3, "own", ("own", "", J.HISTORY + "a\nx\n\n")),
    (["a"], ["x"], 0, "", ("a", "x", "")),
    (["a"], ["x"], 9, "", ("", "", J.HISTORY + "a\nx\n\n")),
    ([], [], 2, "", ("", "", "")),
])
def test_turns(spark, p, r, turn, given, want):
    df = spark.createDataFrame([(p, r, turn, given)], "p array<string>, r array<string>, turn int, given string")
    p, r, turn = F.col("p"), F.col("r"), F.col("turn")
    assert tuple(df.select(J.current_prompt(F.col("given"), p, turn), J.ground_truth(r, turn), J.history(p, r, turn)).first()) == want


def test_templates(spark):
    got = spark.range(1).select(J.fill("{a}\n\nscore {{1}} of {b}\n", a=F.lit(""), b=F.lit("{c}"))).first()[0]
    assert got == "score {1} of {c}"
    with pytest.raises(KeyError):
        J.fill("{a} {b}", a=F.lit(""))


def test_sets_that_are_too_small(spark):
    assert at_least(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError, match="4 tasks"):
        at_least(spark.range(4), 5)


def test_families_that_share_tools(spark):
    of = lambda *rows: spark.createDataFrame(rows, "name string, params array<string>")
    assert_isolated(of(("a", ["x"])), of(("b", ["y"])))
    for held in (("a", ["y"]), ("b", ["x"])):
        with pytest.raises(ValueError, match="share"):
            assert_isolated(of(("a", ["x"])), of(held))

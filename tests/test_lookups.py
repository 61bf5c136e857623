"""Look-ups, summaries, tables as text, second sources, ids and guards on literal rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gymlake.functions import text as X
from gymlake.operators import lookups as L
from gymlake.operators import rates as R
from gymlake.operators.playbook import change_count
from gymlake.plans.bank import at_least
from gymlake.plans.reports import assert_isolated, family_overlap, family_overlaps

ENTRIES = "playbook_id int, pos long, entry_id string, tag string, content string"


def test_entries_by_id_and_tag(spark):
    e = spark.createDataFrame([(1, 2, "a", "Stale ID", "second"), (1, 1, "a", "x", "first"), (1, 3, "b", "stale-id", "b"), (2, 1, "a", None, "other"), (2, 2, None, "!", "none")], ENTRIES)
    wanted = spark.createDataFrame([(1, "a"), (1, "a"), (1, "zz"), (2, "a"), (2, None)], "playbook_id int, entry_id string")
    got = sorted(((r["playbook_id"], r["entry_id"] or "", r["entry"]["content"] if r["entry"] else None) for r in L.entries_by_id(e, wanted).collect()), key=str)
    assert got == [(1, "a", "first"), (1, "a", "first"), (1, "zz", None), (2, "", None), (2, "a", "other")]
    tags = spark.createDataFrame([(1, " STALE id "), (1, "stale-ID"), (2, None)], "playbook_id int, tag string")
    assert sorted((r["playbook_id"], r["tag"], r["content"]) for r in L.entries_by_tag(e, tags).collect()) == [(1, "stale-id", "b"), (1, "stale-id", "second"), (2, "general", "none"), (2, "general", "other")]
    assert L.entries_by_id(e, wanted.limit(0)).count() == L.entries_by_tag(e.limit(0), tags).count() == 0


def test_calls_are_numbered_in_order(spark):
    rows = [("r", 3, "read", "p"), ("r", 1, "list", None), ("r", 2, None, "x"), ("r", 3, "read", "o"), ("none", 1, None, None), (None, 1, "list", "q")]
    calls = L.numbered_calls(spark.createDataFrame(rows, "k string, n int, tool string, args string"), ["k"], "n", "tool", "args")
    got = {r["k"]: (r["t"], len(r["calls"])) for r in calls.withColumn("t", L.calls_text(F.col("calls"))).collect()}
    assert got == {"r": ("1. list()\n2. read(o)\n3. read(p)", 3), "none": ("", 0), None: ("1. list(q)", 1)}


def test_markdown(spark):
    df = spark.createDataFrame([("b", 2, None), ("a|c", 1, 0.5)], "name string, n int, v double")
    got = [r["line"] for r in L.markdown_table(df, {"name": F.col("name"), "v": F.col("v")}, "n").orderBy("place").collect()]
    assert got == ["| name | v |", "|---|---|", "| a\\|c | 0.5 |", "| b | - |"]
    assert [r["line"] for r in L.markdown_table(df.limit(0), {"name": F.col("name")}, "n").orderBy("place").collect()] == ["| name |", "|---|"]


def test_the_first_source_that_measured_counts(spark):
    cells = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    a, b = spark.createDataFrame([(1, 0.1), (2, None)], "k int, v double"), spark.createDataFrame([(1, 9.0), (2, 0.2), (3, 0.0)], "k int, v double")
    got = {tuple(r) for r in L.first_measured(cells, {"csv": a, "json": b}, ["k"], "v").collect()}
    assert got == {(1, 0.1, "csv"), (2, 0.2, "json"), (3, 0.0, "json"), (4, None, None)}


def test_ids_choices_objects_and_changes(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None), ("a", ""), ("ab", "")], "x string, y string").select(X.stable_id("t", F.col("x"), F.col("y")).alias("i"))
    ids = [r["i"] for r in df.collect()]
    assert len(set(ids)) == 4 and ids[0] == "t-" + hashlib.md5(b"=a\x1f=b").hexdigest()[:12]
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]
    assert one("<think>\\boxed{A}</think> \\boxed{b}", X.boxed_choice) == "B" and one("<think>\\boxed{A}", X.boxed_choice) is None and one(None, X.boxed_choice) is None
    assert one('<think>{"no"}</think> a {"x": {1} } b }', X.greedy_object) == '{"x": {1} } b }' and one("none", X.greedy_object) is None and one(None, X.greedy_object) is None
    kinds = spark.createDataFrame([(["added", "merged", "rejected", "suppressed", "removed", "updated"], 3), ([], None)], "o array<string>, m int")
    assert [r[0] for r in kinds.select(change_count(F.col("o"), F.col("m"))).collect()] == [7, 0]


def test_guards(spark):
    df = spark.range(3)
    assert at_least(df, 3).count() == 3
    with pytest.raises(ValueError, match="3 tasks in the set, at least 4"):
        at_least(df, 4)
    tools = spark.createDataFrame([("a", "one", ["p", "q"]), ("b", "two", ["q", None]), ("a", "two", []), (None, "three", None), ("c", "three", ["z", "z"])], "name string, family string, params array<string>")
    got = {r["held"]: tuple(r)[1:] for r in family_overlaps(tools).collect()}
    assert got == {"one": (1, 1, False), "two": (1, 1, False), "three": (0, 0, True)}
    held = tools.where("family = 'one'")
    assert tuple(family_overlap(tools.where("family <> 'one'"), held).first())[:2] == got["one"][:2]
    with pytest.raises(ValueError, match="share 1 tool names"):
        assert_isolated(tools.where("family <> 'one'"), held)
    assert_isolated(tools.where("family <> 'three'"), tools.where("family = 'three'"))


def test_bootstrap_equals_drawing_by_digest(spark):
    rnd = random.Random(1)
    deltas = {u: rnd.choice([-1.0, 0.0, 0.5, 1.0]) for u in range(9)}
    pairs = spark.createDataFrame(list(deltas.items()), "task_id long, delta double")
    got = {r["resample"]: r["mean"] for r in R.bootstrap_means(pairs, 300, seed=5).collect()}
    draw = lambda r, d: int(hashlib.md5(f"5|{r}|{d}".encode()).hexdigest()[:8], 16) % 9
    assert got == pytest.approx({r: sum(deltas[draw(r, d)] for d in range(9)) / 9 for r in range(300)})
    assert R.bootstrap_means(pairs.limit(0), 10).count() == 0
    one = R.bootstrap_interval(pairs.limit(1), 50).first()
    assert (one["n_units"], one["low"], one["high"]) == (1, -1.0, 1.0)
    none = R.bootstrap_interval(pairs.limit(0), 50).first()
    assert (none["n_units"], none["point"], none["low"], none["high"]) == (0, 0.0, 0.0, 0.0)

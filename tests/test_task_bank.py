"""Merges of verdicts into a stored bank, and the audit that takes tasks out."""

import os

from pyspark.sql import functions as F

from gymlake.operators.task_audit import audit_tasks, condemnations, example
from gymlake.functions import state as S
from gymlake.sources import task_bank as B

TASK = "task_id string, tool_family string, gc int, unpassable boolean, too_weak boolean, rate double"
NEWS = "task_id string, report_seq long, unpassable boolean, too_weak boolean"


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def bank(spark, root):
    rows = [(f"t{i}", ("notes", "api", None)[i % 3], 3 + i % 2, False, False, i / 10) for i in range(200)]
    B.save(spark.createDataFrame(rows, TASK), root)
    return rows


def test_a_merge_rewrites_the_partitions_it_has_news_for(spark, tmp_path):
    root = str(tmp_path / "bank")
    rows = bank(spark, root)
    before = files(root)
    news = [("t5", 1, False, True), ("t5", 2, True, None), ("t6", 1, True, False), ("t6", 1, False, False), ("nobody", 9, True, True), (None, 3, True, True), ("t2", 7, False, True)]
    outcome = B.merge_verdicts(spark, root, spark.createDataFrame(news, NEWS), ("unpassable", "too_weak"), str(tmp_path / "r1"))
    assert {tuple(r) for r in outcome.collect()} == {("t5", "updated"), ("t6", "updated"), ("t2", "updated"), ("nobody", "not_found")}
    got = {r["task_id"]: (r["tool_family"], r["gc"], r["unpassable"], r["too_weak"], r["rate"]) for r in B.load(spark, root).collect()}
    want = {r[0]: tuple(r[1:]) for r in rows}
    want["t5"], want["t6"], want["t2"] = (*want["t5"][:2], True, None, 0.5), (*want["t6"][:2], True, False, 0.6), (*want["t2"][:2], False, True, 0.2)
    assert got == want  # t2 and t5 lie in partitions without a family
    gone = {os.path.dirname(f) for f in before - files(root)}
    assert 1 <= len(gone) <= 3 and len(before & files(root)) >= len(before) - 6  # the other files keep their names
    again = files(root)
    B.merge_verdicts(spark, root, spark.createDataFrame([("nobody", 1, True, True)], NEWS), ("unpassable", "too_weak"), str(tmp_path / "r2"))
    B.merge_verdicts(spark, root, spark.createDataFrame([], NEWS), ("unpassable", "too_weak"), str(tmp_path / "r3"))
    assert files(root) == again


def test_the_same_merge_twice_changes_nothing_more(spark, tmp_path):
    root = str(tmp_path / "bank")
    bank(spark, root)
    news = spark.createDataFrame([("t7", 1, True, True)], NEWS)
    states = []
    for k in range(2):
        B.merge_verdicts(spark, root, news, ("unpassable",), str(tmp_path / f"r{k}"))
        states.append(sorted(map(str, B.load(spark, root).collect())))
    assert states[0] == states[1] and sum("task_id='t7'" in x and "unpassable=True, too_weak=False" in x for x in states[0]) == 1


AUDIT = "task_id string, tool_family string, initial_state string, predicate string, step_wise_predicate string"


def test_audit_of_states_and_checkers(spark):
    rows = [
        ("fine", "mcp_notes", '{"notes":[],"_action_log":[]}', "len(state['notes']) == 0", None),
        ("unguarded", "mcp_notes", '{"notes":[]}', "state['notes'][0]['id'] == 1", None),
        ("empty list hides it", "mcp_notes", '{"notes":[]}', "all(n['id'] for n in state['notes'])", None),
        ("guarded", "mcp_notes", '{"notes":[]}', "state['notes'][0].get('id') == 1", None),
        ("no such tool", "web_research", '{"last_results":[],"notebook":[]}', "any(c['tool'] == 'fly' for c in state.get('_action_log', []))", None),
        ("parameter", "web_research", '{"last_results":[],"notebook":[]}', "any(c['arguments']['query'] == 'x' for c in state.get('_action_log', []))", None),
        ("no clue", "mcp_notes", "[1]", "state[", "all(s['zzz'] for s in states)"),
        ("raises, no fault", "mcp_notes", None, "state['notes'][3]['title'] == ''", None),
        ("other family", "nowhere", "{}", "state['x']", None),
        ("nothing", "mcp_notes", None, None, None),
        ("no family", None, None, None, None),
    ]
    out = {r["task_id"]: r for r in audit_tasks(spark.createDataFrame(rows, AUDIT)).collect()}
    got = {k: (r["state_problems"], r["checker_problems"], r["raises"], r["condemned"]) for k, r in out.items()}
    assert got == {
        "fine": ([], [], None, False), "unguarded": ([], ["key:id"], "KeyError", True), "empty list hides it": ([], ["key:id"], "KeyError", True), "guarded": ([], ["key:id"], None, False),
        "no such tool": ([], ["tool:fly"], None, False), "parameter": ([], [], None, False), "no clue": (["kind:state"], ["unsafe:syntax", "key:zzz"], "KeyError", True),
        "raises, no fault": (["missing:notes"], [], "IndexError", False), "other family": (None, None, None, False), "nothing": (["missing:notes"], [], None, False), "no family": (None, None, None, False),
    }
    assert {k for k, r in out.items() if r["skipped"]} == {"other family", "no family"}
    assert {r["task_id"] for r in condemnations(audit_tasks(spark.createDataFrame(rows, AUDIT))).collect()} == {"unguarded", "empty list hides it", "no clue"}
    assert audit_tasks(spark.createDataFrame([], AUDIT)).count() == 0


def test_examples_have_every_field():
    assert example(S.FAMILIES["mcp_notes"]) == {"notes": [{"title": "", "content": "", "tags": []}]}
    assert example(S.FAMILIES["code_repo"])["last_test_run"] == {"suite": "", "passed": 0, "failed": 0, "failing": []} and F is not None

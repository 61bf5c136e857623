"""File sources, sinks and streams on small folders."""

import json

import pytest
from pyspark.sql import functions as F

from gymlake.operators import rates as R
from gymlake.sources import catalog as C
from gymlake.sources import files as S
from gymlake.streaming import rates as stream


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def test_samples(spark, tmp_path):
    write(tmp_path / "a_test.jsonl", {"task": "x/mcp", "id": 1, "prompt": "p", "response": ["r"], "turn_idx": 1}, "", {"task": "y", "id": 2, "prompt": ["p", "q"], "response": "r"})
    write(tmp_path / "ignored.jsonl", {"task": "z", "id": 3})
    got = {r["id"]: r for r in S.read_samples(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2} and got[1]["prompt"] == ["p"] and got[2]["prompt"] == ["p", "q"] and got[2]["response"] == ["r"] and got[1]["file_name"] == "a_test.jsonl"


def test_strict_and_headed_lines(spark, tmp_path):
    write(tmp_path / "score.json", {"accuracy": 0.5, "correct_count": 1, "total_count": 2}, {"id": "b", "error": ["e"]}, "", {"id": "d", "error": []})
    head, rows = S.header_and_rows(spark, str(tmp_path / "score.json"), "accuracy double, correct_count long, total_count long", "id string, error array<string>")
    assert head.first()["accuracy"] == 0.5 and [r["id"] for r in rows.collect()] == ["b", "d"]
    assert S.strict_lines(spark, str(tmp_path / "score.json"), "id string").count() == 3
    write(tmp_path / "bad.json", {"id": "a"}, "{oops")
    with pytest.raises(Exception, match="bad.json:2"):
        S.strict_lines(spark, str(tmp_path / "bad.json"), "id string").collect()
    assert S.read_jsonl(spark, str(tmp_path / "bad.json"), "id string").count() == 1


def test_unambiguous_files(spark, tmp_path):
    write(tmp_path / "x_simple_result.json", {})
    assert S.the_file(spark, str(tmp_path / "*simple*result.json")).endswith("x_simple_result.json")
    with pytest.raises(FileNotFoundError):
        S.the_file(spark, str(tmp_path / "*none*"))
    write(tmp_path / "y_simple_result.json", {})
    with pytest.raises(ValueError):
        S.the_file(spark, str(tmp_path / "*simple*result.json"))
    assert S.first_existing(spark, str(tmp_path / "zz"), str(tmp_path / "x*")).endswith("x_simple_result.json")


def test_iterations_and_playbooks(spark, tmp_path):
    for n in (2, 10):
        write(tmp_path / "it" / f"iteration_{n}.json", {"playbook_version_before": n, "playbook_after": {"version": n, "entries": [{"entry_id": "e", "tag": "t", "content": "c", "helpful": 1, "harmful": 0, "version": 1}]}})
    got = S.read_iterations(spark, str(tmp_path / "it"), "playbook_version_before int").orderBy("iteration").collect()
    assert [r["iteration"] for r in got] == [2, 10]
    assert {r["version"] for r in S.read_playbooks(spark, str(tmp_path / "it")).collect()} == {"2", "10"}
    write(tmp_path / "old.json", {"modules": []})
    with pytest.raises(Exception, match="stale playbook"):
        S.read_playbooks(spark, str(tmp_path / "old.json")).collect()


def test_bank(spark, tmp_path):
    write(tmp_path / "mcp_notes" / "gc3" / "a.json", {"task": {"task_id": "a"}})
    write(tmp_path / "mcp_notes" / "gc4" / "b.json", "{broken")
    got = S.read_bank(spark, str(tmp_path), "task struct<task_id:string>").collect()
    assert [(r["tool_family"], r["gc"], r["task"]["task_id"]) for r in got] == [("mcp_notes", 3, "a")]


def test_csv_prompts_and_sinks(spark, tmp_path):
    write(tmp_path / "c.csv", "coverage_score,x", "0.5,1", ",2", "0.9,3")
    assert [r[0] for r in S.read_column(spark, str(tmp_path / "c.csv"), "coverage_score").collect()] == [0.5, 0.9] and S.read_first_row(spark, str(tmp_path / "c.csv")).count() == 1
    write(tmp_path / "p.txt", "hello")
    got = {r["domain"]: r["prompt"].strip() for r in S.read_prompts(spark, {"a": str(tmp_path / "p.txt"), "b": str(tmp_path / "none.txt")}).collect()}
    assert got == {"a": "hello", "b": ""}
    df = spark.createDataFrame([("x", 1), ("y", 2)], "arm string, v int")
    S.write_by_arm(df, str(tmp_path / "arms"))
    S.write_by_arm(df.where("arm = 'x'").withColumn("v", F.lit(9)), str(tmp_path / "arms"))
    assert {(r["arm"], r["v"]) for r in spark.read.parquet(str(tmp_path / "arms")).collect()} == {("x", 9), ("y", 2)}
    S.write_jsonl(df, str(tmp_path / "j"))
    S.write_csv(df, str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.option("header", True).csv(str(tmp_path / "v")).count() == 2
    assert S.snapshot(df, str(tmp_path / "s")).count() == 2


def test_registry_rejects_duplicates(spark):
    tools = C.tools(spark)
    assert C.registered(tools, tools.limit(0)).count() == len(C.TOOLS)
    with pytest.raises(Exception, match="duplicate tool"):
        C.registered(tools, tools.limit(1)).collect()
    assert C.domains(spark).count() == 7


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    rows = [(i % 3, i, None if i % 5 == 0 else i % 2 == 0) for i in range(60)]
    source, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in range(2):
        write(source / f"{part}.json", *[{"task_id": k, "seq": s, "verdict": v} for k, s, v in rows[part * 30 : part * 30 + 30]])
        stream.run_available(stream.rolling_rates(stream.read_outcomes(spark, str(source)), 7), sink, checkpoint).awaitTermination()
    got = {(r["task_id"], r["seq"]): r["rolling_rate"] for r in spark.read.parquet(sink).collect()}
    batch = R.rolling_rate(spark.createDataFrame(rows, stream.OUTCOME), ["task_id"], ["seq"], width=7)
    assert got == {(r["task_id"], r["seq"]): r["rolling_rate"] for r in batch.collect()}


def test_report_follows_the_stream(spark, tmp_path):
    write(tmp_path / "in" / "0.json", {"task_id": 1, "seq": 1, "verdict": True}, {"task_id": 1, "seq": 2, "verdict": False})
    made = stream.keep_report(stream.read_outcomes(spark, str(tmp_path / "in")), lambda df: R.pass_rates(df, "task_id"), str(tmp_path / "r"), str(tmp_path / "ck"))
    made.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "r" / "report")).first()["pass_rate"] == 0.5

"""Loops that are killed and go on, and the layout of a bank."""

import json

import pytest
from pyspark.sql import functions as F

from gymlake.sources import files as S
from gymlake.streaming import iterations as I

UTILITY = [1.0, 3.0, 2.0, 3.5, 3.5, 1.0, 3.5, 3.4, 9.0]


def loop(spark, folder, calls, fail_at=None, most=20, utilities=UTILITY):
    def improve(df, i):
        calls.append(i)
        if i == fail_at:
            raise RuntimeError("killed")
        return df.union(spark.createDataFrame([(i,)], "v int"))

    def measure(df, i):
        if fail_at == -i and i:
            raise RuntimeError("killed")
        return utilities[i]

    return I.run(spark, folder, lambda: spark.createDataFrame([(0,)], "v int"), improve, measure, tolerance=0.2, patience=3, most=most)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


WANT = [
    (0, 1.0, True, None, False), (1, 3.0, True, None, False), (2, 2.0, False, 1, False), (3, 3.5, True, None, False),
    (4, 3.5, True, None, False), (5, 1.0, False, 3, False), (6, 3.5, True, None, True),
]


def test_history_rolls_back_and_stops(spark, tmp_path):
    calls: list[int] = []
    assert rows(loop(spark, str(tmp_path), calls)) == WANT
    assert {r[0] for r in I.current(spark, str(tmp_path)).collect()} == {0, 1, 3, 6}  # what was rolled back is not in it
    assert rows(loop(spark, str(tmp_path), calls)) == WANT and calls == [1, 2, 3, 4, 5, 6]  # nothing is done again


@pytest.mark.parametrize("fail_at", [3, -4])
def test_a_killed_loop_has_the_history_of_a_whole_one(spark, tmp_path, fail_at):
    calls: list[int] = []
    with pytest.raises(RuntimeError, match="killed"):
        loop(spark, str(tmp_path), calls, fail_at)
    assert rows(I.history(spark, str(tmp_path))) == WANT[: abs(fail_at)]
    assert rows(loop(spark, str(tmp_path), calls)) == WANT
    assert calls.count(abs(fail_at)) == 2 and all(calls.count(i) == 1 for i in range(1, 7) if i != abs(fail_at))
    assert {r[0] for r in I.current(spark, str(tmp_path)).collect()} == {0, 1, 3, 6}


def test_measures_that_are_missing_and_the_last_iteration(spark, tmp_path):
    got = rows(loop(spark, str(tmp_path), [], most=3, utilities=[None, 2.0, None, 1.9]))
    assert got == [(0, None, False, None, False), (1, 2.0, True, None, False), (2, None, False, 1, False), (3, 1.9, True, None, True)]
    assert I.history(spark, str(tmp_path / "none")).count() == 0 and I.complete(spark, str(tmp_path / "none")) == -1


def test_stalled():
    assert not I.stalled([1, 1, 1], 3) and I.stalled([1, 1, 1, 1], 3) and I.stalled([9, 1, 2, 9], 3) and not I.stalled([1, 1, 1, 2], 3)


def test_bank_reads_the_folders_that_are_asked_for(spark, tmp_path):
    root = str(tmp_path / "bank")
    tasks = [(f"t{i}", ("en", "d{e}[1]", None, "a b")[i % 4], 3 + i % 2) for i in range(40)]
    S.write_bank(spark.createDataFrame(tasks, "task_id string, tool_family string, gc int"), root)
    read = lambda **k: S.read_bank(spark, root, "task_id string", lines=True, **k)
    assert sorted(map(tuple, read().collect()), key=str) == sorted(tasks, key=str)
    one = read(families=["d{e}[1]"], gcs=[4])
    assert sorted(map(tuple, one.collect())) == sorted(t for t in tasks if t[1:] == ("d{e}[1]", 4))
    assert 0 < len(one.inputFiles()) < len(read().inputFiles()) and all("gc4" in f for f in one.inputFiles())
    assert read(families=[]).collect() == read(families=["xx"]).collect() == read(gcs=[9]).collect() == []
    S.write_bank(spark.createDataFrame([("new", "en", 3)], "task_id string, tool_family string, gc int"), root)
    assert [r[0] for r in read(families=["en"], gcs=[3]).collect()] == ["new"] and len(read(families=["a b"]).collect()) == 10


def test_bank_of_one_file_per_task_skips_corrupt_ones(spark, tmp_path):
    for name, text in (("notes/gc3/a", json.dumps({"task": {"task_id": "a"}}, indent=1)), ("notes/gc10/b", "{broken"), ("api/gc3/c", json.dumps({"task": {"task_id": "c"}}))):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"{name}.json").write_text(text)
    got = S.read_bank(spark, str(tmp_path), "task struct<task_id:string>", gcs=[3, 10]).select("task.task_id", "tool_family", "gc")
    assert sorted(map(tuple, got.collect())) == [("a", "notes", 3), ("c", "api", 3)] and F is not None

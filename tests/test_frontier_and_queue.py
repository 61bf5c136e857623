"""The streamed frontier against the batch one after each batch, and the queue when it is killed."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gymlake.streaming import frontier as front
from gymlake.streaming import queue

AXES = ("a", "b")
SCHEMA = "playbook string, version long, a double, b double"


def batch_frontier(rows):
    rows = [r for r in rows if None not in (r[1], r[2], r[3])]
    beats = lambda o, r: o[0] == r[0] and o[2] >= r[2] and o[3] >= r[3] and (o[2] > r[2] or o[3] > r[3])
    return {r for r in rows if not any(beats(o, r) for o in rows)}


def run(changes, tmp_path):
    changes.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()


def test_after_each_batch_it_is_the_batch_frontier(spark, tmp_path):
    rnd, rows = random.Random(4), []
    for batch in range(5):  # each run is a new query on the same state
        new = [(rnd.choice(("x", "y", None)), 100 * batch + i, rnd.randrange(12) / 4, rnd.choice((None, 0.0, 1.0, 2.5, 3.0))) for i in range(40)]
        new += [new[3], new[4], ("x", 900 + batch, 2.75, 3.0), ("x", 950 + batch, 2.75, 3.0)]  # repeated rows, and ties on every axis
        new += rows[:5]  # some that came before
        rows += new
        spark.createDataFrame(new, SCHEMA).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        changes = front.frontier_changes(stream, "playbook", "version", AXES)
        with front.keyed_state(spark):
            run(changes, tmp_path)
        log = spark.read.schema(changes.schema).parquet(str(tmp_path / "out"))
        got = [tuple(r) for r in front.frontier_of(log, "playbook", "version", AXES).collect()]
        assert len(got) == len(set(got)) and set(got) == batch_frontier(rows)
    told = [(r["playbook"], r["n"], r["change"]) for r in log.collect()]
    for key in ("x", "y", None):  # changes are numbered without gaps, and some are evictions
        assert sorted(n for k, n, _ in told if k == key) == list(range(1, 1 + sum(k == key for k, _, _ in told)))
    assert sum(c == "evict" for _, _, c in told) > 0


@pytest.mark.parametrize("seed", range(4))
def test_undominated_equals_comparing_all(seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 6, (80, 3)).astype(float)
    points[rng.random(80) < 0.1, 1] = np.nan
    against = rng.integers(0, 5, (5, 3)).astype(float)
    ok = ~np.isnan(points).any(axis=1)
    beats = lambda o, p: (o >= p).all() and (o > p).any()
    want = [bool(ok[i]) and not any(beats(o, p) for o in [*points[ok], *against]) for i, p in enumerate(points)]
    assert front.undominated(points, against).tolist() == want
    assert front.undominated(points[:0]).tolist() == []


GRID = [(t, a) for t in range(6) for a in ("base", "final")]
RESULT = "task_id long, arm string, reply string, attempt string"


def jobs_of(spark, folder, rows):
    spark.createDataFrame(rows, "task_id long, arm string, note string").coalesce(1).write.mode("append").json(str(folder))
    return spark.readStream.schema("task_id long, arm string, note string").option("maxFilesPerTrigger", 1).json(str(folder))


def test_a_killed_run_resumes_and_does_no_key_twice(spark, tmp_path):
    calls = []

    def do(df):
        keys = [(r["task_id"], r["arm"]) for r in df.select("task_id", "arm").collect()]
        if len(calls) == 1 and not broken:
            broken.append(True)
            raise RuntimeError("killed")
        calls.append(keys)
        return df.select("task_id", "arm", F.upper("arm").alias("reply"), F.lit(str(len(calls))).alias("attempt"))

    broken: list[bool] = []
    for part in range(3):
        rows = [(t, a, f"n{part}") for t, a in GRID[4 * part : 4 * part + 4] + GRID[:2]]  # two keys are asked for each time
        stream = jobs_of(spark, tmp_path / "in", rows + rows[:1])
    start = lambda: queue.work(stream, do, str(tmp_path / "out"), RESULT, "task_id", "arm", checkpoint=str(tmp_path / "ck"))
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    expected = spark.createDataFrame(GRID, "task_id long, arm string")
    finished = lambda: queue.done(spark, str(tmp_path / "out"), RESULT)
    assert 0 < queue.missing(expected, finished(), "task_id", "arm").count() < len(GRID)
    stages = []
    left = queue.run_until_complete(start, lambda: queue.missing(expected, finished(), "task_id", "arm"), stage=lambda: stages.append(finished().count()))
    done = [(r["task_id"], r["arm"]) for r in finished().collect()]
    assert left == 0 and sorted(done) == sorted(GRID) and stages == [len(GRID)]
    worked = [k for keys in calls for k in keys]
    assert sorted(worked) == sorted(GRID)


def test_a_batch_that_was_committed_is_not_done_again(spark, tmp_path):
    times = []

    def do(df):
        times.append(df.count())
        return df.select("task_id", "arm", F.lit("r").alias("reply"), F.lit("1").alias("attempt"))

    stream = jobs_of(spark, tmp_path / "in", [(1, "base", "n")])
    for checkpoint in ("a", "b"):  # the second has lost the note that batch 0 was done, as when killed just before it
        queue.work(stream, do, str(tmp_path / "out"), RESULT, "task_id", "arm", checkpoint=str(tmp_path / checkpoint)).awaitTermination()
    assert times == [1] and queue.done(spark, str(tmp_path / "out"), RESULT).count() == 1


def test_a_grid_that_cannot_be_completed_ends(spark, tmp_path):
    stream = jobs_of(spark, tmp_path / "in", [(1, "base", "n"), (None, "base", "n"), (None, "base", "m")])
    do = lambda df: df.where("task_id is null").select("task_id", "arm", "note", F.lit("1").alias("attempt"))
    start = lambda: queue.work(stream, do, str(tmp_path / "out"), "task_id long, arm string, note string, attempt string", "task_id", "arm", checkpoint=str(tmp_path / "ck"))
    finished = lambda: queue.done(spark, str(tmp_path / "out"), "task_id long, arm string, note string, attempt string")
    expected = spark.createDataFrame([(1, "base"), (None, "base")], "task_id long, arm string")
    assert queue.run_until_complete(start, lambda: queue.missing(expected, finished(), "task_id", "arm")) == 1
    assert [tuple(r)[:3] for r in finished().collect()] == [(None, "base", "m")]
    assert queue.missing(expected, queue.done(spark, str(tmp_path / "none"), RESULT), "task_id", "arm").count() == 2

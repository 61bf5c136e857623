"""A loop of improvements over persisted iterations: it goes on after the last complete one, rolls back to the best, and stops by rule.

Each iteration has a folder: its candidate, and a record of one row that is written
last. An iteration without a complete record has not happened; its folder is
written anew. So a run that is killed and started again has the history of one
that was not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gymlake.streaming.queue import exists

RECORD = "iteration int, utility double, kept boolean, restored int, stopped boolean"


def stalled(utilities: list[float], patience: int) -> bool:
    """None of the last `patience` utilities beats the one just before them."""
    return len(utilities) > patience and max(utilities[-patience:]) <= utilities[-patience - 1]


def history(spark: SparkSession, folder: str) -> DataFrame:
    """A row per complete iteration; restored: the iteration whose candidate the next one starts from, where this one fell behind."""
    done = complete(spark, folder)
    if done < 0:
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).json([f"{folder}/{i}/record" for i in range(done + 1)])


def complete(spark: SparkSession, folder: str) -> int:
    """The number of the last complete iteration; -1 if there is none."""
    n = 0
    while exists(spark, f"{folder}/{n}/record/_SUCCESS"):
        n += 1
    return n - 1


def run(
    spark: SparkSession,
    folder: str,
    start: Callable[[], DataFrame],
    improve: Callable[[DataFrame, int], DataFrame],
    measure: Callable[[DataFrame, int], float | None],
    tolerance: float = 0.0,
    patience: int = 3,
    most: int = 20,
) -> DataFrame:
    """The history of: start, then improve what was kept last, measure it, keep it unless it is more than `tolerance` below the best.

    Ends when `patience` measured candidates in a row have not beaten the one before them, or after `most` improvements. A candidate
    whose measure is null was not measured: it is not kept and counts for no rule. Among equal ones the first is the best.
    """
    records = {r["iteration"]: r for r in history(spark, folder).collect()}  # one row per iteration
    schema = None
    for i in range(most + 1):
        if i in records:
            if records[i]["stopped"]:
                break
            continue
        measured = [(records[k]["utility"], -k) for k in range(i) if records[k]["utility"] is not None]
        if i == 0:
            candidate = start()
        else:
            last = records[i - 1]
            base = last["restored"] if last["restored"] is not None else i - 1
            read = spark.read.schema(schema) if schema else spark.read
            candidate = improve(read.parquet(f"{folder}/{base}/candidate"), i)
        candidate.write.mode("overwrite").parquet(f"{folder}/{i}/candidate")
        schema = candidate.schema
        utility = measure(spark.read.schema(schema).parquet(f"{folder}/{i}/candidate"), i)
        best = max(measured, default=None)
        kept = utility is not None and (best is None or utility + tolerance >= best[0])
        restored = None if kept or best is None else -best[1]
        known = [records[k]["utility"] for k in range(i) if records[k]["utility"] is not None] + ([utility] if utility is not None else [])
        records[i] = {"iteration": i, "utility": utility, "kept": kept, "restored": restored, "stopped": i == most or stalled(known, patience)}
        row = spark.createDataFrame([tuple(records[i].values())], RECORD)
        row.coalesce(1).write.mode("overwrite").json(f"{folder}/{i}/record")
        if records[i]["stopped"]:
            break
    return history(spark, folder)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The candidate that the history has settled on: the last one kept, or what it was rolled back to."""
    last = max(history(spark, folder).collect(), key=lambda r: r["iteration"])
    return spark.read.parquet(f"{folder}/{last['restored'] if last['restored'] is not None else last['iteration']}/candidate")

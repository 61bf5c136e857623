"""A queue of jobs over a stream: each key is done once, whatever is killed, and the run ends when the expected grid is complete.

Results of a batch stand in a folder of their own, `rows/_batch=N`, which Spark
commits as a whole. A batch that runs again finds its folder committed and does
nothing, or replaces what was never committed. Keys that an earlier batch has done
are left out by an anti-join, and of keys that repeat within a batch one is done.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def done(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """Rows of all committed batches, with _batch; none where nothing has been done."""
    if not exists(spark, f"{target}/rows"):
        return spark.createDataFrame([], f"{schema}, _batch long")
    return spark.read.schema(f"{schema}, _batch long").parquet(f"{target}/rows")


def pending(jobs: DataFrame, finished: DataFrame, *keys: str) -> DataFrame:
    """Jobs without a result; null keys match null keys. Of jobs with equal keys all stay."""
    same = finished.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return jobs.join(same, on, "left_anti")


def one_each(jobs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One job of each key, the least by its other columns."""
    rest = [c for c in jobs.columns if c not in keys]
    if not rest:
        return jobs.distinct()
    return jobs.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_one")).select(*keys, "_one.*").select(*jobs.columns)


def work(jobs: DataFrame, do: Callable[[DataFrame], DataFrame], target: str, schema: str, *keys: str, checkpoint: str) -> StreamingQuery:
    """Do what has arrived and is not done: do(jobs) returns rows of `schema`, keys included, one for each job that succeeds.

    Keys that fail leave no row and are done again when they are put in the queue again.
    """

    def batch(df: DataFrame, number: int) -> None:
        folder = f"{target}/rows/_batch={number}"
        if exists(df.sparkSession, f"{folder}/_SUCCESS"):
            return
        before = done(df.sparkSession, target, schema).where(F.col("_batch") < number)
        do(one_each(pending(df, before, *keys), keys)).write.mode("overwrite").parquet(folder)

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def missing(expected: DataFrame, finished: DataFrame, *keys: str) -> DataFrame:
    """Cells of the expected grid that have no result."""
    return pending(expected.select(*keys).distinct(), finished, *keys)


def run_until_complete(start: Callable[[], StreamingQuery], left: Callable[[], DataFrame], stage: Callable[[], None] = lambda: None, rounds: int = 100, wait_s: float = 0.0) -> int:
    """Run the queue again and again until nothing is left; the number of cells still missing at the end, 0 if complete.

    stage runs after each round (say, a snapshot of the table so far). Ends early when a round has added nothing, for then waiting
    alone can help, after `rounds` at most.
    """
    last = None
    for _ in range(rounds):
        start().awaitTermination()
        stage()
        now = left().count()
        if now == 0:
            return 0
        if now == last and not wait_s:
            return now
        last = now
        time.sleep(wait_s)
    return last or 0

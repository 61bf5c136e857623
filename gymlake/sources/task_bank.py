"""A stored task bank: partitions by family, graph size and bucket of the task's id; verdicts are merged by copy on write.

A merge reads the ids of the buckets that it has news for, rewrites the partitions
that hold them, and leaves every other file as it is. Spark commits the new
partitions as a whole; a merge that is killed before has changed nothing, and one
that runs again changes nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = ("tool_family", "gc", "bucket")
BUCKETS = 16


def bucket(task_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(task_id), F.lit(buckets)).cast("int")


def save(tasks: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Store tasks (task_id, tool_family, gc and whatever else), replacing what is at root."""
    placed = tasks.withColumn("bucket", bucket(F.col("task_id"), buckets))
    placed.repartition(*PLACE).write.mode("overwrite").partitionBy(*PLACE).parquet(root)


def load(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def last_news(updates: DataFrame, columns: tuple[str, ...], seq: str = "report_seq") -> DataFrame:
    """task_id and _new (a struct of columns) of the last update of each task; of updates with the same seq the greatest. Without task_id none."""
    new = F.struct(*columns)
    return updates.where(F.col("task_id").isNotNull()).groupBy("task_id").agg(F.max_by(new, F.struct(F.col(seq).alias("seq"), new.alias("new"))).alias("_new"))


def merge_verdicts(spark: SparkSession, root: str, updates: DataFrame, columns: tuple[str, ...], report: str, seq: str = "report_seq", buckets: int = BUCKETS) -> DataFrame:
    """Set `columns` of the tasks that updates (task_id, seq, columns) speak of; (task_id, outcome), kept at `report`: updated or not_found.

    A null in an update is written like any value; tasks that are stored twice are both updated. No updates change no file.
    """
    news = last_news(updates, columns, seq).withColumn("bucket", bucket(F.col("task_id"), buckets))
    ids = load(spark, root).select("task_id", *PLACE, F.lit(True).alias("_there"))
    found = news.select("task_id", "bucket").join(ids, ["task_id", "bucket"], "left").select("task_id", *PLACE, F.when(F.col("_there"), "updated").otherwise("not_found").alias("outcome"))
    found.write.mode("overwrite").parquet(f"{report}/found")
    found = spark.read.parquet(f"{report}/found")
    touched = found.where("outcome = 'updated'").select(*PLACE).distinct().collect()  # a row per partition of the layout
    if touched:
        here: dict[tuple, list[int]] = {}
        for r in touched:
            here.setdefault((r["tool_family"], r["gc"]), []).append(r["bucket"])
        inside = F.lit(False)
        for (family, gc), own in here.items():
            inside = inside | (F.col("tool_family").eqNullSafe(F.lit(family)) & F.col("gc").eqNullSafe(F.lit(gc)) & F.col("bucket").isin(*own))
        old = load(spark, root).where(inside)
        fresh = old.join(news.drop("bucket"), "task_id", "left").select(*[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])
        fresh.repartition(*PLACE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(root)
    return found.select("task_id", "outcome").distinct()

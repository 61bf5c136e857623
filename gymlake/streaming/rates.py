"""Incremental rolling rates and incremental screening over file streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OUTCOME = "task_id long, seq long, verdict boolean"
ROLLED = "task_id long, seq long, rolling_rate double"


class RollingRate(StatefulProcessor):
    """Keeps the last `width` outcomes of each key in a list state; one row out per outcome in."""

    def __init__(self, width: int = 20):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "verdict boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        window = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        out = []
        batch = pd.concat(list(rows)).sort_values("seq")
        for seq, verdict in zip(batch["seq"], batch["verdict"], strict=True):
            window = [*window, None if pd.isna(verdict) else bool(verdict)][-self.width :]
            judged = [v for v in window if v is not None]
            out.append((key[0], int(seq), sum(judged) / len(judged) if judged else None))
        self.recent.put([(v,) for v in window])
        yield pd.DataFrame(out, columns=["task_id", "seq", "rolling_rate"])

    def close(self) -> None:
        pass


def rolling_rates(outcomes: DataFrame, width: int = 20) -> DataFrame:
    """Streaming counterpart of the windowed rolling rate; outcomes of a key arrive in order of seq."""
    return outcomes.groupBy("task_id").transformWithStateInPandas(RollingRate(width), outputStructType=ROLLED, outputMode="Append", timeMode="None")


def read_outcomes(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(OUTCOME).option("maxFilesPerTrigger", files_per_batch).json(folder)


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived, once, from where the last run stopped."""
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def keep_report(stream: DataFrame, report: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "task_id") -> StreamingQuery:
    """Append new rows and rewrite a small report of all of them after each batch; a batch that runs twice leaves one copy."""

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(f"{target}/rows")
        report(df.sparkSession.read.parquet(f"{target}/rows").drop("_batch")).write.mode("overwrite").parquet(f"{target}/report")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

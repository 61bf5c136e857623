"""Shared plumbing: the shared scratch folder, lineage cuts, bounded Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (a single-process session, as in tests) a temporary folder is taken.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/gymlake-shared"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return base


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint(), with the shared folder set where the session has none."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: The folders made inside the innermost `owned` block; none outside of one.
_made: ContextVar[list[Scratch] | None] = ContextVar("_made", default=None)


class Scratch:
    """Intermediate tables as Parquet in the shared folder; they survive lost executors.

    They are their maker's: nothing else drops them, but a caller who makes them inside `owned`.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/gymlake-{uuid.uuid4().hex}"
        self.n = 0
        if (made := _made.get()) is not None:
            made.append(self)

    def folder(self) -> str:
        """A path of its own for a caller that writes there itself."""
        self.n += 1
        return f"{self.base}/{self.n}"

    def write(self, df: DataFrame) -> tuple[str, DataFrame]:
        path = self.folder()
        df.write.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame) -> DataFrame:
        return self.write(df)[1]

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def owned() -> Iterator[None]:
    """Drop, on leaving, the intermediate tables of operators that were called inside: for a caller who writes their results before."""
    made: list[Scratch] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for scratch in made:
            scratch.drop(scratch.base)


def trim() -> None:
    """Give memory that Python has freed back to the system, so that it does not add up over the stages of a process."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back this way
        pass


def tidy(run):
    """A function of Arrow batches that gives its memory back when it ends; workers are reused by later stages."""

    def and_trim(batches):
        yield from run(batches)
        trim()

    return and_trim


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner delete the shuffle files of finished phases now."""
    gc.collect()
    trim()
    spark._jvm.System.gc()


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


#: Rows and bytes of an Arrow batch, at most; a single longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Keep Arrow batches small in rows and bytes, so that long texts do not add up in a Python worker.

    Spark takes the limits from the session when it plans a query, so they are set there. They are only ever lowered,
    and change no result.
    """
    for name, limit in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(key).lower()).groups()
        now = int(number) << {"k": 10, "m": 20, "g": 30}.get(unit[:1], 0)
        if now <= 0 or now > limit:
            spark.conf.set(key, str(limit))

"""A folder for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below `spark.checkpoint.dir`, which driver and executors share; below a temporary one only where that is unset, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    return f"{base or 'file://' + tempfile.gettempdir() + '/gymlake-shared'}/files-{uuid.uuid4().hex}"

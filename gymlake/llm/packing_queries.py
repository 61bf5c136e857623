from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gymlake.llm.common import read
from gymlake.llm.packing import pack


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


QUERIES = {"op6_pack_sequences": op6_pack_sequences}
ORACLES: dict[str, str] = {}

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gymlake.llm.common import read
from gymlake.llm.quality_model import classify, train


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classify(docs, train(docs, read(spark, sf_dir, "labels")))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
ORACLES: dict[str, str] = {}

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gymlake.llm.common import read
from gymlake.llm.toxicity import classify, train


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classify(docs, train(docs, read(spark, sf_dir, "labels")))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}

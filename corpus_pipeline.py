"""The corpus pipeline: documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents. `run` writes each stage's rows as Parquet in the
shared folder and reads them again for the next one; what a stage no longer needs
is deleted. Every stage takes nulls in any column, empty and very long texts,
repeated rows, extra columns and empty tables (which give empty tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gymlake.llm import mixing, ngram_join, packing, quality_model, substring
from gymlake.llm.common import Scratch, owned, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier scores under its threshold; null and empty texts have the score of no words."""
    return quality_model.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least doc_id of each group of near copies; rows without doc_id stay, rows that repeat one stay together."""
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the 50-word windows that a smaller document has too; null texts stay null, rows without doc_id stay whole."""
    return substring.apply_removal(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or shorten documents to what the mix takes of them; of null, empty and blank texts it takes nothing, so they go."""
    return mixing.apply_mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack tokens into sequences; a null or empty text is its end token alone."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: A trained classifier and a tokenizer have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = read(spark, sf_dir, "documents"), Scratch(spark), None
    for _, stage in STAGES:
        with owned():
            path, docs = scratch.write(stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = path
    return docs

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gymlake.llm.common import bounded_batches, read, tidy
from gymlake.llm.html_cut import SAMPLE_CHARS, SAMPLE_PAGES, Model, fit, main_text


def learn(pages: DataFrame, html: str = "html", key: str = "page_id", rows: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> Model:
    """A model from at most `rows` pages of at most `chars` characters, drawn by the digest of their key."""
    drawn = pages.select(F.col(key).alias("_key")).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64("_key"), "_key").limit(rows)
    found = pages.select(F.col(key).alias("_key"), F.col(html).alias("_html")).where(F.length("_html") <= chars).join(F.broadcast(drawn), "_key")  # drawn: `rows` keys
    return fit([r["_html"] for r in found.orderBy(F.xxhash64("_key"), "_key", F.xxhash64("_html")).limit(rows).collect()])


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep, text, n_chars of each row, with a model learned from these pages (by the first column of keep). Null html counts as empty; repeated rows are extracted each; other columns are not read."""
    bounded_batches(pages.sparkSession)
    model = learn(pages, html, keep[0])
    inner = pages.select(*keep, F.col(html).alias("_html"))
    fields = ", ".join(f"{c} {inner.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), model) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, "text", "n_chars"])

    return inner.mapInArrow(tidy(run), f"{fields}, text string, n_chars long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op3_html_extract": op3_html_extract}
ORACLES: dict[str, str] = {}

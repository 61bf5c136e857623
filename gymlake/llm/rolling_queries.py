from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gymlake.llm.common import read
from gymlake.llm.rolling import event_time, with_windows
from gymlake.llm.sql import CRC_TABLE, crc_of

WIDTHS = (1800, 86400)


def op12_rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of half an hour and a day before each document, over all documents of its source."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), event_time(F.col("doc_id")).alias("event_s"), F.col("lang").cast("string").alias("lang"), F.length("text").cast("long").alias("length"))
    return with_windows(rows, ["doc_id"], WIDTHS)


OP12_SQL = f"""
with {CRC_TABLE},
d as (select doc_id, source, lang, length(text) l, (60 * floor((doc_id + {crc_of("doc_id::varchar")} % 1000) / 6))::bigint event_s from documents, crc_table),
w as ({" union all ".join(f"select doc_id, {w} window_s, event_s, count(*) over x n_events, sum(l) over x sum_chars, count(distinct lang) over x n_langs, list_sort(list(l) filter (l is not null) over x) o from d window x as (partition by source order by event_s range between {w} preceding and 1 preceding)" for w in WIDTHS)})
select doc_id, window_s::bigint window_s, event_s, n_events, coalesce(sum_chars, 0)::bigint sum_chars, n_langs, o[(len(o) + 1) // 2]::bigint median_chars, o[(99 * len(o) + 99) // 100]::bigint high_chars from w"""

QUERIES = {"op12_rolling_features": op12_rolling_features}
ORACLES = {"op12_rolling_features": OP12_SQL}

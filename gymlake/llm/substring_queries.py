from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gymlake.llm.common import read
from gymlake.llm.substring import remove_repeats


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


# DuckDB: windows as joined word sequences, the smallest document of each, and a sweep over covered words.
OP7_SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
win as (
  select doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) h
  from w, unnest(generate_series(1, len(ws) - 49)) t(i)),
least as (select h, min(doc_id) d from win group by h),
hit as (select win.doc_id, i from win join least using (h) where win.doc_id > least.d),
gone as (select distinct doc_id, i + k as p from hit, unnest(generate_series(0, 49)) t(k)),
gs as (select doc_id, list(p) ps, count(*) n from gone group by doc_id)
select w.doc_id, cast(len(ws) as bigint) n_words, coalesce(gs.n, 0) n_removed,
  sha256(array_to_string(case when gs.n is null then ws else list_filter(ws, lambda x, j: not list_contains(ps, j)) end, ' ')) kept_sha256
from w left join gs using (doc_id)"""

QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLES = {"op7_substring_dedup": OP7_SQL}

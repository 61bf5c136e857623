from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gymlake.llm.common import read
from gymlake.llm.ngram_join import similar_groups


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(read(spark, sf_dir, "documents"))


# DuckDB: shared shingles counted pair by pair, then the closure of the links.
OP5_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws
  from documents),
s as (
  select distinct doc_id, md5(array_to_string(list_slice(ws, i, i + 4), ' ')) h
  from w, unnest(generate_series(1, greatest(len(ws) - 4, 1))) t(i) where len(ws) > 0),
n as (select doc_id, count(*) n from s group by doc_id),
p as (
  select a.doc_id x, b.doc_id y, count(*) k from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
link as (
  select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 80 * (a.n + b.n - k)),
both_ways as (select x, y from link union select y, x from link),
reach as (
  select doc_id x, doc_id y from documents
  union
  select reach.x, both_ways.y from reach join both_ways on reach.y = both_ways.x)
select d.doc_id, coalesce(n.n, 0) n_shingles, r.c component_id
from documents d left join n using (doc_id) join (select x, min(y) c from reach group by x) r on r.x = d.doc_id"""

QUERIES = {"op5_ngram_jaccard_join": op5_ngram_jaccard_join}
ORACLES = {"op5_ngram_jaccard_join": OP5_SQL}

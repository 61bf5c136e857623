from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gymlake.llm.chat import CLOSE, OPEN, render
from gymlake.llm.common import read


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(read(spark, sf_dir, "conversations"))


OP9_SQL = f"""
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
p as (
  select conv_id, row_number() over w place, string_agg(hex(role) || ':' || hex(text), '|') over w prefix,
    string_agg('{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10), '') over w rendered, count(*) over (partition by conv_id) n
  from t window w as (partition by conv_id order by turn, role, text rows unbounded preceding)),
whole as (select min(conv_id) conv_id, count(*) n_equal, prefix, any_value(n) n_turns from p where place = n group by prefix)
select whole.conv_id, n_turns, n_equal, length(p.rendered) n_chars, p.rendered
from whole join p on p.conv_id = whole.conv_id and p.place = p.n
where whole.prefix not in (select prefix from p where place < n)"""

QUERIES = {"op9_chat_format": op9_chat_format}
ORACLES = {"op9_chat_format": OP9_SQL}

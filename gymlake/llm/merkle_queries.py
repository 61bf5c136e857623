from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gymlake.llm.common import Scratch, read
from gymlake.llm.merkle import manifest
from gymlake.llm.sql import CRC_TABLE, crc_of


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, checked with texts that lose their line ends where the digest of doc_id is even; nulls stay."""
    docs = read(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest(docs, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))), Scratch(spark))


def _value(c: str) -> str:
    return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"


def _forest(name: str, base: str) -> str:
    """Nodes by level, and each with its siblings before and after it."""
    return f"""
{name} as ({base}
  union all select source, lvl + 1, pos // 3, sha256(string_agg(h, '' order by pos)), (size + 2) // 3 from {name} where size > 1 group by source, lvl, pos // 3, size),
{name}_sides as (
  select a.source, a.lvl, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (where b.pos < a.pos), '') l, coalesce(string_agg(b.h, '' order by b.pos) filter (where b.pos > a.pos), '') r
  from {name} a left join {name} b on a.source is not distinct from b.source and a.lvl = b.lvl and a.pos // 3 = b.pos // 3 and a.pos <> b.pos
  where a.size > 1 group by a.source, a.lvl, a.pos)"""


OP13_SQL = f"""
with recursive {CRC_TABLE},
d as (
  select doc_id, source, row_number() over () id, sha256(head || {_value("text")}) leaf,
    sha256(head || case when even then {_value("replace(text, chr(10), '')")} else {_value("text")} end) changed
  from (select *, {_value("doc_id")} || {_value("source")} || {_value("lang")} || {_value("n_chars")} head, {crc_of("doc_id::varchar")} % 2 = 0 even from documents, crc_table)),
leaf as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by source) size from d),
{_forest("t", "select source, 0 lvl, pos, leaf h, size from leaf")},
sub as (select source, h subroot, row_number() over (order by source nulls first) - 1 place, count(*) over () n from t where size = 1),
{_forest("u", "select null::varchar source, 0 lvl, place pos, subroot h, n size from sub")},
way as (
  select leaf.id, s.lvl, s.l, s.r from leaf join t_sides s on leaf.source is not distinct from s.source and s.pos = leaf.pos // (3 ** s.lvl)::bigint
  union all
  select leaf.id, 1000 + s.lvl, s.l, s.r from leaf join sub on leaf.source is not distinct from sub.source join u_sides s on s.pos = sub.place // (3 ** s.lvl)::bigint),
steps as (select *, row_number() over (partition by id order by lvl) step from way),
fold as (
  select id, 0 step, changed h from leaf
  union all select fold.id, fold.step + 1, sha256(s.l || fold.h || s.r) from fold join steps s on fold.id = s.id and s.step = fold.step + 1),
proof as (select id, string_agg(l || r, '' order by step) p from steps group by id),
ends as (select id, arg_max(h, step) folded_root from fold group by id)
select doc_id, leaf, subroot, root, sha256(coalesce(p, '')) proof_sha256, folded_root, folded_root = root verified
from leaf join sub on leaf.source is not distinct from sub.source join ends using (id) left join proof using (id), (select h root from u where size = 1)"""

QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLES = {"op13_merkle_manifest": OP13_SQL}

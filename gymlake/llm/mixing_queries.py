from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gymlake.llm.common import read
from gymlake.llm.mixing import mix


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# DuckDB: targets by the level at which the sum is met, seats by highest quotients, and the same seeded layout.
OP8_SQL = r"""
with d as (
  select doc_id, cast(source as varchar) source, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as bigint) size,
    md5('7|' || coalesce(cast(doc_id as varchar), 'null') || '|' || md5(coalesce(text, ''))) o
  from documents),
whole as (select sum(size) total, cast(round_even(sum(size) / 16.0, 0) as bigint) seats, cast(greatest(1, ceil(count(*) / 1000.0)) as bigint) n_shards from d),
s as (select source, sum(size) size, (row_number() over (order by source is null, encode(source)) - 1) % 3 + 1 weight, row_number() over (order by source is null, encode(source)) place from d group by source),
r as (select *, 3.0 * size / weight ratio, sum(3.0 * size) over w capped, sum(weight) over () - sum(weight) over w free from s window w as (order by 3.0 * size / weight, place rows unbounded preceding)),
levels as (  -- with the sources up to this one at three times their size, the level of the others
  select (total - capped) / free as level, lead(ratio) over (order by ratio, place) next_ratio, ratio from r, whole where free > 0
  union all select total / (select sum(weight) from s), (select min(ratio) from r), 0 from whole),
level as (select min(level) level from levels where level <= coalesce(next_ratio, level) and level >= ratio),
t as (select s.*, least(3.0 * size, coalesce(level, 1e300) * weight) target from s left join level on true),
seat as (select place, row_number() over (order by target / (2 * a + 1) desc, place) n from t, whole, unnest(generate_series(0, seats)) x(a) where target > 0),
q as (select t.*, least((select count(*) from seat, whole where seat.place = t.place and n <= seats), cast(floor(3 * size / 16) as bigint)) quota from t),
laid as (
  select d.*, ('0x' || left(o, 8))::bigint % n_shards shard from d, whole),
sh as (select source, shard, sum(size) size from laid group by all),
sseat as (
  select sh.source, shard, row_number() over (partition by sh.source order by sh.size / (2.0 * a + 1) desc, shard) n, quota
  from sh join q on sh.source is not distinct from q.source, unnest(generate_series(0, quota)) x(a) where sh.size > 0),
squota as (select source, shard, count(*) quota from sseat where n <= quota group by all),
p as (
  select doc_id, laid.size, laid.source, laid.shard, sh.size shard_size, q.size source_size, target, coalesce(squota.quota, 0) * 16 wanted, greatest(sh.size, 1) length,
    sum(laid.size) over (partition by laid.source, laid.shard order by o, doc_id, laid.size rows unbounded preceding) stop
  from laid join sh on laid.source is not distinct from sh.source and laid.shard = sh.shard join q on laid.source is not distinct from q.source
    left join squota on laid.source is not distinct from squota.source and laid.shard = squota.shard),
b as (
  select *, wanted // length passes, wanted % length rest, stop - size start,
    (('0x' || left(md5('9|' || coalesce(source, 'null') || '|' || shard), 8))::bigint % cast(ceil(length / 16.0) as bigint)) * 16 "begin"
  from p)
select doc_id, size, cast(source_size as bigint) source_size, target, cast(passes * size + greatest(0, least(stop, least("begin" + rest, length)) - greatest(start, "begin")) + greatest(0, least(stop, "begin" + rest - length) - start) as bigint) taken
from b"""

QUERIES = {"op8_mix_sources": op8_mix_sources}
ORACLES = {"op8_mix_sources": OP8_SQL}

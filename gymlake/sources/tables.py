"""Scans of the star-schema tables and the fact views derived from them.

Every view is a narrow projection over one Parquet scan, so column pruning and
filter push-down reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per judged sample: domain, five 0-5 dimensions (0 = invalid), failed flag."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("sample_id"),
        c("l_linenumber").alias("turn_idx"),
        (c("l_partkey") % 7).cast("int").alias("domain_no"),
        F.concat(F.lit("domain"), (c("l_partkey") % 7).cast("string")).alias("domain"),
        (F.floor("l_quantity").cast("int") % 6).alias("format"),
        (c("l_partkey") % 6).cast("int").alias("factuality"),
        (c("l_suppkey") % 6).cast("int").alias("consistency"),
        (c("l_linenumber") % 6).cast("int").alias("realism"),
        (c("l_orderkey") % 6).cast("int").alias("quality"),
        F.when(c("l_returnflag") == "A", 1.0).otherwise(0.0).cast("double").alias("failed"),
    )


DIMENSIONS = ("format", "factuality", "consistency", "realism", "quality")

JUDGED_SQL = """judged as (
  select l_orderkey sample_id, l_linenumber turn_idx, cast(l_partkey % 7 as int) domain_no,
    'domain' || cast(l_partkey % 7 as varchar) as domain,
    cast(floor(l_quantity) as int) % 6 as format, cast(l_partkey % 6 as int) factuality, cast(l_suppkey % 6 as int) consistency,
    l_linenumber % 6 realism, cast(l_orderkey % 6 as int) quality,
    cast(case when l_returnflag = 'A' then 1 else 0 end as double) failed
  from lineitem)"""


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per rollout: unit (task), arm, rep, verdict (null = never judged), steps."""
    c = F.col
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        c("event_id"), c("ts"), c("user_id").alias("task_id"),
        F.when(c("event_id") % 2 == 0, "baseline").otherwise("final").alias("arm"),
        (c("event_id") % 5).cast("int").alias("rep"),
        F.when(c("event_type") == "error", None).otherwise(c("event_type").isin("purchase", "signup")).alias("verdict"),
        c("event_type"), (k % 12).cast("int").alias("n_steps"), k.alias("k"), c("value"),
    )


ROLLOUTS_SQL = """rollouts as (
  select event_id, ts, user_id task_id, case when event_id % 2 = 0 then 'baseline' else 'final' end arm,
    cast(event_id % 5 as int) rep,
    case when event_type = 'error' then null else event_type in ('purchase', 'signup') end verdict,
    event_type, cast(props->>'$.k' as int) % 12 n_steps, cast(props->>'$.k' as int) k, value
  from events)"""


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task bank: one row per task with its measured rate, screening agent and audit."""
    c = F.col
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    return (
        table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left").select(
            c("doc_id").alias("task_id"), c("lang").alias("tool_family"),
            (3 + c("doc_id") % 2).cast("int").alias("gc"),
            F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("eval")), (c("doc_id") % 3 + 1).cast("int")).alias("split"),
            F.when(c("doc_id") % 7 != 0, (c("doc_id") % 6) / F.lit(5.0).cast("double")).alias("baseline_pass_rate"),
            c("source").alias("screened_by"), c("n_chars").alias("created_at"),
            F.coalesce(c("t") == 1, F.lit(False)).alias("unpassable"),
            F.coalesce(c("q") == 0, F.lit(False)).alias("too_weak"),
            c("q").isNotNull().alias("audited"),
        )
    )


BANK_SQL = """bank as (
  select d.doc_id task_id, d.lang tool_family, cast(3 + d.doc_id % 2 as int) gc,
    case d.doc_id % 3 when 0 then 'train' when 1 then 'val' else 'eval' end split,
    case when d.doc_id % 7 <> 0 then (d.doc_id % 6) / cast(5 as double) end baseline_pass_rate,
    d.source screened_by, d.n_chars created_at,
    coalesce(l.t = 1, false) unpassable, coalesce(l.q = 0, false) too_weak, l.q is not null audited
  from documents d left join (select doc_id, max(quality) q, max(toxic) t from labels group by doc_id) l using (doc_id))"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playbook entries: ordered, tagged rules with credit counts."""
    c = F.col
    return table(spark, sf_dir, "documents").select(
        (c("doc_id") % 10).cast("int").alias("playbook_id"), c("doc_id").alias("pos"), c("doc_id").alias("entry_id"),
        c("source").alias("tag"), c("text").alias("content"),
        (c("doc_id") % 5).cast("int").alias("helpful"), (c("doc_id") % 3).cast("int").alias("harmful"),
        (c("doc_id") % 4).cast("int").alias("entry_version"),
    )


ENTRIES_SQL = """entries as (
  select cast(doc_id % 10 as int) playbook_id, doc_id pos, doc_id entry_id, source tag, text content,
    cast(doc_id % 5 as int) helpful, cast(doc_id % 3 as int) harmful, cast(doc_id % 4 as int) entry_version
  from documents)"""

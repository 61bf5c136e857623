"""Look-ups, summaries and reports over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gymlake.functions.text import percent
from gymlake.operators import lookups as L
from gymlake.operators.playbook import change_count
from gymlake.operators.rates import pass_rates
from gymlake.plans.scores import DOMAIN_SCORES_SQL, domain_scores
from gymlake.sources import files as S
from gymlake.sources.scratch import scratch_folder
from gymlake.sources.tables import DIMENSIONS, ENTRIES_SQL, ROLLOUTS_SQL, entries, rollouts, table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(f"""with {ENTRIES_SQL}, w as (select cast(user_id % 10 as int) playbook_id, user_id * 3 entry_id, count(*) n_asked from events group by 1, 2)
select w.playbook_id, w.entry_id, n_asked, e.tag, e.helpful, e.entry_id is not null found from w left join entries e on w.playbook_id = e.playbook_id and w.entry_id = e.entry_id""")
def entries_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that users ask their playbook for, by id."""
    asked = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).cast("int").alias("playbook_id"), (F.col("user_id") * 3).alias("entry_id")).agg(F.count("*").alias("n_asked"))
    return L.entries_by_id(entries(spark, sf_dir), asked).select("playbook_id", "entry_id", "n_asked", "entry.tag", "entry.helpful", F.col("entry").isNotNull().alias("found"))


@query(f"with {ENTRIES_SQL} select playbook_id, replace(tag, '_', '-') tag, entry_id from entries where tag in ('src1', 'src2') and playbook_id < 5 or tag = 'src3' and playbook_id = 7")
def entries_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of the tags that a playbook is asked for, however they are spelt."""
    asked = spark.range(5).select(F.col("id").cast("int").alias("playbook_id"), F.explode(F.array(F.lit(" SRC1 "), F.lit("--Src2!"))).alias("tag"))
    asked = asked.union(spark.range(1).select(F.lit(7).alias("playbook_id"), F.lit("src3").alias("tag")))
    return L.entries_by_tag(entries(spark, sf_dir), asked).select("playbook_id", "tag", "entry_id")


@query(r"""with s as (select conv_id, turn, case role when 'assistant' then 'reply' when 'user' then 'ask' end tool, length(coalesce(text, ''))::varchar arg from conversations),
n as (select *, row_number() over (partition by conv_id, tool is not null order by turn) step from s)
select conv_id, count(tool) n_calls, string_agg(step || '. ' || tool || '(' || arg || ')', chr(10) order by step) filter (where tool is not null) summary from n group by conv_id""")
def call_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered calls of each rollout, as a judge is shown them."""
    tool = F.when(F.col("role") == "assistant", "reply").when(F.col("role") == "user", "ask")
    steps = table(spark, sf_dir, "conversations").select("conv_id", "turn", tool.alias("tool"), F.length(F.coalesce("text", F.lit(""))).cast("string").alias("arguments"))
    calls = L.numbered_calls(steps, ["conv_id"], "turn", "tool", "arguments")
    return calls.select("conv_id", F.size("calls").cast("long").alias("n_calls"), F.nullif(L.calls_text(F.col("calls")), F.lit("")).alias("summary"))


@query(f"with s as ({DOMAIN_SCORES_SQL}) select row_number() over (order by domain = 'TOTAL', domain) place, s.* from s order by place")
def ordered_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain scores in the order of a report, the total last."""
    rows = F.array_sort(F.collect_list(F.struct((F.col("domain") == "TOTAL").alias("last"), "domain", *DIMENSIONS, "n_valid", "n_failed")))
    listed = domain_scores(spark, sf_dir).agg(rows.alias("rows"))  # a row per domain
    return listed.select(F.posexplode("rows").alias("at", "r")).select((F.col("at") + 1).alias("place"), "r.domain", *[f"r.{d}" for d in DIMENSIONS], "r.n_valid", "r.n_failed").orderBy("place")


@query(f"""with {ROLLOUTS_SQL}, a as (select arm, count(verdict) n, avg(verdict::int) rate from rollouts group by arm),
l as (select 0 place, '| arm | rollouts | pass rate |' line union all select 1, '|---|---|---|' union all
  select 1 + row_number() over (order by arm), '| ' || arm || ' | ' || n || ' | ' || printf('%.3f', rate) || ' |' from a) select place, line from l""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass rates by arm as a Markdown table."""
    rates = pass_rates(rollouts(spark, sf_dir), "arm")
    return L.markdown_table(rates, {"arm": F.col("arm"), "rollouts": F.col("n_judged"), "pass rate": F.format_string("%.3f", F.col("pass_rate"))}, "arm")


@query("""with m as (select c_nationkey k, avg(floor(c_acctbal)) mean from customer group by 1)
select n_name, case n_nationkey % 3 when 0 then mean when 1 then mean / 100 end mean, case when mean is null then null when n_nationkey % 3 = 0 then 'csv' when n_nationkey % 3 = 1 then 'json' end source
from nation left join m on n_nationkey = k""")
def collected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation's mean from its CSV of percents, else from its JSON statistics, else nothing."""
    folder = scratch_folder(spark)
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_nationkey") % 3
    S.write_csv(c.where(k == 0).select("c_nationkey", F.concat(F.lit(" "), F.floor("c_acctbal").cast("string"), F.lit("% ")).alias("score")), f"{folder}/csv")
    S.write_jsonl(c.where(k == 1).groupBy("c_nationkey").agg(F.struct((F.avg(F.floor("c_acctbal")) / 100).alias("mean")).alias("stats")), f"{folder}/json")
    key = F.col("c_nationkey").cast("int").alias("n_nationkey")
    by_csv = spark.read.option("header", True).csv(f"{folder}/csv").select(key, percent(F.col("score")).alias("v")).groupBy("n_nationkey").agg(F.avg("v").alias("mean"))
    by_json = S.read_jsonl(spark, f"{folder}/json", "c_nationkey int, stats struct<mean:double>").select(key, "stats.mean")
    return L.first_measured(n.select("n_nationkey", "n_name"), {"csv": by_csv, "json": by_json}, ["n_nationkey"], "mean").select("n_name", "mean", "source")


@query("""with o as (select user_id, list(case event_type when 'click' then 'added' when 'view' then 'updated' when 'signup' then 'merged' when 'purchase' then 'removed' else 'rejected' end) outcomes, count(*) filter (where event_type = 'signup') * 2 merged from events group by user_id)
select user_id, len(list_filter(outcomes, lambda o: o <> 'rejected')) + merged n_changes from o""")
def edit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a batch of edits changed: what it did, and the entries that its merges took in."""
    kinds = {"click": "added", "view": "updated", "signup": "merged", "purchase": "removed"}
    outcome = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.lit("rejected"))
    batches = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(outcome).alias("outcomes"), (F.count_if(F.col("event_type") == "signup") * 2).alias("merged"))
    return batches.select("user_id", change_count(F.col("outcomes"), F.col("merged")).cast("long").alias("n_changes"))

"""The task bank: draws, pruning, audits, splits and set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gymlake.sources.tables import BANK_SQL, ROLLOUTS_SQL, bank, rollouts

QUERIES, ORACLES = {}, {}
SCREENER = "src1"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def own_rate(screener: str) -> Column:
    """A rate that another agent measured is no rate."""
    return F.when(F.col("screened_by") == screener, F.col("baseline_pass_rate"))


def drawable(tasks: DataFrame, split: str, low: float, high: float, screener: str, require_screened: bool = False) -> DataFrame:
    """Tasks of a split that are not condemned and lie in the band; unscreened ones pass unless screening is required."""
    rate = own_rate(screener)
    fits = rate.between(low, high) if require_screened else rate.isNull() | rate.between(low, high)
    return tasks.where((F.col("split") == split) & ~F.col("unpassable") & ~F.col("too_weak") & F.coalesce(fits, F.lit(False)))


def seeded(seed: int, column: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(column).cast("string")))


def at_least(tasks: DataFrame, least: int) -> DataFrame:
    """tasks, or an error where they are fewer than `least` (a comparison so small shows nothing); looks at no more rows than that."""
    n = tasks.limit(least).count()
    if n < least:
        raise ValueError(f"{n} tasks in the set, at least {least} are needed")
    return tasks


_OWN = f"case when screened_by = '{SCREENER}' then baseline_pass_rate end"
_DRAW = f"split = 'train' and not unpassable and not too_weak and ({_OWN} is null or {_OWN} between 0.2 and 0.6)"


@query(f"with {BANK_SQL} select task_id, tool_family, gc from bank where {_DRAW} order by task_id limit 50")
def bank_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawable(bank(spark, sf_dir), "train", 0.2, 0.6, SCREENER).select("task_id", "tool_family", "gc").orderBy("task_id").limit(50)


@query(f"with {BANK_SQL} select task_id, tool_family, gc from bank where split = 'train' and not unpassable and not too_weak and {_OWN} between 0.2 and 0.6")
def bank_draw_screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawable(bank(spark, sf_dir), "train", 0.2, 0.6, SCREENER, require_screened=True).select("task_id", "tool_family", "gc")


@query(f"""with {BANK_SQL} select tool_family || '/gc' || gc bucket, count(*) filter (where split = 'train') train, count(*) filter (where split = 'val') val, count(*) filter (where split = 'eval') "eval", count(baseline_pass_rate) screened from bank group by 1""")
def bank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: F.count_if(F.col("split") == s).alias(s)
    return bank(spark, sf_dir).groupBy(F.concat("tool_family", F.lit("/gc"), F.col("gc").cast("string")).alias("bucket")).agg(of("train"), of("val"), of("eval"), F.count("baseline_pass_rate").alias("screened"))


def survivors(tasks: DataFrame, newest: int, oldest: int) -> DataFrame:
    """What pruning leaves: neither too old nor unscreened, and the newest of each bucket. Doomed rows take no place."""
    alive = tasks.where((F.col("created_at") >= oldest) & F.col("baseline_pass_rate").isNotNull())
    w = Window.partitionBy("tool_family", "gc").orderBy(F.col("created_at").desc(), "task_id")
    return alive.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= newest).drop("_place")


@query(f"""with {BANK_SQL} select task_id from bank where created_at >= 100 and baseline_pass_rate is not null
qualify row_number() over (partition by tool_family, gc order by created_at desc, task_id) <= 20""")
def bank_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(bank(spark, sf_dir), 20, 100).select("task_id")


_REPORTS = "select doc_id % 50 task_id, doc_id report_seq, doc_id % 3 = 0 unpassable, doc_id % 4 = 1 too_weak from documents"


def upsert(tasks: DataFrame, updates: DataFrame, *columns: str) -> DataFrame:
    """tasks with the columns of the last update of each task; tasks without one keep theirs."""
    last = updates.groupBy("task_id").agg(F.max_by(F.struct(*columns), "report_seq").alias("_new"))
    joined = tasks.join(last, "task_id", "left")
    return joined.select(*[F.coalesce(F.col("_new")[c], F.col(c)).alias(c) if c in columns else F.col(c) for c in tasks.columns], F.col("_new").isNotNull().alias("updated"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return d.select((F.col("doc_id") % 50).alias("task_id"), F.col("doc_id").alias("report_seq"), (F.col("doc_id") % 3 == 0).alias("unpassable"), (F.col("doc_id") % 4 == 1).alias("too_weak"))


@query(f"""with {BANK_SQL}, rep as ({_REPORTS}), last as (select * from rep qualify row_number() over (partition by task_id order by report_seq desc) = 1)
select bank.task_id, coalesce(last.unpassable, bank.unpassable) unpassable, coalesce(last.too_weak, bank.too_weak) too_weak, last.task_id is not null updated from bank left join last using (task_id)""")
def audit_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later reports win; each task keeps its verdict where none speaks of it."""
    return upsert(bank(spark, sf_dir), _reports(spark, sf_dir), "unpassable", "too_weak").select("task_id", "unpassable", "too_weak", "updated")


@query(f"with {BANK_SQL} select count(*) n, count(*) filter (where unpassable) unpassable, count(*) filter (where too_weak) too_weak, count(*) filter (where not unpassable and not too_weak) clean from bank where audited")
def audit_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, w = F.col("unpassable"), F.col("too_weak")
    return bank(spark, sf_dir).where("audited").agg(F.count("*").alias("n"), F.count_if(u).alias("unpassable"), F.count_if(w).alias("too_weak"), F.count_if(~u & ~w).alias("clean"))


def reject_reason(screener: str, low: float, high: float) -> Column:
    """The one reason a task is not selected; null where it is."""
    rate = own_rate(screener)
    return (
        F.when(F.col("seen"), "seen").when(rate.isNull(), "unscreened").when(F.col("unpassable"), "audit:unpassable").when(F.col("too_weak"), "audit:too_weak")
        .when(rate == 0, "pinned_floor").when(rate == 1, "pinned_ceiling").when(~rate.between(low, high), "out_of_band")
    )


_REASON = f"""case when task_id % 10 = 0 then 'seen' when {_OWN} is null then 'unscreened' when unpassable then 'audit:unpassable' when too_weak then 'audit:too_weak'
  when {_OWN} = 0 then 'pinned_floor' when {_OWN} = 1 then 'pinned_ceiling' when not ({_OWN} between 0.2 and 0.6) then 'out_of_band' end"""


@query(f"with {BANK_SQL}, r as (select {_REASON} reason from bank) select coalesce(reason, 'selected') reason, count(*) n from r group by 1")
def eval_set_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = bank(spark, sf_dir).withColumn("seen", F.col("task_id") % 10 == 0)
    return tasks.groupBy(F.coalesce(reject_reason(SCREENER, 0.2, 0.6), F.lit("selected")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"with {BANK_SQL}, r as (select *, {_REASON} reason from bank) select task_id, md5('7|' || task_id) draw from r where reason is null order by draw limit 20")
def eval_set_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = bank(spark, sf_dir).withColumn("seen", F.col("task_id") % 10 == 0)
    chosen = tasks.where(reject_reason(SCREENER, 0.2, 0.6).isNull()).select("task_id", seeded(7, "task_id").alias("draw")).orderBy("draw").limit(20)
    return at_least(chosen, 1)


@query(f"""with {BANK_SQL}, g as (select task_id, case when baseline_pass_rate = 1 then 'ceiling' when baseline_pass_rate = 0 then 'floor' else 'band' end "group" from bank where baseline_pass_rate is not null)
select task_id, "group" from g qualify "group" <> 'ceiling' or row_number() over (partition by "group" order by md5('3|' || task_id)) <= 15""")
def stratified_audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor and band whole, and a seeded sample of the ceiling."""
    r = F.col("baseline_pass_rate")
    g = bank(spark, sf_dir).where(r.isNotNull()).select("task_id", F.when(r == 1, "ceiling").when(r == 0, "floor").otherwise("band").alias("group"))
    sampled = g.where("group = 'ceiling'").orderBy(seeded(3, "task_id")).limit(15)
    return g.where("group <> 'ceiling'").unionByName(sampled)


@query(f"with {BANK_SQL}, {ROLLOUTS_SQL} select (select count(*) from bank where split = 'train' and task_id in (select task_id from bank where split = 'eval')) overlap_splits, (select count(distinct task_id) from rollouts where task_id in (select task_id from bank where split = 'eval')) rolled_eval")
def held_out_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = bank(spark, sf_dir).select("task_id", "split")
    held = tasks.where("split = 'eval'").select("task_id")
    overlap = tasks.where("split = 'train'").join(held, "task_id", "left_semi").agg(F.count("*").alias("overlap_splits"))
    rolled = rollouts(spark, sf_dir).join(held, "task_id", "left_semi").agg(F.count_distinct("task_id").alias("rolled_eval"))
    return overlap.crossJoin(rolled)


@query(f"with {BANK_SQL}, {ROLLOUTS_SQL} select task_id from bank where task_id not in (select task_id from rollouts)")
def unscreened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank(spark, sf_dir).select("task_id").join(rollouts(spark, sf_dir).select("task_id"), "task_id", "left_anti")


@query(f"with {BANK_SQL} select task_id, tool_family, place from (select task_id, tool_family, row_number() over (partition by tool_family order by md5('5|' || task_id)) place from bank where task_id % 4 <> 0) where place <= 5")
def next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks not served yet, a seeded few of each family."""
    served = bank(spark, sf_dir).where("task_id % 4 = 0").select("task_id")
    w = Window.partitionBy("tool_family").orderBy(seeded(5, "task_id"))
    rest = bank(spark, sf_dir).select("task_id", "tool_family").join(served, "task_id", "left_anti")
    return rest.withColumn("place", F.row_number().over(w)).where("place <= 5")


@query(f"with {BANK_SQL} select tool_family <> 'es' train, count(*) n, count(distinct tool_family) n_families from bank group by 1")
def held_out_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank(spark, sf_dir).groupBy((F.col("tool_family") != "es").alias("train")).agg(F.count("*").alias("n"), F.count_distinct("tool_family").alias("n_families"))


@query(f"with {BANK_SQL}, {ROLLOUTS_SQL} select r.arm, coalesce(b.tool_family, '?') family, count(*) n from rollouts r left join bank b using (task_id) group by 1, 2")
def lookup_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = rollouts(spark, sf_dir).groupBy("arm", "task_id").agg(F.count("*").alias("k"))
    return per.join(bank(spark, sf_dir).select("task_id", "tool_family"), "task_id", "left").groupBy("arm", F.coalesce("tool_family", F.lit("?")).alias("family")).agg(F.sum("k").alias("n"))


@query(f"with {BANK_SQL}, {ROLLOUTS_SQL} select task_id, count(*) n, any_value(gc) gc from rollouts join bank using (task_id) group by task_id")
def orphans_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = rollouts(spark, sf_dir).groupBy("task_id").agg(F.count("*").alias("n"))
    return per.join(bank(spark, sf_dir).select("task_id", "gc"), "task_id")

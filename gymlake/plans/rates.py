"""Pass rates, pairing, windows and judge comparison over rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gymlake.functions.stats import wilson
from gymlake.operators import rates as R
from gymlake.sources.tables import JUDGED_SQL, ROLLOUTS_SQL, judged, rollouts

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_RATE = "avg(cast(verdict as int)) pass_rate, count(verdict) n_judged, count(*) n_rollouts"


@query(f"with {ROLLOUTS_SQL} select arm, {_RATE} from rollouts group by arm")
def pass_rate_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pass_rates(rollouts(spark, sf_dir), "arm")


@query(f"with {ROLLOUTS_SQL} select arm, rep, {_RATE} from rollouts group by arm, rep")
def pass_rate_by_rep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pass_rates(rollouts(spark, sf_dir), "arm", "rep")


@query(f"with {ROLLOUTS_SQL} select task_id, {_RATE} from rollouts group by task_id")
def screening_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pass_rates(rollouts(spark, sf_dir), "task_id")


@query(f"with {ROLLOUTS_SQL} select arm, avg(cast(verdict as int)) rate_judged, avg(cast(coalesce(verdict, false) as int)) rate_strict from rollouts group by arm")
def strict_vs_judged_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).groupBy("arm").agg(R.rate_judged().alias("rate_judged"), R.rate_strict().alias("rate_strict"))


_ROLL = "avg(cast(verdict as int)) over (partition by task_id order by ts, event_id rows between 19 preceding and current row)"


@query(f"with {ROLLOUTS_SQL} select event_id, task_id, {_ROLL} rolling_rate, {_ROLL} between 0.2 and 0.6 in_band from rollouts")
def rolling_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rolling_rate(rollouts(spark, sf_dir), ["task_id"], ["ts", "event_id"]).select("event_id", "task_id", "rolling_rate", "in_band")


@query(f"""with {ROLLOUTS_SQL}, x as (select task_id, ts, event_id, {_ROLL} r from rollouts)
select task_id, max_by(r, row(ts, event_id)) current_rate from x group by task_id""")
def current_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = R.rolling_rate(rollouts(spark, sf_dir), ["task_id"], ["ts", "event_id"])
    return rolled.groupBy("task_id").agg(F.max_by("rolling_rate", F.struct("ts", "event_id")).alias("current_rate"))


PAIRS_SQL = f"""{ROLLOUTS_SQL},
arms as (select task_id, avg(cast(verdict as int)) filter (where arm = 'baseline') base_rate, avg(cast(verdict as int)) filter (where arm = 'final') final_rate from rollouts group by task_id),
pairs as (select *, final_rate - base_rate delta from arms where base_rate is not null and final_rate is not null)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.paired(rollouts(spark, sf_dir))


@query(f"with {PAIRS_SQL} select task_id, base_rate, final_rate, delta from pairs")
def paired_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


@query(f"""with {PAIRS_SQL} select count(*) n_units, count(*) filter (where delta > 0) wins, count(*) filter (where delta < 0) losses, count(*) filter (where delta = 0) ties,
  avg(base_rate) base_mean, avg(final_rate) final_mean, avg(delta) mean_delta from pairs""")
def wins_losses_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.movement(pairs(spark, sf_dir))


@query(f"with {PAIRS_SQL} select task_id, delta from pairs order by abs(delta) desc, task_id limit 10")
def largest_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("task_id", "delta").orderBy(F.abs("delta").desc(), "task_id").limit(10)


ENTRY_PAIRS_SQL = f"""{ROLLOUTS_SQL},
ep as (select task_id, max_by(verdict, row(ts, event_id)) filter (where arm = 'baseline' and verdict is not null) base, max_by(verdict, row(ts, event_id)) filter (where arm = 'final' and verdict is not null) final
  from rollouts group by task_id),
entry_pairs as (select * from ep where base is not null and final is not null)"""


def entry_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last judged verdict of each unit in each arm."""
    seen = rollouts(spark, sf_dir).where("verdict is not null")
    last = lambda arm: F.max_by(F.when(F.col("arm") == arm, F.col("verdict")), F.when(F.col("arm") == arm, F.struct("ts", "event_id")))
    return seen.groupBy("task_id").agg(last("baseline").alias("base"), last("final").alias("final")).where("base is not null and final is not null")


DISCORDANT_SQL = f"""{ENTRY_PAIRS_SQL},
disc as (select count(*) filter (where base and final) "both", count(*) filter (where base and not final) only_base, count(*) filter (where not base and final) only_final, count(*) filter (where not base and not final) neither from entry_pairs)"""


@query(f'with {DISCORDANT_SQL} select "both", only_base, only_final, neither from disc')
def discordant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.discordance(entry_pairs(spark, sf_dir), "base", "final")


def wilson_sql(k: str, n: str) -> str:
    z = "cast(1.96 as double)"
    s = f"cast({n} as double)"
    p = f"({k} / {s})"
    centre, half = f"(({p} + {z}*{z}/(2*{s})) / (1 + {z}*{z}/{s}))", f"({z} / (1 + {z}*{z}/{s}) * sqrt({p}*(1-{p})/{s} + {z}*{z}/(4*{s}*{s})))"
    return f"{p} as point, greatest(0, {centre} - {half}) low, least(1, {centre} + {half}) high"


@query(f"with {ROLLOUTS_SQL}, x as (select arm, count(*) filter (where verdict) k, count(verdict) n from rollouts group by arm) select arm, k, n, {wilson_sql('k', 'n')} from x")
def wilson_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = rollouts(spark, sf_dir).groupBy("arm").agg(F.count_if("verdict").alias("k"), F.count("verdict").alias("n"))
    return counts.withColumn("w", wilson(F.col("k"), F.col("n"))).select("arm", "k", "n", "w.*")


# n_steps and the event type stand in for the harness's own reason.
_HARNESS_SQL = "case when event_type = 'view' then 'checker_false' when event_type = 'click' and k % 3 = 0 then 'checker_unsafe' end"
_REASON_SQL = f"""case when verdict is null then 'rollout_error:error' when verdict then 'passed' when ({_HARNESS_SQL}) <> 'checker_false' then {_HARNESS_SQL}
  when n_steps = 0 then 'agent_no_tool_call' when n_steps >= 10 then 'agent_max_steps' else coalesce({_HARNESS_SQL}, 'other') end"""


@query(f"with {ROLLOUTS_SQL}, x as (select arm, {_REASON_SQL} reason from rollouts) select arm, reason, count(*) n, count(*) / cast(sum(count(*)) over (partition by arm) as double) share from x group by arm, reason")
def failure_reason_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    harness = F.when(c("event_type") == "view", "checker_false").when((c("event_type") == "click") & (c("k") % 3 == 0), "checker_unsafe")
    label = F.when(c("verdict").isNull(), "error")
    reasons = rollouts(spark, sf_dir).select("arm", R.failure_reason(label, c("verdict"), harness, c("n_steps")).alias("reason"))
    counts = reasons.groupBy("arm", "reason").agg(F.count("*").alias("n"))
    return counts.withColumn("share", c("n") / F.sum("n").over(Window.partitionBy("arm")).cast("double"))


@query(f"""with {ROLLOUTS_SQL}, x as (select case when event_type = 'error' then case when k % 2 = 0 then 'KeyError' else case when k % 3 = 0 then 'ValueError' else 'TimeoutError' end end end t, 'missing next_state' m from rollouts)
select case when t = 'KeyError' and contains(m, 'next_state') then 'sim_missing_next_state' when t in ('ValueError', 'JSONDecodeError') then 'sim_invalid_json' else 'rollout_error:' || t end bucket, count(*) n
from x where t is not null group by 1""")
def error_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("k") % 2 == 0, "KeyError").when(F.col("k") % 3 == 0, "ValueError").otherwise("TimeoutError")
    errors = rollouts(spark, sf_dir).where("verdict is null").select(R.error_bucket(kind, F.lit("missing next_state")).alias("bucket"))
    return errors.groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"""with {PAIRS_SQL}, g as (select case when base_rate = 1 then 'ceiling' when base_rate = 0 then 'floor' else 'band' end "group", delta, base_rate, final_rate from pairs)
select case when grouping("group") = 1 then 'POOLED' else "group" end as "group", count(*) n, avg(base_rate) base_mean, avg(final_rate) final_mean, avg(delta) mean_delta
from g group by rollup ("group")""")
def group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = pairs(spark, sf_dir).withColumn("g", R.rate_group(F.col("base_rate")))
    out = grouped.rollup("g").agg(F.grouping("g").alias("all"), F.count("*").alias("n"), F.avg("base_rate").alias("base_mean"), F.avg("final_rate").alias("final_mean"), F.avg("delta").alias("mean_delta"))
    return out.select(F.when(F.col("all") == 1, "POOLED").otherwise(F.col("g")).alias("group"), "n", "base_mean", "final_mean", "mean_delta")


@query(f"with {PAIRS_SQL} select count(*) filter (where base_rate = 0 and final_rate = 0) dead_floor, count(*) filter (where base_rate = 1 and final_rate = 1) dead_ceiling, count(*) filter (where not (base_rate = final_rate and base_rate in (0, 1))) effective_n from pairs")
def dead_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, f = F.col("base_rate"), F.col("final_rate")
    return pairs(spark, sf_dir).agg(F.count_if((b == 0) & (f == 0)).alias("dead_floor"), F.count_if((b == 1) & (f == 1)).alias("dead_ceiling"), F.count_if(~((b == f) & b.isin(0.0, 1.0))).alias("effective_n"))


@query(f"""with {ROLLOUTS_SQL}, t as (select task_id, rep, avg(cast(verdict as int)) r from rollouts group by task_id, rep)
select rep, count(*) filter (where r = 1) pinned_high, count(*) filter (where r = 0) pinned_low, count(*) filter (where r between 0.2 and 0.6) in_band, avg(r) mean_rate from t group by rep""")
def pinned_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = rollouts(spark, sf_dir).groupBy("task_id", "rep").agg(R.rate_judged().alias("r"))
    return per.groupBy("rep").agg(F.count_if(F.col("r") == 1).alias("pinned_high"), F.count_if(F.col("r") == 0).alias("pinned_low"), F.count_if(R.in_band(F.col("r"), 0.2, 0.6)).alias("in_band"), F.avg("r").alias("mean_rate"))


# The second judge: a threshold on the event's value.
_LLM_SQL = "case when k % 11 = 0 then null else value > 50 end"


@query(f"""with {ROLLOUTS_SQL}, x as (select arm, verdict checker, {_LLM_SQL} llm from rollouts)
select arm, count(*) filter (where checker is not null and llm is not null) n, avg(cast(checker = llm as int)) agree, count(*) filter (where checker and not llm) true_false, count(*) filter (where not checker and llm) false_true,
  avg(cast(llm is null as int)) error_share from x group by arm""")
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    llm = F.when(F.col("k") % 11 == 0, None).otherwise(F.col("value") > 50)
    x = rollouts(spark, sf_dir).select("arm", F.col("verdict").alias("checker"), llm.alias("llm"))
    a, b = F.col("checker"), F.col("llm")
    return x.groupBy("arm").agg(
        F.count_if(a.isNotNull() & b.isNotNull()).alias("n"), F.avg(R.as_number(a == b)).alias("agree"), F.count_if(a & ~b).alias("true_false"), F.count_if(~a & b).alias("false_true"),
        F.avg(R.as_number(b.isNull())).alias("error_share"),
    )


@query(f"""with {ROLLOUTS_SQL}, known as (select distinct task_id from rollouts where verdict is null), x as (select task_id, avg(value) mean_score, avg(cast({_LLM_SQL} as int)) r from rollouts where task_id in (select task_id from known) group by task_id)
select count(*) n_known, count(*) filter (where r > 0) rescued, avg(mean_score) mean_score from x""")
def rescued_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollouts(spark, sf_dir)
    llm = F.when(F.col("k") % 11 == 0, None).otherwise(F.col("value") > 50)
    known = rows.where("verdict is null").select("task_id").distinct()
    per = rows.join(known, "task_id", "left_semi").groupBy("task_id").agg(F.avg("value").alias("mean_score"), F.avg(R.as_number(llm)).alias("r"))
    return per.agg(F.count("*").alias("n_known"), F.count_if(F.col("r") > 0).alias("rescued"), F.avg("mean_score").alias("mean_score"))


@query(f"""with {ROLLOUTS_SQL}, x as (select verdict old, {_LLM_SQL} new from rollouts)
select avg(cast(old is null as int)) old_error_share, avg(cast(new is null as int)) new_error_share, avg(cast(old as int)) old_rate, avg(cast(new as int)) new_rate, count(*) filter (where not old and new) fail_to_pass, count(*) filter (where old and not new) pass_to_fail from x""")
def judgment_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    llm = F.when(F.col("k") % 11 == 0, None).otherwise(F.col("value") > 50)
    x = rollouts(spark, sf_dir).select(F.col("verdict").alias("old"), llm.alias("new"))
    o, n = F.col("old"), F.col("new")
    return x.agg(
        F.avg(R.as_number(o.isNull())).alias("old_error_share"), F.avg(R.as_number(n.isNull())).alias("new_error_share"), R.rate_judged("old").alias("old_rate"), R.rate_judged("new").alias("new_rate"),
        F.count_if(~o & n).alias("fail_to_pass"), F.count_if(o & ~n).alias("pass_to_fail"),
    )


@query(f"""with {ROLLOUTS_SQL}, a as (select task_id, rep, max_by(verdict, event_id) stored from rollouts where arm = 'baseline' group by 1, 2), b as (select task_id, rep, max_by(verdict, event_id) recomputed from rollouts where arm = 'final' group by 1, 2)
select task_id, rep, stored, recomputed from a join b using (task_id, rep) where stored is distinct from recomputed""")
def verdict_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollouts(spark, sf_dir)
    last = lambda arm: F.max_by(F.when(F.col("arm") == arm, F.col("verdict")), F.when((F.col("arm") == arm) & F.col("verdict").isNotNull(), F.col("event_id")))
    both = rows.groupBy("task_id", "rep").agg(last("baseline").alias("stored"), last("final").alias("recomputed"), F.count_if(F.col("arm") == "baseline").alias("na"), F.count_if(F.col("arm") == "final").alias("nb"))
    return both.where("na > 0 and nb > 0").where(~F.col("stored").eqNullSafe(F.col("recomputed"))).select("task_id", "rep", "stored", "recomputed")


@query(f"""with {ROLLOUTS_SQL}, t as (select arm, task_id, avg(n_steps) s, avg(n_steps) filter (where verdict) p from rollouts group by 1, 2) select arm, avg(s) mean_steps, avg(p) mean_steps_passed from t group by arm""")
def mean_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = rollouts(spark, sf_dir).groupBy("arm", "task_id").agg(F.avg("n_steps").alias("s"), F.avg(F.when(F.col("verdict"), F.col("n_steps"))).alias("p"))
    return per.groupBy("arm").agg(F.avg("s").alias("mean_steps"), F.avg("p").alias("mean_steps_passed"))


FEATURES_SQL = f"""{ROLLOUTS_SQL}, feat as (select task_id, avg(cast(verdict as int)) rate, count(*) n_rollouts, avg(n_steps) steps, cast(max(k) % 7 as int) clauses from rollouts group by task_id)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).groupBy("task_id").agg(R.rate_judged().alias("rate"), F.count("*").alias("n_rollouts"), F.avg("n_steps").alias("steps"), (F.max("k") % 7).cast("int").alias("clauses"))


@query(" union all ".join(
    (f"with {FEATURES_SQL} " if i == 0 else "") + f"select '{c}' feature, count(*) n, case when count(*) >= 3 and stddev_pop({c}) > 0 and stddev_pop(rate) > 0 then corr({c}, rate) end r from feat where rate is not null"
    for i, c in enumerate(("steps", "n_rollouts", "clauses"))
))
def feature_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson's r of each feature with the rate; null under three tasks or without variance."""
    rows = features(spark, sf_dir).where("rate is not null")
    long = rows.select("rate", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in ("steps", "n_rollouts", "clauses")])).alias("f")).select("rate", "f.*")
    sums = long.groupBy("feature").agg(F.count("*").alias("n"), F.covar_pop("x", "rate").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("rate").alias("sy"))
    fine = (F.col("n") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0)
    return sums.select("feature", "n", F.when(fine, F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))).alias("r"))


@query(f"with {FEATURES_SQL} select least(clauses, 6) bucket, count(*) n, avg(rate) mean_rate, median(steps) median_steps from feat group by 1")
def clause_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy(F.least(F.col("clauses"), F.lit(6)).alias("bucket")).agg(F.count("*").alias("n"), F.avg("rate").alias("mean_rate"), F.median("steps").alias("median_steps"))


@query(f"""with {FEATURES_SQL}, t as (select *, row_number() over (order by steps, task_id) - 1 i, count(*) over () n from feat where rate is not null),
cut as (select max(steps) filter (where i = n // 3) lo, max(steps) filter (where i = (2 * n) // 3) hi from t)
select avg(rate) filter (where steps <= lo) low_mean, avg(rate) filter (where steps >= hi) high_mean, count(*) filter (where steps <= lo) n_low, count(*) filter (where steps >= hi) n_high from t, cut""")
def clause_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means below the value at index n // 3 and above that at 2n // 3, ties on both sides included."""
    rows = features(spark, sf_dir).where("rate is not null").select("task_id", "rate", "steps")
    n = rows.agg(F.count("*").alias("n"))
    placed = rows.withColumn("i", F.row_number().over(Window.orderBy("steps", "task_id")) - 1).crossJoin(F.broadcast(n))
    at = lambda k: F.max(F.when(F.col("i") == F.floor(F.col("n") * k / 3).cast("int"), F.col("steps")))
    cut = placed.agg(at(1).alias("lo"), at(2).alias("hi"))
    low, high = F.col("steps") <= F.col("lo"), F.col("steps") >= F.col("hi")
    return rows.crossJoin(F.broadcast(cut)).agg(F.avg(F.when(low, F.col("rate"))).alias("low_mean"), F.avg(F.when(high, F.col("rate"))).alias("high_mean"), F.count_if(low).alias("n_low"), F.count_if(high).alias("n_high"))


@query(f"""with {ROLLOUTS_SQL}, r as (select arm, rep, avg(cast(verdict as int)) p from rollouts group by 1, 2)
select min(p) filter (where arm = 'baseline') base_min, max(p) filter (where arm = 'baseline') base_max, min(p) filter (where arm = 'final') final_min, max(p) filter (where arm = 'final') final_max,
  max(p) filter (where arm = 'baseline') < min(p) filter (where arm = 'final') disjoint_ranges from r""")
def disjoint_rep_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = R.pass_rates(rollouts(spark, sf_dir), "arm", "rep")
    of = lambda f, arm: f(F.when(F.col("arm") == arm, F.col("pass_rate")))
    return per.agg(
        of(F.min, "baseline").alias("base_min"), of(F.max, "baseline").alias("base_max"), of(F.min, "final").alias("final_min"), of(F.max, "final").alias("final_max"),
        (of(F.max, "baseline") < of(F.min, "final")).alias("disjoint_ranges"),
    )


@query(f"""with {ROLLOUTS_SQL}, s as (select arm, task_id, event_type tool, row_number() over (partition by arm, task_id order by ts, event_id) i from rollouts)
select arm, tool, count(*) n_all, count(*) filter (where i = 1) n_first from s group by 1, 2""")
def tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("arm", "task_id").orderBy("ts", "event_id")
    steps = rollouts(spark, sf_dir).select("arm", F.col("event_type").alias("tool"), F.row_number().over(w).alias("i"))
    return steps.groupBy("arm", "tool").agg(F.count("*").alias("n_all"), F.count_if(F.col("i") == 1).alias("n_first"))


@query(f"""with {ROLLOUTS_SQL}, r as (select task_id, {_REASON_SQL} reason from rollouts) select task_id, count(*) n, count(*) filter (where reason like 'checker%') n_checker, avg(cast(reason like 'rollout_error%' as int)) harness_share, count(distinct reason) n_reasons from r group by 1""")
def reason_counts_per_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    harness = F.when(c("event_type") == "view", "checker_false").when((c("event_type") == "click") & (c("k") % 3 == 0), "checker_unsafe")
    r = rollouts(spark, sf_dir).select("task_id", R.failure_reason(F.when(c("verdict").isNull(), "error"), c("verdict"), harness, c("n_steps")).alias("reason"))
    return r.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(c("reason").startswith("checker")).alias("n_checker"), F.avg(R.as_number(c("reason").startswith("rollout_error"))).alias("harness_share"), F.count_distinct("reason").alias("n_reasons"))


# --- over judged samples


@query(f"""with {JUDGED_SQL} select sample_id, turn_idx, (format * cast(format > 0 as int) + factuality * cast(factuality > 0 as int) + consistency * cast(consistency > 0 as int) + realism * cast(realism > 0 as int) + quality * cast(quality > 0 as int))
  / cast(nullif(cast(format > 0 as int) + cast(factuality > 0 as int) + cast(consistency > 0 as int) + cast(realism > 0 as int) + cast(quality > 0 as int), 0) as double) t, domain_no from judged""".replace(" t, domain_no", " raw_total, domain_no"))
def row_total_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the positive dimensions of each sample; null where none is."""
    dims = F.array("format", "factuality", "consistency", "realism", "quality")
    valid = F.filter(dims, lambda x: x > 0)
    total = F.aggregate(valid, F.lit(0), lambda a, x: a + x)
    return judged(spark, sf_dir).select("sample_id", "turn_idx", F.try_divide(total.cast("double"), F.size(valid)).alias("raw_total"), "domain_no")


_TOTAL_SQL = f"""{JUDGED_SQL}, long as (select domain, unnest([format, factuality, consistency, realism, quality]) v from judged where failed = 0),
per as (select domain, (avg(v) filter (where v > 0) - 1) / 4 * 100 score, (sum(v) filter (where v > 0)) s, count(*) filter (where v > 0) n from long group by domain)"""


@query(f"with {_TOTAL_SQL} select avg(score) macro, (sum(s) / cast(sum(n) as double) - 1) / 4 * 100 micro, count(*) n_domains from per")
def overall_macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both overall scores: the unweighted mean of domains, and the mean over all valid scores."""
    dims = ("format", "factuality", "consistency", "realism", "quality")
    rows = judged(spark, sf_dir).where("failed = 0")
    s = sum(F.when(F.col(d) > 0, F.col(d)).otherwise(0) for d in dims)
    n = sum((F.col(d) > 0).cast("int") for d in dims)
    per = rows.groupBy("domain").agg(F.sum(s).alias("s"), F.sum(n).alias("n"))
    score = (F.try_divide(F.col("s").cast("double"), F.col("n")) - 1) / 4 * 100
    return per.agg(F.avg(score).alias("macro"), ((F.try_divide(F.sum("s").cast("double"), F.sum("n")) - 1) / 4 * 100).alias("micro"), F.count("*").alias("n_domains"))

"""The study: exact tests, bootstrap intervals, the two axes and the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gymlake.functions.stats import binomial_two_sided, classify_interval, excludes_zero, mcnemar_exact, normal_quantile, sign_test_one_sided
from gymlake.operators import rates as R
from gymlake.plans.rates import DISCORDANT_SQL, PAIRS_SQL, entry_pairs, pairs
from gymlake.sources.tables import ROLLOUTS_SQL, rollouts

QUERIES, ORACLES = {}, {}
RESAMPLES = 10_000


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def binomial_sql(k: str, n: str) -> str:
    """P(X <= k) at p = 1/2 by log-gamma."""
    return f"(select coalesce(sum(exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(cast(2 as double)))), 0) from unnest(generate_series(cast(0 as bigint), cast({k} as bigint))) t(i))"


@query(f"with {DISCORDANT_SQL}, d as (select only_base, only_final, only_base + only_final n, least(only_base, only_final) k from disc) select only_base, only_final, case when n = 0 then 1 else least(1, 2 * {binomial_sql('k', 'n')}) end p_value from d")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = R.discordance(entry_pairs(spark, sf_dir), "base", "final")
    return counts.select("only_base", "only_final", mcnemar_exact(F.col("only_base"), F.col("only_final")).alias("p_value"))


@query(f"""with {PAIRS_SQL}, d as (select count(*) filter (where delta > 0) w, count(*) filter (where delta < 0) l from pairs)
select w wins, l losses, least(1, 2 * {binomial_sql('least(w, l)', '(w + l)')}) two_sided, {binomial_sql('l', '(w + l)')} one_sided from d""")
def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.movement(pairs(spark, sf_dir)).select("wins", "losses", (F.col("wins") + F.col("losses")).alias("n"))
    return m.select("wins", "losses", binomial_two_sided(F.col("wins"), F.col("n")).alias("two_sided"), sign_test_one_sided(F.col("wins"), F.col("n")).alias("one_sided"))


def bootstrap_sql(source: str, unit: str, prefix: str = "") -> str:
    """CTEs ending in {prefix}boot(n_units, point, low, high), with the same hashed draws."""
    p = prefix
    return f"""{p}placed as (select {unit} u, delta, row_number() over (order by {unit}) - 1 pos, count(*) over () n from {source}),
{p}draws as (select r.i resample, ('0x' || substr(md5('0|' || r.i || '|' || d.i), 1, 8))::bigint % s.n pos from (select max(n) n from {p}placed) s, range({RESAMPLES}) r(i), lateral (select unnest(range(s.n)) i) d),
{p}means as (select resample, avg(delta) m from {p}draws join {p}placed using (pos) group by resample),
{p}ranked as (select m, row_number() over (order by m, resample) - 1 i, count(*) over () b from {p}means),
{p}boot as (select (select count(*) from {source}) n_units, (select avg(delta) from {source}) point, max(m) filter (where i = round_even(0.025::double * (b - 1), 0)) low, max(m) filter (where i = round_even(0.975::double * (b - 1), 0)) high from {p}ranked)"""


CLASS_SQL = "case when low > 0 then 'gain' when high < 0 then 'regression' else 'no_effect' end"


@query(f"with {PAIRS_SQL}, {bootstrap_sql('pairs', 'task_id')} select n_units, point, low, high, low > 0 or high < 0 excludes_zero, {CLASS_SQL} verdict from boot")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ci = R.bootstrap_interval(pairs(spark, sf_dir), RESAMPLES)
    return ci.select("n_units", "point", "low", "high", excludes_zero(F.col("low"), F.col("high")).alias("excludes_zero"), classify_interval(F.col("low"), F.col("high")).alias("verdict"))


_IN_SQL = f"""{PAIRS_SQL}, {bootstrap_sql('pairs', 'task_id')},
mv as (select count(*) filter (where delta > 0) wins, count(*) filter (where delta < 0) losses, count(*) filter (where delta = 0) ties, avg(base_rate) base_mean, avg(final_rate) final_mean from pairs),
indom as (select n_units, base_mean, final_mean, point, low, high, wins, losses, ties, least(1, 2 * {binomial_sql('least(wins, losses)', '(wins + losses)')}) sign_p, {CLASS_SQL} verdict from boot, mv)"""


def in_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    ci = R.bootstrap_interval(p, RESAMPLES)
    m = R.movement(p).drop("n_units")
    w = F.col("wins")
    return ci.crossJoin(m).select("n_units", "base_mean", "final_mean", "point", "low", "high", "wins", "losses", "ties", binomial_two_sided(w, w + F.col("losses")).alias("sign_p"), classify_interval(F.col("low"), F.col("high")).alias("verdict"))


@query(f"with {_IN_SQL} select * from indom")
def in_domain_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units paired by task: two-level means, bootstrap interval, movement and sign test."""
    return in_domain(spark, sf_dir)


_TR_SQL = f"""{DISCORDANT_SQL}, deltas as (select task_id, cast(final as int) - cast(base as int) delta from entry_pairs), {bootstrap_sql('deltas', 'task_id', 'x')},
tr0 as (select n_units, point, low, high, only_base, only_final, least(1, 2 * {binomial_sql('least(only_base, only_final)', '(only_base + only_final)')}) p_value from xboot, disc),
transfer as (select *, case when p_value <= 0.05 then {CLASS_SQL} else 'no_effect' end verdict from tr0)"""


def transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entry_pairs(spark, sf_dir)
    deltas = e.select("task_id", (F.col("final").cast("int") - F.col("base").cast("int")).cast("double").alias("delta"))
    d = R.discordance(e, "base", "final").select("only_base", "only_final", mcnemar_exact(F.col("only_base"), F.col("only_final")).alias("p_value"))
    both = R.bootstrap_interval(deltas, RESAMPLES).crossJoin(d)
    verdict = F.when(F.col("p_value") <= 0.05, classify_interval(F.col("low"), F.col("high"))).otherwise("no_effect")
    return both.select("n_units", "point", "low", "high", "only_base", "only_final", "p_value", verdict.alias("verdict"))


@query(f"with {_TR_SQL} select * from transfer")
def transfer_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries paired by id: the interval and McNemar's test must both speak for an effect."""
    return transfer(spark, sf_dir)


_PRE_SQL = f"""{ROLLOUTS_SQL}, pre as (
  select 'non_empty' as "check", count(*) > 0 ok from rollouts union all
  select 'arms_differ', count(distinct arm) = 2 from rollouts union all
  select 'edits_made', count(*) filter (where rep > 0) > 0 from rollouts union all
  select 'held_out', (select count(*) from (select task_id from rollouts where task_id % 3 = 0 intersect select task_id from rollouts where task_id % 3 <> 0)) = 0 union all
  select 'baseline_not_saturated', coalesce((select avg(cast(verdict as int)) from rollouts where arm = 'baseline') < 0.95, true))"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five checks, from one pass of aggregates and one semi-join."""
    rows = rollouts(spark, sf_dir)
    train, held = rows.where("task_id % 3 = 0"), rows.where("task_id % 3 <> 0")
    shared = train.select("task_id").distinct().join(held.select("task_id"), "task_id", "left_semi").agg((F.count("*") == 0).alias("held_out"))
    facts = rows.agg(
        (F.count("*") > 0).alias("non_empty"), (F.count_distinct("arm") == 2).alias("arms_differ"), (F.count_if(F.col("rep") > 0) > 0).alias("edits_made"),
        F.coalesce(F.avg(F.when(F.col("arm") == "baseline", R.as_number("verdict"))) < 0.95, F.lit(True)).alias("baseline_not_saturated"),
    ).crossJoin(shared)
    names = ("non_empty", "arms_differ", "edits_made", "held_out", "baseline_not_saturated")
    return facts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("ok")) for n in names])).alias("x")).select("x.*")


@query(f'with {_PRE_SQL} select "check", ok from pre')
def preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks(spark, sf_dir)


def decide(checks_ok, in_domain_verdict, transfer_verdict):
    """The report's decision, the first row of the table that applies."""
    i, t = in_domain_verdict, transfer_verdict
    return (
        F.when(~checks_ok, "void").when((i == "regression") | (t == "regression"), "regression").when((i == "gain") & (t == "gain"), "supported")
        .when(i == "gain", "in_domain_only").otherwise("not_supported")
    )


@query(f"""with {_IN_SQL}, {_TR_SQL.replace(ROLLOUTS_SQL + ',', '', 1)}, {_PRE_SQL.replace(ROLLOUTS_SQL + ',', '', 1)}
select (select bool_and(ok) from pre) checks_ok, indom.verdict in_domain, transfer.verdict transfer,
  case when not (select bool_and(ok) from pre) then 'void' when indom.verdict = 'regression' or transfer.verdict = 'regression' then 'regression' when indom.verdict = 'gain' and transfer.verdict = 'gain' then 'supported'
    when indom.verdict = 'gain' then 'in_domain_only' else 'not_supported' end decision from indom, transfer""")
def study_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = checks(spark, sf_dir).agg(F.every("ok").alias("checks_ok"))
    i, t = in_domain(spark, sf_dir).select(F.col("verdict").alias("in_domain")), transfer(spark, sf_dir).select(F.col("verdict").alias("transfer"))
    return ok.crossJoin(i).crossJoin(t).withColumn("decision", decide(F.col("checks_ok"), F.col("in_domain"), F.col("transfer")))


@query(f"""with {ROLLOUTS_SQL}, a as (select arm, count(distinct task_id) n from rollouts where verdict is not null group by arm), s as (select count(*) n from (select task_id from rollouts where verdict is not null group by task_id having count(distinct arm) = 2))
select (select n from a where arm = 'baseline') n_base, (select n from a where arm = 'final') n_final, s.n n_shared, s.n < (select n from a where arm = 'baseline') or s.n < (select n from a where arm = 'final') warns from s""")
def coverage_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = rollouts(spark, sf_dir).where("verdict is not null").groupBy("task_id").agg(F.bool_or(F.col("arm") == "baseline").alias("b"), F.bool_or(F.col("arm") == "final").alias("f"))
    out = per.agg(F.count_if("b").alias("n_base"), F.count_if("f").alias("n_final"), F.count_if(F.col("b") & F.col("f")).alias("n_shared"))
    return out.withColumn("warns", (F.col("n_shared") < F.col("n_base")) | (F.col("n_shared") < F.col("n_final")))


@query(f"""with {ROLLOUTS_SQL}, x as (select task_id, arm, count(*) filter (where verdict) passed, count(*) total from rollouts group by 1, 2)
select task_id, arm, passed, total, abs(passed / cast(total as double) - round(passed / cast(total as double), 2)) > 1e-6 mismatch from x""")
def accuracy_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed accuracy of each task and arm against the reported one, here one that was rounded to two places, so that some differ."""
    x = rollouts(spark, sf_dir).groupBy("task_id", "arm").agg(F.count_if("verdict").alias("passed"), F.count("*").alias("total"))
    accuracy = F.col("passed") / F.col("total").cast("double")
    return x.select("task_id", "arm", "passed", "total", (F.abs(accuracy - F.round(accuracy, 2)) > 1e-6).alias("mismatch"))


_Z = {0.1: -1.281552, 0.2: -0.841621, 0.3: -0.524401, 0.4: -0.253347, 0.5: 0.0, 0.6: 0.253347, 0.7: 0.524401, 0.8: 0.841621, 0.9: 1.281552, 0.975: 1.959964, 0.025: -1.959964}
_P = "case when k % 50 = 0 then 0.025 when k % 50 = 1 then 0.975 else (1 + k % 9) / 10.0 end"


@query(f"with {ROLLOUTS_SQL}, q as (select ({_P})::double p from rollouts where k is not null) select p, case {' '.join(f'when abs(p - {p}) < 1e-9 then {z}' for p, z in _Z.items())} end::double z, count(*) n from q group by p")
def normal_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal quantile of each rollout's level, by level."""
    k = F.col("k")
    level = F.when(k % 50 == 0, 0.025).when(k % 50 == 1, 0.975).otherwise((1 + k % 9) / F.lit(10.0))
    levels = rollouts(spark, sf_dir).where(k.isNotNull()).groupBy(level.cast("double").alias("p")).agg(F.count("*").alias("n"))
    return levels.select("p", F.round(normal_quantile(F.col("p")), 6).alias("z"), "n")

"""Intervals, exact tests and windows on literal inputs, nulls included."""

import math

import pytest
from pyspark.sql import functions as F

from gymlake.functions import stats as S
from gymlake.operators import rates as R


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("k,n,want", [(0, 20, (0.0, 0.0, 0.161130)), (20, 20, (1.0, 0.838870, 1.0)), (5, 10, (0.5, 0.236591, 0.763409)), (50, 100, (0.5, 0.403830, 0.596170)), (0, 0, (0.0, 0.0, 0.0))])
def test_wilson(spark, k, n, want):
    got = value(spark, S.wilson(F.lit(k), F.lit(n)))
    assert tuple(round(x, 5) for x in got) == pytest.approx(want, abs=2e-5)


@pytest.mark.parametrize("a,b,p", [(0, 10, 0.001953125), (5, 5, 1.0), (0, 0, 1.0), (9, 2, 0.065430), (20, 3, 0.000488)])
def test_mcnemar(spark, a, b, p):
    assert value(spark, S.mcnemar_exact(F.lit(a), F.lit(b))) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("k,n,p", [(3, 50, 0.1), (0, 7, 0.3), (120, 4000, 0.04), (900, 100000, 0.01), (7, 7, 0.2), (-1, 5, 0.5)])
def test_binomial_tail(spark, k, n, p):
    want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
    assert value(spark, S.binomial_tail(F.lit(k), F.lit(n), p)) == pytest.approx(min(want, 1.0), rel=1e-9)


def test_binomial_of_many_trials_does_not_underflow(spark):
    assert value(spark, S.binomial_two_sided(F.lit(500_000), F.lit(1_000_000))) == pytest.approx(1.0, abs=1e-2)
    assert 0 < value(spark, S.binomial_two_sided(F.lit(498_000), F.lit(1_000_000))) < 1e-4


@pytest.mark.parametrize("p,z", [(0.975, 1.959964), (0.5, 0.0), (0.001, -3.090232), (0.0, None), (1.0, None)])
def test_normal_quantile(spark, p, z):
    got = value(spark, S.normal_quantile(F.lit(p)))
    assert got is None if z is None else got == pytest.approx(z, abs=1e-6)


def test_classify(spark):
    rows = [(-0.05, 0.29), (0.03, 0.21), (-0.21, -0.03)]
    got = [r[0] for r in spark.createDataFrame(rows, "lo double, hi double").select(S.classify_interval(F.col("lo"), F.col("hi"))).collect()]
    assert got == ["no_effect", "gain", "regression"]


def rollouts(spark, rows):
    return spark.createDataFrame(rows, "task_id long, arm string, seq long, verdict boolean")


def test_rates_skip_what_was_never_judged(spark):
    df = rollouts(spark, [(1, "a", 1, True), (1, "a", 2, False), (1, "a", 3, None), (1, "a", 4, True), (2, "a", 1, None), (2, "a", 2, None)])
    got = {r["task_id"]: r for r in df.groupBy("task_id").agg(R.rate_judged().alias("j"), R.rate_strict().alias("s")).collect()}
    assert got[1]["j"] == pytest.approx(2 / 3) and got[1]["s"] == 0.5 and got[2]["j"] is None and got[2]["s"] == 0.0


def test_pairs_need_both_arms(spark):
    df = rollouts(spark, [(1, "baseline", 1, False), (1, "final", 1, True), (2, "baseline", 1, True), (3, "final", 1, None), (3, "baseline", 1, True)])
    assert [tuple(r) for r in R.paired(df).collect()] == [(1, 0.0, 1.0, 1.0)]


def test_rolling_rate_by_bucket(spark):
    df = rollouts(spark, [(1, "a", i, v) for i, v in enumerate([True, True, True, False])] + [(2, "a", 0, None)])
    got = {(r["task_id"], r["seq"]): (r["rolling_rate"], r["in_band"]) for r in R.rolling_rate(df, ["task_id"], ["seq"], width=3).collect()}
    assert got[(1, 3)] == (pytest.approx(2 / 3), False) and got[(2, 0)] == (None, None)


@pytest.mark.parametrize("deltas,want", [([], (0.0, 0.0, 0.0)), ([0.4], (0.4, -1.0, 1.0)), ([1.0] * 12, (1.0, 1.0, 1.0))])
def test_bootstrap_of_few_units(spark, deltas, want):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(deltas)], "task_id long, delta double")
    r = R.bootstrap_interval(df, 100).first()
    assert (r["point"], r["low"], r["high"]) == pytest.approx(want) and r["n_units"] == len(deltas)


def test_bootstrap_straddles_zero(spark):
    df = spark.createDataFrame([(i, 1.0 if i % 2 else -1.0) for i in range(12)], "task_id long, delta double")
    r = R.bootstrap_interval(df, 300).first()
    assert r["low"] < 0 < r["high"] and r["point"] == 0


def test_failure_ladder(spark):
    rows = [("E", None, None, 3), (None, True, None, 3), (None, False, "checker_unsafe", 0), (None, False, "checker_false", 0), (None, False, "checker_false", 12), (None, False, None, 4), (None, False, "checker_false", 4)]
    df = spark.createDataFrame(rows, "label string, verdict boolean, harness string, steps int")
    got = [r[0] for r in df.select(R.failure_reason(F.col("label"), F.col("verdict"), F.col("harness"), F.col("steps"))).collect()]
    assert got == ["rollout_error:E", "passed", "checker_unsafe", "agent_no_tool_call", "agent_max_steps", "other", "checker_false"]

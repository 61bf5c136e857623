"""Rates, pairing and windows over rollouts; every function is DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_number(verdict: str | Column) -> Column:
    return (F.col(verdict) if isinstance(verdict, str) else verdict).cast("int").cast("double")


def rate_judged(verdict: str = "verdict") -> Column:
    """Mean of verdicts that exist; null where none does. A rollout never judged is not a failure."""
    return F.avg(as_number(verdict))


def rate_strict(verdict: str = "verdict") -> Column:
    """Mean with unjudged rollouts as failures (held-out validation)."""
    return F.avg(as_number(F.coalesce(F.col(verdict), F.lit(False))))


def pass_rates(rollouts: DataFrame, *keys: str) -> DataFrame:
    return rollouts.groupBy(*keys).agg(rate_judged().alias("pass_rate"), F.count("verdict").alias("n_judged"), F.count("*").alias("n_rollouts"))


def in_band(rate: Column, low: float, high: float) -> Column:
    """Inclusive; null stays null."""
    return rate.between(low, high)


def rate_group(rate: Column) -> Column:
    return F.when(rate == 1.0, "ceiling").when(rate == 0.0, "floor").when(rate.isNotNull(), "band")


def paired(rollouts: DataFrame, unit: str = "task_id", arm: str = "arm", base: str = "baseline", final: str = "final") -> DataFrame:
    """One row per unit with a judged rollout in both arms: base_rate, final_rate, delta.

    Both arms come from one aggregation, so no join and a single shuffle.
    """
    rates = rollouts.groupBy(unit).agg(
        F.avg(F.when(F.col(arm) == base, as_number("verdict"))).alias("base_rate"),
        F.avg(F.when(F.col(arm) == final, as_number("verdict"))).alias("final_rate"),
    )
    return rates.where("base_rate is not null and final_rate is not null").withColumn("delta", F.col("final_rate") - F.col("base_rate"))


def movement(pairs: DataFrame) -> DataFrame:
    """Wins, losses, ties and two-level means over paired units."""
    return pairs.agg(
        F.count("*").alias("n_units"), F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") < 0).alias("losses"),
        F.count_if(F.col("delta") == 0).alias("ties"), F.avg("base_rate").alias("base_mean"), F.avg("final_rate").alias("final_mean"), F.avg("delta").alias("mean_delta"),
    )


def discordance(pairs: DataFrame, base: str, final: str) -> DataFrame:
    b, f = F.col(base), F.col(final)
    return pairs.agg(F.count_if(b & f).alias("both"), F.count_if(b & ~f).alias("only_base"), F.count_if(~b & f).alias("only_final"), F.count_if(~b & ~f).alias("neither"))


def rolling_rate(outcomes: DataFrame, keys: Sequence[str], order: Sequence[str], width: int = 20, low: float = 0.2, high: float = 0.6) -> DataFrame:
    """Mean verdict of the last `width` outcomes of each key, at every outcome."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(width - 1), 0)
    rate = F.avg(as_number("verdict")).over(w)
    return outcomes.withColumn("rolling_rate", rate).withColumn("in_band", in_band(F.col("rolling_rate"), low, high))


def histogram(df: DataFrame, key: str) -> DataFrame:
    """Counts and shares. The total is a one-row aggregate of the counts, not of the rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", (F.col("n") / F.col("total").cast("double")).alias("share"))


def failure_reason(label: Column, verdict: Column, harness: Column, steps: Column) -> Column:
    """One reason per rollout, the first that applies."""
    return (
        F.when(label.isNotNull(), F.concat(F.lit("rollout_error:"), label))
        .when(verdict, "passed")
        .when(harness.isNotNull() & (harness != "checker_false"), harness)
        .when(steps == 0, "agent_no_tool_call")
        .when(steps >= 10, "agent_max_steps")
        .otherwise(F.coalesce(harness, F.lit("other")))
    )


def error_bucket(error_type: Column, message: Column) -> Column:
    """Bucket of an exception by its type and message."""
    return (
        F.when((error_type == "KeyError") & message.contains("next_state"), "sim_missing_next_state")
        .when(error_type.isin("ValueError", "JSONDecodeError"), "sim_invalid_json")
        .otherwise(F.concat(F.lit("rollout_error:"), error_type))
    )


def nearest_rank(df: DataFrame, value: str, ranks: dict[str, float], order: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Values at index half-even-round(q * (n - 1)) of the ordered values, one column per name."""
    w = Window.partitionBy(*keys).orderBy(value, *order)
    size = Window.partitionBy(*keys)
    placed = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(size))
    picks = [F.max(F.when(F.col("_at") == F.bround(F.lit(q).cast("double") * (F.col("_n") - 1)).cast("int"), F.col(value))).alias(name) for name, q in ranks.items()]
    return placed.groupBy(*keys).agg(*picks)


#: Units of a bootstrap, at most: their differences are one array, which each task holds. They are tasks, already aggregated.
MAX_UNITS = 1_000_000


def bootstrap_means(pairs: DataFrame, resamples: int, seed: int = 0, unit: str = "task_id") -> DataFrame:
    """(resample, mean): means of `delta` over units drawn with replacement, from hashed draws.

    Draw d of a resample takes the unit at position md5(seed|resample|d) mod n, by unit. A resample is one row, its draws a fold
    over that row, so nothing is multiplied or shuffled but the array of units, which goes to each task. More than MAX_UNITS units
    are an error; none give no means.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct(unit, "delta"))), lambda x: x["delta"])
    one = pairs.agg(listed.alias("d")).where(F.size("d") > 0)
    n = F.size("d")
    few = F.when(n <= MAX_UNITS, n).otherwise(F.raise_error(F.lit(f"more than {MAX_UNITS} units")).cast("int"))

    def drawn(i: Column) -> Column:
        digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("resample").cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long")
        return F.element_at("d", (digest % F.col("n") + 1).cast("int"))

    rows = pairs.sparkSession.range(resamples).withColumnRenamed("id", "resample").crossJoin(F.broadcast(one)).withColumn("n", few)  # one row
    total = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0).cast("double"), lambda acc, i: acc + drawn(i))
    return rows.select("resample", (total / F.col("n")).alias("mean"))


def bootstrap_interval(pairs: DataFrame, resamples: int = 10_000, seed: int = 0, alpha: float = 0.05, unit: str = "task_id") -> DataFrame:
    """One row: point, low, high, n_units. No units: zeros; one unit: (point, -1, 1)."""
    means = bootstrap_means(pairs, resamples, seed, unit)
    ends = nearest_rank(means, "mean", {"lo": alpha / 2, "hi": 1 - alpha / 2}, ["resample"])
    point = pairs.agg(F.count("*").alias("n_units"), F.avg("delta").alias("p"))
    zero, one = F.lit(0.0).cast("double"), F.lit(1.0).cast("double")
    n = F.col("n_units")
    return point.crossJoin(ends).select(
        "n_units", F.coalesce("p", zero).alias("point"),
        F.when(n == 0, zero).when(n == 1, -one).otherwise(F.col("lo")).alias("low"),
        F.when(n == 0, zero).when(n == 1, one).otherwise(F.col("hi")).alias("high"),
    )

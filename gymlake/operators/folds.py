"""Rollouts as ordered folds: each step's predicted state is completed from the repaired state before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gymlake.functions import state as S
from gymlake.operators.verdicts import with_verdicts


def fold_states(steps: DataFrame, keys: list[str], order: str, predicted: str, initial: Column, schema: T.StructType, max_steps: int = 10_000) -> DataFrame:
    """keys and `states`, an array of (place, at, state): the initial one at place 0 with null `at`, then one per step by `order`.

    A null prediction keeps the state before it. initial may read the key columns. Steps with equal order go by their prediction's
    JSON text; repeated steps are folded each. A rollout is one row, so one of more than max_steps is an error, never cut.
    """
    step = F.struct(F.col(order).alias("at"), F.to_json(predicted).alias("tie"), F.col(predicted).alias("state"))
    rows = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(step["at"].alias("at"), step["tie"].alias("tie")))).alias("order"), F.collect_list(step).alias("steps"))
    in_order = F.transform("order", lambda o: F.element_at(F.filter("steps", lambda s: s["at"].eqNullSafe(o["at"]) & s["tie"].eqNullSafe(o["tie"])), 1))
    few = F.when(F.size("steps") <= max_steps, in_order).otherwise(F.raise_error(F.lit(f"a rollout has more than {max_steps} steps")).cast(T.ArrayType(T.StructType([T.StructField("at", steps.schema[order].dataType), T.StructField("tie", T.StringType()), T.StructField("state", steps.schema[predicted].dataType)]))))
    at = steps.schema[order].dataType
    one = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("at", at), T.StructField("state", schema)])
    first = F.array(F.struct(F.lit(0).alias("place"), F.lit(None).cast(at).alias("at"), initial.cast(schema).alias("state"))).cast(T.ArrayType(one))

    def next_state(done: Column, now: Column) -> Column:
        before = F.element_at(done, -1)["state"]
        after = F.struct(F.size(done).alias("place"), now["at"].alias("at"), S.complete(before, now["state"], schema).cast(schema).alias("state"))
        return F.concat(done, F.array(after)).cast(T.ArrayType(one))

    return rows.select(*keys, F.aggregate(few, first, next_state).alias("states"))


def step_verdicts(folded: DataFrame, keys: list[str], predicates: dict[str, str], schema: T.StructType) -> DataFrame:
    """Per rollout and predicate: whether it ever holds, holds on every state, holds at the end, and where it first fails.

    Columns name_ever, name_always, name_at_end, name_first_failure (the state's place; null if none) and name_error (what the
    first state at which it could not be judged raised; null if none). Each state is judged once, by the state predicate.
    """
    rows = folded.select(*keys, F.inline("states"))
    judged = with_verdicts(rows, predicates, schema)
    out: list[Column] = [F.count("*").alias("n_states")]
    for name in predicates:
        v, place = F.col(name), F.col("place")
        out += [
            F.bool_or(v).alias(f"{name}_ever"), F.bool_and(v).alias(f"{name}_always"), F.max_by(v, place).alias(f"{name}_at_end"),
            F.min(F.when(~v, place)).alias(f"{name}_first_failure"), F.min_by(F.col(f"{name}_error"), F.when(F.col(f"{name}_error").isNotNull(), place)).alias(f"{name}_error"),
        ]
    return judged.groupBy(*keys).agg(*out)

"""Audit of stored tasks: initial states and checkers against their family's declaration, and what justifies to take a task out."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gymlake.functions import predicates as P
from gymlake.functions import state as S
from gymlake.sources.catalog import TOOLS


def names_in(t: T.DataType) -> set[str]:
    """Field names at any depth."""
    if isinstance(t, T.StructType):
        return {f.name for f in t.fields} | {n for f in t.fields for n in names_in(f.dataType)}
    return names_in(t.elementType) if isinstance(t, T.ArrayType) else set()


def example(t: T.DataType) -> object:
    """A state with one object in each list and every field at its neutral value: the best case for any checker."""
    if isinstance(t, T.StructType):
        return {f.name: example(f.dataType) for f in t.fields}
    if isinstance(t, T.ArrayType):
        return [example(t.elementType)] if isinstance(t.elementType, T.StructType) else []
    return {"string": "", "bigint": 0, "double": 0, "boolean": False}.get(t.simpleString(), {})


def without_log(raw: Column) -> Column:
    """A raw state without the harness's own log; texts that are no objects stay as they are."""
    members = F.map_filter(F.from_json(raw, "map<string,variant>"), lambda k, _: k != "_action_log")
    return F.when(S.kind_of(raw) == "object", F.to_json(members)).otherwise(raw)


def _checked(families: dict[str, T.StructType]):
    keys = {f: names_in(t) | {p for _, g, parameters in TOOLS if g == f for p in parameters} for f, t in families.items()}
    tools = {f: {n for n, g, _ in TOOLS if g == f} for f in families}
    examples = {f: json.dumps(example(t)) for f, t in families.items()}

    def one(family: str | None, end: str | None, steps: str | None) -> dict | None:
        if family not in examples:
            return None
        problems = [x for p in ([end or "True"] + ([steps] if steps else [])) for x in P.static_problems(p, keys[family], tools[family]) if x.startswith(("key:", "tool:", "unsafe:syntax"))]
        state = json.loads(examples[family])
        said = "" if P.vet(steps or end or "True") else P.program(steps, "states")([state]) if steps else P.program(end or "True", "state")(state)
        return {"problems": problems, "raised": said.split(":", 1)[1] if ":" in said else None}

    @F.pandas_udf("struct<problems:array<string>,raised:string>")
    def run(family: pd.Series, end: pd.Series, steps: pd.Series) -> pd.DataFrame:
        out = [one(*r) or {"problems": None, "raised": None} for r in zip(family, end, steps, strict=True)]
        return pd.DataFrame(out, columns=["problems", "raised"])

    return run


def audit_tasks(tasks: DataFrame, families: dict[str, T.StructType] = S.FAMILIES) -> DataFrame:
    """tasks (task_id, tool_family, initial_state: JSON text, predicate, step_wise_predicate) with what the audit says.

    skipped: the family has no declaration (then the rest is null); state_problems; checker_problems (keys and tools that do not
    exist, in either predicate, or one that does not parse); raises: the class of error of the checker on the
    family's example state, null if none; condemned: it has problems and raises even there. A null state has no objects, a null
    predicate holds always.
    """
    found = _checked(families)(F.col("tool_family"), F.col("predicate"), F.col("step_wise_predicate"))
    rows = tasks.withColumn("_found", found).withColumn("_raw", without_log(F.coalesce("initial_state", F.lit("{}"))))
    problems = F.lit(None).cast("array<string>")
    for family, t in families.items():
        problems = F.when(F.col("tool_family") == family, S.violations(F.col("_raw"), t)).otherwise(problems)
    rows = rows.withColumn("state_problems", problems).withColumn("checker_problems", F.col("_found.problems")).withColumn("raises", F.col("_found.raised"))
    rows = rows.withColumn("skipped", F.col("checker_problems").isNull())
    return rows.withColumn("condemned", F.coalesce((F.size("checker_problems") > 0) & F.col("raises").isNotNull(), F.lit(False))).drop("_found", "_raw")


def condemnations(audited: DataFrame) -> DataFrame:
    """The verdicts that a bank takes from an audit."""
    return audited.where("condemned").select("task_id", F.lit(0).alias("report_seq"), F.lit(True).alias("unpassable"), F.lit(False).alias("too_weak"))

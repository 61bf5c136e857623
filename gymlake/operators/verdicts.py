"""Predicates judged over a table of states."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gymlake.functions import predicates as P


def with_verdicts(df: DataFrame, predicates: dict[str, str], schema: T.StructType, root: str = "state") -> DataFrame:
    """df with `name` (boolean, never null) and `name_error` (why it is false without having been judged so; null else) per predicate.

    The predicates read the column `root`, a state of this schema or, for `states`, an array of them. Those with a native form are
    columns of one projection; the others share one pass in Python, which reads each state once.
    """
    compiled = {name: P.compile_predicate(p, schema, **{root: F.col(root)}) for name, p in predicates.items()}
    python = {name: predicates[name] for name, c in compiled.items() if c.backend == "python"}
    if python:
        inner = df.withColumn("_json", F.to_json(root, {"ignoreNullFields": "false"}))
        fields = [T.StructField(f"_v_{name}", T.StringType()) for name in python]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            programs = [P.program(p, root) for p in python.values()]
            for batch in batches:
                states = [None if x is None else json.loads(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], *(pa.array([one(x) for x in states], pa.string()) for one in programs)], [*batch.schema.names[:-1], *(f.name for f in fields)]
                )

        df = inner.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))
    for name, c in compiled.items():
        if name in python:
            verdict = F.col(f"_v_{name}")
            df = df.withColumn(name, verdict == "t").withColumn(f"{name}_error", F.when(F.length(verdict) > 1, verdict)).drop(f"_v_{name}")
        else:
            df = df.withColumn(name, c.column).withColumn(f"{name}_error", c.error)
    return df

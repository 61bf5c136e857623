"""Look-ups in playbooks, summaries of rollouts, tables as text, measures from a second source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gymlake.functions.text import normalise_tag


def entries_by_id(entries: DataFrame, wanted: DataFrame, key: str = "playbook_id") -> DataFrame:
    """wanted (key, entry_id) with the first entry, by pos, of that id in the playbook, as `entry`; null where there is none.

    An id that is asked for twice is answered twice.
    """
    first = entries.groupBy(key, "entry_id").agg(F.min_by(F.struct(*[c for c in entries.columns if c not in (key, "entry_id")]), "pos").alias("entry"))
    return wanted.join(first, [key, "entry_id"], "left")


def entries_by_tag(entries: DataFrame, wanted: DataFrame, key: str = "playbook_id") -> DataFrame:
    """All entries whose tag is the wanted one (key, tag), both in normal form, with that form as `tag`."""
    asked = wanted.select(key, normalise_tag(F.col("tag")).alias("tag")).distinct()
    return entries.withColumn("tag", normalise_tag(F.col("tag"))).join(asked, [key, "tag"], "left_semi")


def numbered_calls(steps: DataFrame, keys: list[str], order: str, tool: str, arguments: str) -> DataFrame:
    """keys and `calls`: an array of (step, tool, arguments), numbered from 1 by order; steps without a tool count for nothing.

    A rollout is one row; rollouts without calls have an empty array.
    """
    call = F.struct(F.col(order).alias("at"), F.col(tool).alias("tool"), F.col(arguments).alias("arguments"))
    listed = F.array_sort(F.collect_list(F.when(F.col(tool).isNotNull(), call)))
    return steps.groupBy(*keys).agg(F.transform(listed, lambda c, i: F.struct((i + 1).alias("step"), c["tool"].alias("tool"), c["arguments"].alias("arguments"))).alias("calls"))


def calls_text(calls: Column) -> Column:
    """A line per call, as prompts show them."""
    return F.array_join(F.transform(calls, lambda c: F.concat(c["step"].cast("string"), F.lit(". "), c["tool"], F.lit("("), F.coalesce(c["arguments"], F.lit("")), F.lit(")"))), "\n")


def markdown_table(rows: DataFrame, columns: dict[str, Column], order: str) -> DataFrame:
    """(place, line) of a Markdown table of a small report: the heads, a rule, then a line per row by `order`. Nulls are a dash, bars are escaped."""
    cell = lambda c: F.replace(F.coalesce(c.cast("string"), F.lit("-")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns.values()]), F.lit(" |"))
    body = rows.select(F.col(order).alias("_by"), line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("_by", "line"))).alias("lines"))  # a report: few rows
    head = F.array(F.lit("| " + " | ".join(columns) + " |"), F.lit("|" + "---|" * len(columns)))
    return body.select(F.posexplode(F.concat(head, F.transform("lines", lambda x: x["line"]))).alias("place", "line"))


def first_measured(expected: DataFrame, sources: dict[str, DataFrame], keys: list[str], measure: str) -> DataFrame:
    """Every expected cell with the measure of the first source, in order, that has one, and that source's name; nulls where none has."""
    out = expected
    for name, found in sources.items():
        out = out.join(found.select(*keys, F.col(measure).alias(f"_{name}")), keys, "left")
    taken = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n in sources])
    return out.select(*expected.columns, F.coalesce(*[F.col(f"_{n}") for n in sources]).alias(measure), taken.alias("source"))

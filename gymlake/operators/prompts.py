"""Prompts of judged turns: what was asked, what came before, and templates with named slots."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from gymlake.functions.text import trimmed

#: Headings that judges are given.
HISTORY = "# Context (Historical Interactions):\n\n"
TURN = "# Current Turn:\n\n"
PREDICTED = "**World Model Output (Simulated):**\n"
TRUTH = "**Ground Truth (Real Output):**\n"


def at_turn(texts: Column, turn: Column) -> Column:
    """The text of a turn, counted from 1 (earlier ones are the first); null beyond the last."""
    return F.try_element_at(texts, F.greatest(turn, F.lit(1)).cast("int"))


def current_prompt(given: Column, prompts: Column, turn: Column) -> Column:
    """The prompt that a job carries itself, else that of its turn, else an empty text."""
    return F.coalesce(F.nullif(given, F.lit("")), at_turn(prompts, turn), F.lit(""))


def ground_truth(responses: Column, turn: Column) -> Column:
    return F.coalesce(at_turn(responses, turn), F.lit(""))


def history(prompts: Column, responses: Column, turn: Column) -> Column:
    """Prompts and responses of the turns before, where there are both, under a heading; empty without any."""
    n = F.greatest(F.least(turn - 1, F.size(prompts), F.size(responses)), F.lit(0)).cast("int")
    lines = F.zip_with(F.slice(prompts, F.lit(1), n), F.slice(responses, F.lit(1), n), lambda p, r: F.concat(p, F.lit("\n"), r, F.lit("\n\n")))
    return F.when(n > 0, F.concat(F.lit(HISTORY), F.array_join(lines, ""))).otherwise("")


def fenced(heading: str, text: Column) -> Column:
    return F.concat(F.lit(f"{heading}```\n"), text, F.lit("\n```"))


def fill(template: str, **slots: Column) -> Column:
    """A template, its {slots} filled with Columns and doubled braces made single, without white space around it.

    A slot without a value raises while planning; texts in slots are not read as templates.
    """
    parts = []
    for text, slot, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if slot is not None:
            parts.append(slots[slot])
    return trimmed(F.concat(*parts))

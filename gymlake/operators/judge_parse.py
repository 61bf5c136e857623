"""From a judge's raw reply to scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gymlake.functions import text as X
from gymlake.sources.tables import DIMENSIONS


def coerce_score(raw: Column) -> Column:
    """A score (variant) to 0..5: whole numbers as they are, others rounded half to even, true 1, "4/5" its first part if that is a whole number; anything else 0."""
    kind, text = F.schema_of_variant(raw), F.try_variant_get(raw, "$", "string")
    part = X.trimmed(F.split_part(text, F.lit("/"), F.lit(1)))
    whole = (
        F.when(kind == "BOOLEAN", (text == "true").cast("int")).when(kind == "STRING", F.when(part.rlike("^[+-]?[0-9]+$"), part.try_cast("int")))
        .when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.bround(text.try_cast("double"), 0).cast("int"))
    )
    return F.when(F.coalesce(whole, F.lit(0)) > 0, F.least(whole, F.lit(5))).otherwise(F.lit(0))


def total_score(*scores: Column) -> Column:
    """Mean of the positive ones; 0 where none is."""
    valid = F.filter(F.array(*scores), lambda s: s > 0)
    return F.coalesce(F.try_divide(F.aggregate(valid, F.lit(0), lambda a, s: a + s).cast("double"), F.size(valid)), F.lit(0.0).cast("double"))


def string_list(raw: Column) -> Column:
    """A JSON list to its members as text; a non-empty text to a list of itself; else an empty list."""
    as_list = F.from_json(raw, "array<string>")
    own = F.when((raw.isNotNull()) & (raw != "") & (raw != "null"), F.array(raw)).otherwise(F.array().cast("array<string>"))
    return F.when(F.startswith(F.ltrim(raw), F.lit("[")) & as_list.isNotNull(), as_list).otherwise(own)


def parse_judgements(df: DataFrame, raw: str = "raw", tag: str = "final_evaluation") -> DataFrame:
    """Adds the five dimensions, total_score, strengths, weaknesses, success, error_message.

    Thinking goes first (an unclosed one ends where the tag opens); then of the last
    tagged block, or the whole, the fenced object or the last balanced one, each
    preferably with scores, read leniently, and at last the scores alone. A reply
    with a scores object succeeds, also where no score is valid; one without fails
    with zeros.
    """
    body = F.coalesce(X.last_tag_block(F.col("_clean"), tag), F.col("_clean"))
    df = df.withColumn("_clean", X.strip_thinking(F.coalesce(F.col(raw), F.lit("")), tag))
    df = df.withColumn("_body", body).withColumn("_object", F.coalesce(X.fenced_json(F.col("_body")), X.outer_object(F.col("_body"), True, '"scores"')))
    shape = "scores variant, strengths variant, weaknesses variant"
    df = df.withColumn("_read", X.lenient_json(F.col("_object"), shape)).withColumn("_alone", X.lenient_json(X.scores_alone(F.col("_body")), "variant"))
    is_object = lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    df = df.withColumn("_scores", F.when(is_object(F.col("_read.scores")), F.col("_read.scores")).when(is_object(F.col("_alone")), F.col("_alone")))
    for d in DIMENSIONS:
        df = df.withColumn(d, coerce_score(F.try_variant_get("_scores", f"$.{d}", "variant")))
    df = df.withColumn("total_score", total_score(*[F.col(d) for d in DIMENSIONS])).withColumn("success", F.col("_scores").isNotNull())
    for c in ("strengths", "weaknesses"):
        df = df.withColumn(c, string_list(F.try_variant_get(f"_read.{c}", "$", "string")))
    message = F.when(X.trimmed(F.coalesce(F.col(raw), F.lit(""))) == "", "Empty output").when(F.col("_object").isNull() & ~F.col("success"), "No JSON object found").when(~F.col("success"), "No scores found")
    return df.withColumn("error_message", message).drop("_clean", "_body", "_object", "_read", "_alone", "_scores")


def bounded_score(raw: Column) -> tuple[Column, Column]:
    """(score, error) of a reply that should hold a score in [0, 1]."""
    value = F.get_json_object(raw, "$.score").try_cast("double")
    fine = value.between(0.0, 1.0)
    return F.when(fine, value).otherwise(F.lit(0.0).cast("double")), F.when(~F.coalesce(fine, F.lit(False)), "score missing or out of range")


def verdict(mode: str, checker: Column, score: Column, threshold: float) -> Column:
    """checker, llm, or both, where the checker decides."""
    by_score = score >= threshold
    return checker if mode in ("checker", "both") else by_score

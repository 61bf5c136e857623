"""Inline dimensions: domains, tools and their families, graph sizes per model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gymlake.functions.text import model_key

# The benchmark's domains and the tags of their outputs.
DOMAINS = ("terminal", "swe", "search", "mcp", "android", "web", "os")
RESPONSE_MARKER = "**Environment Observation:**"
RESPONSE_TAG = "predicted_observation"
JUDGE_TAG = "final_evaluation"

# Tool, family, parameters.
TOOLS = (
    ("list_collections", "mcp_api", ()),
    ("query_records", "mcp_api", ("collection", "filter_expr")),
    ("create_record", "mcp_api", ("collection", "fields")),
    ("update_record", "mcp_api", ("record_id", "fields")),
    ("delete_record", "mcp_api", ("record_id",)),
    ("list_directory", "terminal_ops", ("directory",)),
    ("read_file", "terminal_ops", ("path",)),
    ("write_file", "terminal_ops", ("path", "text")),
    ("move_path", "terminal_ops", ("source", "target")),
    ("remove_path", "terminal_ops", ("path",)),
    ("make_directory", "terminal_ops", ("directory",)),
    ("web_search", "web_research", ("query",)),
    ("open_result", "web_research", ("rank",)),
    ("extract_snippet", "web_research", ("rank",)),
    ("save_note", "web_research", ("headline", "body")),
    ("list_saved_notes", "web_research", ()),
    ("show_file", "code_repo", ("module",)),
    ("apply_patch", "code_repo", ("module", "diff")),
    ("run_test_suite", "code_repo", ("suite",)),
    ("vcs_status", "code_repo", ()),
    ("open_branch", "code_repo", ("branch",)),
)
DESTRUCTIVE = ("delete_record", "remove_path", "delete_note")
HELD_OUT_FAMILY = "web_research"
# Nodes of the sampled tool graph by model, an example of the table that `graph_size` takes; the default comes last.
GRAPH_SIZES = (("agent-8b", None, 4, 4), ("simulator-35b", None, 4, 4), (None, None, 3, 3))


def domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, RESPONSE_MARKER, RESPONSE_TAG, JUDGE_TAG, f"prompts/{d}/system_prompt.txt", f"prompts/{d}/judge_system_prompt.txt") for d in DOMAINS], "domain string, marker string, tag string, judge_tag string, prompt_path string, judge_prompt_path string")


def tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, f, list(p)) for n, f, p in TOOLS], "name string, family string, params array<string>")


def registered(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Both; a name given twice stops the query."""
    both = registry.unionByName(new)
    counts = both.groupBy("name").agg(F.count("*").alias("_n"))
    bad = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate tool: "), "name")).cast("long")).otherwise(F.col("_n"))
    return both.join(counts.select("name", bad.alias("_n")), "name").where("_n = 1").drop("_n")


def graph_size(requests: DataFrame, sizes: DataFrame) -> DataFrame:
    """lo and hi for (model, family): the family's row, else the model's, else the default; lo >= 1, hi >= lo."""
    keyed = requests.withColumn("_m", model_key(F.col("model")))
    s = lambda cond, p: sizes.where(cond).select(F.col("model").alias(f"{p}m"), F.col("family").alias(f"{p}f"), F.col("lo").alias(f"{p}lo"), F.col("hi").alias(f"{p}hi"))
    by_family, by_model, default = s("family is not null", "a"), s("model is not null and family is null", "b"), s("model is null", "c")
    joined = keyed.join(by_family, (F.col("_m") == F.col("am")) & (F.col("family") == F.col("af")), "left").join(by_model, F.col("_m") == F.col("bm"), "left").crossJoin(F.broadcast(default))  # the default is one row
    lo = F.greatest(F.coalesce("alo", "blo", "clo"), F.lit(1))
    return joined.select(*requests.columns, lo.alias("lo"), F.greatest(F.coalesce("ahi", "bhi", "chi"), lo).alias("hi"))

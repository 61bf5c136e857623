"""File sources and sinks: JSONL sets, strict and headed JSONL, banks, CSV, prompts, snapshots.

Paths go through Spark's and Hadoop's file systems, so any store that Spark
reads will do. Sinks use Spark's commit protocol: readers see whole results or none.
"""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = "task string, id long, prompt {lists}, response {lists}, current_prompt string, system_str string, turn_idx int, total_turns int"


def read_samples(spark: SparkSession, folder: str, pattern: str = "*_test.jsonl") -> DataFrame:
    """All samples of a folder's files, with the file each came from. prompt and response may be a text or a list of texts; blank lines are no rows."""
    raw = spark.read.schema(SAMPLE.format(lists="variant")).option("pathGlobFilter", pattern).json(folder)

    def listed(name: str) -> Column:
        c = F.col(name)
        return F.when(F.schema_of_variant(c).startswith("ARRAY"), F.try_variant_get(c, "$", "array<string>")).when(c.isNotNull(), F.array(F.try_variant_get(c, "$", "string")))

    return raw.select(*[listed(c).alias(c) if c in ("prompt", "response") else F.col(c) for c in raw.columns], F.col("_metadata.file_name").alias("file_name"))


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines; strict fails on the first line that does not parse, else such lines are dropped."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("mode", mode).json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): non-blank lines of each file, numbered from 0 within it.

    A file is read by as many tasks as it has splits: lines are numbered within their split, in the order in which they are read,
    and a split begins where the counts of those before it end. That takes two scans and moves no line. Splits follow from file
    sizes and settings alone, so both scans have the same.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = spark.read.text(path).select(*split, "value").where(F.trim("value") != "").withColumn("id", F.monotonically_increasing_id())
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    splits = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    splits = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(splits, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("line"), "value")


def strict_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed lines; a line that is no JSON object stops the query with its file and number."""
    where = F.concat("file", F.lit(":"), (F.col("line") + 1).cast("string"), F.lit(": not a JSON object"))
    parsed = F.from_json("value", schema)
    ok = F.try_parse_json("value").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{"))
    return numbered_lines(spark, path).select("file", "line", F.when(ok, parsed).otherwise(F.raise_error(where).cast(T._parse_datatype_string(schema))).alias("row"))


def header_and_rows(spark: SparkSession, path: str, header: str, row: str) -> tuple[DataFrame, DataFrame]:
    """The summary on a report's first line, and the failures on the others."""
    lines = numbered_lines(spark, path)
    first = lines.where("line = 0").select("file", F.from_json("value", header).alias("h")).select("file", "h.*")
    rest = lines.where("line > 0").select("file", F.from_json("value", row).alias("r")).select("file", "r.*")
    return first, rest


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in (found or []))


def the_file(spark: SparkSession, pattern: str) -> str:
    """The one path that matches; none or several is an error."""
    found = glob_paths(spark, pattern)
    if len(found) != 1:
        raise FileNotFoundError(f"no file matches {pattern}") if not found else ValueError(f"{len(found)} files match {pattern}: {found[:5]}")
    return found[0]


def first_existing(spark: SparkSession, *patterns: str) -> str | None:
    """The first path of the first pattern that matches anything, as for a file or a folder with a results file."""
    return next((found[0] for p in patterns if (found := glob_paths(spark, p))), None)


def read_iterations(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """iteration_N.json documents with N as a number, so 10 comes after 2."""
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "iteration_*.json").json(folder)
    return df.withColumn("iteration", F.regexp_extract("_metadata.file_name", r"iteration_(\d+)", 1).cast("int"))


def read_playbooks(spark: SparkSession, path: str) -> DataFrame:
    """Playbook documents, unwrapped from an iteration record; the older format with modules and no entries is an error."""
    v = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.parse_json("value").alias("v"))
    inner = F.coalesce(F.try_variant_get("v", "$.playbook_after", "variant"), F.col("v"))
    v = v.select("file", inner.alias("v"))
    stale = F.try_variant_get("v", "$.modules", "variant").isNotNull() & F.try_variant_get("v", "$.entries", "variant").isNull()
    entries = F.from_json(F.to_json(F.try_variant_get("v", "$.entries", "variant")), "array<struct<entry_id:string,tag:string,content:string,helpful:long,harmful:long,version:int>>")
    kept = F.when(stale, F.raise_error(F.concat(F.lit("stale playbook format: "), "file")).cast("string")).otherwise(F.to_json(F.col("v")))
    return v.select("file", F.get_json_object(kept, "$.version").alias("version"), F.posexplode_outer(entries).alias("pos", "e")).select("file", "version", "pos", "e.*")


def _as_it_is(name: str) -> str:
    """A name for use in a glob."""
    return re.sub(r"([\\{}\[\]*?,^-])", r"\\\1", name)


def read_bank(spark: SparkSession, root: str, schema: str, families: list[str] | None = None, gcs: list[int] | None = None, lines: bool = False) -> DataFrame:
    """Tasks of <family>/gc<N>/*.json below root, with tool_family and gc from the path; corrupt files are skipped.

    Only the folders of the families and sizes that are asked for are listed and read; no folder that matches gives no rows. A file
    holds one task, or with `lines` one in each line.
    """
    one_of = lambda names: "{" + ",".join(names) + "}"
    family = "*" if families is None else one_of(map(_as_it_is, families))
    pattern = f"{root}/{family}/{'gc*' if gcs is None else one_of(f'gc{n}' for n in gcs)}"
    full = f"{schema}, _corrupt string"
    nothing = (families is not None and not families) or (gcs is not None and not gcs)
    folders = [] if nothing else glob_paths(spark, pattern)
    if not folders:
        df = spark.createDataFrame([], full).withColumn("_path", F.lit(""))
    else:
        df = spark.read.schema(full).option("multiLine", not lines).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json([_as_it_is(f) for f in folders])
        df = df.withColumn("_path", F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))))
    name = F.regexp_extract("_path", r"/([^/]+)/gc\d+/[^/]+$", 1)
    out = df.withColumn("tool_family", F.nullif(name, F.lit(NO_FAMILY))).withColumn("gc", F.regexp_extract("_path", r"/gc(\d+)/[^/]+$", 1).try_cast("int"))
    return out.where(F.col("_corrupt").isNull()).drop("_corrupt", "_path")


#: The folder of tasks without a family.
NO_FAMILY = "__HIVE_DEFAULT_PARTITION__"


def write_bank(tasks: DataFrame, root: str) -> None:
    """Tasks (tool_family, gc and others) as <family>/gc<N>/*.json, a task a line; a folder that is there is replaced as a whole.

    Spark writes all folders aside; then each moves to its place.
    """
    spark = tasks.sparkSession
    aside = f"{root}/_aside-{uuid.uuid4().hex}"
    tasks.write.partitionBy("tool_family", "gc").json(aside)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    store = path(aside).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in glob_paths(spark, f"{_as_it_is(aside)}/tool_family=*/gc=*"):  # a folder per family and size
        family, gc = (part.split("=", 1)[1] for part in found.rsplit("/", 2)[1:])
        target = path(f"{root}/{unquote(family)}/gc{gc}")  # Spark escapes what it puts into folder names
        store.mkdirs(target.getParent())
        store.delete(target, True)
        store.rename(path(found), target)
    store.delete(path(aside), True)


def read_first_row(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).limit(1)


def read_column(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(F.col(name).try_cast("double").alias(name)).where(F.col(name).isNotNull())


def read_prompts(spark: SparkSession, keys: dict[str, str]) -> DataFrame:
    """(domain, prompt) from one text file per domain; empty where there is none."""
    rows = [(k, p if glob_paths(spark, p) else None) for k, p in keys.items()]
    grid = spark.createDataFrame(rows, "domain string, path string")
    there = [p for _, p in rows if p]
    if not there:
        return grid.select("domain", F.lit("").alias("prompt"))
    texts = spark.read.text(there, wholetext=True).select(F.regexp_replace("_metadata.file_path", "^file:/*", "/").alias("p"), "value")
    return grid.join(F.broadcast(texts), F.regexp_replace("path", "^file:/*", "/") == F.col("p"), "left").select("domain", F.coalesce("value", F.lit("")).alias("prompt"))  # a file per domain


def measured(expected: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Every expected combination, with nulls where nothing was found: not measured is not neutral."""
    return expected.join(found, list(keys), "left")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_by_arm(df: DataFrame, path: str, key: str = "arm") -> None:
    """One folder per arm; writing an arm again replaces that arm alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """A copy to go back to before an overwrite; reads of the copy do not depend on the original."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def newest(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

"""Sources and sinks end to end: what is written in a format and read again equals what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gymlake.operators import rates as R
from gymlake.sources import files as S
from gymlake.sources.scratch import scratch_folder
from gymlake.sources.tables import BANK_SQL, ROLLOUTS_SQL, bank, rollouts, table
from gymlake.streaming import rates as stream

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("""with p as (select conv_id, list(text order by turn) filter (where role = 'user') u, list(text order by turn) filter (where role = 'assistant') a from conversations group by conv_id)
select conv_id id, 'bench/d' || (conv_id % 7) task, coalesce(len(u), 0) n_prompts, case when len(a) > 0 then 1 else 0 end n_responses, coalesce(u[1], '') first_prompt from p""")
def jsonl_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark samples through JSONL files; prompt is a list, response a bare text."""
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(of("user").alias("prompt"), of("assistant").alias("a"))
    folder = scratch_folder(spark)
    S.write_jsonl(c.select(F.col("conv_id").alias("id"), F.concat(F.lit("bench/d"), (F.col("conv_id") % 7).cast("string")).alias("task"), "prompt", F.try_element_at("a", F.lit(1)).alias("response")), folder)
    back = S.read_samples(spark, folder, "*.json")
    return back.select("id", "task", F.size("prompt").alias("n_prompts"), F.when(F.col("response").isNull(), 0).otherwise(F.size("response")).alias("n_responses"), F.coalesce(F.try_element_at("prompt", F.lit(1)), F.lit("")).alias("first_prompt"))


@query(f"""with {ROLLOUTS_SQL}, x as (select distinct task_id, bool_or(verdict) over (partition by task_id) passed from rollouts)
select task_id % 5 report, count(*) total, count(*) filter (where passed) passed, count(*) filter (where passed) / cast(count(*) as double) accuracy from x group by 1""")
def headed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score files with a summary line and a line per failure: passed is what ran less what failed, and must agree with the summary."""
    folder = scratch_folder(spark)
    ran = rollouts(spark, sf_dir).groupBy("task_id").agg(F.coalesce(F.bool_or("verdict"), F.lit(False)).alias("ok")).withColumn("report", F.col("task_id") % 5)
    failure = F.when(~F.col("ok"), F.to_json(F.struct(F.col("task_id").cast("string").alias("id"), F.array(F.lit("e")).alias("error"))))
    head = F.to_json(F.struct((F.count_if("ok") / F.count("*").cast("double")).alias("accuracy"), F.count_if("ok").alias("correct_count"), F.count("*").alias("total_count")))
    text = ran.groupBy("report").agg(F.concat_ws("\n", F.concat(F.lit('{"report":'), F.col("report").cast("string"), F.lit(","), F.substr(head, F.lit(2))), F.array_sort(F.collect_list(failure))).alias("value"))
    text.select("value", "report").write.partitionBy("report").text(folder)
    summary, failures = S.header_and_rows(spark, f"{folder}/*/*.txt", "report long, accuracy double, correct_count long, total_count long", "id string, error array<string>")
    failed = failures.groupBy("file").agg(F.count("*").alias("n_failed"))
    both = summary.join(failed, "file", "left").withColumn("passed", F.col("total_count") - F.coalesce("n_failed", F.lit(0)))
    checked = F.when(F.abs(F.col("passed") / F.col("total_count").cast("double") - F.col("accuracy")) > 1e-6, F.raise_error(F.lit("accuracy mismatch")).cast("double")).otherwise(F.col("accuracy"))
    return both.select("report", F.col("total_count").alias("total"), "passed", checked.alias("accuracy"))


@query(f"with {BANK_SQL} select tool_family, gc, count(*) n, avg(baseline_pass_rate) mean_rate from bank where tool_family in ('en', 'de') group by 1, 2")
def bank_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank laid out by family and graph size; of it two families' folders are listed and read."""
    folder = scratch_folder(spark)
    S.write_bank(bank(spark, sf_dir).select("task_id", "baseline_pass_rate", "tool_family", "gc"), folder)
    back = S.read_bank(spark, folder, "task_id long, baseline_pass_rate double", families=["en", "de"], lines=True)
    return back.groupBy("tool_family", "gc").agg(F.count("*").alias("n"), F.avg("baseline_pass_rate").alias("mean_rate"))


@query("select n_name, count(*) n, avg(c_acctbal) mean from customer join nation on c_nationkey = n_nationkey group by 1")
def csv_collector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV written with a header and read back, numbers parsed leniently."""
    folder = scratch_folder(spark)
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    S.write_csv(joined.select("n_name", "c_acctbal"), folder)
    back = spark.read.option("header", True).csv(folder)
    return back.groupBy("n_name").agg(F.count("*").alias("n"), F.avg(F.col("c_acctbal").try_cast("double")).alias("mean"))


@query(f"with {ROLLOUTS_SQL} select arm, case when arm = 'final' then 2 else 1 end * count(*) total from rollouts group by arm")
def arm_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewriting one arm's folder leaves the other arm's as it was."""
    folder = scratch_folder(spark)
    counts = R.pass_rates(rollouts(spark, sf_dir), "arm").select("arm", F.col("n_rollouts").alias("total"))
    S.write_by_arm(counts, folder)
    S.write_by_arm(counts.where("arm = 'final'").withColumn("total", F.col("total") * 2), folder)
    return spark.read.parquet(folder).select(F.col("arm").cast("string").alias("arm"), "total")


@query(f"with {ROLLOUTS_SQL} select task_id, event_id seq, avg(cast(verdict as int)) over (partition by task_id order by event_id rows between 19 preceding and current row) rolling_rate from rollouts")
def streamed_rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling rate from a file stream with keyed state, run on what is available."""
    folder = scratch_folder(spark)
    rollouts(spark, sf_dir).select("task_id", F.col("event_id").alias("seq"), "verdict").coalesce(4).write.json(f"{folder}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.run_available(stream.rolling_rates(stream.read_outcomes(spark, f"{folder}/in")), f"{folder}/out", f"{folder}/state").awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.ROLLED).parquet(f"{folder}/out")

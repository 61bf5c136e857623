"""Streams with state and sinks that may be killed: the frontier as candidates arrive, the queue until its grid is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gymlake.operators.enrich import enrich
from gymlake.sources.scratch import scratch_folder
from gymlake.sources.tables import ROLLOUTS_SQL, rollouts, table
from gymlake.streaming import frontier as front
from gymlake.streaming import iterations, queue

QUERIES, ORACLES = {}, {}
AXES = ("success", "robustness", "compactness")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _arriving(df: DataFrame, folder: str, batches: int = 4) -> DataFrame:
    """df as a stream of files that arrives in so many batches."""
    spark = df.sparkSession
    parts = max(2 * batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartition(parts, F.xxhash64(*df.columns)).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-parts // batches)).parquet(folder)


@query("""with c as (select source playbook, doc_id version, (doc_id * 37 % 101) / 100.0::double success, (n_chars % 23) / 22.0::double robustness, 1 / (1 + n_chars // 100)::double compactness from documents)
select * from c where not exists (select 1 from c o where o.playbook is not distinct from c.playbook and o.success >= c.success and o.robustness >= c.robustness and o.compactness >= c.compactness
  and (o.success > c.success or o.robustness > c.robustness or o.compactness > c.compactness))""")
def streamed_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each playbook's undominated versions, kept up as versions arrive in four batches."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        F.col("source").alias("playbook"), i.alias("version"), ((i * 37 % 101) / F.lit(100.0)).alias("success"), ((F.col("n_chars") % 23) / F.lit(22.0)).alias("robustness"),
        (1 / (1 + (F.col("n_chars") - F.col("n_chars") % 100) / 100)).alias("compactness"),
    )
    folder = scratch_folder(spark)
    changes = front.frontier_changes(_arriving(d, f"{folder}/in"), "playbook", "version", AXES)
    with front.keyed_state(spark):
        changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return front.frontier_of(spark.read.schema(changes.schema).parquet(f"{folder}/out"), "playbook", "version", AXES)


@query(f"with {ROLLOUTS_SQL} select distinct task_id, arm, rep, reverse(task_id || '|' || arm || '|' || rep) reply, 1 copies from rollouts")
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the grid of tasks, arms and repetitions once, though it is asked for in many batches; ends when the grid is complete."""
    folder, keys, schema = scratch_folder(spark), ("task_id", "arm", "rep"), "task_id long, arm string, rep int, reply string"
    asked = rollouts(spark, sf_dir).select(*keys)
    jobs = _arriving(asked, f"{folder}/in")
    prompt = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])

    def do(df: DataFrame) -> DataFrame:
        return enrich(df.withColumn("prompt", prompt), "prompt", "reply").where("error is null").select(*keys, "reply")

    finished = lambda: queue.done(spark, f"{folder}/out", schema)
    left = queue.run_until_complete(lambda: queue.work(jobs, do, f"{folder}/out", schema, *keys, checkpoint=f"{folder}/state"), lambda: queue.missing(asked, finished(), *keys))
    if left:
        raise RuntimeError(f"{left} cells of the grid have no result")
    return finished().groupBy(*keys).agg(F.first("reply").alias("reply"), F.count("*").alias("copies"))


_TRIED = "list_filter({drops}, lambda d: (doc_id * 31 + d * 17) % 10 = 0)"


@query(f"""
with recursive e as (select doc_id, doc_id % 5 - doc_id % 3 worth from documents),
r as (
  select 0 iteration, []::int[] drops, avg(worth) utility, true kept, null::int restored, [avg(worth)] us, [[]::int[]] tried, count(*) n_entries from e
  union all
  select iteration + 1, next_drops, u, u + 0.01 >= list_max(us), case when u + 0.01 < list_max(us) then list_position(us, list_max(us)) - 1 end, list_append(us, u), list_append(tried, next_drops), n
  from (select *, list_append(case when restored is not null then tried[restored + 1] else drops end, iteration + 1) next_drops from r where iteration < 12 and not (len(us) > 3 and list_max(us[-3:]) <= us[-4])),
    lateral (select avg(worth) u, count(*) n from e where len({_TRIED.format(drops="next_drops")}) = 0))
select iteration, utility, kept, restored, iteration = (select max(iteration) from r) stopped, n_entries from r""")
def iterated_playbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A playbook cut again and again, each version measured, rolled back where it falls behind, until it stalls."""
    folder = scratch_folder(spark)
    i = F.col("doc_id")
    entries = table(spark, sf_dir, "documents").select(i.alias("entry_id"), (i % 5 - i % 3).alias("worth"))
    cut = lambda df, n: df.where((F.col("entry_id") * 31 + n * 17) % 10 != 0)
    told = iterations.run(spark, folder, lambda: entries, cut, lambda df, n: df.agg(F.avg("worth")).first()[0], tolerance=0.01, patience=3, most=12)
    number = F.regexp_extract("_metadata.file_path", r"/([0-9]+)/candidate/", 1).cast("int")
    sizes = spark.read.schema(entries.schema).parquet(f"{folder}/*/candidate").select(number.alias("iteration")).groupBy("iteration").agg(F.count("*").alias("n_entries"))
    return told.join(sizes, "iteration", "left").select("iteration", "utility", "kept", "restored", "stopped", F.coalesce("n_entries", F.lit(0)).alias("n_entries"))

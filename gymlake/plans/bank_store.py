"""The stored bank: verdicts merged into touched partitions, audits of tasks that take the unusable ones out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gymlake.operators.task_audit import audit_tasks, condemnations
from gymlake.sources import task_bank as B
from gymlake.sources.scratch import scratch_folder
from gymlake.sources.tables import BANK_SQL, bank, table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(f"""with {BANK_SQL}, u as (select doc_id * 2 task_id, coalesce(toxic = 1, false) unpassable, coalesce(quality = 0, false) too_weak, doc_id from labels),
last as (select * from u qualify row_number() over (partition by task_id order by doc_id desc, unpassable desc, too_weak desc) = 1)
select coalesce(bank.task_id, last.task_id) task_id, case when last.task_id is null then 'kept' when bank.task_id is null then 'not_found' else 'updated' end outcome,
  case when bank.task_id is not null then coalesce(last.unpassable, bank.unpassable) end unpassable, case when bank.task_id is not null then coalesce(last.too_weak, bank.too_weak) end too_weak
from bank full join last on bank.task_id = last.task_id""")
def bank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts merged into a stored bank: what was updated, what the bank has not, what stays as it was."""
    folder = scratch_folder(spark)
    B.save(bank(spark, sf_dir).select("task_id", "tool_family", "gc", "unpassable", "too_weak"), f"{folder}/bank")
    said = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    updates = table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("task_id"), said("toxic", 1).alias("unpassable"), said("quality", 0).alias("too_weak"), F.col("doc_id").alias("report_seq"))
    outcome = B.merge_verdicts(spark, f"{folder}/bank", updates, ("unpassable", "too_weak"), f"{folder}/report")
    now = B.load(spark, f"{folder}/bank").select("task_id", "unpassable", "too_weak")
    return now.join(outcome, "task_id", "full_outer").select("task_id", F.coalesce("outcome", F.lit("kept")).alias("outcome"), "unpassable", "too_weak")


_LISTS = {"terminal_ops": "entries", "web_research": "notebook", "code_repo": "modules", "mcp_api": "records"}
_DECLARED = {"terminal_ops": 2, "web_research": 2, "code_repo": 3, "mcp_api": 1}
_FAMILY = [*_LISTS, "android"]


@query(f"""with t as (select doc_id task_id, ['{"', '".join(_FAMILY)}'][n_chars % 5 + 1] family, doc_id % 4 k, source = 'src3' steps, n_chars % 3 = 0 bare from documents),
a as (select *, family = 'android' skipped, case when bare then 0 else 1 end given, [{", ".join(map(str, _DECLARED.values()))}, 0][list_position(['{"', '".join(_FAMILY)}'], family)] declared from t)
select task_id, family, skipped, case when not skipped then declared - given end n_state_problems,
  case when skipped then null when k in (1, 2) then ['key:nope'] when k = 3 then ['tool:fly'] else [] end checker_problems,
  case when not skipped then case when steps then 'IndexError' when k = 1 then 'KeyError' end end raises,
  not skipped and k > 0 and (steps or k = 1) condemned, not skipped and k > 0 and (steps or k = 1) unpassable
from a""")
def task_schema_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks audited against their family; those with a fault that raises even on the example state are marked in the stored bank."""
    n, i = F.col("n_chars"), F.col("doc_id")
    family = F.element_at(F.array(*map(F.lit, _FAMILY)), (n % 5 + 1).cast("int"))
    listed = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _LISTS.items() for x in kv]), family), F.lit("apps"))
    code = lambda form: F.format_string(form, listed)
    end = (
        F.when(i % 4 == 0, code("len(state['%s']) > 0")).when(i % 4 == 1, code("state['%s'][0]['nope'] == 1")).when(i % 4 == 2, code("state['%s'][0].get('nope') == 1"))
        .otherwise("any(c['tool'] == 'fly' for c in state.get('_action_log', []))")
    )
    raw = F.when(n % 3 == 0, '{"_action_log":[]}').otherwise(code('{"_action_log":[],"%s":[]}'))
    tasks = table(spark, sf_dir, "documents").select(
        i.alias("task_id"), family.alias("tool_family"), raw.alias("initial_state"), end.alias("predicate"), F.when(F.col("source") == "src3", code("all(s['%s'][5] for s in states)")).alias("step_wise_predicate"),
        (3 + i % 2).cast("int").alias("gc"), F.lit(False).alias("unpassable"), F.lit(False).alias("too_weak"),
    )
    folder = scratch_folder(spark)
    B.save(tasks, f"{folder}/bank")
    audit_tasks(B.load(spark, f"{folder}/bank")).write.parquet(f"{folder}/audit")
    audit = spark.read.parquet(f"{folder}/audit")
    B.merge_verdicts(spark, f"{folder}/bank", condemnations(audit), ("unpassable", "too_weak"), f"{folder}/report")
    now = B.load(spark, f"{folder}/bank").select("task_id", "unpassable")
    kept = audit.select("task_id", F.col("tool_family").alias("family"), "skipped", F.when(~F.col("skipped"), F.size("state_problems")).alias("n_state_problems"), "checker_problems", "raises", "condemned")
    return kept.join(now, "task_id")

"""Conversation assembly, tag and marker parsing, judge replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gymlake.functions import text as X
from gymlake.operators.judge_parse import bounded_score, parse_judgements
from gymlake.sources.tables import ENTRIES_SQL, entries, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _ordered(column: Column, frame=None) -> Column:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return F.collect_list(column).over(w.rowsBetween(Window.unboundedPreceding, frame) if frame is not None else w)


@query("""with a as (select conv_id, turn, role, coalesce(string_agg(text || chr(10), '') over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), '') h from conversations)
select conv_id, turn, case when h = '' then '' else '### History' || chr(10) || h end context from a where role = 'user'""")
def history_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came before each user turn; the heading only where something did."""
    before = F.array_join(_ordered(F.concat("text", F.lit("\n")), -1), "")
    rows = turns(spark, sf_dir).select("conv_id", "turn", "role", before.alias("h"))
    return rows.where("role = 'user'").select("conv_id", "turn", F.when(F.col("h") == "", "").otherwise(F.concat(F.lit("### History\n"), F.col("h"))).alias("context"))


@query("select conv_id, turn, list(role || ':' || length(text)) over (partition by conv_id order by turn rows between unbounded preceding and current row) log from conversations")
def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a conversation so far, in order, at every step."""
    return turns(spark, sf_dir).select("conv_id", "turn", _ordered(F.concat("role", F.lit(":"), F.length("text").cast("string")), 0).alias("log"))


@query("""with s as (select conv_id, string_agg(text, chr(10) || chr(10) order by turn) sys from conversations where role = 'system' group by conv_id),
u as (select conv_id, min(turn) t from conversations where role = 'user' group by conv_id)
select c.conv_id, c.turn, c.role, case when s.sys is not null and c.turn = u.t then s.sys || chr(10) || chr(10) || c.text else c.text end as text
from conversations c left join s using (conv_id) left join u using (conv_id) where c.role <> 'system'""")
def fold_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System texts in front of the first user turn."""
    w = Window.partitionBy("conv_id")
    system = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "system", F.struct("turn", "text"))).over(w)), lambda x: x["text"]), "\n\n")
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(w)
    rows = turns(spark, sf_dir).select("conv_id", "turn", "role", "text", system.alias("s"), first.alias("t")).where("role <> 'system'")
    return rows.select("conv_id", "turn", "role", F.when((F.col("s") != "") & (F.col("turn") == F.col("t")), F.concat("s", F.lit("\n\n"), "text")).otherwise(F.col("text")).alias("text"))


@query("select conv_id, turn, coalesce(lag(text) over (partition by conv_id order by turn), '') prior, text as next, row_number() over (partition by conv_id order by turn) step from conversations")
def state_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step with the state before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns(spark, sf_dir).select("conv_id", "turn", F.coalesce(F.lag("text").over(w), F.lit("")).alias("prior"), F.col("text").alias("next"), F.row_number().over(w).alias("step"))


def _odd(kind: Column, text: Column) -> Column:
    """Replies in all the shapes a model gives them, from plain texts."""
    return (
        F.when(kind == 0, F.concat(F.lit("<obs>"), text, F.lit("</obs>")))
        .when(kind == 1, F.concat(F.lit("<obs>old</obs> then <OBS> "), text, F.lit(" </obs> tail")))
        .when(kind == 2, F.concat(F.lit("<obs>"), text))
        .when(kind == 3, F.concat(F.lit("**Out:** "), text))
        .when(kind == 4, F.concat(F.lit("say **Out:** "), text, F.lit(" **Out:**")))
        .when(kind == 5, F.lit("  \n "))
        .when(kind == 6, F.concat(text, F.lit(" \\boxed{A} or \\boxed{ b }")))
        .otherwise(F.concat(text, F.lit(" so my answer is **B**")))
    )


_OUT = """out as (select conv_id, turn, case conv_id % 8 when 0 then '<obs>' || text || '</obs>' when 1 then '<obs>old</obs> then <OBS> ' || text || ' </obs> tail' when 2 then '<obs>' || text
  when 3 then '**Out:** ' || text when 4 then 'say **Out:** ' || text || ' **Out:**' when 5 then '  ' || chr(10) || ' ' when 6 then text || ' \\boxed{A} or \\boxed{ b }' else text || ' so my answer is **B**' end raw from conversations)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", _odd(F.col("conv_id") % 8, F.col("text")).alias("raw"))


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(f"""with {_OUT}, p as (select *, regexp_split_to_array(raw, '(?i)<obs>') parts from out)
select conv_id, turn, case when {_TRIM.format('raw')} = '' then 'No output' when len(parts) > 1 then {_TRIM.format("regexp_split_to_array(parts[-1], '(?i)</obs>')[1]")} else {_TRIM.format('raw')} end block from p""")
def last_tag_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies(spark, sf_dir).select("conv_id", "turn", X.observation(F.col("raw"), "obs").alias("block"))


@query(f"with {_OUT} select conv_id, turn, {_TRIM.format('''case when starts_with(raw, '**Out:**') then substr(raw, 9) else replace(raw, '**Out:**', '') end''')} body from out")
def marker_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies(spark, sf_dir).select("conv_id", "turn", X.strip_marker(F.col("raw"), "**Out:**").alias("body"))


@query(rf"""with {_OUT}, c as (select conv_id, turn, upper(coalesce(regexp_extract_all(raw, '(?i)\\boxed\{{\s*([AB])\s*\}}', 1)[-1], nullif(regexp_extract(raw, '(?i)(?:answer|choice|select|choose|pick)\s*(?:is|:)?\s*\**\s*([AB])\b', 1), ''),
  nullif(regexp_extract(raw, '(?i)\b([AB])\s*(?:is|appears|seems)\s+(?:more\s+)?(?:realistic|correct|better)', 1), ''))) choice from out)
select conv_id, turn, choice, cast(case when choice = 'A' then 1 else 0 end as double) reward from c""")
def boxed_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    choice = replies(spark, sf_dir).select("conv_id", "turn", X.boxed_choice(F.col("raw")).alias("choice"))
    return choice.withColumn("reward", X.choice_reward(F.col("choice")))


@query(None)
def strip_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, text = F.col("conv_id") % 5, F.col("text")
    raw = (
        F.when(kind == 0, F.concat(F.lit("<think>a</think>"), text)).when(kind == 1, F.concat(F.lit("<THINK>a<think>b</think>c</think>"), text))
        .when(kind == 2, F.concat(F.lit("lost</think>"), text)).when(kind == 3, F.concat(text, F.lit("<think>never closed <obs>kept"))).otherwise(text)
    )
    return turns(spark, sf_dir).select("conv_id", "turn", X.strip_thinking(raw, "obs").alias("clean"))


@query(None)
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge replies of every shape, down to truncated ones, with what was read from them."""
    kind, n = F.col("conv_id") % 6, (F.col("turn") % 7).cast("string")
    scores = F.concat(F.lit('"scores": {"format": '), n, F.lit(', "factuality": "4/5", "consistency": 2.5, "realism": true, "quality": 9}'))
    good = F.concat(F.lit("{"), scores, F.lit(', "strengths": ["a", "b"], "weaknesses": "one"}'))
    raw = (
        F.when(kind == 0, F.concat(F.lit("<final_evaluation>```json\n"), good, F.lit("\n```</final_evaluation>")))
        .when(kind == 1, F.concat(F.lit("<think>{}</think> It is: "), good, F.lit(" as said")))
        .when(kind == 2, F.replace(good, F.lit('"b"]'), F.lit('"b",]')))
        .when(kind == 3, F.concat(F.lit("cut {"), scores, F.lit(', "strengths": ["a')))
        .when(kind == 4, F.lit("")).otherwise(F.col("text"))
    )
    parsed = parse_judgements(turns(spark, sf_dir).select("conv_id", "turn", raw.alias("raw")))
    return parsed.drop("raw")


@query("""with x as (select conv_id, turn, case conv_id % 4 when 0 then '{"score": 0.' || turn || '}' when 1 then '{"score": 1.5}' when 2 then 'none' else '{"score": "0.25"}' end raw from conversations),
v as (select conv_id, turn, case when json_valid(raw) then try_cast(raw->>'$.score' as double) end v from x)
select conv_id, turn, coalesce(case when v between 0 and 1 then v end, 0) score, case when not coalesce(v between 0 and 1, false) then 'score missing or out of range' end error from v""")
def bounded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("conv_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit('{"score": 0.'), F.col("turn").cast("string"), F.lit("}"))).when(kind == 1, '{"score": 1.5}').when(kind == 2, "none").otherwise('{"score": "0.25"}')
    score, error = bounded_score(F.col("raw"))
    return turns(spark, sf_dir).select("conv_id", "turn", raw.alias("raw")).select("conv_id", "turn", score.alias("score"), error.alias("error"))


@query(r"""with x as (select conv_id, turn, 'a {"n":' || turn || '} ' || coalesce(text, '') || case when turn % 3 = 2 then '' else ' {"m":' || conv_id || '} z' end raw from conversations)
select conv_id, turn, regexp_extract(raw, '(?s)\{.*\}') object, 'reply-' || left(md5('=' || conv_id || chr(31) || '=' || turn), 12) reply_id from x""")
def greedy_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simple reading of a reply's object, behind thinking that holds one too; replies by a stable id."""
    t, c = F.col("turn"), F.col("conv_id").cast("string")
    body = F.concat(F.lit('a {"n":'), t.cast("string"), F.lit("} "), F.coalesce("text", F.lit("")), F.when(t % 3 == 2, "").otherwise(F.concat(F.lit(' {"m":'), c, F.lit("} z"))))
    raw = F.when(t % 3 == 0, F.concat(F.lit("<think>{no</think>"), body)).otherwise(body)
    return turns(spark, sf_dir).select("conv_id", "turn", X.greedy_object(raw).alias("object"), X.stable_id("reply", F.col("conv_id"), t).alias("reply_id"))


@query(r"""with x as (select conv_id, turn, case conv_id % 4 when 0 then 'B' when 1 then 'A' when 2 then null else case when turn % 2 = 0 then 'A' else 'B' end end choice from conversations)
select conv_id, turn, choice, case when choice = 'A' then 1.0 else 0.0 end::double reward from x""")
def reasoned_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A choice is what follows the thinking: a letter boxed within it is none."""
    k, letter = F.col("conv_id") % 4, F.when(F.col("turn") % 2 == 0, "a").otherwise("b")
    raw = (
        F.when(k == 0, r"<think>\boxed{A}</think> then \boxed{ b }").when(k == 1, r"<think>first \boxed{B} <think>or \boxed{B}</think></think>The answer is **A")
        .when(k == 2, r"<think>\boxed{A}").otherwise(F.concat(F.lit(r"\boxed{B} lost</think> so \boxed{A} no, \boxed{"), letter, F.lit("}")))
    )
    return turns(spark, sf_dir).select("conv_id", "turn", X.boxed_choice(raw).alias("choice")).withColumn("reward", X.choice_reward(F.col("choice")))


@query("""select conv_id, turn, unnest([0, 1]) place, unnest(['{"turn":' || turn || ',"inner":{"s":"a } \\" b"}}', '{"n":' || length(coalesce(text, '')) || '}']) object from conversations""")
def reply_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every balanced object of a reply as a row, behind braces that are never closed and with braces in its texts."""
    words = F.translate(F.coalesce("text", F.lit("")), '{}"', "   ")
    first = F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit(',"inner":{"s":"a } \\" b"}}'))
    raw = F.concat(F.lit("{ cut: { "), words, F.lit(' "quoted" '), first, F.lit(" "), words, F.lit('{"n":'), F.length(F.coalesce("text", F.lit(""))).cast("string"), F.lit("} {"))
    t = turns(spark, sf_dir).select("conv_id", "turn", raw.alias("raw"))
    return t.lateralJoin(X.BalancedObjects(F.col("raw").outer())).select("conv_id", "turn", "place", "object")


_TAG = r"coalesce(nullif(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'general')"


@query(rf"with {ENTRIES_SQL} select entry_id, {_TAG.format("content")} tag from entries")
def tag_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("entry_id", X.normalise_tag(F.col("content")).alias("tag"))


@query(f"with {ENTRIES_SQL} select playbook_id, left(sha1('m' || chr(10) || string_agg(tag || ':' || content, chr(10) order by tag || ':' || content)), 12) fingerprint, count(*) n_entries from entries group by playbook_id")
def playbook_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("tag", F.lit(":"), "content")
    return entries(spark, sf_dir).groupBy("playbook_id").agg(X.fingerprint(F.lit("m"), F.collect_list(line)).alias("fingerprint"), F.count("*").alias("n_entries"))


@query("select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) n_words, left(split_part(split_part(split_part(text, ' (', 1), ';', 1), ':', 1), 90) kind, case when length(text) > 600 then left(text, 600) || chr(10) || '[truncated ' || (length(text) - 600) || ' characters]' else text end clipped from documents".replace("'\\s+'", r"'[ \t\n\r\f\x0b]+'"))
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count(t).alias("n_words"), X.problem_kind(t).alias("kind"), X.clip(t, 600).alias("clipped"))

"""Record shaping: wire formats, ids, prompts, operation and diagnosis parsing, predicate audits, replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gymlake.functions import predicates as P
from gymlake.functions import state as S
from gymlake.functions import text as X
from gymlake.operators import prompts as J
from gymlake.operators.verdicts import with_verdicts
from gymlake.plans.states import NOTES, typed_states
from gymlake.sources import catalog as C
from gymlake.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""select doc_id, '{"type":"function","function":{"name":"' || source || '","parameters":"' || lang || '"}}' wire from documents""")
def wire_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool as it goes over the wire: without its internal family."""
    tool = F.struct(F.lit("function").alias("type"), F.struct(F.col("source").alias("name"), F.col("lang").alias("parameters")).alias("function"), F.lit("internal").alias("family"))
    return table(spark, sf_dir, "documents").select("doc_id", tool.alias("tool")).select("doc_id", F.to_json(F.col("tool").dropFields("family")).alias("wire"))


@query("select conv_id, turn, case when turn % 2 = 0 then 'call_' || turn || '_0' else role end call_id, substr(md5(conv_id || ':' || turn), 1, 12) step_id from conversations")
def synthesised_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id where a call came without one, and stable record ids from keys."""
    given = F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("role"))
    made = F.concat(F.lit("call_"), F.col("turn").cast("string"), F.lit("_0"))
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.nullif(given, F.lit("")), made).alias("call_id"), F.substring(F.md5(key), 1, 12).alias("step_id"))


@query("""select doc_id, 'Task ' || doc_id || chr(10) || 'State: {"lang":"' || lang || '","n":' || n_chars || '}' || chr(10) || 'Answer ACCEPT or REJECT.' prompt from documents""")
def adjudication_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.to_json(F.struct("lang", F.col("n_chars").alias("n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", F.concat(F.lit("Task "), F.col("doc_id").cast("string")), F.concat(F.lit("State: "), state), F.lit("Answer ACCEPT or REJECT.")).alias("prompt"))


@query("select doc_id, doc_id % 3 = 0 accepted from documents")
def adjudication_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    reply = F.when(k == 0, "\n accept: fine").when(k == 1, "I would accept").otherwise("REJECT")
    return table(spark, sf_dir, "documents").select("doc_id", X.accepts(reply).alias("accepted"))


@query(r"select doc_id, replace(text, 'the', 'REDACTED') redacted, 'a' || chr(10) || 'b' cleaned from documents")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A secret taken out of artifacts, and a marked block taken out of a file."""
    marked = F.concat(F.lit("a\n# BEGIN\n"), "text", F.lit("\n# END\nb"))
    return table(spark, sf_dir, "documents").select("doc_id", X.redact(F.col("text"), "the").alias("redacted"), X.remove_marked_block(marked, "# BEGIN", "# END").alias("cleaned"))


@query("""select doc_id, case when doc_id % 4 = 3 then 0 else 2 - cast(doc_id % 4 = 1 as int) end n_ops, case doc_id % 4 when 0 then 'add' when 1 then 'remove' when 2 then 'merge' end first_op, doc_id % 4 = 3 malformed from documents""")
def parsed_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply's list of edits: operations without a known kind are skipped; anything but a list is malformed."""
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, '```json\n[{"op":"add","content":"x"},{"op":"update","entry_ids":["1"]}]\n```').when(k == 1, '[{"op":"dance"},{"op":"remove","entry_ids":["2"]}]').when(k == 2, '[{"op":"merge","entry_ids":["1","2"]},{"op":"add"}]').otherwise('{"op":"add"}')
    body = X.strip_fence(raw)
    ops = F.filter(F.from_json(body, "array<struct<op:string,entry_ids:array<string>,tag:string,content:string>>"), lambda o: F.coalesce(o["op"].isin("add", "update", "merge", "remove"), F.lit(False)))
    is_list = F.startswith(body, F.lit("["))
    kept = F.when(is_list, ops).otherwise(F.array().cast("array<struct<op:string,entry_ids:array<string>,tag:string,content:string>>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(kept).alias("n_ops"), F.try_element_at(kept, F.lit(1))["op"].alias("first_op"), (~is_list).alias("malformed"))


@query("""select doc_id, case doc_id % 3 when 0 then 'success' when 1 then 'failure' end overall, case doc_id % 3 when 1 then 'stale-id' when 0 then 'general' end tag, case doc_id % 3 when 1 then ['e1', 'e2'] when 0 then [] end helpful, case when doc_id % 3 = 2 then 'missing overall' end error from documents""")
def parsed_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diagnosis needs its overall verdict; the rest has defaults."""
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, '{"overall":"success"}').when(k == 1, '{"overall":"failure","tag":"Stale ID","helpful":["e1","e2"]}').otherwise('{"tag":"x"}')
    d = F.from_json(raw, "struct<overall:string,tag:string,helpful:array<string>>")
    ok = d["overall"].isin("success", "partial", "failure")
    fine = F.coalesce(ok, F.lit(False))
    rows = table(spark, sf_dir, "documents").select("doc_id", d.alias("d"), fine.alias("ok"))
    return rows.select(
        "doc_id", F.when(F.col("ok"), F.col("d.overall")).alias("overall"), F.when(F.col("ok"), X.normalise_tag(F.col("d.tag"))).alias("tag"),
        F.when(F.col("ok"), F.coalesce("d.helpful", F.array().cast("array<string>"))).alias("helpful"), F.when(~F.col("ok"), "missing overall").alias("error"),
    )


@query("""with d as (select case when doc_id % 3 = 0 then 0 else 1 + doc_id % 3 end n from documents)
select checker, problems, n_initially from (values ('clean', []::varchar[], (select count(*) from d where n = 2)), ('initially_true', [], (select count(*) from d where n = 0)), ('leaks', ['leak'], 0), ('reads_unknown', ['unknown:zzz', 'raises:KeyError'], 0),
  ('tautology', ['tautology'], (select count(*) from d)), ('unknown_tool', ['unknown:size'], 0)) t(checker, problems, n_initially)""")
def predicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkers against their family: keys outside its vocabulary, leaked wording, tautologies, and of how many initial states they already hold."""
    checkers = {
        "clean": "len(state['notes']) == 2", "initially_true": "len(state['notes']) == 0", "leaks": "state['notes'][0]['title'] == 'write this exact and very long sentence'",
        "reads_unknown": "state['zzz'] == 1", "tautology": "state['notes'] == [] or state['notes'] != []", "unknown_tool": "state['notes'][0].get('size') == 3",
    }
    known = {"notes", "title", "content", "tags"} | {p for _, f, ps in C.TOOLS if f == "mcp_notes" for p in ps}
    rows = []
    for name, p in sorted(checkers.items()):
        reason = P.compile_predicate(p, NOTES, state=F.lit(None)).reason
        problems = [f"unknown:{k}" for k in sorted(P.keys_read(p) - known)] + (["raises:KeyError"] if reason == "checker_raised:KeyError" else []) + ["leak"] * bool(P.long_literals(p)) + ["tautology"] * P.is_tautology(p)
        rows.append((name, problems))
    i = F.col("doc_id")
    note = F.struct(F.col("source").alias("title"), F.lit("c").alias("content"), F.array(F.lit("x")).alias("tags"))
    notes = F.array_repeat(note, F.when(i % 3 == 0, 0).otherwise(1 + i % 3).cast("int"))
    initial = table(spark, sf_dir, "documents").select(F.struct(notes.alias("notes")).cast(NOTES).alias("state"))
    held = with_verdicts(initial, checkers, NOTES).agg(*[F.count_if(n).alias(n) for n in checkers])
    truth = held.select(F.explode(F.array(*[F.struct(F.lit(n).alias("checker"), F.col(n).alias("n_initially")) for n in checkers])).alias("x")).select("x.*")
    return truth.join(spark.createDataFrame(rows, "checker string, problems array<string>"), "checker")  # a row per checker


@query("select doc_id, case when doc_id % 5 = 4 then 2 when doc_id % 5 = 3 then 0 else 2 end n_after, case when doc_id % 5 in (3, 4) then doc_id % 5 = 4 else true end has_food from documents")
def replay_with_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of a rollout folded in order, each completed from the repaired one before it."""
    steps = typed_states(spark, sf_dir).select("doc_id", "prior", F.array("predicted", "predicted").alias("steps"))
    last = F.aggregate("steps", F.col("prior").cast(NOTES), lambda before, now: S.complete(before, now, NOTES).cast(NOTES))
    food = P.compile_predicate("any('food' in n['tags'] for n in state['notes'])", NOTES, state=F.col("s")).column
    return steps.select("doc_id", last.alias("s")).select("doc_id", F.size("s.notes").alias("n_after"), food.alias("has_food"))


@query("""select doc_id, case when doc_id % 2 = 0 then '{"notes":[]}' else '{"cwd":"/"}' end domain_state from documents""")
def domain_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state without the harness's own log."""
    raw = F.when(F.col("doc_id") % 2 == 0, '{"_action_log":[{"tool":"a"}],"notes":[]}').otherwise('{"cwd":"/"}')
    members = F.map_filter(F.from_json(raw, "map<string,variant>"), lambda k, _: k != "_action_log")
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(members).alias("domain_state"))


@query("""with o as (select source, avg(doc_id % 5) a, avg(doc_id % 7) b from documents where doc_id % 2 = 0 group by 1), n as (select source, avg(doc_id % 5) a from documents where doc_id % 3 = 0 and source <> 'src4' group by 1)
select o.source, coalesce(n.a, o.a) success, o.b robustness, n.a is not null refreshed from o left join n using (source)""")
def pareto_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New measurements where there are any, else the previous ones."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    old = d.where(i % 2 == 0).groupBy("source").agg(F.avg(i % 5).alias("a"), F.avg(i % 7).alias("b"))
    new = d.where((i % 3 == 0) & (F.col("source") != "src4")).groupBy("source").agg(F.avg(i % 5).alias("na"))
    return old.join(new, "source", "left").select("source", F.coalesce("na", "a").alias("success"), F.col("b").alias("robustness"), F.col("na").isNotNull().alias("refreshed"))


@query("""with h as (select doc_id % 10 playbook, doc_id seq, (doc_id * 37 % 101) / 100.0::double u from documents), l as (select playbook, max(seq) seq, max_by(u, seq) u, max(u) best, min(seq) filter (where true) f from h group by 1),
b as (select playbook, max_by(seq, row(u, -seq)) from_seq from h group by 1)
select playbook, seq, u utility, null::bigint restored from l union all select l.playbook, l.seq + 1, best, b.from_seq from l join b using (playbook) where l.u + 0.05 < best""")
def rollback_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of each history and, where it fell behind, a new one restored from the best."""
    i = F.col("doc_id")
    h = table(spark, sf_dir, "documents").select((i % 10).alias("playbook"), i.alias("seq"), ((i * 37 % 101) / F.lit(100.0).cast("double")).alias("u"))
    last = h.groupBy("playbook").agg(F.max("seq").alias("seq"), F.max_by("u", "seq").alias("u"), F.max("u").alias("best"), F.max_by("seq", F.struct("u", -F.col("seq"))).alias("from_seq"))
    kept = last.select("playbook", "seq", F.col("u").alias("utility"), F.lit(None).cast("long").alias("restored"))
    added = last.where(F.col("u") + 0.05 < F.col("best")).select("playbook", (F.col("seq") + 1).alias("seq"), F.col("best").alias("utility"), F.col("from_seq").alias("restored"))
    return kept.unionByName(added)


@query("""select doc_id, [lang, source, 'lang', 'meta', 'name'] strings from documents""")
def collected_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys and texts of a nested value, level by level (the depth is bounded)."""
    raw = F.to_json(F.struct("lang", F.struct(F.col("source").alias("name")).alias("meta")))
    level = F.from_json(raw, "map<string,string>")
    inner = F.filter(F.map_values(level), lambda v: F.startswith(v, F.lit("{")))
    deeper = F.transform(inner, lambda v: F.from_json(v, "map<string,string>"))
    texts = F.concat(F.filter(F.map_values(level), lambda v: ~F.startswith(v, F.lit("{"))), F.flatten(F.transform(deeper, F.map_values)))
    keys = F.array_sort(F.concat(F.map_keys(level), F.flatten(F.transform(deeper, F.map_keys))))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(texts, keys).alias("strings"))


@query("""select user_id, '{"n":' || count(*) || ',"ci95":[' || min(event_id) || ',' || max(event_id) || ']}' report from events group by user_id""")
def serialised_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    return agg.select("user_id", F.to_json(F.struct("n", F.array("a", "b").alias("ci95"))).alias("report"))


@query("""with l as (select source, tag, n from (select source, lang tag, count(*) n from documents group by 1, 2)), r as (select *, row_number() over (partition by source order by n desc, tag) i from l) select source, tag, n from r where i <= 2""")
def top_problem_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two commonest kinds per group."""
    counts = table(spark, sf_dir, "documents").groupBy("source", F.col("lang").alias("tag")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy(F.col("n").desc(), "tag")
    return counts.withColumn("i", F.row_number().over(w)).where("i <= 2").drop("i")


@query("""select doc_id, list_sort(list_distinct(['lang', 'meta', 'name', 'parts', 'deep', 'text', lang, source, text])) strings from documents""")
def nested_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys and texts of a nested value of any depth, whole texts with quotes and line breaks among them."""
    deep = F.array(F.struct(F.struct("text").alias("deep")))
    raw = F.to_json(F.struct("lang", F.struct(F.col("source").alias("name"), deep.alias("parts")).alias("meta")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(X.all_strings(raw)).alias("strings"))


@query("""select doc_id, case doc_id % 6 when 1 then case when doc_id % 2 = 0 then [] else ['leak'] end when 2 then ['key:zzz'] when 3 then ['tool:fly'] when 5 then ['unsafe:syntax'] else [] end problems from documents""")
def checker_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkers of a bank held against what their authors were shown and what their family has."""
    k, words = F.col("doc_id") % 6, "write these seven words into the title"
    checker = F.element_at(F.array(*[F.lit(p) for p in (
        "state['notes'][0]['title'] == 'x'", f"state['notes'][0]['title'] == '{words}'", "state['zzz'] == 1", "any(c['tool'] == 'fly' for c in state['_action_log'])",
        f"state['notes'][0]['title'] == '{words}' and any(c['arguments']['title'] == 'x' for c in state['_action_log'])", "state['notes'",
    )]), (k + 1).cast("int"))
    shown = X.all_strings(F.to_json(F.struct(F.struct(F.when(F.col("doc_id") % 2 == 0, words).alias("instruction")).alias("task"))))
    tools = [name for name, _, _ in C.TOOLS]
    return table(spark, sf_dir, "documents").select("doc_id", P.audited(["notes", "title", "content", "tags"], tools)(checker, shown).alias("problems"))


JUDGED = """{context}

{asked}

{predicted}

{truth}

Give each of the five dimensions a score from 1 to 5, as {{"scores": ...}}."""


@query("""with p as (select conv_id, coalesce(list(coalesce(text, '') order by turn) filter (where role = 'user'), []) p, coalesce(list(coalesce(text, '') order by turn) filter (where role = 'assistant'), []) r from conversations group by conv_id),
t as (select *, unnest(range(1, len(p) + 1)) turn_idx from p),
x as (select conv_id, turn_idx, array_to_string(list_transform(range(1, least(turn_idx - 1, len(r)) + 1), lambda i: p[i] || chr(10) || r[i] || chr(10) || chr(10)), '') h,
  case when conv_id % 3 = 0 then 'Turn ' || turn_idx else p[turn_idx] end asked, regexp_replace(coalesce(r[turn_idx], ''), '^\\s+|\\s+$', '', 'g') truth from t)
select conv_id, turn_idx, case when h = '' then '' else '# Context (Historical Interactions):' || chr(10) || chr(10) || h || chr(10) || chr(10) end
  || '# Current Turn:' || chr(10) || chr(10) || asked || chr(10) || chr(10) || '**World Model Output (Simulated):**' || chr(10) || '```' || chr(10) || truth || chr(10) || '```' || chr(10) || chr(10)
  || '**Ground Truth (Real Output):**' || chr(10) || '```' || chr(10) || truth || chr(10) || '```' || chr(10) || chr(10) || 'Give each of the five dimensions a score from 1 to 5, as {"scores": ...}.' prompt from x""")
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt that a judge gets for each turn of a conversation; some jobs carry their own question."""
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))), lambda x: x["text"])
    jobs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(of("user").alias("p"), of("assistant").alias("r"))
    jobs = jobs.select("conv_id", "p", "r", F.posexplode("p").alias("at", "_")).withColumn("turn_idx", F.col("at").cast("long") + 1)
    turn, given = F.col("turn_idx"), F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Turn "), F.col("turn_idx").cast("string"))).otherwise("")
    truth = J.ground_truth(F.col("r"), turn)
    prompt = J.fill(
        JUDGED, context=J.history(F.col("p"), F.col("r"), turn), asked=F.concat(F.lit(J.TURN), J.current_prompt(given, F.col("p"), turn)),
        predicted=J.fenced(J.PREDICTED, X.strip_marker(F.concat(F.lit("**Out:** "), truth), "**Out:**")), truth=J.fenced(J.TRUTH, X.strip_marker(truth, "**Out:**")),
    )
    return jobs.select("conv_id", "turn_idx", prompt.alias("prompt"))

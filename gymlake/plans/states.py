"""Environment states, evidence and checkers over states built from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gymlake.functions import predicates as P
from gymlake.functions import state as S
from gymlake.functions.text import sequence_similarity
from gymlake.operators.verdicts import with_verdicts
from gymlake.sources.tables import table

QUERIES, ORACLES = {}, {}
NOTES = S.FAMILIES["mcp_notes"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def notes_raw(i: Column, title: Column) -> Column:
    """JSON states with one kind of defect each, by number."""
    full = F.concat(F.lit('{"notes":[{"title":"'), title, F.lit('","content":"c","tags":["x"]}]}'))
    return (
        F.when(i == 0, full).when(i == 1, F.concat(F.lit('{"notes":[{"title":"'), title, F.lit('","content":"c"}]}')))
        .when(i == 2, '{"notes":{"a":1}}').when(i == 3, '{"notes":[{"id":1,"title":"t","content":"c","tags":[]}]}')
        .when(i == 4, '{"notes":[{"title":"t","content":"c","tags":"client"}]}').when(i == 5, "{}").when(i == 6, '{"notes":[],"zzz":0}').otherwise("not json")
    )


def raw_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", notes_raw(F.col("doc_id") % 8, F.col("source")).alias("raw"))


@query("""select doc_id, case doc_id % 8 when 0 then [] when 1 then ['missing:notes[0].tags'] when 2 then ['kind:notes:object'] when 3 then ['extra:notes[0].id'] when 4 then ['kind:notes[0].tags']
  when 5 then ['missing:notes'] when 6 then ['extra:zzz'] else ['kind:state'] end problems from documents""")
def state_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_states(spark, sf_dir).select("doc_id", S.violations(F.col("raw"), NOTES).alias("problems"))


@query("""select doc_id, case when doc_id % 8 in (0, 1, 3, 4) then 1 else 0 end n_notes, case when doc_id % 8 in (0, 1) then source when doc_id % 8 in (3, 4) then 't' end first_title,
  case when doc_id % 8 = 0 then 1 when doc_id % 8 in (1, 3, 4) then 0 end n_tags from documents""")
def state_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw states read with their type and filled with neutral values."""
    readable = F.when(S.kind_of(F.get_json_object("raw", "$.notes")) == "list", F.col("raw"))
    mended = F.regexp_replace(readable, '"tags":"[^"]*"', '"tags":[]')
    typed = S.conform(F.from_json(mended, NOTES), NOTES)
    rows = raw_states(spark, sf_dir).select("doc_id", typed.alias("s")).select("doc_id", F.col("s.notes").alias("n"))
    first = F.try_element_at("n", F.lit(1))
    return rows.select("doc_id", F.size("n").alias("n_notes"), first["title"].alias("first_title"), F.size(first["tags"]).alias("n_tags")).withColumn("n_tags", F.when(F.col("n_notes") > 0, F.col("n_tags")))


@query("""select doc_id, case when doc_id % 3 = 0 then ['a', 'c'] when doc_id % 3 = 1 then ['b'] else [] end touched, case when doc_id % 3 = 2 then null when doc_id % 3 = 0 then 'b' else 'a' end perturb_key from documents""")
def touched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys a step changed, and the first untouched one, which a counterfactual probe may perturb."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    k = F.col("doc_id") % 3
    prior, after = F.lit('{"a":1,"b":[2]}'), F.when(k == 0, '{"a":2,"b":[2],"c":null}').when(k == 1, '{"a":1,"b":[3]}').otherwise('{"a":1,"b":[2]}')
    read = lambda c: F.from_json(c, "map<string,variant>")
    as_text = lambda c: F.transform_values(read(c), lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))
    rows = d.select("doc_id", as_text(prior).alias("p"), as_text(after).alias("n")).withColumn("touched", S.touched(F.col("p"), F.col("n")))
    rest = F.array_sort(F.array_except(F.map_keys("p"), "touched"))
    return rows.select("doc_id", "touched", F.when((F.size("touched") > 0) & (F.size(rest) > 0), F.try_element_at(rest, F.lit(1))).alias("perturb_key"))


@query("select doc_id, case doc_id % 6 when 0 then 'true' when 1 then '3.0' when 2 then '\"x (counterfactual probe)\"' when 3 then '[1,\"__counterfactual_probe__\"]' when 4 then '{\"__counterfactual_probe__\":true}' else '\"__counterfactual_probe__\"' end probe from documents")
def counterfactual_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    raw = F.when(k == 0, "false").when(k == 1, "2").when(k == 2, '"x"').when(k == 3, "[1]").when(k == 4, "{}").otherwise("null")
    return table(spark, sf_dir, "documents").select("doc_id", S.perturbed(raw).alias("probe"))


@query("""select doc_id, case when doc_id % 4 = 3 then null when doc_id % 4 = 2 then '{"notes":[]}' else '{"a":1}' end state, case when doc_id % 4 = 3 then 'missing next_state' end error from documents""")
def unwrap_next_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    raw = F.when(k < 2, '{"next_state":{"a":1}}').when(k == 2, '{"notes":[]}').otherwise('{"other":1}')
    state, error = S.unwrap_next(raw, ["notes"])
    return table(spark, sf_dir, "documents").select("doc_id", state.alias("state"), error.alias("error"))


@query("select doc_id, case when doc_id % 3 = 0 then ['path', 'text'] else [] end argument_names from documents")
def tool_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, '{"path":"/a","text":"b"}').when(k == 1, "[1]").otherwise("{broken")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.map_keys(S.tool_arguments(raw))).alias("argument_names"))


@query("""with x as (select unnest(case doc_id % 8 when 0 then ['notes', 'notes[].content', 'notes[].tags', 'notes[].title'] when 1 then ['notes', 'notes[].content', 'notes[].title'] when 2 then ['notes']
  when 3 then ['notes', 'notes[].content', 'notes[].id', 'notes[].tags', 'notes[].title'] when 4 then ['notes', 'notes[].content', 'notes[].tags', 'notes[].title'] when 6 then ['notes', 'zzz'] else [] end) path from documents)
select path, count(*) n from x group by path""")
def key_path_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_states(spark, sf_dir).select(F.explode(S.key_paths(F.col("raw"), NOTES)).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


def _note(title: Column, tags: Column) -> Column:
    return F.struct(title.alias("title"), F.lit("c").alias("content"), tags.alias("tags"))


def typed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-step sequences of typed states: prior, then a prediction that forgot some fields."""
    i, none = F.col("doc_id") % 5, F.lit(None).cast("array<string>")
    prior = F.struct(F.array(_note(F.col("source"), F.array(F.lit("food"))), _note(F.lit("b"), F.array(F.lit("k")))).alias("notes"))
    after = F.struct(F.when(i == 4, F.lit(None)).otherwise(F.when(i == 3, F.array().cast(NOTES["notes"].dataType)).otherwise(F.array(_note(F.col("source"), none), _note(F.lit("new"), none)))).cast(NOTES["notes"].dataType).alias("notes"))
    return table(spark, sf_dir, "documents").select("doc_id", prior.alias("prior"), after.alias("predicted"))


@query("""select doc_id, case when doc_id % 5 = 4 then [source, 'b'] when doc_id % 5 = 3 then [] else [source, 'new'] end titles, case when doc_id % 5 = 4 then ['food', 'k'] when doc_id % 5 = 3 then [] else ['food'] end tags from documents""")
def complete_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known objects keep the tags they had, new ones get none, deleted ones stay deleted."""
    full = typed_states(spark, sf_dir).select("doc_id", S.complete(F.col("prior"), F.col("predicted"), NOTES)["notes"].alias("n"))
    return full.select("doc_id", F.transform("n", lambda x: x["title"]).alias("titles"), F.flatten(F.transform("n", lambda x: x["tags"])).alias("tags"))


PREDICATES = {
    "has_food": "any('food' in n['tags'] for n in state['notes'])",
    "two_notes": "len(state['notes']) == 2 and state['notes'][0]['content'] == 'c'",
    "renamed": "all(n['title'] != 'b' for n in state['notes'] if 'k' in n['tags'])",
    "undeclared": "state['missing'] == 1",
    "unsafe": "__import__('os') == state",
    "past_the_end": "state['notes'][1]['title'] != 'zzz'",
    "not_past_the_end": "not state['notes'][1]['title'] == 'zzz'",
    "distinct_titles": "len({n['title'] for n in state['notes']}) == len(state['notes'])",
    "tag_or_none": "len(state['notes']) == 0 or state.get('notes', [])[-1]['title'] == 'new'",
}


@query("""with c as (select doc_id, doc_id % 5 k from documents)
select doc_id, k <> 3 has_food, k <> 3 two_notes, k <> 4 renamed, false undeclared, false unsafe, k <> 4 tag_or_none, k <> 3 past_the_end, k <> 3 not_past_the_end,
  true distinct_titles, case when k = 3 then 'checker_raised:IndexError' end past_the_end_error from c""")
def checker_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates over completed states, with the class of what they raise."""
    full = typed_states(spark, sf_dir).select("doc_id", S.complete(F.col("prior"), F.col("predicted"), NOTES).alias("state"))
    return with_verdicts(full, PREDICATES, NOTES).select("doc_id", *PREDICATES, "past_the_end_error")


_HOLDS = {"has_food": "k <> 3", "two_notes": "k <> 3", "renamed": "k <> 4", "undeclared": "false", "unsafe": "false", "past_the_end": "k <> 3", "not_past_the_end": "k <> 3", "distinct_titles": "true", "tag_or_none": "k <> 4"}
_AUDITED = ", ".join(f"('{n}', {'null' if n not in ('undeclared', 'unsafe') else repr({'undeclared': 'checker_raised:KeyError', 'unsafe': 'checker_unsafe:call'}[n])}, {2 if n == 'two_notes' else 1}, (select count(*) from c where {p}))" for n, p in _HOLDS.items())


@query(f"with c as (select doc_id % 5 k from documents) select * from (values {_AUDITED}) t(predicate, reason, n_clauses, n_true)")
def checker_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkers with their static reason and number of clauses, and on how many states each holds."""
    rows = [(n, P.compile_predicate(p, NOTES, state=F.lit(None)).reason, len(P.conjuncts(p))) for n, p in PREDICATES.items()]
    held = checker_verdicts(spark, sf_dir).agg(*[F.count_if(n).alias(n) for n in PREDICATES])
    counts = held.select(F.explode(F.array(*[F.struct(F.lit(n).alias("predicate"), F.col(n).alias("n_true")) for n in PREDICATES])).alias("x")).select("x.*")
    return spark.createDataFrame(rows, "predicate string, reason string, n_clauses int").join(counts, "predicate")  # a row per checker


@query("""with c as (select doc_id % 5 k, lang from documents)
select lang, count(*) n, count(*) filter (where k = 3) clause_1_failed, 0::bigint clause_2_failed_alone, avg(cast(k <> 3 as int)) pass_rate from c group by lang""")
def clause_anatomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which clause of a conjunction fails, by group: each clause is a column of its own."""
    full = typed_states(spark, sf_dir).select("doc_id", S.complete(F.col("prior"), F.col("predicted"), NOTES).alias("state"))
    flags = with_verdicts(full, dict(zip("ab", P.conjuncts(PREDICATES["two_notes"]), strict=True)), NOTES).select("doc_id", "a", "b")
    lang = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return flags.join(lang, "doc_id").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(~F.col("a")).alias("clause_1_failed"), F.count_if(F.col("a") & ~F.col("b")).alias("clause_2_failed_alone"), F.avg((F.col("a") & F.col("b")).cast("int")).alias("pass_rate")
    )


@query("select doc_id, doc_id % 5 <> 3 ever, case when doc_id % 5 = 3 then false else true end at_end from documents")
def ever_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step-wise predicate over the sequence of states, and its value on the last one."""
    seq = typed_states(spark, sf_dir).select("doc_id", F.array(S.complete(F.col("prior"), F.col("predicted"), NOTES)).alias("states"))
    return with_verdicts(seq, {"ever": "any(len(s['notes']) > 1 for s in states)", "at_end": "len(states[-1]['notes']) > 1"}, NOTES, "states").select("doc_id", "ever", "at_end")


@query("""with c as (select doc_id % 5 k, doc_id from documents) select doc_id, k <> 3 base, k <> 4 final, not (k <> 3) and k <> 4 genuinely_improved, k <> 3 and not (k <> 4) regressed from c""")
def paired_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = typed_states(spark, sf_dir).select("doc_id", S.complete(F.col("prior"), F.col("predicted"), NOTES).alias("state"))
    two = {m: PREDICATES[n] for n, m in (("has_food", "base"), ("tag_or_none", "final"))}
    b, f = F.col("base"), F.col("final")
    return with_verdicts(full, two, NOTES).select("doc_id", "base", "final", (~b & f).alias("genuinely_improved"), (b & ~f).alias("regressed"))


_EV = """with e as (select event_id, event_id % 7 <> 0 valid, (event_id % 11) / 10.0::double agreement, case when event_id % 4 = 0 then null else event_id % 3 <> 0 end cf, case when event_id % 13 = 0 then true when event_id % 17 = 0 then false end adj from events),
s as (select *, case when adj is not null then cast(cast(adj as int) as double) when valid then 0.6 * agreement + 0.4 * cast(coalesce(cf, true) as int) else 0 end confidence from e)"""


@query(f"""{_EV} select event_id, confidence, valid and coalesce(cf, true) and confidence >= 0.6 accepted, adj is null and valid and confidence between 0.4 and 0.6 needs_adjudication from s""")
def evidence_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        i, (i % 7 != 0).alias("valid"), ((i % 11) / F.lit(10.0).cast("double")).alias("agreement"), F.when(i % 4 != 0, i % 3 != 0).alias("cf"), F.when(i % 13 == 0, True).when(i % 17 == 0, False).alias("adj")
    )
    s = e.withColumn("confidence", S.confidence(F.col("valid"), F.col("agreement"), F.col("cf"), F.col("adj")))
    c = F.col("confidence")
    return s.select(i, c, (F.col("valid") & F.coalesce("cf", F.lit(True)) & (c >= 0.6)).alias("accepted"), (F.col("adj").isNull() & F.col("valid") & c.between(0.4, 0.6)).alias("needs_adjudication"))


@query(f"""{_EV}, u as (select e.user_id, s.valid and coalesce(s.cf, true) and s.confidence >= 0.6 a from s join events e using (event_id)) select user_id, count(*) n_steps, bool_and(a) accepted from u group by user_id""")
def trajectory_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = evidence_confidence(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
    return steps.groupBy("user_id").agg(F.count("*").alias("n_steps"), F.every("accepted").alias("accepted"))


@query(None)
def self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of all pairs of a step's samples: none gives 0, one gives 1. Samples of a step are few."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("out"))
    a, b = c.select("conv_id", F.col("turn").alias("i"), F.col("out").alias("x")), c.select("conv_id", F.col("turn").alias("j"), F.col("out").alias("y"))
    pairs = a.join(b, "conv_id").where("i < j").select("conv_id", sequence_similarity(F.col("x"), F.col("y")).alias("s")).groupBy("conv_id").agg(F.avg("s").alias("s"))
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n"))
    return n.join(pairs, "conv_id", "left").select("conv_id", "n", F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, 1.0).otherwise(F.col("s")).alias("agreement"))


@query("select event_id, (event_id % 3 = 0) = (event_id % 2 = 0) and (event_id % 5) = (event_id % 5) invariant from events")
def key_path_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two outputs agree on every invariant path; a path missing on both sides agrees."""
    i = F.col("event_id")
    out = lambda flag: F.to_json(F.struct(F.struct(flag.alias("id"), (i % 5).alias("n")).alias("resource")))
    rows = table(spark, sf_dir, "events").select(i, out(i % 3 == 0).alias("a"), out(i % 2 == 0).alias("b"))
    paths = ("$.resource.id", "$.resource.n", "$.nowhere")
    same = [F.get_json_object("a", p).eqNullSafe(F.get_json_object("b", p)) for p in paths]
    return rows.select("event_id", (same[0] & same[1] & same[2]).alias("invariant"))
